"""Small helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c: Column | str) -> Column:
    """NULL, empty or only spaces."""
    return F.coalesce(F.trim(as_col(c)), F.lit("")) == ""


def none_if_blank(c: Column | str) -> Column:
    return F.nullif(F.trim(as_col(c)), F.lit(""))


def first_nonblank(*cols: Column | str) -> Column:
    return F.coalesce(*[none_if_blank(c) for c in cols])


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit(""))


def tags(*pairs: tuple[Column, str]) -> Column:
    """Array of the labels whose condition is true, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(label)) for cond, label in pairs]))


def lookup(c: Column, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Constant-map lookup compiled into the plan (no join, no shuffle)."""
    items = [F.lit(x) for kv in mapping.items() for x in kv]
    hit = F.element_at(F.create_map(*items), c)
    return hit if default is None else F.coalesce(hit, default)


def case_when(pairs: Iterable[tuple[Column, object]], otherwise: object = None) -> Column:
    out: Column | None = None
    for cond, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    if out is None:
        return F.lit(otherwise)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def phrase_regex(phrases: Sequence[str]) -> str:
    """Case-insensitive whole-word regex for a list of phrase patterns (any script)."""
    return rf"(?iu)(?<!{WORD})(?:" + "|".join(phrases) + rf")(?!{WORD})"


def has_phrase(c: Column | str, phrases: Sequence[str]) -> Column:
    return as_col(c).rlike(phrase_regex(phrases))


def head_of(c: Column | str, n: int | None) -> Column:
    """The first n characters; all of them without n."""
    return as_col(c) if n is None else F.substring(as_col(c), 1, n)


def shortened(c: Column, n: int | None) -> Column:
    """At most n characters, the last an ellipsis where text was left out; the whole text without n."""
    return c if n is None else F.when(F.length(c) <= n, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…")))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          rank: str | None = None) -> DataFrame:
    """Best k rows per key.

    The `row_number() <= k` filter lets Spark cut each map partition to k rows per
    key before the shuffle, so a key holding most of the rows stays cheap.
    """
    name = rank or "__rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


HELD_ROWS = 1 << 16  # rows that a task of `smallest_k` holds before it cuts them


def _cut_table(t: pa.Table, keys: Sequence[str], order: str, k: int) -> pa.Table:
    """The k rows of smallest `order` of each key; nulls come first, as in Spark."""
    code = np.zeros(t.num_rows, np.int64)
    for name in keys:  # dense after every column, so that the product never overflows
        own = t.column(name).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        code = np.unique(code * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    at = pc.sort_indices(pa.table({"key": code, "order": t.column(order)}), [("key", "ascending"), ("order", "ascending")], null_placement="at_start").to_numpy()
    sorted_code = code[at]
    first = np.flatnonzero(np.diff(sorted_code, prepend=-1))
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return t.take(pa.array(np.sort(at[place < k])))


def smallest_k(df: DataFrame, keys: Sequence[str], order: str, k: int) -> DataFrame:
    """`top_k` by one ascending column for keys that repeat very often: tasks cut their rows batch by batch, without sorting all of them."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, limit = [], 0, HELD_ROWS
        for b in batches:
            held, rows = [*held, b], rows + b.num_rows
            if rows < limit:
                continue
            t = _cut_table(pa.Table.from_batches(held), keys, order, k)
            if t.num_rows > HELD_ROWS:  # too many keys to hold: the shuffle brings them together
                yield from t.to_batches()
                held, rows, limit = [], 0, HELD_ROWS
            else:
                held, rows, limit = t.to_batches(), t.num_rows, t.num_rows + HELD_ROWS
        if held:
            yield from _cut_table(pa.Table.from_batches(held), keys, order, k).to_batches()

    return top_k(df.mapInArrow(run, df.schema), keys, [F.asc(order)], k)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given total order."""
    return top_k(df, keys, order, 1)


def share(num: Column, den: Column, digits: int = 4) -> Column:
    """num / den rounded, 0 when the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(F.round(num / den, digits))


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`, which all executors share; a folder of our own only in one process without it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """New folder under the session's shared folder."""
    return f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a Parquet table into the shared folder and read it back; survives lost executors like a checkpoint."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
