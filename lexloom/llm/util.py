"""Shared pieces: stage tables in the shared folder, Arrow batches in and out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

HELD_OUT_FOLDS = 3
HELD_OUT_FOLD = 1


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in `spark.checkpoint.dir`; a folder of our own only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a Parquet table into the shared folder and read it back; later reads survive lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}_{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stage tables that no later step reads."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stage_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_rows(df: DataFrame, make: Callable[[], Callable], schema: str, columns: Sequence[str]) -> DataFrame:
    """Per Arrow batch: `make()` once per task, then `f(*lists) -> lists`, one list per output column.

    Only `columns` reach Python, so other columns of the input cannot clash.
    """
    out = arrow_schema(schema)

    def batchwise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            cols = f(*[c.to_pylist() for c in b.columns])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, out.types)], schema=out)

    return df.select(*columns).mapInArrow(batchwise, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def held_out(id_col: str = "doc_id"):
    """True for rows whose crc32(id as text) mod 3 is 1; these never teach a model."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_FOLDS == HELD_OUT_FOLD


def first_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """Bounded training sample: the n rows with the smallest hash of `key` (the same rows at every run)."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key)).limit(n)
