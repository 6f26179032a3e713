"""Merkle manifest of a dataset: one tree per source, one tree over the sources, a proof per row.

Every node carries the interval [lo, hi) of leaf ranks that it covers, so the tree needs no pointers:

- leaves get their rank in their source from a range partitioning by (source, id): position in the partition plus the
  rows of the source in the partitions before it. No source passes through one task, however many rows it has;
- a level is made of the one below by grouping on (source, lo div fan**level), at most `fan` nodes a group, with partial
  nodes at the end of a source. A source is done when one node covers [0, n);
- ancestors are attached from the top down: at each level a node meets, by an equi-join on the bucket lo div fan**level,
  the one node above whose interval contains its own. Its siblings are that parent's interval less its own: what
  lies left of lo and what lies right of hi.

The roots of the sources are the leaves of a tree that is built and labelled in the same way.

A leaf is the hash of its fields, each `-` if null, else its UTF-8 length, a colon and the value. Nulls, empty and long
texts are ordinary values. A null source is a source of its own and comes first; a null id comes first in its source and
is never tampered with. Rows of a source that share an id are ordered by their leaf hash, so repeated rows, which have
equal leaves, may stand in any order: their proofs differ by place, and no row is dropped. An empty table has no nodes and
no result rows. Only the named columns are read, so further columns of any name cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.util import discard, stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
POSITION_BITS = 33  # of monotonically_increasing_id: the place of a row in its partition


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows of `grp` numbered from 0 (`lo`) in the given order, with the rows of their group (`n`); no group in one task."""
    placed = stage(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).alias("pos")), "placed")
    runs = placed.groupBy("grp", "part").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("k"))
    own = Window.partitionBy("grp")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stage(runs.select(F.col("grp").alias("run_grp"), F.col("part").alias("run_part"), (F.coalesce(F.sum("k").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("k").over(own).alias("n")), "runs")
    met = placed.join(runs, F.col("grp").eqNullSafe(F.col("run_grp")) & (F.col("part") == F.col("run_part")))
    out = stage(met.select(*rows.columns, (F.col("pos") + F.col("shift")).alias("lo"), "n"), "ranked")
    discard(placed, runs)
    return out


def levels(leaves: DataFrame, fan: int) -> list[DataFrame]:
    """Node tables (grp, n, lo, hi, hash, kids) of the levels above `leaves` (grp, n, lo, hash), the lowest first."""
    most, out = leaves.agg(F.max("n")).first()[0] or 0, []
    below = leaves.select("grp", "n", "lo", (F.col("lo") + 1).alias("hi"), "hash")
    while fan ** len(out) < most:
        width = fan ** (len(out) + 1)
        kids = F.sort_array(F.collect_list(F.struct("lo", "hash")))
        nodes = below.where("hi - lo < n").groupBy("grp", "n", F.expr(f"lo div {width}L").alias("bucket")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), kids.alias("kids"))
        out.append(stage(nodes.select("grp", "n", "lo", "hi", digest(F.array_join("kids.hash", "")).alias("hash"), "kids"), "level"))
        below = out[-1]
    return out


def roots(leaves: DataFrame, above: Sequence[DataFrame]) -> DataFrame:
    """(grp, hash) of the nodes that cover their whole group."""
    out = leaves.where("n = 1").select("grp", "hash")
    for nodes in above:
        out = out.union(nodes.where("hi - lo = n").select("grp", "hash"))
    return out


def with_paths(leaves: DataFrame, above: Sequence[DataFrame], fan: int, tops: DataFrame) -> DataFrame:
    """Leaves with `path`: per level their siblings to the left and to the right; `tops` (grp, root, path) goes on from the group's root."""
    tops = tops.select(F.col("grp").alias("top_grp"), "root", "path")

    def entering(nodes: DataFrame, whole: str) -> DataFrame:
        return nodes.where(whole).join(tops, F.col("grp").eqNullSafe(F.col("top_grp"))).drop("top_grp")

    reached = None
    for height in range(len(above), -1, -1):
        at = above[height - 1] if height else leaves.withColumn("hi", F.col("lo") + 1)
        found = entering(at, "hi - lo = n")
        if reached is not None:
            bucket = f"lo div {fan ** (height + 1)}L"
            parent = reached.select(F.col("grp").alias("p_grp"), F.expr(bucket).alias("p_bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), F.col("kids").alias("p_kids"), "root", F.col("path").alias("p_path"))
            inside = F.col("grp").eqNullSafe(F.col("p_grp")) & (F.expr(bucket) == F.col("p_bucket")) & (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
            left = F.array_join(F.transform(F.filter("p_kids", lambda k: k["lo"] < F.col("lo")), lambda k: k["hash"]), "")
            right = F.array_join(F.transform(F.filter("p_kids", lambda k: k["lo"] >= F.col("hi")), lambda k: k["hash"]), "")
            path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "p_path")
            met = at.where("hi - lo < n").join(parent, inside).select(*at.columns, "root", path.alias("path"))
            found = met.unionByName(found)
        reached = found
    return reached.drop("hi")


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along its siblings."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def manifest(docs: DataFrame, shown: DataFrame | Column | None = None, fan: int = 3, id_col: str = "doc_id", source_col: str = "source", fields: Sequence[str] = FIELDS) -> DataFrame:
    """Per row: id, source, leaf, subroot, root, path, and the leaf of the row as it is shown to the verifier.

    `shown` is the hash of that row as a column over `docs`; the row itself without it.
    """
    leaf = digest(*[encoded(F.col(f)) for f in fields])
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("grp"), leaf.alias("hash"), (leaf if shown is None else shown).alias("shown"))
    rows = stage(rows, "leaves")
    leaves = ranked(rows, ["id", "hash"])
    discard(rows)
    above = levels(leaves, fan)

    subroots = roots(leaves, above).select(F.lit(0).alias("grp"), F.col("grp").alias("source"), "hash")
    sources = ranked(subroots, ["source"])
    over = levels(sources, fan)
    root = roots(sources, over).select("grp", F.col("hash").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    tops = with_paths(sources, over, fan, root)
    tops = stage(tops.select(F.col("source").alias("grp"), F.struct(F.col("hash").alias("subroot"), "root").alias("root"), "path"), "tops")
    discard(sources, *over)
    return with_paths(leaves, above, fan, tops).select("id", F.col("grp").alias("source"), F.col("hash").alias("leaf"), "root.subroot", "root.root", "path", "shown")


def without_newlines(id_col: str = "doc_id", text_col: str = "text", fields: Sequence[str] = FIELDS) -> Column:
    """Leaf of the row as shown: where 2 divides crc32 of the decimal id, the text has lost its newlines."""
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0, F.lit(False))
    text = F.when(hit, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))
    return digest(*[encoded(text if f == text_col else F.col(f)) for f in fields])


def verified(entries: DataFrame) -> DataFrame:
    """The manifest with digests of the proofs, the root that each shown row leads to, and whether it is the root."""
    out = entries.withColumn("proof_sha256", proof_digest(F.col("path"))).withColumn("folded_root", folded(F.col("shown"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
