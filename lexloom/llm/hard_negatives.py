"""Hard-negative mining with exact integer scores out of float32 products in a residue number system.

Scores are inner products of integer vectors. A matrix product in float32 is fast but exact up to 2**24 only, so each
product is made modulo several small primes: components become centred residues, at most (p - 1) / 2 in size, of which
`depth` can be multiplied and added without leaving 2**24; longer vectors are multiplied in runs of `depth` components.
The residues of a score then give its signed value by Chinese remaindering in mixed radix with centred digits. As many
primes are used as the largest possible score of the table asks for, so the result is exact, whatever the vectors.

The score matrix of anchors by rows is cut into cells: a block of anchors by a group of rows. Both sides travel in packs;
anchors are sent once per group, rows once per block, and a cell is multiplied pack by pack in tiles. No cell holds more
than a block of anchors and one pack of rows, and no group grows with a label or an id. Two passes are made:

1. per anchor the best rows of its own label (positives), best of each cell first, then of all cells;
2. per anchor and positive the best rows of other labels whose score lies in the window that the positive's score spans.

Rows with a null id, label or vector, or a null or non-finite component, take no part. Shorter vectors count as filled up
with zeros. Equal scores go to the smaller id. Rows that share an id are rows of their own: each may be listed, an anchor
that repeats gives its results once per row, and none of them is a positive of the other. Scores beyond the range of a
long are not defined. An empty table, or one without anchors, gives no rows. Further columns of any name cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.util import arrow_schema, discard, stage

NONE = np.iinfo(np.int64).min
EXACT = 1 << 24  # float32 holds every integer up to here
DEPTH = 64
TILE = 512
PACK_ROWS = 4096
PACK = "seq binary, id binary, label binary, v binary, span binary"
CELL = f"block long, grp long, side int, {PACK}"


def primes_for(bound: int, depth: int = DEPTH) -> list[int]:
    """Largest primes whose centred residues keep `depth` products exact, until they tell 2 * bound + 1 scores apart."""
    p, out, product = 2 * isqrt(EXACT // depth) + 1, [], 1
    while product <= 2 * bound:
        if p < 3:
            raise ValueError("vectors too large for residues of this depth")
        if all(p % q for q in range(3, isqrt(p) + 1, 2)):
            out.append(p)
            product *= p
        p -= 2
    return out or [p]


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p - 1) / 2 to (p - 1) / 2."""
    return (x + p // 2) % p - p // 2


def residues(v: np.ndarray, primes: Sequence[int]) -> list[np.ndarray]:
    return [centred(v, p).astype(np.float32) for p in primes]


def scores(a: list[np.ndarray], b: list[np.ndarray], primes: Sequence[int], depth: int = DEPTH) -> np.ndarray:
    """Exact signed products of all rows of a with all rows of b, from their residues."""
    total, radix = None, 1
    for p, x, y in zip(primes, a, b):
        r = np.zeros((len(x), len(y)), np.int64)
        for k in range(0, x.shape[1], depth):
            r += (x[:, k:k + depth] @ y[:, k:k + depth].T).astype(np.int64)
        if total is None:
            total = centred(r, p)
        else:  # the next digit of the mixed radix makes the number right modulo p
            total = total + centred((r - total) % p * pow(radix, -1, p), p) * np.int64(radix)
        radix *= p
    return total


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores and ids per row, best first; `ids` rises, so ties go to the smaller one. Overwrites `score`."""
    rows = np.arange(len(score))
    s, i = np.full((len(score), k), NONE), np.zeros((len(score), k), np.int64)
    for j in range(min(k, score.shape[1])):
        at = score.argmax(1)
        s[:, j], i[:, j] = score[rows, at], ids[at]
        if (s[:, j] == NONE).all():
            break
        score[rows, at] = NONE
    return s, i


def merged(s: np.ndarray, i: np.ndarray, more_s: np.ndarray, more_i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s2, i2 = np.concatenate([s, more_s], -1), np.concatenate([i, more_i], -1)
    by = np.lexsort((i2, -np.maximum(s2, NONE + 1)), axis=-1)[..., :s.shape[-1]]
    return np.take_along_axis(s2, by, -1), np.take_along_axis(i2, by, -1)


class Anchors:
    """A block of anchors in a cell, with what has been found for each so far (`slots` lists of k)."""

    def __init__(self, seq, ids, labels, v, span, primes: Sequence[int], slots: int, k: int):
        self.seq, self.ids, self.labels, self.span, self.primes = seq, ids, labels, span.reshape(len(ids), -1, 2), primes
        self.parts = residues(v, primes)
        self.s, self.i = np.full((len(ids), slots, k), NONE), np.zeros((len(ids), slots, k), np.int64)

    def meet(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        by = np.argsort(ids, kind="stable")
        ids, labels, parts = ids[by], labels[by], residues(v[by], self.primes)
        for a in range(0, len(self.ids), TILE):
            t = slice(a, a + TILE)
            score = scores([x[t] for x in self.parts], parts, self.primes)
            same = self.labels[t][:, None] == labels[None, :]
            for slot in range(self.s.shape[1]):
                if self.span.size:  # negatives: another label, in the window of this positive
                    lo, hi = self.span[t, slot, 0][:, None], self.span[t, slot, 1][:, None]
                    able = ~same & (score >= lo) & (score <= hi)
                else:  # positives: the same label, another id
                    able = same & (self.ids[t][:, None] != ids[None, :])
                able &= score >= self.s[t, slot, -1][:, None]
                live = np.flatnonzero(able.any(1))
                if len(live):
                    new = best_of(np.where(able[live], score[live], NONE), ids, self.s.shape[2])
                    at = live + a
                    self.s[at, slot], self.i[at, slot] = merged(self.s[at, slot], self.i[at, slot], *new)

    def rows(self) -> pa.RecordBatch:
        row, slot, _ = np.nonzero(self.s != NONE)
        found = self.s != NONE
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.seq[row], self.ids[row], slot.astype(np.int32), self.i[found], self.s[found])], names=[c.split()[0] for c in FOUND.split(", ")])


FOUND = "seq long, anchor_id long, slot int, vec_id long, score long"


def _packed(df: DataFrame, dtype: str, keyed: bool) -> DataFrame:
    """Rows (block, seq, id, label, v, span) in packs of at most PACK_ROWS; rows of a block are adjacent where `keyed`."""
    ddl = f"block long, {PACK}"
    schema = arrow_schema(ddl)

    def pack(block: int, t: pa.Table) -> pa.RecordBatch:
        lengths = np.diff(np.concatenate([c.offsets.to_numpy() for c in [t.column("v").combine_chunks()]]))
        wide = np.zeros((t.num_rows, int(lengths.max(initial=0))), dtype)
        wide[np.arange(wide.shape[1])[None, :] < lengths[:, None]] = t.column("v").combine_chunks().flatten().to_numpy()
        flat = lambda c: t.column(c).to_numpy().astype(np.int64).tobytes()
        span = np.array(t.column("span").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.int64).tobytes()
        row = (block, flat("seq"), flat("id"), flat("label"), wide.tobytes(), span)
        return pa.RecordBatch.from_arrays([pa.array([x], ty) for x, ty in zip(row, schema.types)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                for a in range(0, t.num_rows, PACK_ROWS):
                    yield pack(now, t.slice(a, PACK_ROWS))
                held.clear()

        for b in batches:
            key = b.column("block").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:len(key)]).tolist() if keyed else [0]
            for a, z in zip(cuts, [*cuts[1:], b.num_rows]):
                if z > a:
                    if keyed and key[a] != now or sum(x.num_rows for x in held) >= PACK_ROWS:
                        yield from flush()
                    now = int(key[a])
                    held.append(b.slice(a, z - a))
        yield from flush()

    return df.select("block", "seq", "id", "label", "v", "span").mapInArrow(run, ddl)


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _cells(anchors: DataFrame, rows: DataFrame, blocks: int, groups: int, primes: Sequence[int], dtype: str, slots: int, k: int) -> DataFrame:
    """Best rows of every anchor in every cell."""
    def matrix(n: int, v: bytes) -> np.ndarray:
        return np.frombuffer(v, dtype).astype(np.int64).reshape(n, -1)

    def aligned(a: np.ndarray, width: int) -> np.ndarray:
        return np.pad(a, ((0, 0), (0, width - a.shape[1])))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packs, block = None, [], None
        width = 0
        for b in batches:
            for cell, side, seq, ids, labels, v, span in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), *(b.column(c).to_pylist() for c in range(2, 8))):
                if cell != now:
                    if block is not None:
                        yield block.rows()
                    now, packs, block = cell, [], None
                i, label = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
                m = matrix(len(i), v)
                if side == 0:
                    packs.append((np.frombuffer(seq, np.int64), i, label, m, np.frombuffer(span, np.int64)))
                    continue
                if not packs:
                    continue
                if block is None:
                    width = max(p[3].shape[1] for p in packs)
                    joined = [np.concatenate(c) for c in zip(*[(s, x, y, aligned(z, width), w) for s, x, y, z, w in packs])]
                    block = Anchors(*joined, primes, slots, k)
                m = m[:, :width]  # what one side lacks counts as zero
                block.meet(i, label, aligned(m, width))
        if block is not None:
            yield block.rows()

    left = anchors.select("block", F.explode(_numbers(groups)).alias("grp"), F.lit(0).alias("side"), "seq", "id", "label", "v", "span")
    right = rows.select(F.explode(_numbers(blocks)).alias("block"), F.pmod(F.xxhash64("id", "v"), F.lit(groups)).alias("grp"), F.lit(1).alias("side"), "seq", "id", "label", "v", "span")
    cells = left.union(right).repartition(blocks * groups, "block", "grp").sortWithinPartitions("block", "grp", "side")
    return cells.mapInArrow(run, FOUND)


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_negatives(vectors: DataFrame, anchors: str, positives: int = 5, negatives: int = 3, window: tuple[int, int, int] = (50, 95, 100), scale: int = 256,
                   id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block_rows: int = 4096, group_rows: int = 65536) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; `anchors` is SQL over `id` and `label`.

    `window` (lo, hi, unit) keeps negatives with lo * positive <= unit * negative <= hi * positive.
    """
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    sound = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("x"))
    sound = sound.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    sound = sound.select(F.expr(anchors).alias("asks"), F.monotonically_increasing_id().alias("seq"), "id", "label", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))
    table = stage(sound, "vectors")
    top = F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))
    n, asked, most, size = table.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(top), F.max(F.size("v"))).first()
    spark = vectors.sparkSession
    blocks = max(1, -(-asked // block_rows))
    groups = max(-(-n // group_rows), -(-spark.sparkContext.defaultParallelism // blocks))
    primes = primes_for((most or 0) ** 2 * max(size or 0, 1))
    dtype = next(t for t in ("<i2", "<i4", "<i8") if t == "<i8" or (most or 0) < np.iinfo(t).max)

    asks = stage(table.where("asks").withColumn("block", F.pmod(F.xxhash64("seq"), F.lit(blocks))), "asks")
    blocked: Callable[[DataFrame], DataFrame] = lambda df: _packed(df.repartition(blocks, "block").sortWithinPartitions("block"), dtype, True)
    rows = stage(_packed(table.withColumn("block", F.lit(0).cast("long")).withColumn("span", F.array().cast("array<long>")), dtype, False), "packs")
    discard(table)

    found = _cells(blocked(asks.withColumn("span", F.array().cast("array<long>"))), rows, blocks, groups, primes, dtype, 1, positives)
    near = stage(_first(found, ["seq"], positives).select("seq", "anchor_id", F.col("rank").alias("no"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    lo, hi, unit = window
    # Spans in the order of the positives; a place without a positive gets one that nothing lies in.
    at = lambda i: F.max(F.when(F.col("no") == i + 1, F.col("positive_score")))
    per = near.groupBy("seq").agg(*[at(i).alias(f"p{i}") for i in range(positives)])
    ends = [e for i in range(positives) for e in (F.coalesce(F.ceil(F.col(f"p{i}") * F.lit(lo).cast("decimal(20,0)") / unit).cast("long"), F.lit(1)), F.coalesce(F.floor(F.col(f"p{i}") * F.lit(hi).cast("decimal(20,0)") / unit).cast("long"), F.lit(0)))]
    spans = per.select("seq", F.array(*ends).alias("span"))
    found = _cells(blocked(asks.join(spans, "seq")), rows, blocks, groups, primes, dtype, positives, negatives)
    best = _first(found, ["seq", "slot"], negatives).withColumn("no", F.col("slot") + 1)
    return best.join(near.drop("anchor_id"), ["seq", "no"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
