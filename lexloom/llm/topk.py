"""Exact top-k inner products by dual-tree search over cover trees.

Vectors are quantised to integers. Candidates are indexed in blocks of `block_rows` inside the tasks that read them, one
cover tree per block; the queries are read in blocks of `query_rows` at most, each with a tree of its own, broadcast.
Pairs of nodes are visited from the roots; for nodes with centres q and c and covering radii r and s no product exceeds
q.c + |q| s + |c| r + r s, and a pair is pruned when that is below the worst kth score of every query under the node.
Leaves are multiplied as integers. A task keeps its k best per query over all its blocks; a window over these ends it.

Cover trees: a node's children lie further apart than the radius of their level and cover all its points within it; the
node's own centre is the first of them. Where a level has more than `fan` children, splitting bounds nothing any more
(vectors without structure), and the node stays a leaf; that changes the work, not the result.

Vectors that are null, or hold null or non-finite components, or a number of components other than most vectors of
the table, take no part. Equal scores go to the smaller id. A query's own row (by id) is no candidate. Repeated rows
with an id are one vector each and may both be listed. With fewer than k candidates all are listed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.util import arrow_schema

NONE = -(1 << 62)
OUT = "query_id long, vec_id long, score long"


class CoverTree:
    """Arrays of nodes: centre (a row), covering radius, children or, for leaves, rows."""

    def __init__(self, points: np.ndarray, leaf: int = 64, fan: int = 32, base: float = 1.5):
        self.points = points
        self.x = points.astype(np.float64)
        self.norm = np.sqrt((self.x ** 2).sum(1))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.rows: list[np.ndarray] = []
        self.leaf, self.fan, self.base = leaf, fan, base
        if len(points):
            mean = self.x.mean(0)
            first = int(((self.x - mean) ** 2).sum(1).argmin())
            self._grow(np.arange(len(points)), first)

    def _grow(self, rows: np.ndarray, centre: int) -> int:
        at = len(self.centre)
        far = np.sqrt(((self.x[rows] - self.x[centre]) ** 2).sum(1))
        self.centre.append(centre)
        self.radius.append(float(far.max()))
        self.children.append([])
        self.rows.append(rows)
        if len(rows) <= self.leaf or far.max() == 0:
            return at
        reach = far.max() / self.base
        nearest, owner, chosen = far.copy(), np.zeros(len(rows), np.int64), [centre]
        while nearest.max() > reach:
            if len(chosen) == self.fan:
                return at
            k = int(nearest.argmax())
            d = np.sqrt(((self.x[rows] - self.x[rows[k]]) ** 2).sum(1))
            owner[d < nearest] = len(chosen)
            nearest = np.minimum(nearest, d)
            chosen.append(int(rows[k]))
        self.children[at] = [self._grow(rows[owner == i], c) for i, c in enumerate(chosen)]
        return at


def search(queries: CoverTree, query_ids: np.ndarray, block: CoverTree, ids: np.ndarray, k: int, best: np.ndarray, who: np.ndarray) -> None:
    """Fold a block into the k best scores and ids per query, in place (rows in falling order)."""
    if not len(block.points) or not len(queries.points):
        return
    worst = {}  # of a query node: the least kth score of its queries

    def bound(q: int) -> int:
        if q not in worst:
            worst[q] = int(best[queries.rows[q], k - 1].min())
        return worst[q]

    def most(q: int, c: int) -> float:
        a, b = queries.centre[q], block.centre[c]
        r, s = queries.radius[q], block.radius[c]
        product = float(queries.x[a] @ block.x[b]) + queries.norm[a] * s + block.norm[b] * r + r * s
        return product + 1e-9 * abs(product) + 1e-6

    def multiply(q: int, c: int) -> None:
        rows, cols = queries.rows[q], block.rows[c]
        score = (queries.x[rows] @ block.x[cols].T)  # integers below 2**53: exact
        score = np.where(query_ids[rows][:, None] == ids[cols][None, :], np.float64(NONE), score).astype(np.int64)
        live = np.flatnonzero((score >= best[rows, k - 1][:, None]).any(1))
        if not len(live):
            return
        s = np.concatenate([best[rows[live]], score[live]], axis=1)
        i = np.concatenate([who[rows[live]], np.broadcast_to(ids[cols], (len(live), len(cols)))], axis=1)
        by = np.lexsort((i, -s), axis=1)[:, :k]
        best[rows[live]], who[rows[live]] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)
        worst.clear()

    todo = [(0, 0)]
    while todo:
        q, c = todo.pop()
        if most(q, c) < bound(q):
            continue
        split_q, split_c = queries.children[q], block.children[c]
        if not split_q and not split_c:
            multiply(q, c)
        elif split_q and (not split_c or queries.radius[q] >= block.radius[c]):
            todo += [(x, c) for x in split_q]
        else:  # the most promising child is visited first, so that bounds rise early
            todo += sorted(((q, x) for x in split_c), key=lambda p: most(*p))


def _quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the vectors that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    sound = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return sound.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(b: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.diff(b.column(1).offsets.to_numpy())
    keep = lengths == size
    return b.column(0).to_numpy()[keep], b.column(1).flatten().to_numpy()[np.repeat(keep, lengths)].reshape(-1, size)


def top_k(vectors: DataFrame, is_query: str, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding",
          block_rows: int = 8192, query_rows: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which the SQL condition `is_query` (on the column vec_id) holds."""
    spark = vectors.sparkSession
    own = _quantised(vectors, id_col, vec_col, scale)
    usual = own.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if usual is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size, parts = usual["size"], []
    block: list = []
    for r in own.where(is_query).where(F.size("v") == size).toLocalIterator():  # one block of queries at a time
        block.append(r)
        if len(block) == query_rows:
            parts.append(_one_block(own, block, size, k, block_rows))
            block = []
    if block or not parts:
        parts.append(_one_block(own, block, size, k, block_rows))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_block(vectors: DataFrame, block: list, size: int, k: int, block_rows: int) -> DataFrame:
    ids = np.array([r[0] for r in block], np.int64)
    tree = CoverTree(np.array([r[1] for r in block], np.int64).reshape(len(block), size))
    shared: Broadcast = vectors.sparkSession.sparkContext.broadcast((ids, tree))
    schema = arrow_schema(OUT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        best, who = np.full((len(query_ids), k), NONE), np.full((len(query_ids), k), np.iinfo(np.int64).max)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def fold() -> None:
            if held:
                own, x = (np.concatenate(c) for c in zip(*held))
                for a in range(0, len(own), block_rows):
                    search(queries, query_ids, CoverTree(x[a:a + block_rows]), own[a:a + block_rows], k, best, who)
                held.clear()

        for b in batches:
            held.append(_matrix(b, size))
            if sum(len(i) for i, _ in held) >= block_rows:
                fold()
        fold()
        r, c = np.nonzero(best != NONE)
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[r]), pa.array(who[r, c]), pa.array(best[r, c])], schema=schema)

    return vectors.mapInArrow(run, OUT)
