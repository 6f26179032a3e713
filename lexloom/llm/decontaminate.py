"""Benchmark decontamination by suffix arrays over shards of the training text.

A shard is as many documents as fill `shard_bytes` (a longer document is a shard alone); it is made from the Arrow
batches of a task, so the corpus is neither shuffled nor gathered. Each shard gets a suffix array over its words; every
benchmark suffix is searched in it by bisection, which gives its longest verbatim match and where its windows occur.

Words are compared by 64-bit hashes while sorting and searching; the bytes of every window found are compared at the
end, so a hash collision cannot make a hit. The benchmark is a stated query set: it is read in blocks of at most
`block_bytes`, one broadcast and one pass per block (in practice one).

Null and empty texts have no words and no hits. Repeated rows give a row each, also where they share an id. An item with
fewer words than the window is one window as a whole; an item without words has none. An item without an id is named by
the empty string. Empty tables give no rows, or rows without hits. Very long documents are shards of their own. Further
columns of any name cannot clash: the search reads id and text only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from lexloom.llm.util import arrow_schema
from lexloom.llm.words import hash_words

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Byte classes: 0 separates words, capitals map to small letters.
_FOLD = np.zeros(256, np.uint8)
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, word starts, word ends and a 64-bit hash per word (never 0)."""
    b = _FOLD[np.frombuffer(data, np.uint8)]
    return (b, *hash_words(b, b != 0))


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in the order of their words. A word of 0 ends a suffix; the last word is 0.

    Doubling: suffixes sorted by their first h words get sorted by 2h words through the ranks of the suffixes h words
    further on. Only suffixes that still tie are sorted again; ties that reach their end together stay as they are.
    """
    n = len(words)
    ends = np.flatnonzero(words == 0)
    to_end = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    order = np.argsort(words)
    fresh = np.concatenate([[True], words[order][1:] != words[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # of a tie: the place of its first
    place = np.flatnonzero(~(fresh & np.append(fresh[1:], True)) & (to_end[order] >= 1))
    h = 1
    while len(place):
        pos = order[place]
        key = (rank[pos] << 32) + rank[pos + h]
        by = np.argsort(key)
        pos, key = pos[by], key[by]
        order[place] = pos
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[pos] = np.maximum.accumulate(np.where(fresh, place, 0))
        h *= 2
        place = place[~(fresh & np.append(fresh[1:], True)) & (to_end[pos] >= h)]
    return order


def bisect_suffixes(words: np.ndarray, order: np.ndarray, query: np.ndarray, width: np.ndarray, right: bool) -> np.ndarray:
    """For each row of `query` (its first `width` words): the first place in `order` not below it, or with `right` the first above it."""
    lo, hi = np.zeros(len(query), np.int64), np.full(len(query), len(order), np.int64)
    padded = np.concatenate([words, np.zeros(query.shape[1], np.uint64)])
    while (left := np.flatnonzero(lo < hi)).size:
        mid = (lo[left] + hi[left]) >> 1
        at, less, live = order[mid], np.zeros(len(left), bool), np.arange(len(left))
        for j in range(query.shape[1]):
            live = live[width[left[live]] > j]
            a, b = padded[at[live] + j], query[left[live], j]
            less[live[a < b]] = True
            live = live[a == b]
            if not len(live):
                break
        if right:  # rows that agree in all their words
            equal = np.ones(len(left), bool)
            for j in range(query.shape[1]):
                equal &= (width[left] <= j) | (padded[at + j] == query[left, j])
            less |= equal
        lo[left] = np.where(less, mid + 1, lo[left])
        hi[left] = np.where(less, hi[left], mid)
    return lo


class Benchmark:
    """One block of items, ready for searching: distinct windows, their items and every suffix."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        windows: dict[tuple[bytes, ...], set[str]] = {}
        self.texts = []
        for item, text in items:
            w = WORD.findall((text or "").encode().lower())  # of bytes: folds A-Z only
            if w:
                self.texts.append((item, w))
            for i in range(max(1, len(w) - window + 1) if w else 0):
                windows.setdefault(tuple(w[i:i + window]), set()).add(item)
        self.windows = list(windows)
        self.items = [sorted(windows[w]) for w in self.windows]
        self.width = np.array([len(w) for w in self.windows], np.int64)
        self.query = np.zeros((len(self.windows), window), np.uint64)
        for i, w in enumerate(self.windows):
            self.query[i, :len(w)] = words_of(b" ".join(w))[3]
        self.window = window


class Shard:
    """Suffix array over the words of a run of documents."""

    def __init__(self, texts: list[bytes]):
        data = b"\0".join(texts)  # a byte that separates words
        self.bytes, self.start, self.end, h = words_of(data)
        edges = np.cumsum([len(t) + 1 for t in texts])
        self.doc = np.searchsorted(edges, self.start, "right")
        self.n_words = np.bincount(self.doc, minlength=len(texts))
        # An ending word of 0 after each document keeps matches inside it.
        self.slot = np.arange(len(h)) + self.doc
        self.words = np.zeros(len(h) + len(texts), np.uint64)
        self.words[self.slot] = h
        self.word_at = np.full(len(self.words), -1, np.int64)
        self.word_at[self.slot] = np.arange(len(h))
        self.order = suffix_array(self.words)

    def find(self, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers and window numbers of all occurrences, compared byte by byte."""
        lo = bisect_suffixes(self.words, self.order, bench.query, bench.width, False)
        hi = bisect_suffixes(self.words, self.order, bench.query, bench.width, True)
        which = np.repeat(np.arange(len(lo)), hi - lo)
        place = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
        at = self.word_at[self.order[place]]
        same = [self._spelled(a, bench.windows[w]) for a, w in zip(at.tolist(), which.tolist())]
        same = np.array(same, bool)
        return at[same], which[same]

    def _spelled(self, word: int, window: tuple[bytes, ...]) -> bool:
        last = word + len(window) - 1
        return WORD.findall(self.bytes[self.start[word]:self.end[last]].tobytes()) == list(window)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    block, size = [], 0
    for r in benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = 13, share: int = 20, shard_bytes: int = 4 << 20, block_bytes: int = 2 << 20) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, and its hit word ranges and longest match.

    contaminated: n_hit > 0 and share * n_hit >= n_words. `spans` are [start, end) word numbers; `longest` is the
    longest run of hit words. Items are named as strings.
    """
    sc = docs.sparkSession.sparkContext
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    block = next(blocks, [])
    while block is not None:
        after = next(blocks, None)
        out = _search(out, sc.broadcast(Benchmark(block, window)), shard_bytes, share if after is None else None)
        block = after
    return out


SPANS = "spans array<struct<a:long,b:long>>"


def _shards(column: pa.Array, shard_bytes: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts (null: empty) that fill a shard, with the row where each begins."""
    a, size, own = 0, 0, []
    for i, t in enumerate(column.cast(pa.binary()).to_pylist()):
        if own and size + len(t or b"") > shard_bytes:
            yield a, own
            a, size, own = i, 0, []
        own.append(t or b"")
        size += len(t or b"")
    if own:
        yield a, own


def _search(docs: DataFrame, bench: Broadcast, shard_bytes: int, share: int | None) -> DataFrame:
    """One pass over the documents for one block; earlier blocks' spans and items are carried along. `share`: make the result."""
    carried = "spans" in docs.columns
    ddl = f"doc_id long, text string, {SPANS}, items array<string>" if share is None else f"doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, {SPANS}"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, texts in _shards(b.column(1), shard_bytes):
                part = b.slice(a, len(texts))
                rows = list(judge(part.column(0).to_pylist(), texts, *(part.column(i).to_pylist() for i in range(2, part.num_columns))))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def judge(ids: list, texts: list, spans: list | None = None, items: list | None = None) -> Iterator[tuple]:
        q = bench.value
        shard = Shard(texts)
        at, which = shard.find(q)
        docs_hit = shard.doc[at]
        by = np.argsort(docs_hit, kind="stable")
        cuts = np.searchsorted(docs_hit[by], np.arange(len(texts) + 1))
        first = np.concatenate([[0], np.cumsum(shard.n_words)])
        for i, doc in enumerate(ids):
            own = by[cuts[i]:cuts[i + 1]]
            found = [(p - first[i], p - first[i] + q.width[w]) for p, w in zip(at[own], which[own])]
            named = {x for w in set(which[own].tolist()) for x in q.items[w]}
            if carried:
                found += [(s["a"], s["b"]) for s in spans[i]]
                named |= set(items[i])
            runs: list[list[int]] = []
            for a, b in sorted(found):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], int(b))
                else:
                    runs.append([int(a), int(b)])
            out = [{"a": a, "b": b} for a, b in runs]
            if share is None:
                yield doc, texts[i].decode(), out, sorted(named)
                continue
            n, hit = int(shard.n_words[i]), sum(b - a for a, b in runs)
            yield doc, n, hit, len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), hit > 0 and share * hit >= n, max((b - a for a, b in runs), default=0), out

    return docs.mapInArrow(run, ddl)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               window: int = 13, share: int = 20, shard_bytes: int = 4 << 20, block_bytes: int = 2 << 20) -> DataFrame:
    """The rows of documents that are not contaminated, with all their columns.

    Each row is judged by itself, whatever its id, at every size of the benchmark: hit ranges are carried along from block
    to block. Columns of the documents may have any names.
    """
    sc, at = docs.sparkSession.sparkContext, docs.columns.index(text_col)
    carried = StructType([*docs.schema, StructField("__hits" + "_" * max(map(len, docs.columns)), ArrayType(LongType()))])
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    out, own, block = docs, len(docs.columns), next(blocks, [])
    while block is not None:
        after = next(blocks, None)
        out = _sift(out, sc.broadcast(Benchmark(block, window)), at, own, shard_bytes, share, docs.schema if after is None else carried)
        block = after
    return out


def _sift(docs: DataFrame, bench: Broadcast, at: int, own: int, shard_bytes: int, share: int, result: StructType) -> DataFrame:
    """One pass for one block: the `own` first columns, with the hit ranges so far ([a, b, a, b ...]) or, at the end, without contaminated rows."""
    carried, last = len(docs.columns) > own, len(result) == own
    schema = to_arrow_schema(result)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, texts in _shards(b.column(at), shard_bytes):
                part = b.slice(a, len(texts))
                shard = Shard(texts)
                word, which = shard.find(bench.value)
                first = np.concatenate([[0], np.cumsum(shard.n_words)])
                edge = np.zeros(len(shard.start) + 1, np.int64)
                np.add.at(edge, word, 1)
                np.add.at(edge, word + bench.value.width[which], -1)
                if carried:
                    so_far = part.column(own).to_pylist()
                    ranges = np.array([x + f for r, f in zip(so_far, first.tolist()) for x in r], np.int64)
                    np.add.at(edge, ranges[0::2], 1)
                    np.add.at(edge, ranges[1::2], -1)
                covered = np.cumsum(edge)[:-1] > 0
                rows = part.columns[:own]
                if last:
                    hit = np.bincount(shard.doc, covered, len(texts))
                    yield pa.RecordBatch.from_arrays(rows, names=schema.names).filter(pa.array((hit == 0) | (share * hit < shard.n_words)))
                    continue
                # A run of hit words ends with its document.
                fresh = np.concatenate([[True], shard.doc[1:] != shard.doc[:-1]]) if len(covered) else covered
                begin = np.flatnonzero(covered & (fresh | ~np.concatenate([[False], covered[:-1]])))
                end = np.flatnonzero(covered & np.concatenate([(fresh | ~covered)[1:], [True]])) + 1 if len(covered) else begin
                found: list[list[int]] = [[] for _ in texts]
                for d, x, y in zip(shard.doc[begin].tolist(), begin.tolist(), end.tolist()):
                    found[d] += [x - int(first[d]), y - int(first[d])]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(found, schema.types[own])], names=schema.names)

    return docs.mapInArrow(run, result)
