"""Best-fit packing of token pieces by bin completion.

A packing needs only how many pieces there are of each length, and lengths are at most `capacity`. So the search runs
on a histogram of at most `capacity` rows, whatever the size of the corpus, and gives patterns (a filling and how often
it is used). The pieces are dealt to the patterns by their rank within their length; ranks come from counts per task,
so no length is ever gathered in one place.

Null and empty texts give one piece (the end id). Repeated rows are packed as often as they occur. An empty table gives
no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.util import arrow_schema, stage

CACHED_WORDS = 500_000
RANK_BITS = 48


# Texts of these characters are split here as the tokenizer would split them after lower-casing; others are left to it.
PLAIN = re.compile(rb"(?:[\t-\r -~]+|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*+")
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff\t-\r ]+")
SPECIAL = b"<|"


class WordTokenizer:
    """Token ids of whole texts, as little-endian bytes.

    The tokenizer splits a text into words before anything else, so its ids are those of its words, one after the
    other. Words repeat; their ids are kept in two generations, the older of which is dropped when the younger is full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok, self.ids, self.older = Tokenizer.from_file(path), {}, {}

    def __call__(self, text: bytes) -> bytes:
        if SPECIAL in text or not PLAIN.fullmatch(text):
            return b"".join([self._plain(c) if PLAIN.fullmatch(c) and SPECIAL not in c else self._other(c) for c in text.split()])
        return self._plain(text)

    def _other(self, chunk: bytes) -> bytes:
        return np.array(self.tok.encode(chunk.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, text: bytes) -> bytes:
        words, ids = WORDS.findall(text.decode().lower()), self.ids
        try:
            return b"".join([ids[w] for w in words])
        except KeyError:
            pass
        if len(ids) > CACHED_WORDS:
            self.ids, self.older = {}, ids
            ids = self.ids
        new = []
        for w in {w for w in words if w not in ids}:
            if w in self.older:
                ids[w] = self.older[w]
            else:
                new.append(w)
        if new:
            e = self.tok.encode(" ".join(new), add_special_tokens=False)
            data, at = np.array(e.ids, "<u4").tobytes(), np.array(e.word_ids, np.int64)
            assert at[-1] == len(new) - 1, "the tokenizer splits words in another way"
            cuts = (4 * np.searchsorted(at, np.arange(len(new) + 1))).tolist()
            ids.update((w, data[i:j]) for w, i, j in zip(new, cuts, cuts[1:]))
        return b"".join([ids[w] for w in words])


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096,
                 eos_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids; `part` and `k` say which task made a piece and how many of its length came before."""
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, k long" + (", ids array<int>" if keep_ids else "")
    schema, step = arrow_schema(ddl), 4 * capacity
    end = np.array([eos_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, seen, part = WordTokenizer(tokenizer), Counter(), TaskContext.get().partitionId()
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                ids = tok(text or b"") + end
                for i in range(0, len(ids), step):
                    own = ids[i:i + step]
                    n = len(own) // 4
                    row = (doc, i // step, i // 4, n, zlib.crc32(own), part, seen[n])
                    rows.append((*row, np.frombuffer(own, "<i4")) if keep_ids else row)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, ddl)


Run = tuple[int, int]  # a length and how often it is taken


def _best_fit(counts: dict[int, int], lengths: list[int], top: int, space: int) -> tuple[list[Run], int]:
    """The longest of lengths[:top] that fits, as often as it fits, again and again; and the space that is left."""
    out = []
    while (top := bisect_right(lengths, space, 0, top)) > 0:
        size = lengths[top - 1]
        k = min(counts[size], space // size)
        if k:
            out.append((size, k))
            space -= k * size
        top -= 1
    return out, space


def complete(counts: dict[int, int], lengths: list[int], room: int, nodes: int) -> list[int]:
    """The undominated filling of `room` that leaves the least waste, by depth-first branch and bound.

    Branches say how often a length is taken, lengths in falling order, the highest number first. Every node is completed
    by best fit, so each is a whole filling of any number of pieces, and `nodes` bounds the branching only: the first node
    is best fit. A branch ends when the whole rest of shorter pieces cannot beat the incumbent, or when it leaves out a
    piece that fits and weighs no less than all shorter pieces together (that piece dominates whatever they make).
    """
    best, least = _best_fit(counts, lengths, len(lengths), room)
    below = [0]  # what the pieces of lengths[:i] weigh together
    if least and nodes > 1:
        below += accumulate(n * counts[n] for n in lengths)
    todo: list[tuple[int, int, list[Run], int | None]] = [(len(lengths), room, [], None)]
    left = nodes - 1
    while todo and least and left > 0:
        top, space, taken, k = todo.pop()
        if k is None:  # a state that has been completed; branch at the longest length that fits
            top = bisect_right(lengths, space, 0, top)
            if not top or space - below[top] >= least:
                continue
            k = min(counts[lengths[top - 1]], space // lengths[top - 1])
        size, most = lengths[top - 1], min(counts[lengths[top - 1]], space // lengths[top - 1])
        rest = space - k * size
        if rest - below[top - 1] >= least or (k < most and below[top - 1] <= size):
            continue  # nor can a lower number do better: more space, the same rest
        if k:
            todo.append((top, space, taken, k - 1))
        own = [*taken, (size, k)] if k else taken
        left -= 1
        more, waste = _best_fit(counts, lengths, top - 1, rest)
        if waste < least:
            best, least = [*own, *more], waste
        todo.append((top - 1, rest, own, None))
    return [n for n, k in best for _ in range(k)]


def plan_bins(histogram: dict[int, int], capacity: int, nodes: int = 400, mixes: int = 16) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and their multiplicities that use up the histogram. `nodes` bounds the search for one pattern.

    The best of: best fit; bin completion, with `nodes` or less, over all pieces or with the small ones kept to fill what
    the others leave; and the first patterns of each of these followed by best fit, from `mixes` places on. A plan of ceil(pieces / capacity) bins cannot be beaten and ends this.
    """
    bins = lambda plan: sum(times for _, times in plan)
    bound = -(-sum(n * c for n, c in histogram.items()) // capacity)
    best = _plan(histogram, capacity, 1)
    for budget, small in ((nodes, 0), (nodes, capacity // 16), (nodes // 16, 0), (nodes // 64, capacity // 16)):
        if bins(best) == bound:
            break
        own = _plan(histogram, capacity, budget, small)
        best = min(own, best, key=bins)
        for cut in sorted({len(own) * i // mixes for i in range(1, mixes)}):
            if bins(best) == bound:
                break
            rest = Counter(histogram)
            for filling, times in own[:cut]:
                for n in filling:
                    rest[n] -= times
            best = min(best, own[:cut] + _plan(rest, capacity, 1), key=bins)
    return best


def _plan(histogram: dict[int, int], capacity: int, nodes: int, small: int = 0) -> list[tuple[tuple[int, ...], int]]:
    counts = {n: c for n, c in histogram.items() if c > 0}
    lengths, plan = sorted(counts), []
    while lengths:
        big = lengths[-1]
        counts[big] -= 1
        low = bisect_right(lengths, small)
        filling = (big, *complete(counts, lengths[low:] if low else lengths, capacity - big, nodes))
        if low:
            filling += tuple(n for n, k in _best_fit(counts, lengths, low, capacity - sum(filling))[0] for _ in range(k))
        counts[big] += 1
        need = Counter(filling)
        times = min(counts[n] // k for n, k in need.items())
        plan.append((filling, times))
        for n, k in need.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
                lengths.pop(bisect_right(lengths, n) - 1)
    return plan


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096,
         eos_id: int = 1, keep_ids: bool = False, nodes: int = 400) -> DataFrame:
    """Every piece with its sequence and its place there."""
    pieces = stage(token_pieces(docs, tokenizer, id_col, text_col, capacity, eos_id, keep_ids), "pieces")
    spark = docs.sparkSession
    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    used, seq, slots = Counter(), 0, []
    for filling, times in plan_bins(histogram, capacity, nodes):
        at = 0
        for n in filling:
            slots.append(((n << RANK_BITS) + used[n], seq, at))
            used[n] += times
            at += n
        seq += times
    slots.sort()
    table = spark.sparkContext.broadcast(tuple(np.array([s[i] for s in slots], np.int64) for i in range(3)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    keep = [c for c in pieces.columns if c not in ("part", "k")]
    ranked = pieces.join(ranks, ["part", "length"]).select(*keep, (F.col("before") + F.col("k")).alias("rank"))
    fields = {f.name: f.dataType.simpleString() for f in pieces.schema}
    ddl = ", ".join(f"{c} {fields[c]}" for c in keep) + ", sequence_id long, offset long"

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, first, offset = table.value
        for b in batches:
            key = (b.column(b.schema.get_field_index("length")).to_numpy() << RANK_BITS) + b.column(len(keep)).to_numpy()
            i = np.searchsorted(starts, key, "right") - 1
            more = [pa.array(first[i] + key - starts[i]), pa.array(offset[i])]
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], *more], names=[*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(place, ddl)
