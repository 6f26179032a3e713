"""Exact n-gram Jaccard join and its components, as a blocked sparse product of the document by n-gram incidence matrix.

The product of the matrix with its transpose holds the overlap of every two documents, but only entries that reach the
threshold matter, and these lie in few blocks. Rows are blocked so that no such entry is missed:

- by size: texts that link differ in size by the threshold at most, so a row belongs to its own size band and the one
  below;
- by slices of the columns: two rows of a band that link differ in at most D places, D following from their sizes. The
  columns of a band are cut into more than D slices, so the rows agree on a whole slice. Rows with the same content of
  a slice form a block. (A row with more than D non-empty slices needs no blocks for its empty ones.)

Within blocks, pairs whose sizes or parity sketches (a lower bound of the difference) rule them out are discarded;
for the rest the overlap is accumulated over ranges of columns, and a pair is dropped as soon as what is left cannot
lift it to the bound of its sizes.

Only components are asked for, so a block need not give all of its pairs. First every row is multiplied with a head of
its block (linear in the block). Blocks that then still hold several components are open. In an open block rows are
compared by their sketches where they stand, in chunks of at most `chunk` rows a side, and only pairs that the sketches
allow leave the task: all of them where they are few, else two partners a row, so that what hangs together becomes one
component at a cost linear in the block; such blocks come up again, until all pairs of different components are out.
Near copies share most of their blocks, so at first a row meets only the largest of its open ones, and later a pair that
has some of its rows' OWNERS largest blocks in common belongs to the largest of these and leaves no other. From blocks of
more than `chunk` rows those go beforehand that have no pair there: that share such a larger block with all of its rows. Equal sets meet by
their digest, and only one of each enters the product; a batch sends one row per block, however many of its rows are in
it. So no group is gathered in one place.

N-grams are compared by 64-bit hashes. Null and empty texts have no n-grams and link with nothing. Rows that share an
id are one document. Rows without an id come back as they are, linked with nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.util import arrow_schema, discard, stage
from lexloom.llm.words import hash_words, mix

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32
_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_STEP = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
SKETCH_BITS = 256
SENT_BITS = 1024
ROUNDS = 4  # in the first a row meets its largest open block only, in the last one all pairs leave an open block
FEW = 4  # pairs a row that leave it in the others
OWNERS = 4  # largest blocks of a row that are known where it meets others
MARKS = 64  # largest blocks of a row by which its pairs in blocks of more than a chunk are known beforehand
FEW_MARKS = 16  # of these count in blocks of more than MANY_ROWS rows
MANY_ROWS = 1 << 14
SLICE_BYTES = 4 << 20
BUCKET_ROWS = 500_000
SENT_KEYS = 1 << 19
RANGES = 4
SALTS = 16
STAR_ROWS = 1 << 18  # edges that a task holds to replace them by stars


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; of the whole text where it has fewer words."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    start, _, h = hash_words(_FOLD[data], _WORD[data])
    cuts = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts])).tolist()
    rolled = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        rolled += h[j:j + len(rolled)] * _STEP[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(cuts, cuts[1:]):
        if b - a >= n:
            out.append(np.unique(rolled[a:b - n + 1]))
        else:
            out.append(mix((h[a:b] * _STEP[:b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


class Threshold:
    """Link where den * intersection >= num * union."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.starts = [1]

    def difference(self, a, b):
        """Largest symmetric difference of linked sets of these sizes (negative: they cannot link)."""
        least = -(-self.num * (a + b) // (self.num + self.den))
        return np.where(self.den * np.minimum(a, b) >= self.num * np.maximum(a, b), a + b - 2 * least, -1)

    def band(self, size: int) -> int:
        while self.starts[-1] <= size:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.starts, size, "right")) - 1

    @lru_cache(maxsize=4096)
    def slices(self, band: int) -> tuple[int, int]:
        """D of the band, and its number of slices."""
        top = self.starts[band + 1] - 1
        d = (top + top * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        return d, d + 1 + (d + 7) // 8 + 2 * (d > 0)


def block_keys(own: np.ndarray, limit: Threshold) -> np.ndarray:
    """Keys of the blocks of a row: per band and slice, a hash of the slice's content."""
    out, mixed = [], mix(own)
    top = limit.band(len(own))
    for band in {top, max(0, top - 1)}:
        d, m = limit.slices(band)
        part = ((own >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # rises with the hash, so slices are runs
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        full = part[first]
        content = np.add.reduceat(mixed, first)
        if len(full) <= d:  # too few slices have content: the empty ones count as well
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), full)
            full, content = np.concatenate([full, empty]), np.concatenate([content, np.zeros(len(empty), np.uint64)])
        out.append(mix(content + mix(full + (np.uint64(band + 1) << np.uint64(32)))))
    return np.concatenate(out)


def sketch(own: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parities of how many hashes fall on each bit; two sketches differ in at most as many bits as the sets in elements."""
    return np.packbits((np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_sketch(own: np.ndarray) -> bytes:
    """A sketch of two bits or more per element, so that it tells sets apart that a short one can't."""
    return sketch(own, max(SKETCH_BITS, 1 << (2 * len(own)).bit_length()))


def folded(x: bytes, size: int) -> np.ndarray:
    """A sketch of at most so many bytes: the parities of its halves add up."""
    a = np.frombuffer(x, np.uint8)
    return a if len(a) <= size else np.bitwise_xor.reduce(a.reshape(-1, size), axis=0)


def difference_bound(x: bytes, y: bytes) -> int:
    """Least symmetric difference that two wide sketches allow; the longer is folded."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def _in_slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= SLICE_BYTES or i == len(texts) - 1:
            yield ids[a:i + 1], [t or b"" for t in texts[a:i + 1]]
            a, size = i + 1, 0


def profiles_of(docs: DataFrame, n: int, keys: Callable[[np.ndarray], np.ndarray], signature: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Per document: size and digest of its set, number of its blocks, wide sketch, the sketch folded to what is sent to blocks, a signature."""
    ddl = "id long, n long, digest binary, blocks long, sketch binary, small binary" + (", sig binary" if signature else "")
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _in_slices(b):
                sets = shingle_sets(texts, n)
                sketches = [wide_sketch(s) for s in sets]
                cols = [ids, [len(s) for s in sets], [_digest(s) for s in sets], [len(keys(s)) if len(s) else 0 for s in sets], sketches, [folded(x, SENT_BITS // 8).tobytes() for x in sketches]]
                if signature:
                    cols.append([signature(s).tobytes() for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return docs.mapInArrow(run, ddl)


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def memberships(docs: DataFrame, n: int, keys: Callable[[np.ndarray], np.ndarray], total: int) -> DataFrame:
    """Rows (key, id, head) of all blocks that hold more than one row, out of one shuffle of packed keys, about `total` in all.

    Equal sets of a task and equal keys of about SENT_KEYS are met first: one row stands for a key in the shuffle and is the head of the
    others, which are members already and go along beside it. The rows that stand for a key have the smallest id as head.
    """
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // BUCKET_ROWS) + 1)
    ddl = "bucket int, met boolean, keys binary, ids binary, heads binary"
    schema = arrow_schema(ddl)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        owned, ids, held = [], [], 0
        for b in batches:
            for docs_in, texts in _in_slices(b):
                for doc, own in zip(docs_in, shingle_sets(texts, n)):
                    if len(own) and (digest := _digest(own)) not in seen:
                        seen.add(digest)
                        owned.append(keys(own))
                        ids.append(np.full(len(owned[-1]), doc, np.int64))
                        held += len(owned[-1])
                if held >= SENT_KEYS:
                    yield packed(owned, ids)
                    owned, ids, held = [], [], 0
        if owned:
            yield packed(owned, ids)

    def packed(owned: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        key, doc, head, first, several = _blocks(np.concatenate(owned), np.concatenate(ids))
        rows = []
        bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # rises with the key
        for met, mask in ((False, first), (True, several)):
            k, d, h, p = key[mask], doc[mask], head[mask], bucket[mask].astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])[:len(p)]).tolist()
            rows += [(int(p[a]), met, k[a:z].tobytes(), d[a:z].tobytes(), h[a:z].tobytes() if met else b"") for a, z in zip(cuts, [*cuts[1:], len(p)])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for bucket, met, own, ids, heads in zip(*(c.to_pylist() for c in b.columns)):
                key, doc = np.frombuffer(own, np.uint64), np.frombuffer(ids, np.int64)
                if met:
                    yield _member_rows(key, doc, np.frombuffer(heads, np.int64))
                    continue
                if bucket != now:
                    yield from _met(held)
                    now, held = bucket, []
                held.append((key, doc))
        yield from _met(held)

    sent = docs.mapInArrow(send, ddl)
    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "key long, id long, head long")


def _blocks(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows by key and id, each with the smallest id of its key; which stand first; which have company."""
    by = np.lexsort((doc, key))
    key, doc = key[by], doc[by]
    first = np.concatenate([[True], key[1:] != key[:-1]])[:len(key)]
    head = doc[np.flatnonzero(first)[np.cumsum(first) - 1]]
    return key, doc, head, first, ~(first & np.append(first[1:], True)[:len(key)])


def _member_rows(key: np.ndarray, doc: np.ndarray, head: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(head)], names=["key", "id", "head"])


def _met(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if held:
        key, doc, head, _, several = _blocks(*(np.concatenate(c) for c in zip(*held)))
        yield _member_rows(key[several], doc[several], head[several])


def _open_blocks(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members (key, id, component, k) of the blocks that hold several components; k is the size of the block."""
    known = ["k"] if "k" in members.columns else []
    now = stage(members.select("key", "id", *known).join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"), *known), "labelled")
    sizes = now.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key", "k")
    # One block may hold a large share of the rows: its members are dealt over SALTS tasks.
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("k") > SALTS, SALTS - 1).otherwise(0))))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    if known:  # blocks stay whole, so that a row has the size of its block since the first time
        out = now.withColumn("salt", F.when(F.col("k") > SALTS, salt).otherwise(0)).join(sizes.drop("k"), ["key", "salt"]).select("key", "id", "component", "k")
    else:
        large, small = sizes.where(F.col("k") > SALTS), sizes.where(F.col("k") <= SALTS)
        out = now.withColumn("salt", salt).join(large, ["key", "salt"]).select("key", "id", "component", "k").union(now.join(small, "key").select("key", "id", "component", "k"))
    out = stage(out, "open")
    discard(now)
    return out


def _largest(open_: DataFrame) -> DataFrame:
    """Of each row the membership in its largest open block."""
    main = open_.groupBy("id").agg(F.max(F.struct("k", "key")).alias("main"))
    return open_.join(main, "id").where(F.col("key") == F.col("main.key")).drop("main").distinct()


def _with_pairs(large: DataFrame, chunk: int) -> DataFrame:
    """Of the memberships (key, id, component, k) in large blocks those that have a pair there which no larger block has; `chunks` by their number.

    The largest blocks of one row of a block are its landmarks. Two rows that have in common a landmark larger than the block
    meet there, so a row goes when it has one in common with every row of its block. That is decided by the distinct sets of
    landmarks.
    """
    lists = large.groupBy("id").agg(_largest_keys(MARKS).alias("own"))
    with_own = large.join(lists, "id")
    marked = with_own.join(with_own.groupBy("key").agg(F.min_by("own", "id").alias("marks")), "key").select("key", "id", "k", "own", "marks")

    def hold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, k, own, marks = b.column(0).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3), MARKS), _matrix(b.column(4), MARKS)
            marks[np.logical_or.accumulate(marks == key[:, None], axis=1)] = 0  # lists fall in size: from here on none is larger
            held = np.zeros(len(key), np.int64)
            for i in range(MARKS):
                held |= ((own == marks[:, i:i + 1]).any(1) & (marks[:, i] != 0) & ((k <= MANY_ROWS) | (i < FEW_MARKS))).astype(np.int64) << i
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held)], names=["key", "id", "held"])

    def staying(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, sets in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held, rows = np.array([(x["held"], x["rows"]) for x in sets], np.int64).T
                stay = _disjoint(held)
                n = int(stay.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key, np.int64)), pa.array(held[stay]), pa.array(np.full(n, -(-int(rows[stay].sum()) // chunk), np.int32))], names=["key", "held", "chunks"])

    held = stage(marked.mapInArrow(hold, "key long, id long, held long"), "held")
    sets = held.groupBy("key", "held").agg(F.count(F.lit(1)).alias("rows")).groupBy("key").agg(F.collect_list(F.struct("held", "rows")).alias("sets"))
    stay = held.join(sets.mapInArrow(staying, "key long, held long, chunks int"), ["key", "held"]).select("key", "id", "chunks")
    return large.join(stay, ["key", "id"])


def _largest_keys(most: int):
    """Of the memberships of a row the keys of the largest blocks."""
    return F.slice(F.sort_array(F.collect_list(F.struct("k", "key")), asc=False), 1, most)["key"]


def _matrix(lists: pa.Array, most: int) -> np.ndarray:
    """Lists of at most so many keys as rows of a matrix, zeros behind."""
    out = np.zeros((len(lists), most), np.int64)
    out[np.arange(most)[None, :] < np.diff(lists.offsets.to_numpy())[:, None]] = lists.flatten().to_numpy()
    return out


def _disjoint(held: np.ndarray) -> np.ndarray:
    """Which of the sets of landmarks (bits) have nothing in common with some set among them."""
    if len(held) <= MANY_ROWS:
        return np.array([not (held & h).all() for h in held], bool)
    inside = np.zeros(1 << FEW_MARKS, bool)  # does any set lie inside this one
    inside[held] = True
    for i in range(FEW_MARKS):
        halves = inside.reshape(-1, 2, 1 << i)
        halves[:, 1] |= halves[:, 0]
    return inside[held ^ ((1 << FEW_MARKS) - 1)]


def _block_pairs(open_: DataFrame, profiles: DataFrame, able: Callable, columns: Sequence[str], chunk: int, round_no: int) -> DataFrame:
    """Pairs (a, b) of rows that share an open block, are in different components so far and that `able` allows.

    Blocks of more than `chunk` rows are cut into chunks, which meet themselves in the first two rounds, each other in
    later ones. A group of rows with more than FEW pairs a row gives two pairs a row, with its first and its last partner,
    except in the last round; its block, like all that have not met as a whole, is named in a row (key).
    """
    last = round_no == ROUNDS - 1
    owners = open_.groupBy("id").agg(_largest_keys(OWNERS).alias("owners"))
    mine = open_.withColumn("chunks", F.ceil(F.col("k") / chunk).cast("int"))
    if round_no:
        mine = mine.where(F.col("k") <= chunk).unionByName(_with_pairs(open_.where(F.col("k") > chunk), chunk))
    mine = mine.join(owners, "id").join(profiles.select("id", *columns), "id").withColumn("mine", F.pmod(F.xxhash64("id", F.lit(round_no)), F.col("chunks")).cast("int"))
    if round_no > 1:  # chunk i meets chunk j >= i: as the left side once per j, as the right side once per i
        mine = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    else:
        mine = mine.withColumn("other", F.col("mine"))
    sent = mine.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("left"), "id", "component", "owners", *columns,
                       (F.lit(round_no <= 1) & (F.col("chunks") > 1)).alias("part"))
    ddl = "a long, b long, key long"

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            now = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            key, i, j = (now.column(c).to_numpy() for c in ("key", "i", "j"))
            same = (key[1:] == key[:-1]) & (i[1:] == i[:-1]) & (j[1:] == j[:-1])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last group may go on in the next batch
            yield from pairs(now.slice(0, cut))
            rest = now.slice(cut)
        if rest is not None:
            yield from pairs(rest)

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Rows of a group stand together: row r meets row r + d for d = 1, 2, ... as long as any group reaches so far."""
        if not t.num_rows:
            return
        key, i, j, left, ids, group = (t.column(c).to_numpy() for c in ("key", "i", "j", "left", "id", "component"))
        test = able(*(t.column(c) for c in columns))
        own = _matrix(t.column("owners").combine_chunks(), OWNERS)
        edge = np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        run = np.cumsum(edge) - 1
        ends = np.append(np.flatnonzero(edge)[1:], t.num_rows)[run]
        row, d, reach = np.arange(t.num_rows), 1, np.bincount(run)
        first, final, seen, found = np.full(t.num_rows, -1), np.full(t.num_rows, -1), np.zeros(len(reach), np.int64), []
        while len(row := row[row + d < ends[row]]):
            x, y = row, row + d
            fit = (group[x] != group[y]) & ((i[x] == j[x]) | (left[x] != left[y]))
            x, y = x[fit], y[fit]
            common = ((own[x][:, :, None] == own[y][:, None, :]) & (own[x] != 0)[:, :, None]).any(2)
            fit = ~common.any(1) | (own[x, common.argmax(1)] == key[x])  # the largest common block has the pair
            x, y = x[fit], y[fit]
            fit = test(x, y)
            x, y = x[fit], y[fit]
            seen += np.bincount(run[x], minlength=len(seen))
            first[y], final[x] = x, y  # later rounds reach farther
            few = last | (seen[run[x]] <= FEW * reach[run[x]])
            found.append((x[few], y[few]))
            d += 1
        many = (seen > FEW * reach) & (not last)
        x, y = (np.concatenate(c) for c in zip(*found)) if found else (first[:0], first[:0])
        all_of = ~many[run[x]]
        lead, tail = np.flatnonzero((first >= 0) & many[run]), np.flatnonzero((final >= 0) & many[run])
        x, y = ids[np.concatenate([x[all_of], first[lead], tail])], ids[np.concatenate([y[all_of], lead, final[tail]])]
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        again = np.unique(key[many[run] | t.column("part").to_numpy()])
        pair = np.repeat([True, False], [both.shape[1], len(again)])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(both[0], again), mask=~pair), pa.array(np.append(both[1], again), mask=~pair), pa.array(np.append(both[0], again), mask=pair)], names=["a", "b", "key"])

    keys = ["key", "i", "j"]
    return sent.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(meet, ddl).distinct()


def sketches_allow(limit: Threshold) -> Callable:
    """Test of the rows x and y of a table by their sizes and the sketches sent along; for `_block_pairs`."""
    def able(n: pa.ChunkedArray, small: pa.ChunkedArray) -> Callable:
        size, bits = n.to_numpy(), small.combine_chunks()
        lengths = pa.compute.binary_length(bits).to_numpy().astype(np.int64) // 8
        words = np.frombuffer(b"".join(bits.to_pylist()), np.uint64)
        start = np.cumsum(lengths) - lengths

        def of(rows: np.ndarray, long: int, short: int) -> np.ndarray:
            return np.bitwise_xor.reduce(words[start[rows][:, None] + np.arange(long)].reshape(len(rows), long // short, short), axis=1)

        def test(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            most, out = limit.difference(size[x], size[y]), np.zeros(len(x), bool)
            kinds = lengths[x] << 32 | lengths[y]
            for kind in np.unique(kinds).tolist():
                a, b = kind >> 32, kind & 0xFFFFFFFF
                at = np.flatnonzero((kinds == kind) & (most >= 0))
                short = min(a, b)
                out[at] = np.bitwise_count(of(x[at], a, short) ^ of(y[at], b, short)).sum(1) <= most[at]
            return out

        return test

    return able


def overlaps(a: np.ndarray, b: np.ndarray, limit: Threshold) -> int:
    """Overlap of two rows, summed over ranges of columns; -1 as soon as the bound is out of reach."""
    need = -(-limit.num * (len(a) + len(b)) // (limit.num + limit.den))
    cuts = [np.uint64(((1 << 64) // RANGES) * r) for r in range(1, RANGES)]
    ca, cb = [0, *np.searchsorted(a, cuts), len(a)], [0, *np.searchsorted(b, cuts), len(b)]
    total = 0
    for r in range(RANGES):
        x, y = a[ca[r]:ca[r + 1]], b[cb[r]:cb[r + 1]]
        if len(x) and len(y):
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            total += int((y[at] == x).sum())
        if total + min(len(a) - ca[r + 1], len(b) - cb[r + 1]) < need:
            return -1
    return total


def _sets(docs: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """Sets, made again, of the documents in question."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in _in_slices(b):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.tobytes() for s in shingle_sets(texts, n)], pa.binary())], names=["id", "set"])

    return docs.join(asked, "id", "left_semi").mapInArrow(run, "id long, set binary")


def _each_once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch once; those of different batches may come again."""
    for b in batches:
        yield from pa.Table.from_batches([b]).group_by(b.schema.names, use_threads=False).aggregate([]).to_batches()


def confirmed(docs: DataFrame, profiles: DataFrame, pairs: DataFrame, n: int, limit: Threshold) -> DataFrame:
    """Those of the pairs (a, b) that link, some repeated: by their wide sketches first, the few that are left by their sets."""
    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            bound = np.array([difference_bound(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist())], np.int64)
            yield from _each_once([pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(bound <= limit.difference(na, nb), pa.bool_()))])

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [overlaps(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), limit) >= 0 for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda of, key, **cols: of.select(F.col("id").alias(key), *[F.col(c).alias(name) for c, name in cols.items()])
    told = pairs.join(side(profiles, "a", n="na", sketch="x"), "a").join(side(profiles, "b", n="nb", sketch="y"), "b").select("a", "b", "na", "nb", "x", "y")
    close = stage(told.mapInArrow(near, "a long, b long"), "close")
    asked = close.select(F.explode(F.array("a", "b")).alias("id")).mapInArrow(_each_once, "id long")
    sets = stage(_sets(docs, asked, n), "sets")
    both = close.join(side(sets, "a", set="x"), "a").join(side(sets, "b", set="y"), "b")
    links = stage(both.select("a", "b", "x", "y").mapInArrow(multiply, "a long, b long"), "links")
    discard(close, sets)
    return links


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every id, but the smallest of its component, to that one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    up = np.arange(len(ids))
    while (apart := up[x] != up[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(up, np.maximum(up[x], up[y]), np.minimum(up[x], up[y]))
        while (up != up[up]).any():
            up = up[up]
    leaf = np.flatnonzero(up != np.arange(len(ids)))
    return ids[leaf], ids[up[leaf]]


def _local_stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars instead of the edges of a task, by at most STAR_ROWS of them; ids stay connected as they were."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > STAR_ROWS:
            a, b = stars(a, b)
            if 2 * len(a) > STAR_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                a = b = np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in stars(a, b)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the ids in `edges` (a, b): the smallest id that can be reached.

    Tasks replace the edges that they read by stars; then alternating stars, until nothing changes or no more edges are
    left than one task may hold, which needs no shuffle.
    """
    edges = stage(edges.where("a <> b").mapInArrow(_local_stars, "a long, b long"), "edges")
    before, left = None, edges.count()
    while True:
        if left <= STAR_ROWS:
            return edges.coalesce(1).mapInArrow(_local_stars, "a long, b long").toDF("id", "component")
        # Large star: every larger neighbour of u points to the smallest of u and its neighbours.
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: the smaller neighbours of u, and u, point to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        last, edges = edges, stage(small, "edges")
        discard(last)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before, left = now, now[0]


def joined_components(docs: DataFrame, profiles: DataFrame, n: int, limit: Threshold, keys: Callable[[np.ndarray], np.ndarray], able: Callable, columns: Sequence[str], chunk: int) -> DataFrame:
    """doc_id, n_shingles, component_id of documents (id, text) with staged profiles; `keys` are the blocks of a set."""
    copies = profiles.where("n > 0").groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    # Copies of one text may be a large share of all rows: they are dealt over SALTS tasks.
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = profiles.select("id", "n", "digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    named = stage(salted.join(copies, ["digest", "salt"], "left").select("id", "n", F.coalesce("first", "id").alias("first")), "named")
    copied = stage(named.groupBy("id").agg(F.min(F.col("id") != F.col("first")).alias("only_copies")).where("id is null or only_copies").select("id"), "copied")

    total = profiles.agg(F.sum("blocks")).first()[0] or 0
    own = docs.where("id is not null").join(copied, "id", "left_anti").select("id", "text")
    members = stage(memberships(own, n, keys, total), "members")
    with_head = members.where("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
    found = stage(components(confirmed(docs, profiles, with_head, n, limit)), "components")
    for number in range(ROUNDS):
        open_ = _open_blocks(members, found)
        discard(members)
        members = open_
        if open_.isEmpty():
            break
        asked = open_ if number else _largest(open_)
        met = stage(_block_pairs(asked, profiles, able, columns, chunk, number), "met")
        links = confirmed(docs, profiles, met.where("key is null and a <> b").select("a", "b"), n, limit)
        known, found = found, stage(components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links)), "components")
        discard(known, links)
        if not number:
            discard(met)
            continue
        again = met.where("key is not null").select("key")
        if again.isEmpty():
            break
        members = stage(open_.join(again, "key", "left_semi"), "members")
        discard(open_, met)
    # Copies follow the row that stands for them. Its name may be as frequent as they are, so it is salted again.
    follow = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("id", "first")
    ended = named.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(follow, ["first", "salt"], "left")
    return ended.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "first")).alias("component_id"))


def ngram_components(docs: DataFrame, n: int = 3, threshold: tuple[int, int] = (9, 10), id_col: str = "doc_id", text_col: str = "text", chunk: int = 1000) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id that links lead to, its own included)."""
    limit = Threshold(*threshold)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keys = lambda own: block_keys(own, limit)
    return joined_components(docs, stage(profiles_of(docs, n, keys), "profiles"), n, limit, keys, sketches_allow(limit), ["n", "small"], chunk)


def keep_first(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (8, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the smallest of its component, with all their columns. Of rows that share an id all stay."""
    found = ngram_components(docs, n, threshold, id_col, text_col).where(F.col("doc_id") != F.col("component_id"))
    gone = next(f"gone_{i}" for i in range(len(docs.columns) + 1) if f"gone_{i}" not in map(str.lower, docs.columns))
    return docs.join(found.select(F.col("doc_id").alias(gone)).distinct(), docs[id_col] == F.col(gone), "left_anti")
