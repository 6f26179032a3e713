"""Near duplicates by MinHash signatures, joined under a Hamming distance through several indexes.

A signature has one place per bin of the hash range: `BITS` bits of the least hash of the set in that bin, 0 where the bin
is empty. Two signatures differ in a place only where an element of one set alone falls, so their distance is at most the
symmetric difference of the sets; and of large sets each place differs with the probability 1 - similarity. The distance
allowed is the smaller of what the sizes of linked sets allow and of the binomial tail: a pair just at the threshold lies
beyond it with a probability below `miss`, the only way in which a link can be lost, and then only for large sets.

The join finds every pair under that distance. Signatures are cut into chunks, few enough that one chunk of a pair
differs in `errors` places at most (pigeonhole). Where chunks of equal content would be too short to tell texts apart, one
error is allowed and the chunks are longer: a row is entered under the content of each chunk and under what is left of it
without each of its places, so two chunks that differ in one place meet. A row with enough filled chunks needs no entry
for empty content. Sizes decide the cut, in bands, and a row is entered for its own band and the one below.

Rows that meet are compared by whole signatures, then by parity sketches of the sets, and linked by the sets themselves.
How blocks are kept small and components built is shared with the n-gram join (`joined_components`): equal sets meet by
digest, heads of blocks first, open blocks in rounds; no group is gathered in one task.

Null and empty texts have no shingles and link with nothing. Very long texts are taken whole; their signatures are as
long as any. Rows that share an id are one document; rows without an id come back as they are, linked with nothing and
kept. Repeated texts are copies of the one with the smallest id. An empty table gives no rows. Only id and text are
read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from math import comb, exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.ngram_join import Threshold, joined_components, profiles_of, sketches_allow
from lexloom.llm.util import stage
from lexloom.llm.words import mix

BINS = 128
BITS = 16
STEPS = (0, 1, 3, 5, 7, 11, 15, 21, 29, 39, 53, 71, 95, BINS)  # distances that are told apart: neighbouring bands share a cut
FILLED = 4  # places that a chunk without errors should hold to tell texts apart


def signature(own: np.ndarray) -> np.ndarray:
    """Per bin 16 bits of the least hash in it (1 and up), 0 where it is empty; `own` rises, so the least comes first."""
    out, places = np.zeros(BINS, np.uint16), own >> np.uint64(64 - BINS.bit_length() + 1)
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])[:len(own)])
    out[places[first].astype(np.int64)] = np.maximum(mix(own[first]) & np.uint64((1 << BITS) - 1), np.uint64(1))
    return out


def tail_distance(num: int, den: int, miss: float) -> int:
    """Least distance that a binomial of BINS places, each differing with 1 - num / den, exceeds with less than `miss`."""
    p, above, d = 1 - num / den, 0.0, BINS
    while d >= 0:
        above += comb(BINS, d) * p ** d * (1 - p) ** (BINS - d)
        if above >= miss:
            return d
        d -= 1
    return 0


class Cut:
    """How signatures of a size band are cut: distance allowed, errors per chunk, chunks."""

    def __init__(self, limit: Threshold, miss: float):
        self.limit, self.tail = limit, tail_distance(limit.num, limit.den, miss)

    @lru_cache(maxsize=4096)
    def of(self, band: int) -> tuple[int, int, int]:
        distance = min(next(s for s in STEPS if s >= min(self.limit.slices(band)[0], self.tail)), self.tail)
        filled = BINS * (1 - exp(-self.limit.starts[band] / BINS))

        def chunks(errors: int) -> int:
            need = distance // (errors + 1) + 1  # so many chunks cannot all have more errors
            return min(BINS, need + (need // 8 + 2 if distance and filled < 0.98 * BINS else 0))

        errors = 0 if filled >= FILLED * chunks(0) or not distance else 1
        return distance, errors, chunks(errors)

    def keys(self, own: np.ndarray) -> np.ndarray:
        """Keys under which a set is entered."""
        top = self.limit.band(len(own))
        sig = signature(own)
        at = np.flatnonzero(sig).astype(np.uint64)
        item = mix(mix((at << np.uint64(BITS)) | sig[at.astype(np.int64)]))
        out = [_keys(at, item, *cut) for cut in {self.of(b) for b in (top, max(0, top - 1))}]
        return np.unique(np.concatenate(out))


def _keys(at: np.ndarray, item: np.ndarray, distance: int, errors: int, chunks: int) -> np.ndarray:
    part = at * np.uint64(chunks) // np.uint64(BINS)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    size = np.diff(np.append(first, len(part)))
    content, where = np.add.reduceat(item, first), part[first]
    if errors:
        run = np.repeat(np.arange(len(first)), size)
        less = size[run] > 1  # what is left without one place; alone in its chunk nothing is left
        content, where = np.concatenate([content, content[run[less]] - item[less]]), np.concatenate([where, part[less]])
    # Chunks with more places than errors share content with any chunk that differs in so few; enough of them suffice.
    if (size > errors).sum() * (errors + 1) <= distance:
        bare = np.arange(chunks, dtype=np.uint64) if errors and (size == 1).any() else np.setdiff1d(np.arange(chunks, dtype=np.uint64), part)
        content, where = np.concatenate([content, np.zeros(len(bare), np.uint64)]), np.concatenate([where, bare])
    return mix(content + mix(where + (np.uint64(chunks * 2 + errors) << np.uint64(32))))


def signatures_allow(cut: Cut) -> Callable:
    """Test of rows x and y of a table: signatures within the distance of their sizes, then sketches."""
    sketches = sketches_allow(cut.limit)

    def able(n: pa.ChunkedArray, small: pa.ChunkedArray, sig: pa.ChunkedArray) -> Callable:
        near, size = sketches(n, small), n.to_numpy()
        sigs = np.frombuffer(b"".join(sig.to_pylist()), np.uint16).reshape(-1, BINS)

        def test(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = (sigs[x] != sigs[y]).sum(1) <= np.minimum(cut.limit.difference(size[x], size[y]), cut.tail)
            out[out] = near(x[out], y[out])
            return out

        return test

    return able


def minhash_components(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (8, 10), miss: float = 1e-9, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1000) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id that links lead to), kept (that id is its own)."""
    limit = Threshold(*threshold)
    cut = Cut(limit, miss)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    profiles = stage(profiles_of(docs, n, cut.keys, signature), "profiles")
    out = joined_components(docs, profiles, n, limit, cut.keys, signatures_allow(cut), ["n", "small", "sig"], chunk)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
