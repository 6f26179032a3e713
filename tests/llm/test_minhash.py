import random

import numpy as np

from lexloom.llm.minhash import BINS, Cut, minhash_components, signature, tail_distance
from lexloom.llm.ngram_join import Threshold

from test_ngram_join import brute, family


def test_components_against_brute_force(docs_of):
    for seed, n, t in ((4, 3, (85, 100)), (5, 5, (8, 10))):
        rows = family(seed)
        got = minhash_components(docs_of(rows), n, t, chunk=7).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, n, *t)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def sets_at(rng, size, share):
    """Two random sets of about so many elements, of which about so large a share of the union is common."""
    apart = rng.binomial(size, 1 - share)
    both = rng.integers(0, 1 << 64, size - apart, np.uint64)
    own = rng.integers(0, 1 << 64, apart, np.uint64)
    k = rng.integers(0, apart + 1)
    return np.unique(np.concatenate([both, own[:k]])), np.unique(np.concatenate([both, own[k:]]))


def test_every_pair_within_the_distance_meets():
    rng = np.random.default_rng(2)
    for num, den in ((85, 100), (8, 10)):
        cut, linked = Cut(Threshold(num, den), 1e-9), 0
        for _ in range(3000):
            a, b = sets_at(rng, int(rng.choice([2, 4, 7, 8, 14, 30, 60, 120, 300, 700, 3000])), num / den + rng.uniform(-0.03, 0.1))
            common = len(np.intersect1d(a, b))
            distance = int((signature(a) != signature(b)).sum())
            assert distance <= len(a) + len(b) - 2 * common
            allowed = min(int(cut.limit.difference(len(a), len(b))), cut.tail) if len(a) and len(b) else -1
            if distance <= allowed:
                assert len(np.intersect1d(cut.keys(a), cut.keys(b)))
            if len(a) and len(b) and den * common >= num * (len(a) + len(b) - common):
                linked += 1
                assert distance <= allowed
        assert linked > 500


def test_keys_are_few_and_errors_are_enumerated():
    rng = np.random.default_rng(3)
    cut = Cut(Threshold(85, 100), 1e-9)
    for size in (1, 5, 40, 200, 1000, 20000):
        own = np.unique(rng.integers(0, 1 << 64, size, np.uint64))
        assert len(cut.keys(own)) <= 3 * BINS
    assert any(cut.of(b)[1] for b in range(cut.limit.band(1000))) and 0 < tail_distance(85, 100, 1e-9) < BINS


def test_odd_tables(spark, docs_of):
    assert minhash_components(docs_of([])).count() == 0
    docs = spark.createDataFrame([(None, "a b c d", 1, "x"), (None, "a b c d", 1, "x"), (1, "a b c d", 2, "x"), (1, "a b c d", 3, "x"), (2, None, 4, "x"), (3, " \n", 4, "x"), (0, "A b  c d", 4, "x")], "doc_id long, text string, kept int, id string")
    got = minhash_components(docs, 3, (85, 100)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 2, None, True)] * 2 + [(1, 2, 0, False)] * 2 + [(2, 0, 2, True), (3, 0, 3, True), (0, 2, 0, True)], key=str)


def test_many_near_copies_and_long_texts(docs_of):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    long = " ".join(f"z{rng.randrange(10 ** 6)}" for _ in range(20_000))
    rows += [(1000, long), (1001, long + " end"), (1002, " ".join(long.split()[:19_000]))]
    got = minhash_components(docs_of(rows), 3, (85, 100)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 3, 85, 100)
