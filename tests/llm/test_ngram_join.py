import random
import re

import numpy as np

from lexloom.llm.ngram_join import Threshold, block_keys, components, difference_bound, folded, keep_first, ngram_components, overlaps, shingle_sets, sketches_allow, wide_sketch


def plain_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, num, den):
    sets = [(i, plain_set(t, n)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets)


def family(seed):
    """Chains of near copies at all distances around the threshold, copies, a shared passage, odd rows."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(14):
        w = [word() for _ in range(rng.choice([2, 3, 4, 6, 12, 30, 80, 200]))]
        for _ in range(8):
            rows.append(" ".join(w) + rng.choice(["", " ", "\n"]))
            w = list(w)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.3:
                w += [word() for _ in range(1 + len(w) // 30)]
    rows += [" ".join(passage + [word() for _ in range(rng.randrange(8, 14))]) for _ in range(60)]
    rows += [None, "", " \n", "A\x00b c", "a\x00B C", "x " * 3000, "X " * 3000, "ſ K", "s k"]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows))


def test_components_against_brute_force(docs_of):
    for seed, n, t in ((1, 3, (9, 10)), (2, 5, (8, 10))):
        rows = family(seed)
        got = ngram_components(docs_of(rows), n, t, chunk=7).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, n, *t)


def test_linked_rows_share_a_block():
    rng = np.random.default_rng(0)
    for num, den in ((9, 10), (8, 10), (1, 2)):
        limit = Threshold(num, den)
        for _ in range(300):
            common = rng.integers(0, 1 << 64, rng.integers(1, 120), np.uint64)
            more = max(0, int(len(common) * (den - num) / num)) + 1
            cut = rng.integers(0, more + 1)
            extra = rng.integers(0, 1 << 64, more, np.uint64)
            a, b = np.unique(np.concatenate([common, extra[:cut]])), np.unique(np.concatenate([common, extra[cut:rng.integers(cut, more + 1)]]))
            linked = den * len(common) >= num * (len(a) + len(b) - len(common))
            assert (overlaps(a, b, limit) == len(common)) if linked else True
            if linked:
                assert len(np.intersect1d(block_keys(a, limit), block_keys(b, limit)))
                assert limit.difference(len(a), len(b)) >= len(a) + len(b) - 2 * len(common)
            assert difference_bound(wide_sketch(a), wide_sketch(b)) <= len(np.setxor1d(a, b))


def test_shingles_of_many_texts():
    texts = [t or "" for _, t in family(3)]
    for n in (1, 3, 5):
        assert [len(s) for s in shingle_sets([t.encode() for t in texts], n)] == [len(plain_set(t, n)) for t in texts]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 99}


def test_few_edges_are_joined_without_a_shuffle(spark, monkeypatch):
    from lexloom.llm import ngram_join

    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 3000, (2, 2000))
    ids, root = ngram_join.stars(a, b)
    assert (root < ids).all() and len(np.unique(ids)) == len(ids) and not np.isin(root, ids).any()
    assert [x.size for x in ngram_join.stars(a[:0], b[:0])] == [0, 0]
    edges = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long").repartition(5)
    few = components(edges)
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ngram_join, "STAR_ROWS", 100)  # by alternating stars
    many = components(edges)
    want = dict(zip(ids.tolist(), root.tolist()))
    for got in (few, many):
        assert {r.id: r.component for r in got.collect()} == want and got.count() == len(want)


def test_odd_tables(spark, docs_of):
    assert ngram_components(docs_of([])).count() == 0
    docs = spark.createDataFrame([(None, "a b c d", 1), (1, "a b c d", 2), (1, "a b c d", 3), (2, None, 4)], "doc_id long, text string, n_shingles int")
    assert sorted(map(tuple, ngram_components(docs).collect()), key=str) == sorted([(None, 2, None), (1, 2, 1), (1, 2, 1), (2, 0, 2)], key=str)


def test_sketches_in_blocks():
    import pyarrow as pa

    rng = np.random.default_rng(7)
    limit = Threshold(8, 10)
    sets = [np.unique(rng.integers(0, 1 << 64, n, np.uint64)) for n in (3, 40, 40, 900, 1000, 9000)]
    sets += [s[: max(1, len(s) - len(s) // 12)] for s in sets]
    small = [folded(wide_sketch(s), 128).tobytes() for s in sets]
    test = sketches_allow(limit)(pa.chunked_array([[len(s) for s in sets]]), pa.chunked_array([pa.array(small, pa.binary())]))
    x, y = map(np.array, zip(*[(i, j) for i in range(len(sets)) for j in range(len(sets))]))
    got = test(x, y)
    for i, j, able in zip(x, y, got):
        a, b = sets[i], sets[j]
        linked = 10 * len(np.intersect1d(a, b)) >= 8 * len(np.union1d(a, b))
        assert able or not linked
        assert not able or limit.difference(len(a), len(b)) >= difference_bound(small[i], small[j])
    assert got.sum() < len(got) / 2 and not test(x[:0], y[:0]).size and not test(np.array([0]), np.array([5])).any()


def test_keep_first(docs_of):
    t = " ".join(f"w{i}" for i in range(60))
    docs = docs_of([(5, t), (3, t + " end"), (9, "other"), (4, None), (6, None)])
    assert keep_first(docs.withColumnRenamed("start", "gone_0").withColumnRenamed("score", "__gone")).count() == 4
    kept = keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 6, 9]


def test_rows_of_large_blocks_go_where_their_pairs_are_owned(spark):
    """Near copies share most blocks: what is sent to the chunks of all blocks grows with the rows, and every pair keeps its largest block."""
    from itertools import combinations

    from lexloom.llm import ngram_join
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    member = rng.random((300, 80)) < np.linspace(0.8, 0.5, 80)
    k = member.sum(0)
    rows = [(int(b) + 1, int(i), 0 if i % 2 else int(i), int(k[b])) for i, b in zip(*np.nonzero(member))]
    kept = ngram_join._with_pairs(spark.createDataFrame(rows, "key long, id long, component long, k long"), 40).collect()
    stay = {(r.key, r.id) for r in kept}
    order = sorted(range(80), key=lambda b: (-k[b], -b))
    for i, j in combinations(range(300), 2):
        b = next(b for b in order if member[i, b] and member[j, b])
        assert (b + 1, i) in stay and (b + 1, j) in stay
    assert sum(r.chunks for r in kept) < sum(int(n) * -(-int(n) // 40) for n in k) / 3
    held = np.array([0b0011, 0b0101, 0b1001, 0b1100])
    assert ngram_join._disjoint(held).tolist() == [True, False, False, True]
    many = rng.integers(0, 1 << 16, 40_000)
    got = ngram_join._disjoint(many)
    assert all(got[i] == bool((many & many[i] == 0).any()) for i in range(0, 40_000, 500))
