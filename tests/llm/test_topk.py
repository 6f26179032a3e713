import numpy as np

from lexloom.llm.topk import CoverTree, top_k


def brute(rows, queries, k):
    ok = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, x in ok:
        if q in queries:
            best = sorted((-int(x @ y), i) for i, y in ok if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int")


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 4))
    rows = [(i, (centres[i % 6] + 0.1 * rng.normal(size=4)).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(30)] + [(1100, [0.0] * 4), (1200, None), (1300, [1.0, None, 0.0, 0.0]), (1400, [float("nan"), 1.0, 1.0, 1.0]), (1500, [float("inf")] * 4), (1600, [1.0]), (1700, []), (None, [1.0] * 4)]
    queries = {i for i, _ in rows if i is not None and i % 50 == 0}
    for query_rows, block_rows in ((1000, 64), (5, 8192)):
        got = top_k(table(spark, rows).repartition(3), "vec_id % 50 = 0", k=7, block_rows=block_rows, query_rows=query_rows).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, queries, 7)


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0])]
    assert sorted(tuple(r) for r in top_k(table(spark, rows), "vec_id = 0").collect()) == [(0, 1, 2, 1024 ** 2), (0, 2, 1, 0)]
    assert top_k(table(spark, []), "vec_id = 0").count() == 0
    assert top_k(table(spark, rows), "vec_id = 9").count() == 0


def test_cover_tree_covers_and_separates():
    rng = np.random.default_rng(5)
    t = CoverTree(rng.integers(-50, 50, (900, 2)), leaf=10)
    for n, kids in enumerate(t.children):
        d = np.sqrt(((t.x[t.rows[n]] - t.x[t.centre[n]]) ** 2).sum(1))
        assert d.max() <= t.radius[n] + 1e-9
        if kids:
            assert sorted(np.concatenate([t.rows[c] for c in kids])) == sorted(t.rows[n]) and t.centre[kids[0]] == t.centre[n]
            c = t.x[[t.centre[c] for c in kids]]
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2))[np.triu_indices(len(c), 1)]
            assert apart.min() > t.radius[n] / t.base - 1e-9 and all(t.radius[k] <= t.radius[n] / t.base + 1e-9 for k in kids)
