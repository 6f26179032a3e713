import numpy as np

from lexloom.llm.boost import fit_additive, fit_trees, monotone_probability, sigmoid
from lexloom.llm.quality import keep_good, score_quality


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(4000) < 0.05)).astype(float)
    m = fit_additive(x[:3000], y[:3000])
    assert m.pairs[0] == (0, 1)
    assert ((sigmoid(m.score(x[3000:])) > 0.5) == y[3000:]).mean() > 0.85
    by_hand = m.base + sum(t[np.searchsorted(e, x[5, j], "right")] for j, (e, t) in enumerate(zip(m.edges, m.tables))) + sum(
        t[np.searchsorted(m.pair_edges[i], x[5, i], "right"), np.searchsorted(m.pair_edges[j], x[5, j], "right")] for (i, j), t in zip(m.pairs, m.pair_tables))
    assert abs(m.score(x[5:6])[0] - by_hand) < 1e-9


def test_trees_and_calibration():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, 4))
    y = ((x[:, 0] > 0) & (x[:, 1] > 0.2)).astype(float)
    z = fit_trees(x[:2000], y[:2000]).score(x[2000:])
    assert ((z > 0) == y[2000:]).mean() > 0.97
    at, p = monotone_probability(z, y[2000:])
    assert (np.diff(at) >= 0).all() and (np.diff(p) >= -0.2).all() and p[-1] > 0.9 and p[0] < 0.1


def test_scores_and_filter(spark):
    good, bad = "A plain sentence about rivers and hills. ", "BUY!! NOW!! ### $$$ BUY!! "
    rows = [(i, (good if i % 2 else bad) * (2 + i % 7), "other") for i in range(200)] + [(500, None, "o"), (501, "", "o"), (502, good, "o"), (502, good, "o"), (503, bad * 20_000, "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(200)] + [(9000, 1, 0), (3, None, 1)], "doc_id long, quality int, text int")
    got = score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id < 200) and {r.predicted for r in got if r.doc_id == 502} == {1}
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in score_quality(docs, none).collect()] == [0.5]
    assert score_quality(docs.limit(0), none).count() == 0
