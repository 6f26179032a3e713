import zlib

import numpy as np

from lexloom.llm.langid import best_paths, label_languages


def test_paths_against_dynamic_programming():
    rng = np.random.default_rng(4)
    lengths = np.array([1, 7, 12, 12])
    scores = rng.normal(size=(4, 12, 3)).astype(np.float32) * 3
    got = best_paths(scores, lengths, 2.0)
    for d, n in enumerate(lengths):
        s, worth = scores[d, :n], {(j,): scores[d, 0, j] for j in range(3)}
        for i in range(1, n):
            step = {p + (j,): v + s[i, j] - 2.0 * (p[-1] != j) for p, v in worth.items() for j in range(3)}
            worth = {}
            for p, v in step.items():  # the best path to each last language
                if (p[-1],) not in {(q[-1],) for q in worth} or v > max(w for q, w in worth.items() if q[-1] == p[-1]):
                    worth = {q: w for q, w in worth.items() if q[-1] != p[-1]} | {p: v}
        best = max(worth.values())
        own = got[d, :n]
        assert abs(s[np.arange(n), own].sum() - 2.0 * (np.diff(own) != 0).sum() - best) < 1e-3


def test_mixed_texts_scripts_and_odd_rows(spark):
    en, ru, de = "the cat and the dog were thinking of things ", "это был очень длинный день и вечер ", "der hund und die katze sind nicht über den weg "
    rows = [(i, t * 5, lang) for i in range(30) for t, lang in ((en, "en"), (ru, "ru"), (de, "de"))]
    rows = [(3 * i + k, t, lang) for i in range(30) for k, (_, t, lang) in enumerate(rows[:3])]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 !!", None), (903, en * 6 + ru * 2 + de * 3, None), (904, "漢字", None), (905, ru.upper(), None), (905, ru.upper(), None), (906, "x" * 200_000, None)]
    docs = spark.createDataFrame([(*r, 1.0, "q") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string").repartition(3)
    got = {r.doc_id: r for r in label_languages(docs, spans=True, switch=6.0).collect()}
    assert label_languages(docs).count() == len(rows)
    for i, _, lang in rows[:90]:
        assert got[i].lang_pred == lang and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert [s.lang for s in got[903].spans] == ["en", "ru", "de"] and got[903].lang_pred == "en" and 0 < got[903].score < 1
    assert got[905].lang_pred == "ru" and got[905].score == 1.0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in label_languages(docs).collect()] == [("und", 0.0)]
    assert label_languages(docs.limit(0)).count() == 0
