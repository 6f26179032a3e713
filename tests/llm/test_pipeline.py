from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexloom.llm import pii, quality
from test_decontaminate import brute as brute_contamination
from test_ngram_join import brute as brute_components

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The input and the result of every stage."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, apply in corpus_pipeline.STAGES:
        apply(spark, docs, DATA).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_columns(tables):
    assert all(t.columns == tables[0].columns for t in tables[:-1])


def test_quality(spark, tables):
    scores = quality.score_quality(tables[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    assert sorted(r.doc_id for r in tables[1].collect()) == sorted(r.doc_id for r in scores.collect() if r.score >= 0.5)
    bad = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 0").collect()}
    assert not bad & {r.doc_id for r in tables[1].collect()}


def test_near_duplicates(tables):
    rows = [(r.doc_id, r.text) for r in tables[1].collect()]
    assert sorted(r.doc_id for r in tables[2].collect()) == [i for i, _, c in brute_components(rows, 5, 8, 10) if i == c]


def test_contamination(spark, tables):
    rows, items = [(r.doc_id, r.text) for r in tables[2].collect()], [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in tables[3].collect()) == sorted(r[0] for r in brute_contamination(rows, items, 13) if not r[5])


def test_redaction(tables):
    before, after = ({r.doc_id: r for r in t.collect()} for t in tables[3:5])
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        assert r.text == before[i].text or pii.proposals(before[i].text) or pii.base_spans(before[i].text)


def test_packing(tables):
    tok, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    for r in tables[4].collect():
        want[r.doc_id] = len(tok.encode(r.text, add_special_tokens=False).ids) + 1
    got, bins = defaultdict(int), defaultdict(int)
    for r in tables[5].collect():
        got[r.doc_id] += r.length
        bins[r.sequence_id] += r.length
    assert got == want and max(bins.values()) <= 4096 and len(bins) <= sum(want.values()) // 4096 + 2


def test_run_is_the_stages_in_order(spark, tables):
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(key, tables[-1].collect()))


def test_stages_on_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for name, apply in corpus_pipeline.STAGES:
            assert apply(spark, rows, DATA).count() <= rows.count(), name
