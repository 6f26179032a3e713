import json

import pytest
from pyspark.sql import functions as F

from lexloom.sources import readers, sinks
from lexloom.streaming.session_facts import session_facts, session_facts_expiring


def test_corpus_and_inventory(spark, tmp_path):
    (tmp_path / "nghi_dinh_168.txt").write_text("Số 168/2025/NĐ-CP của Chính phủ\r\nngày 1 tháng 2 năm 2025", encoding="utf-8")
    r = readers.read_corpus(spark, str(tmp_path), "enterprise").first()
    assert (r.doc_type, r.doc_code, r.issuing_body, r.first_date) == ("decree", "168/2025/NĐ-CP", "Chính phủ", "ngày 1 tháng 2 năm 2025")
    root = tmp_path / "art"
    (root / "tax").mkdir(parents=True)
    (root / "tax" / "rules.jsonl").write_text("{}\n{}\n")
    (root / "tax" / "packs_1.jsonl").write_text("{}\n")
    i = readers.artifact_inventory(spark, str(root)).first()
    assert (i.domain, i.rules, i.packs, i.complete, i.missing) == ("tax", 2, 1, False, "canonical,traceability")


def test_rules_from_object_and_lines(spark, tmp_path):
    o = tmp_path / "o.json"
    o.write_text(json.dumps({"rules": [{"rule_id": "r1", "head": {"predicate": "p", "args": ["a"]}}, {"rule_id": "", "logic_form": "x"}]}))
    good, bad = readers.read_rules(spark, str(o), lines=False)
    assert [(r.rule_id, r.logic_form, r.head.predicate) for r in good.collect()] == [("r1", "unknown", "p")] and bad.count() == 1
    l = tmp_path / "l.jsonl"
    l.write_text('{"rule_id": "r2"}\n{broken\n\n')
    good, bad = readers.read_rules(spark, str(l))
    assert [(r.rule_id, r.head.predicate) for r in good.collect()] == [("r2", "unknown")] and bad.count() == 1


def test_chunks_list_and_object(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"chunk_id": "1", "text": "t"}]))
    (tmp_path / "b.json").write_text(json.dumps({"evidence_chunks": [{"chunk_id": "2", "text": "u"}, {"chunk_id": "3", "text": " "}]}))
    assert sorted(r.chunk_id for r in readers.read_chunks(spark, str(tmp_path), lines=False).collect()) == ["1", "2"]


def test_review_needs_columns(spark, tmp_path):
    sinks.write_review_table(spark.createDataFrame([("a",)], "x string"), str(tmp_path / "t"))
    with pytest.raises(ValueError):
        readers.read_review_table(spark, str(tmp_path / "t"), ["x", "y"])


def test_stage_prefix(spark, tmp_path):
    base = spark.range(3)
    stages = [("one", lambda h: h["base"].withColumn("a", F.lit(1))), ("two", lambda h: h["one"].filter("id > 0")), ("three", lambda h: h["two"])]
    have = sinks.run_stages(spark, {"base": base}, stages, str(tmp_path), until="two")
    assert set(have) == {"base", "one", "two"} and have["two"].count() == 2


def test_statute_packs(spark, tmp_path):
    d = spark.createDataFrame([("a/b", 1), ("", 2), (None, 3)], "doc_code string, v int")
    got = {r.doc_key: r.rule_count for r in sinks.write_statute_packs(d, str(tmp_path / "p")).collect()}
    assert got == {"a_b": 1, "unknown_doc": 2}


def test_stateful_stream_equals_batch(spark, tmp_path):
    rows = [(1, "k", "a", 1), (1, "k", "b", 2), (1, " ", "x", 3), (2, "k", None, 4)]
    d = spark.createDataFrame(rows, "session_id long, fact_key string, value string, seq long")
    d.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = (session_facts_expiring(src, 3_600_000).writeStream.outputMode("update").format("memory").queryName("facts_out").option("checkpointLocation", str(tmp_path / "c")).start())
    # A query with a processing-time timeout does not end by itself.
    q.awaitTermination(20)
    q.stop()
    key = lambda df: sorted((r.session_id, r.fact_key, r.value) for r in df.collect())
    assert key(spark.table("facts_out")) == key(session_facts(d)) == [(1, "k", "b"), (2, "k", "true")]
