from datetime import datetime, timedelta
import random

import pytest

from lexloom.operators.evaluate import trace_rollup
from lexloom.streaming import keyed_state as S

T0 = datetime(2024, 5, 1)
HOUR = 3_600_000
ANSWERS = "session_id long, fact_key string, value string, seq long, at timestamp"
SPANS = "run_id long, seq long, step string, status string, duration_ms double, at timestamp"


def arriving(spark, tmp_path, batches, ddl):
    """A stream of one micro-batch per list of rows."""
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(spark, tmp_path, stream):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STORE)
    S.start_updates(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def at(hours):
    return T0 + timedelta(hours=hours)


def test_facts_expire_and_late_answers_are_dropped(spark, tmp_path):
    batches = [
        [(1, "k", "a", 1, at(0)), (1, "k2", "b", 2, at(0)), (1, " ", "blank", 3, at(0)), (3, "z", None, 4, at(0.5))],
        [(2, "x", "c", 5, at(10)), (1, "k2", "b2", 6, at(9.5)), (1, "k2", "older", 7, at(9.2))],
        [(1, "k", "late", 8, at(1)), (1, "k3", "new", 9, at(11)), (2, "x", "c2", 10, at(10))],
        [(4, "end", "e", 11, at(12))],
    ]
    updates = run(spark, tmp_path, S.keyed_facts(arriving(spark, tmp_path, batches, ANSWERS), 5 * HOUR, "1 hour"))
    rows = updates.collect()
    assert {(r.session_id, r.fact_key) for r in rows if r.expired} == {(1, "k"), (3, "z")} and all(r.value is None for r in rows if r.expired)
    assert not {"late", "older", "blank"} & {r.value for r in rows}
    key = lambda df: sorted(map(tuple, df.collect()))
    living = key(S.living_facts(updates, at(11), 5 * HOUR))
    assert living == [(1, "k2", "b2", 6), (1, "k3", "new", 9), (2, "x", "c2", 10), (4, "end", "e", 11)]
    whole = spark.createDataFrame([r for b in batches for r in b if r[2] != "late"], ANSWERS)
    assert living == key(S.living_facts_batch(whole, at(11), 5 * HOUR))


def test_an_answer_after_expiry_counts_again(spark, tmp_path):
    batches = [[(1, "k", "a", 9, at(0))], [(2, "x", "c", 2, at(20))], [(1, "k", "back", 3, at(21))], [(2, "x", "d", 4, at(21))]]
    updates = run(spark, tmp_path, S.keyed_facts(arriving(spark, tmp_path, batches, ANSWERS), 5 * HOUR, "1 hour"))
    assert [(r.value, r.expired) for r in updates.where("session_id = 1").orderBy("at", "expired").collect()] == [("a", False), (None, True), ("back", False)]
    assert [r.value for r in S.living_facts(updates, at(20), 5 * HOUR).where("session_id = 1").collect()] == ["back"]


def spans(n, seed=3):
    rng = random.Random(seed)
    return [(rng.randrange(7), i, f"step{i % 5}", rng.choice(["ok", "ok", "failed"]), rng.randrange(1000) / 8, T0 + timedelta(minutes=rng.randrange(600))) for i in range(n)]


@pytest.mark.parametrize("shuffled", [False, True])
def test_span_stream_equals_batch(spark, tmp_path, shuffled):
    rows = spans(400)
    if not shuffled:
        rows.sort(key=lambda r: r[5])
    stream = S.span_windows(arriving(spark, tmp_path, [rows[i::4] if shuffled else rows[i * 100:(i + 1) * 100] for i in range(4)], SPANS), "1 hour", "12 hours" if shuffled else "1 minute")
    got = sorted(map(tuple, S.rollup_windows(run(spark, tmp_path, stream)).collect()))
    whole = spark.createDataFrame(rows, SPANS)
    assert got == sorted(map(tuple, trace_rollup(whole).collect())) == sorted(map(tuple, S.rollup_windows(S.span_windows(whole)).collect()))


def test_late_spans_are_not_counted(spark, tmp_path):
    batches = [[(1, 1, "a", "ok", 1.0, at(0))], [(1, 2, "b", "failed", 1.0, at(5))], [(1, 5, "e", "ok", 0.0, at(5.2))], [(1, 3, "c", "failed", 9.0, at(0.5)), (1, 4, "d", "ok", 2.0, at(5.5))]]
    stream = S.span_windows(arriving(spark, tmp_path, batches, SPANS), "1 hour", "1 hour")
    assert [tuple(r) for r in S.rollup_windows(run(spark, tmp_path, stream)).collect()] == [(1, 4, 4.0, 2.0, 1, "b")]
