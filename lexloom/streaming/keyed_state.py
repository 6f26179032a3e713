"""Streams with state in event time: session facts that expire, and the rollup of trace spans.

Facts are kept per session in one keyed state with one timer, so a session is read and written once per micro-batch. A fact
lives for `ttl` after its last answer, in the time of the answers: when the watermark passes the earliest end of a session's
facts the timer fires, the facts that ended are forgotten, and that is told downstream. Answers older than
the watermark come too late and are dropped. Spans are added up by native windowed aggregation, whose state goes when the
watermark passes the window. Both write their updates per micro-batch; folding the updates gives the state at any time,
and a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.streaming.session_facts import prepared

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UPDATES = "session_id bigint, fact_key string, value string, seq bigint, at timestamp, expired boolean"


def _step(ttl: int):
    """Latest answer of each fact of a session, by time and then by number; a session's facts are one state with one timer."""

    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        late = state.getCurrentWatermarkMs()
        facts: dict[str, list] = json.loads(state.get[0]) if state.exists else {}  # fact -> at, seq, value
        best: dict[str, tuple[int, int, str]] = {}
        for pdf in rows:
            at = pdf["at"].astype("datetime64[us]").astype("int64").tolist()
            for fact, own in zip(pdf["fact_key"], zip(at, pdf["seq"].tolist(), pdf["value"])):
                if own[0] >= late * 1000:  # the engine's own filter lags a micro-batch behind
                    best[fact] = max(own, best.get(fact, own))
        out = []
        for fact, (at, seq, _) in sorted(facts.items()):
            if at // 1000 + ttl <= late:
                out.append((key[0], fact, None, seq, at, True))
        gone = {row[1] for row in out}
        for fact, (at, seq, value) in sorted(best.items()):
            if fact in facts and (facts[fact][0], facts[fact][1]) >= (at, seq):
                continue
            facts[fact] = [at, seq, value]
            gone.discard(fact)
            out.append((key[0], fact, value, seq, at, False))
        for fact in gone:
            del facts[fact]
        if facts:
            state.update((json.dumps(facts),))
            due = min(at for at, *_ in facts.values()) // 1000 + ttl
            state.setTimeoutTimestamp(max(due - 1, late + 1))  # it fires when the watermark is past this time
        elif state.exists:
            state.remove()
        if out:
            yield _rows(out)

    return step


def _rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["session_id", "fact_key", "value", "seq", "at", "expired"])
    out["at"] = out["at"].astype("int64").astype("datetime64[us]")
    return out


def keyed_facts(answers: DataFrame, ttl_ms: int, delay: str) -> DataFrame:
    """Stream of updates of answers(session_id, fact_key, value, seq, at): an answer that counts, or a fact that expired."""
    grouped = prepared(answers, "at").withWatermark("at", delay).groupBy("session_id")
    return grouped.applyInPandasWithState(_step(ttl_ms), UPDATES, "facts string", "update", GroupStateTimeout.EventTimeTimeout)


def start_updates(stream: DataFrame, updates: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of each micro-batch, with its number, to the Parquet table `updates`."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{updates}/batch={number}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def living_facts(updates: DataFrame, until: object, ttl_ms: int) -> DataFrame:
    """Facts that live at the time `until` (the watermark), from the updates of `keyed_facts`."""
    last = updates.groupBy("session_id", "fact_key").agg(F.max(F.struct("at", "seq", "expired", "value")).alias("l"))
    alive = ~F.col("l.expired") & (F.unix_millis("l.at") + ttl_ms > F.unix_millis(F.lit(until)))
    return last.where(alive).select("session_id", "fact_key", F.col("l.value").alias("value"), F.col("l.seq").alias("seq"))


def living_facts_batch(answers: DataFrame, until: object, ttl_ms: int) -> DataFrame:
    """The same from the answers themselves."""
    own = prepared(answers, "at").withColumn("expired", F.lit(False))
    return living_facts(own, until, ttl_ms)


def span_windows(spans: DataFrame, length: str = "1 hour", delay: str | None = None) -> DataFrame:
    """Spans(run_id, seq, step, status, duration_ms, at) added up per run and window of time; `delay` for a stream."""
    spans = spans if delay is None else spans.withWatermark("at", delay)
    bad = F.col("status") == "failed"
    return spans.groupBy("run_id", F.window("at", length).alias("w")).agg(
        F.count(F.lit(1)).alias("n_spans"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"), F.count_if(bad).alias("n_failed"),
        F.min(F.when(bad, F.struct("seq", "step"))).alias("failed"))


def rollup_windows(windows: DataFrame) -> DataFrame:
    """Per run, from the windows of `span_windows`; of a stream's updates (with `batch`) the last of each window counts."""
    if "batch" in windows.columns:
        rest = [c for c in windows.columns if c not in ("run_id", "w", "batch")]
        windows = windows.groupBy("run_id", "w").agg(F.max_by(F.struct(*rest), "batch").alias("x")).select("run_id", "w", "x.*")
    return windows.groupBy("run_id").agg(
        F.sum("n_spans").alias("n_spans"), F.round(F.sum("total_ms"), 2).alias("total_ms"), F.max("max_ms").alias("max_ms"), F.sum("n_failed").alias("n_failed"),
        F.min("failed")["step"].alias("first_failed_step"))
