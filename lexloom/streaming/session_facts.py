"""Latest value per (session, fact key): batch, a stream without state, and a stateful stream with expiry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.common import is_blank

OUT = "session_id bigint, fact_key string, value string, seq bigint"


def prepared(answers: DataFrame, *more: str) -> DataFrame:
    """Blank keys are ignored; an answer without a value states the fact as true. Reads session_id, fact_key, value, seq, and more."""
    return answers.filter(~is_blank("fact_key")).select("session_id", F.trim("fact_key").alias("fact_key"), F.coalesce("value", F.lit("true")).alias("value"), "seq", *more)


def _latest(df: DataFrame) -> DataFrame:
    last = F.max(F.struct("seq", "value"))
    return df.groupBy("session_id", "fact_key").agg(last.alias("l")).select("session_id", "fact_key", F.col("l.value").alias("value"), F.col("l.seq").alias("seq"))


def session_facts(answers: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Batch: last answer by seq. initial(session_id, fact_key) are user facts that start as true."""
    a = prepared(answers)
    if initial is not None:
        a = a.unionByName(initial.select("session_id", "fact_key", F.lit("true").alias("value"), F.lit(-1).cast("bigint").alias("seq")))
    return _latest(a)


def session_facts_stream(answers: DataFrame, updates: str, checkpoint: str) -> StreamingQuery:
    """Start a stream that appends, per micro-batch, the last answer of each key to the Parquet table `updates`.

    The stream keeps no state: `latest_updates` folds the table, which may be compacted at any time. Batches are written
    to a folder of their own, so a batch that is repeated after a failure replaces itself.
    """
    def write(batch: DataFrame, number: int) -> None:
        _latest(batch).write.mode("overwrite").parquet(f"{updates}/batch={number}")

    return prepared(answers).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def latest_updates(updates: DataFrame) -> DataFrame:
    return _latest(updates)


def session_facts_expiring(answers: DataFrame, ttl_ms: int) -> DataFrame:
    """Stateful stream that forgets a fact `ttl_ms` after its last answer (our addition; update mode)."""
    def step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else (-(1 << 62), "")
        for pdf in rows:
            i = pdf["seq"].idxmax()
            best = max(best, (int(pdf.at[i, "seq"]), str(pdf.at[i, "value"])), key=lambda x: x[0])
        state.update(best)
        state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame({"session_id": [key[0]], "fact_key": [key[1]], "value": [best[1]], "seq": [best[0]]})

    return prepared(answers).groupBy("session_id", "fact_key").applyInPandasWithState(step, OUT, "seq long, value string", "update", GroupStateTimeout.ProcessingTimeTimeout)
