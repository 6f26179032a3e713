"""Queries for sources, sinks and the session stream."""

from datetime import timedelta

from pyspark.sql import functions as F

from lexloom.common import scratch_path
from lexloom.plans.registry import query
from lexloom.sources import readers, sinks
from lexloom.streaming import keyed_state
from lexloom.streaming.session_facts import latest_updates
from lexloom.streaming.session_facts import session_facts as latest_facts
from lexloom.streaming.session_facts import session_facts_stream as stream_facts


def _scratch(t, name):
    return scratch_path(t.spark, name)


@query("read_rules", """SELECT rule_id || '_' || p_partkey AS rule_id, CASE WHEN p_size % 6 = 0 THEN 'unknown' ELSE logic_form END AS logic_form, CASE WHEN head_predicate = '' THEN 'unknown' ELSE head_predicate END AS predicate FROM rules WHERE p_partkey % 9 <> 0""", uses=["rules"])
def read_rules(t):
    path = _scratch(t, "rules")
    row = F.to_json(F.struct(F.concat("rule_id", F.lit("_"), F.col("p_partkey").cast("string")).alias("rule_id"), F.when(F.col("p_size") % 6 != 0, F.col("logic_form")).alias("logic_form"),
                             F.struct(F.col("head_predicate").alias("predicate"), F.array("p_name").alias("args")).alias("head")))
    t.rules.select(F.when(F.col("p_partkey") % 9 == 0, F.lit("{broken")).otherwise(row).alias("value")).write.text(path)
    good, _ = readers.read_rules(t.spark, path)
    return good.select("rule_id", "logic_form", F.col("head.predicate").alias("predicate"))


@query("read_chunks", "SELECT item_id::VARCHAR AS chunk_id, text, article FROM chunks WHERE trim(text) <> ''", uses=["chunks"])
def read_chunks(t):
    path = _scratch(t, "chunks")
    sinks.write_jsonl(t.chunks.select(F.col("item_id").cast("string").alias("chunk_id"), "text", "article"), path)
    return readers.read_chunks(t.spark, path).select("chunk_id", "text", "article")


@query("pack_counts", "SELECT replace(doc_code, ' ', '_') AS doc_key, count(*) AS rule_count FROM seeds GROUP BY 1", uses=["seeds"])
def pack_counts(t):
    return sinks.pack_counts(t.seeds)


@query("flat_columns", "SELECT event_id, event_type, '[\"' || event_type || '\",null]' AS tags, '{\"user\":' || user_id || ',\"kind\":null}' AS info, NULL::VARCHAR AS absent FROM events")
def flat_columns(t):
    none = F.lit(None).cast("string")
    e = t.events.select("event_id", "event_type", F.array("event_type", none).alias("tags"), F.struct(F.col("user_id").alias("user"), none.alias("kind")).alias("info"))
    return sinks.flat_columns(e, ["event_id", "event_type", "tags", "info", "absent"])


@query("review_table", "SELECT rule_id, CASE rule_type WHEN 'quy_tac_ho_so' THEN 'Hồ sơ' ELSE rule_type END AS rule_type, summary || ' ' AS summary, CASE WHEN condition IS NOT NULL THEN 'co' ELSE 'khong' END AS has_condition FROM seeds", uses=["seeds"])
def review_table(t):
    s = t.seeds.select("rule_id", "rule_type", F.concat("summary", F.lit("\x07 \x01")).alias("summary"), F.col("condition").isNotNull().alias("has_condition"))
    return sinks.review_table(s, ["rule_id", "rule_type", "summary", "has_condition"], {"rule_type": {"quy_tac_ho_so": "Hồ sơ"}})


@query("read_review_table", "SELECT doc_id, coalesce(nullif(lang, 'en'), 'und') AS lang, doc_id % 3 = 0 AS flag, CASE WHEN doc_id % 4 <> 0 THEN n_chars::INT END AS n_chars, text FROM (SELECT doc_id::VARCHAR AS sid, * FROM documents)")
def read_review_table(t):
    path = _scratch(t, "review")
    d = t.documents.select("doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("lang"), (F.col("doc_id") % 3 == 0).alias("flag"), F.when(F.col("doc_id") % 4 != 0, F.col("n_chars").cast("string")).otherwise("n/a").alias("n_chars"), "text")
    sinks.write_review_table(sinks.review_table(d, ["doc_id", "lang", "flag", "n_chars", "text"]), path)
    r = readers.read_review_table(t.spark, path, ["doc_id", "text"], ["flag"], ["n_chars"], {"lang": "und"})
    return r.withColumn("doc_id", F.col("doc_id").cast("bigint"))


SESS = """WITH e AS (SELECT user_id AS session_id, CASE WHEN event_id % 17 = 0 THEN '' ELSE event_type || (event_id % 3) END AS k, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'v' || (event_id % 7) END AS v, event_id AS seq FROM events)
SELECT session_id, k AS fact_key, coalesce(v, 'true') AS value, seq FROM e WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY session_id, k ORDER BY seq DESC) = 1"""


def _answers(e, at=None):
    key = F.when(F.col("event_id") % 17 == 0, "").otherwise(F.concat("event_type", (F.col("event_id") % 3).cast("string")))
    val = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("v"), (F.col("event_id") % 7).cast("string")))
    return e.select(F.col("user_id").alias("session_id"), key.alias("fact_key"), val.alias("value"), F.col("event_id").alias("seq"), *([F.col(at).alias("at")] if at else []))


@query("session_facts", SESS)
def session_facts(t):
    return latest_facts(_answers(t.events))


@query("session_facts_stream", SESS)
def session_facts_stream(t):
    """The stream over the whole events table, run to its end in several micro-batches; last update per key."""
    out, ckpt, src = _scratch(t, "facts"), _scratch(t, "facts_ckpt"), _scratch(t, "events")
    t.events.repartition(4, "event_id").write.parquet(src)
    stream_facts(_answers(t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(src)), out, ckpt).awaitTermination()
    return latest_updates(t.spark.read.parquet(out))


TTL_DAYS = 6
TIMED = f"""WITH e AS (SELECT user_id AS session_id, CASE WHEN event_id % 17 = 0 THEN '' ELSE event_type || (event_id % 3) END AS k, CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'v' || (event_id % 7) END AS v, event_id AS seq, ts FROM events),
l AS (SELECT session_id, k AS fact_key, coalesce(v, 'true') AS value, seq, ts FROM e WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY session_id, k ORDER BY ts DESC, seq DESC) = 1)
SELECT session_id, fact_key, value, seq FROM l WHERE ts + INTERVAL {TTL_DAYS} DAY > (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""


def _slices(t, name, n=4):
    """The events table in n runs of time, written one after the other, as they would arrive."""
    src = _scratch(t, name)
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    for i in range(n):
        part = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(low))) * n / (F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)) + 1))
        events.where(part == i).coalesce(1).write.mode("append").parquet(src)
    return t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src), high


@query("session_facts_keyed", TIMED)
def session_facts_keyed(t):
    """Session facts that expire six days after their last answer, kept as keyed state over the whole events table."""
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed_state.STORE)
    events, high = _slices(t, "timed_events")
    out = _scratch(t, "timed_facts")
    keyed_state.start_updates(keyed_state.keyed_facts(_answers(events, "ts"), TTL_DAYS * 86_400_000, "1 hour"), out, _scratch(t, "timed_ckpt")).awaitTermination()
    return keyed_state.living_facts(t.spark.read.parquet(out), high - timedelta(hours=1), TTL_DAYS * 86_400_000)


@query("trace_rollup_stream", """SELECT user_id AS run_id, count(*) AS n_spans, round(sum(value), 2) AS total_ms, max(value) AS max_ms, count(*) FILTER (event_type = 'error') AS n_failed, arg_min('step' || (event_id % 6), event_id) FILTER (event_type = 'error') AS first_failed_step FROM events GROUP BY user_id""")
def trace_rollup_stream(t):
    """The rollup of spans as a stream with a watermark, over the whole events table in four micro-batches."""
    events, _ = _slices(t, "spans")
    spans = events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.concat(F.lit("step"), (F.col("event_id") % 6).cast("string")).alias("step"),
                          F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("value").alias("duration_ms"), F.col("ts").alias("at"))
    out = _scratch(t, "span_windows")
    keyed_state.start_updates(keyed_state.span_windows(spans, "1 hour", "2 hours"), out, _scratch(t, "spans_ckpt")).awaitTermination()
    return keyed_state.rollup_windows(t.spark.read.parquet(out))
