"""Queries for evaluation and monitoring reports."""

from pyspark.sql import functions as F

from lexloom.operators import evaluate as A
from lexloom.plans.policy_plans import _own, _sql
from lexloom.plans.registry import query


def _arr(c):
    return F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ","))


def _results(t):
    return t.results.withColumn("predicted_domains", _arr("doms")).withColumn("citations", _arr("cites")).withColumn("missing_facts", _arr("mf"))


def _joined(t):
    return _results(t).join(t.gold.withColumn("gold_missing", _arr("gm")), "id")


LISTS = "lower(mf) AS p, lower(gm) AS g"
JOINED = """jn AS (SELECT r.*, g.* EXCLUDE (id), list_distinct(string_split(lower(mf), ',')) AS pl, list_distinct(string_split(lower(gm), ',')) AS gl FROM results r JOIN gold g USING (id)),
ov AS (SELECT *, CASE WHEN mf <> '' AND gm <> '' THEN len(list_intersect(gl, pl)) / len(gl) END AS ov FROM jn),
ir AS (SELECT *, CASE WHEN status NOT IN ('error', '') THEN 0.5 ELSE 0 END + CASE WHEN domain IS NULL OR contains(doms, domain) OR contains(domain, 'tax') AND contains(doms, 'tax') THEN 0.5 ELSE 0 END AS i0,
  CASE WHEN selected_rule_id IS NOT NULL THEN 0.5 ELSE 0 END + CASE WHEN cites <> '' THEN 0.5 ELSE 0 END AS r0, CASE WHEN proof_present THEN 0.5 ELSE 0 END + CASE WHEN v_forward <> 'N/A' THEN 0.25 ELSE 0 END + CASE WHEN v_rule = 'PASS' THEN 0.25 ELSE 0 END AS a0,
  least(1.0, CASE WHEN contains(mode, 'B') THEN CASE WHEN mf <> '' THEN 0.5 ELSE 0 END + CASE WHEN ov IS NOT NULL THEN 0.5 * ov WHEN mf <> '' THEN 0.25 ELSE 0 END
   ELSE CASE WHEN must_answer AND status = 'success' THEN 0.75 WHEN status IN ('success', 'partial') THEN 0.4 ELSE 0 END + CASE WHEN must_cite AND cites <> '' THEN 0.25 ELSE 0 END END) AS c0,
  CASE WHEN cites <> '' THEN 0.5 ELSE 0 END + CASE WHEN proof_present THEN 0.25 ELSE 0 END + CASE WHEN v_parse = 'PASS' THEN 0.25 ELSE 0 END AS l0 FROM ov),
sc AS (SELECT *, round(i0::DOUBLE, 4) AS "I", round(r0::DOUBLE, 4) AS "R", round(a0::DOUBLE, 4) AS "A", round(c0::DOUBLE, 4) AS "C", round(l0::DOUBLE, 4) AS "L" FROM ir),
s2 AS (SELECT *, round((i0::DOUBLE + r0::DOUBLE + a0::DOUBLE + c0::DOUBLE + l0::DOUBLE) / 5, 4) AS score, (cites <> '' AND proof_present)::INT AS grounded, proof_present::INT AS proof,
  CASE WHEN v_forward = 'N/A' AND v_rule = 'N/A' AND v_parse = 'N/A' AND v_answer = 'N/A' THEN 0 WHEN v_parse <> 'FAIL' AND v_answer <> 'FAIL' THEN 1 ELSE 0 END AS verified,
  CASE WHEN contains(mode, 'B') THEN CASE WHEN mf = '' THEN 0 WHEN gm = '' THEN 1 ELSE (ov >= 0.5)::INT END END AS missing_fact_correct FROM sc)"""
EV = ["results", "gold"]


@query("score_irac", f'WITH {JOINED} SELECT id, "I", "R", "A", "C", "L", score FROM s2', uses=EV)
def score_irac(t):
    return A.score_irac(_joined(t)).select("id", "I", "R", "A", "C", "L", "score")


@query("score_verifiability", f"WITH {JOINED} SELECT id, grounded, proof, verified, missing_fact_correct FROM s2", uses=EV)
def score_verifiability(t):
    return A.score_verifiability(_joined(t)).select("id", "grounded", "proof", "verified", "missing_fact_correct")


@query("score_tables", f"""WITH {JOINED} SELECT domain, question_group, CASE grouping_id(domain, question_group) WHEN 1 THEN 'domain' WHEN 2 THEN 'question_group' ELSE 'overall' END AS level, count(*) AS n, round(avg("I"), 4) AS "I", round(avg(score), 4) AS score,
  round(100.0 * avg(grounded), 1) AS grounded_pct, round(100.0 * avg(verified), 1) AS verified_pct, round(100.0 * avg(missing_fact_correct), 1) AS missing_fact_pct, count(missing_fact_correct) AS n_missing_fact FROM s2 GROUP BY GROUPING SETS ((domain), (question_group), ())""", uses=EV)
def score_tables(t):
    s = A.score_tables(A.score_verifiability(A.score_irac(_joined(t))))
    return s.select("domain", "question_group", "level", "n", "I", "score", "grounded_pct", "verified_pct", "missing_fact_pct", "n_missing_fact")


@query("gold_join", "SELECT id, CASE WHEN error IS NOT NULL THEN 'error' WHEN id IN (SELECT id FROM gold) THEN 'scored' ELSE 'no_gold' END AS part, CASE WHEN mf <> '' AND status <> '' THEN 'A+B' WHEN mf <> '' THEN 'B' ELSE 'A' END AS pred_mode FROM results", uses=EV)
def gold_join(t):
    r = t.results.withColumn("pred_mode", A.infer_mode("status", F.col("mf") != "")).select("id", "error", "pred_mode")
    parts = A.gold_join(r, t.gold.select("id"))
    out = [p.select("id", F.lit(n).alias("part"), "pred_mode") for p, n in zip(parts, ("scored", "no_gold", "error"))]
    return out[0].union(out[1]).union(out[2])


LG = """SELECT event_id, CASE WHEN event_type = 'view' THEN 'partial' WHEN event_type = 'error' THEN 'failed' ELSE 'Answered' END AS status, CASE WHEN event_id % 7 = 0 THEN 'forward_failed' WHEN event_id % 7 = 1 THEN 'unification_broken' WHEN event_id % 7 = 2 THEN 'some_partial' ELSE '' END AS error_stage,
  user_id % 3 <> 0 AS has_proof, CASE WHEN event_id % 5 = 0 THEN 'REPAIR' ELSE 'ACCEPT' END AS decision, CASE WHEN event_id % 11 = 0 THEN 'mock_mode' ELSE '' END AS nli_status, user_id % 8 = 0 AS no_reports,
  CASE cast(user_id % 4 AS int) WHEN 0 THEN '' WHEN 1 THEN 'tax, Shared' WHEN 2 THEN 'labor' ELSE 'tax' END AS act, CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('b', cast(event_id % 4 AS string)) END AS br,
  CASE WHEN event_id % 2 = 0 THEN '' ELSE event_type END AS pd, cast(event_id % 4 AS int) AS attempted, cast(event_id % 2 AS int) AS success, CASE WHEN event_id % 6 = 0 THEN NULL ELSE 1 END AS blocked, CASE WHEN event_id % 9 = 0 THEN ' ' ELSE 's' END AS grounding,
  CASE WHEN user_id % 5 = 0 THEN '' ELSE event_type END AS fd, concat('d', cast(user_id % 3 AS string)) AS td, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'br1' END AS tb FROM {events}"""


@query("quality_summary", f"""WITH l AS ({_own(LG)}), f AS (SELECT lower(status) = 'answered' AS an, contains(error_stage, 'forward') AND contains(error_stage, 'fail') AS fb, contains(error_stage, 'unification_broken') AS ub, NOT no_reports AND decision = 'ACCEPT' AND nli_status = '' AS cl, has_proof,
  status = 'partial' OR error_stage = 'forward_failed' OR (status = 'Answered' AND contains(error_stage, 'partial')) AS pa FROM l),
c AS (SELECT count(*) AS t, count(*) FILTER (an) AS a, count(*) FILTER (pa) AS p, count(*) FILTER (fb) AS f, count(*) FILTER (ub) AS u, count(*) FILTER (an AND NOT pa AND cl) AS v, count(*) FILTER (has_proof AND NOT cl) AS pu FROM f)
SELECT metric, n, round(n / t, 6) AS rate FROM (SELECT t, unnest(['rows_total','answered','partial','forward_failure_fallback','unification_broken','verified_final','proof_with_unverified_verification','answered_clean']) AS metric, unnest([t, a, p, f, u, v, pu, greatest(a - p, 0)]) AS n FROM c)""")
def quality_summary(t):
    rep = F.struct("decision", "nli_status")
    l = _sql(t, LG).withColumn("reports", F.when(F.col("no_reports"), F.array().cast("array<struct<decision:string,nli_status:string>>")).otherwise(F.array(rep)))
    return A.quality_summary(l)


def _xlogs(t):
    l = _sql(t, LG)
    tr = F.array(F.struct(F.col("fd").alias("from_domain"), F.col("td").alias("to_domain"), F.col("tb").alias("bridge_id")))
    return l.withColumn("activated", _arr("act")).withColumn("bridges", _arr("br")).withColumn("proof_domains", _arr("pd")).withColumn("transitions", tr)


@query("cross_domain_summary", f"""WITH l AS ({_own(LG)}) SELECT count(*) AS rows_total, count(*) FILTER (act <> '') AS with_domains, count(*) FILTER (br <> '') AS with_bridges, count(*) FILTER (contains(act, 'Shared')) AS with_shared, count(*) FILTER (pd <> '') AS with_proof_domains,
 count(*) FILTER (trim(grounding) <> '') AS with_grounding, sum(attempted)::BIGINT AS attempted, sum(success)::BIGINT AS success, sum(blocked)::BIGINT AS blocked, round(sum(success) / sum(attempted), 6) AS success_rate FROM l""")
def cross_domain_summary(t):
    return A.cross_domain_summary(_xlogs(t))


@query("cross_domain_frequencies", f"""WITH l AS ({_own(LG)}), k AS (SELECT 'domain' AS kind, trim(unnest(string_split(act, ','))) AS key FROM l WHERE act <> '' UNION ALL SELECT 'proof_domain', pd FROM l UNION ALL SELECT 'bridge', br FROM l
 UNION ALL SELECT 'pair', fd || '->' || td FROM l WHERE fd <> '' UNION ALL SELECT 'pair_bridge', fd || '->' || td || '::' || tb FROM l WHERE fd <> '' AND tb IS NOT NULL) SELECT kind, key, count(*) AS n FROM k WHERE key <> '' GROUP BY ALL""")
def cross_domain_frequencies(t):
    return A.cross_domain_frequencies(_xlogs(t))


@query("field_accuracy", "WITH f AS (SELECT 'focus' AS field, value > 20 AS ok FROM events UNION ALL SELECT 'goal', CASE WHEN user_id % 3 = 0 THEN NULL ELSE event_type = 'view' END FROM events) SELECT field, count(*) AS n_checked, count(*) FILTER (ok) AS n_pass, round(count(*) FILTER (ok) / count(*), 4) AS rate FROM f WHERE ok IS NOT NULL GROUP BY field")
def field_accuracy(t):
    m = F.create_map(F.lit("focus"), F.col("value") > 20, F.lit("goal"), F.when(F.col("user_id") % 3 != 0, F.col("event_type") == "view"))
    return A.field_accuracy(t.events.select(m.alias("checks")))


GAP = """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN event_type ELSE '' END AS snapshot, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'view' END AS wanted, event_id % 5 = 0 AS allow_stated, CASE WHEN event_type = 'error' THEN 'stated_condition' ELSE event_type END AS predicate,
  event_type = 'error' AS stated_used, CASE WHEN value > 100 THEN 0.9 ELSE value / 100 END AS confidence, CASE WHEN user_id % 6 = 0 THEN 'score_tie' ELSE '' END AS ambiguity, user_id FROM {events}"""
GAPC = """CASE WHEN snapshot <> '' AND predicate = snapshot THEN '' WHEN allow_stated AND stated_used THEN '' WHEN wanted IS NOT NULL AND predicate <> 'stated_condition' AND predicate <> wanted THEN 'wrong_predicate' WHEN wanted IS NOT NULL AND predicate = 'stated_condition' THEN 'missing_trigger'
  WHEN stated_used AND confidence >= 0.55 THEN 'too_generic' WHEN stated_used THEN 'missing_trigger' WHEN ambiguity = 'score_tie' OR (confidence < 0.72 AND confidence > 0.4) THEN 'ambiguous_condition' ELSE '' END"""


@query("gap_label", f"WITH g AS ({_own(GAP)}) SELECT event_id, {GAPC} AS gap_label FROM g")
def gap_label(t):
    return A.gap_label(_sql(t, GAP)).select("event_id", "gap_label")


@query("label_counts", f"WITH g AS ({_own(GAP)}), k AS (SELECT 'gap_label' AS kind, {GAPC} AS key FROM g UNION ALL SELECT 'tag', 't' || (user_id % 3) FROM g) SELECT kind, key, count(*) AS n FROM k WHERE key <> '' GROUP BY ALL UNION ALL SELECT 'fallback', '', count(*) FROM g WHERE stated_used")
def label_counts(t):
    g = A.gap_label(_sql(t, GAP)).withColumn("tags", F.array(F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")))).withColumn("fallback", F.col("stated_used"))
    return A.label_counts(g)


CS = """SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 'rule_reading' ELSE 'fact_application' END AS question_type, l_partkey % 13 = 0 AS backend_error, CASE WHEN l_suppkey % 3 = 0 THEN 'maximum recursion depth x' WHEN l_suppkey % 3 = 1 THEN '' ELSE concat('err ', l_returnflag) END AS error_detail,
  l_quantity > 10 AS useful, l_quantity > 20 AS has_rule_text, l_quantity > 30 AS has_application, l_discount > 0.03 AS grounded_answer, l_tax > 0.02 AS proof_present, l_tax > 0.04 AS verification_success,
  CASE l_returnflag WHEN 'A' THEN 'ACCEPT' WHEN 'R' THEN 'reject' ELSE 'REPAIR' END AS final_decision, CASE WHEN l_suppkey % 4 = 0 THEN 'justified_fallback' ELSE 'final' END AS application_status, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE 'R1' END AS selected_rule_id FROM {lineitem}"""


@query("calibrated_scores", f"""WITH c AS ({_own(CS)}), d AS (SELECT *, upper(final_decision) AS fd, application_status = 'justified_fallback' AS fb, selected_rule_id <> '' AS ru, NOT backend_error AS live FROM c),
e AS (SELECT *, (0.10 * useful::INT + 0.35 * has_rule_text::INT + 0.40 * CASE WHEN question_type = 'fact_application' THEN has_application::INT ELSE has_rule_text::INT END + 0.15 * grounded_answer::INT)::DOUBLE
   * CASE WHEN fd = 'ACCEPT' AND proof_present THEN 1.0 WHEN fd = 'REPAIR' AND verification_success THEN 0.8 WHEN fb THEN 0.68 WHEN fd = 'REJECT' AND ru AND grounded_answer THEN 0.6 ELSE 0.3 END AS ir,
  CASE WHEN grounded_answer AND fd <> 'REJECT' THEN 1.0 WHEN fb AND ru THEN 0.9 WHEN fd = 'REJECT' AND ru AND grounded_answer THEN 0.75 ELSE 0 END AS g, CASE WHEN NOT proof_present THEN 0 WHEN fd = 'ACCEPT' THEN 1.0 WHEN fd <> 'REJECT' THEN 0.9 WHEN fb THEN 0.85 WHEN ru THEN 0.75 ELSE 0 END AS p,
  CASE WHEN fd = 'ACCEPT' THEN 1.0 WHEN fb AND ru AND grounded_answer AND fd <> 'REJECT' THEN 0.9 WHEN fd = 'REPAIR' AND grounded_answer THEN 0.85 WHEN fd = 'REJECT' AND fb AND ru AND grounded_answer THEN 0.75 ELSE 0 END AS v FROM d)
SELECT question_type, count(*) AS total, count(*) FILTER (live) AS scored, count(*) FILTER (NOT live) AS crashed, round(100.0 * avg(useful::INT) FILTER (live), 1) AS useful_pct, round(100.0 * avg(has_rule_text::INT) FILTER (live), 1) AS rule_pct,
  round(avg(ir) FILTER (live), 4) AS irac, round(avg(g) FILTER (live), 4) AS grounded, round(avg(p) FILTER (live), 4) AS proof, round(avg(v) FILTER (live), 4) AS verification FROM e GROUP BY question_type""")
def calibrated_scores(t):
    return A.calibrated_scores(_sql(t, CS))


@query("crash_causes", f"WITH c AS ({_own(CS)}) SELECT CASE WHEN contains(error_detail, 'maximum recursion depth') THEN 'maximum recursion depth exceeded' WHEN error_detail = '' THEN 'unknown' ELSE error_detail END AS cause, count(*) AS n FROM c WHERE backend_error GROUP BY 1")
def crash_causes(t):
    return A.crash_causes(_sql(t, CS))


def _runs(t):
    c = _sql(t, CS).withColumn("run", F.concat(F.lit("run"), (F.col("l_orderkey") % 3).cast("string")))
    return A.run_summary(c, {"answered": F.col("useful"), "proof": F.col("proof_present"), "crashed": F.col("backend_error")})


RUNS = f"c AS (SELECT *, 'run' || (l_orderkey % 3) AS run FROM ({_own(CS)})), s AS (SELECT run, 'answered' AS metric, count(*) FILTER (useful) AS n FROM c GROUP BY 1 UNION ALL SELECT run, 'proof', count(*) FILTER (proof_present) FROM c GROUP BY 1 UNION ALL SELECT run, 'crashed', count(*) FILTER (backend_error) FROM c GROUP BY 1)"


@query("run_summary", f"WITH {RUNS} SELECT run, metric, n FROM s")
def run_summary(t):
    return _runs(t)


@query("run_delta", f"WITH {RUNS} SELECT metric, max(n) FILTER (run = 'run0') AS run0, max(n) FILTER (run = 'run1') AS run1, max(n) FILTER (run = 'run2') AS run2, max(n) FILTER (run = 'run2') - max(n) FILTER (run = 'run0') AS delta FROM s GROUP BY metric")
def run_delta(t):
    return A.run_delta(_runs(t), ["run0", "run1", "run2"])


def _traces(t):
    stage = F.when(F.col("l_linenumber") % 2 == 0, "parse_verification").otherwise("forward")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", stage.alias("stage"), F.when(F.col("l_returnflag") == "R", "REJECT").otherwise("ACCEPT").alias("decision"), F.col("l_tax").alias("score"), F.array("l_returnflag", "l_linestatus").alias("reasons"))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.array_sort(F.collect_list(row)).alias("trace"))


@query("reject_causes", """WITH t AS (SELECT * FROM lineitem WHERE l_linenumber % 2 = 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_returnflag = 'R' DESC, l_tax DESC) = 1)
SELECT l_orderkey AS case_id, l_tax AS score, l_returnflag || '; ' || l_linestatus AS reasons FROM t WHERE l_returnflag = 'R'""")
def reject_causes(t):
    return A.reject_causes(_traces(t))


@query("diagnosis_table", """WITH c AS (SELECT conv_id, max(CASE WHEN turn = 0 AND role = 'system' THEN 'top' END) AS f0, max(turn) FILTER (length(text) % 2 = 0) AS lt, bool_or(length(text) % 3 = 0) AS la, count(*) AS n, max(length(text)) AS m FROM conversations GROUP BY 1),
d AS (SELECT conv_id, unnest(['no_focus','empty_action','no_selected_rule','rule_without_proof','no_answer','degraded_answer']) AS diagnosis, unnest([f0 IS NULL AND lt IS NULL, NOT la, n <= 2, n > 2 AND m % 2 = 0, m % 5 = 0, m % 7 = 0]) AS hit FROM c)
SELECT diagnosis, count(*) AS n, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (rn <= 5) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY diagnosis ORDER BY conv_id) AS rn FROM d WHERE hit) GROUP BY diagnosis""")
def diagnosis_table(t):
    n = F.length("text")
    tr = F.struct("turn", F.when(n % 2 == 0, "f").alias("focus"), F.when(n % 3 == 0, "a").alias("action"))
    c = t.conversations.groupBy(F.col("conv_id").alias("case_id")).agg(
        F.max(F.when((F.col("turn") == 0) & (F.col("role") == "system"), "top")).alias("focus"), F.array_sort(F.collect_list(tr)).alias("trace"), F.count("*").alias("n"), F.max(n).alias("m"))
    c = c.select("case_id", "focus", F.lit(None).cast("string").alias("action"), "trace", (F.col("n") > 2).alias("has_rule"), (F.col("m") % 2 != 0).alias("has_proof"), (F.col("m") % 5 != 0).alias("has_answer"), (F.col("m") % 7 == 0).alias("degraded"))
    return A.diagnosis_table(c)


@query("stage_funnel", """WITH u AS (SELECT l_partkey AS k, count(*) AS units, count(*) FILTER (l_returnflag = 'A') AS flagged FROM lineitem GROUP BY 1), c AS (SELECT l_partkey AS k, count(DISTINCT l_orderkey) AS candidates FROM lineitem WHERE l_discount > 0.07 GROUP BY 1),
f AS (SELECT l_partkey AS k, count(DISTINCT l_orderkey) AS frames FROM lineitem WHERE l_discount > 0.08 GROUP BY 1), r AS (SELECT l_partkey AS k, count(DISTINCT l_orderkey) AS rules FROM lineitem WHERE l_discount > 0.09 GROUP BY 1),
j AS (SELECT k, coalesce(units, 0) AS units, coalesce(flagged, 0) AS flagged, coalesce(candidates, 0) AS candidates, coalesce(frames, 0) AS frames, coalesce(rules, 0) AS rules FROM u FULL JOIN c USING (k) FULL JOIN f USING (k) FULL JOIN r USING (k))
SELECT k AS article_key, units, flagged, candidates, frames, rules, CASE WHEN units = 0 OR (flagged = 0 AND candidates = 0) THEN 'no_content' WHEN candidates = 0 THEN 'lost_at_candidate' WHEN frames = 0 THEN 'lost_at_frame' WHEN rules = 0 THEN 'lost_at_rule'
  WHEN (flagged >= 4 AND rules <= greatest(1, flagged // 4)) OR (frames >= 3 AND rules = 1 AND candidates >= 2) THEN 'thin' ELSE 'complete' END AS status, flagged >= 3 AND rules <= 2 AS suspicious FROM j""")
def stage_funnel(t):
    l = t.lineitem.withColumnRenamed("l_partkey", "article_key")
    s = lambda x: l.filter(F.col("l_discount") > x).select("article_key", F.col("l_orderkey").alias("id"))
    return A.stage_funnel(l.select("article_key", (F.col("l_returnflag") == "A").alias("flagged")), s(0.07), s(0.08), s(0.09))


@query("rules_per_frame", "SELECT n_rules, count(*) AS n_frames FROM (SELECT frame_id, count(*) AS n_rules FROM seeds GROUP BY 1) GROUP BY 1", uses=["seeds"])
def rules_per_frame(t):
    return A.rules_per_frame(t.seeds)


@query("corpus_stats", "SELECT doc_code, count(DISTINCT doc_id) AS documents, count(DISTINCT (doc_id, chapter)) AS chapters, count(DISTINCT (doc_id, article)) AS articles, count(DISTINCT (doc_id, article, clause)) FILTER (clause IS NOT NULL) AS clauses, "
       "count(DISTINCT (doc_id, article, clause, point)) FILTER (clause IS NOT NULL AND point IS NOT NULL) AS points, count(*) AS units FROM clauses GROUP BY doc_code", uses=["clauses"])
def corpus_stats(t):
    return A.corpus_stats(t.clauses, "doc_code")


@query("stratified_sample", "WITH r AS (SELECT o_orderkey AS case_id, o_orderpriority AS domain, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS turn FROM orders) SELECT case_id, domain, turn::INT AS turn FROM r ORDER BY turn, domain LIMIT 33")
def stratified_sample(t):
    return A.stratified_sample(t.orders.select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("domain")), 33)


@query("trace_presence", """WITH e AS (SELECT l_orderkey AS case_id, 'R' || l_partkey AS rule_id FROM lineitem), n AS (SELECT case_id, count(*) AS n_retrieved, count(*) FILTER (rule_id IN (SELECT 'R' || s_suppkey FROM supplier)) AS in_canonical, count(*) FILTER (rule_id IN (SELECT 'R' || p_partkey FROM part)) AS in_runtime FROM e GROUP BY 1)
SELECT case_id, n_retrieved, in_canonical, in_runtime, (SELECT count(*) FROM part WHERE p_type = CASE WHEN case_id % 2 = 0 THEN 'SMALL' ELSE 'ABSENT' END) AS n_goal_rules FROM n""")
def trace_presence(t):
    cases = t.lineitem.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_list(F.concat(F.lit("R"), F.col("l_partkey").cast("string"))).alias("retrieved"))
    cases = cases.withColumn("goal", F.when(F.col("case_id") % 2 == 0, "SMALL").otherwise("ABSENT"))
    p = t.part.select(F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("rule_id"), F.col("p_type").alias("head_predicate"))
    return A.trace_presence(cases, t.supplier.select(F.concat(F.lit("R"), F.col("s_suppkey").cast("string")).alias("rule_id")), p)


@query("pending_cases", "SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_cases(t):
    return A.pending_cases(t.documents.select(F.col("doc_id").alias("id"), "source"), t.labels.select(F.col("doc_id").alias("id")))


CG = "SELECT o_orderkey AS case_id, concat('f', cast(o_orderkey % 3 AS string), ',f', cast(3 + o_custkey % 3 AS string)) AS b, concat('f', cast(o_custkey % 3 AS string), ',f5') AS a, cast(o_orderkey % 4 AS int) AS bs, cast(o_custkey % 5 AS int) AS az, o_orderstatus AS st, o_orderkey % 2 = 0 AS x, o_custkey % 2 = 0 AS y FROM {orders}"


@query("clarification_gain", f"WITH c AS ({_own(CG)}) SELECT case_id, array_to_string(list_sort(list_filter(string_split(b, ','), lambda v: NOT list_contains(string_split(a, ','), v))), ',') AS newly_satisfied, az - bs AS step_delta, st <> 'F' AS status_changed, y AND NOT x AS gained_answer, x AND NOT y AS gained_proof FROM c")
def clarification_gain(t):
    c = _sql(t, CG)
    before = c.select("case_id", F.split("b", ",").alias("missing"), F.col("bs").alias("n_steps"), F.lit("F").alias("status"), F.col("x").alias("has_answer"), F.col("y").alias("has_proof"))
    after = c.select("case_id", F.split("a", ",").alias("missing"), F.col("az").alias("n_steps"), F.col("st").alias("status"), F.col("y").alias("has_answer"), F.col("x").alias("has_proof"))
    return A.clarification_gain(before, after).withColumn("newly_satisfied", F.array_join("newly_satisfied", ","))


@query("answer_stats", """WITH a AS (SELECT d.source AS domain, quality * 0.5 + toxic * 0.25 AS score, text, doc_id % 3 = 0 AS hc, toxic = 1 AS ha, CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'A+B' END AS m FROM documents d JOIN labels USING (doc_id))
SELECT domain, count(*) AS n, round(avg(score)::DOUBLE, 4) AS score_avg, min(score)::DOUBLE AS score_min, max(score)::DOUBLE AS score_max, round(100.0 * count(*) FILTER (hc) / count(*), 1) AS citation_pct, round(100.0 * count(*) FILTER (ha) / count(*), 1) AS hallucination_pct, round(100.0 * count(*) FILTER (m = 'A') / count(*), 1) AS mode_a_pct,
  round(100.0 * count(*) FILTER (m = 'B') / count(*), 1) AS mode_b_pct, round(100.0 * count(*) FILTER (m = 'A+B') / count(*), 1) AS mode_ab_pct, round(avg(length(text)), 2) AS len_avg, min(length(text))::INT AS len_min, max(length(text))::INT AS len_max FROM a GROUP BY domain""")
def answer_stats(t):
    a = t.documents.join(t.labels, "doc_id").select(F.col("source").alias("domain"), (F.col("quality") * 0.5 + F.col("toxic") * 0.25).cast("double").alias("score"), F.col("text").alias("answer"), (F.col("doc_id") % 3 == 0).alias("has_citation"), (F.col("toxic") == 1).alias("hallucination"),
                                                    F.expr("CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'A+B' END").alias("mode"))
    return A.answer_stats(a)


@query("integrity_report", """WITH d AS (SELECT count(*) AS n FROM clauses WHERE clause IS NOT NULL AND point IS NULL GROUP BY doc_id, article, clause HAVING n > 1), p AS (SELECT count(*) AS n FROM clauses WHERE clause IS NOT NULL AND point IS NOT NULL GROUP BY doc_id, article, clause, point HAVING n > 1),
o AS (SELECT DISTINCT doc_id, article, clause FROM clauses c WHERE clause IS NOT NULL AND point IS NOT NULL AND NOT EXISTS (SELECT 1 FROM clauses x WHERE x.point IS NULL AND x.doc_id = c.doc_id AND x.article = c.article AND x.clause = c.clause)), m AS (SELECT count(DISTINCT doc_id) AS n FROM clauses GROUP BY article HAVING n > 1)
SELECT 'duplicate_clause' AS kind, count(*) AS n_keys, coalesce(max(n), 0) AS n_max, coalesce(sum(n - 1), 0)::BIGINT AS n_extra FROM d UNION ALL SELECT 'duplicate_point', count(*), coalesce(max(n), 0), coalesce(sum(n - 1), 0)::BIGINT FROM p UNION ALL SELECT 'orphan_point_clause', count(*), 0, 0 FROM o UNION ALL SELECT 'article_in_many_documents', count(*), coalesce(max(n), 0), coalesce(sum(n - 1), 0)::BIGINT FROM m""", uses=["clauses"])
def integrity_report(t):
    return A.integrity_report(t.clauses)


SLOTS = ["canonical_predicate", "action", "effect", "metric", "condition"]


@query("slot_fill_rates", " UNION ALL ".join(f"SELECT '{c}' AS slot, count(*) FILTER (trim(coalesce({c}, '')) <> '') AS filled, count(*) FILTER (trim(coalesce({c}, '')) = '') AS blank FROM seeds" for c in SLOTS), uses=["seeds"])
def slot_fill_rates(t):
    return A.slot_fill_rates(t.seeds, SLOTS)


@query("value_counts", "SELECT slot, value, count(*) AS n FROM (SELECT 'rule_type' AS slot, rule_type AS value FROM seeds UNION ALL SELECT 'family', coalesce(nullif(family, ''), '(blank)') FROM seeds UNION ALL SELECT 'unit', coalesce(unit, '(blank)') FROM seeds) GROUP BY ALL", uses=["seeds"])
def value_counts(t):
    return A.value_counts(t.seeds, ["rule_type", "family", "unit"])


@query("trace_rollup", """SELECT user_id AS run_id, count(*) AS n_spans, round(sum(value), 2) AS total_ms, max(value) AS max_ms, count(*) FILTER (event_type = 'error') AS n_failed, arg_min('step' || (event_id % 6), event_id) FILTER (event_type = 'error') AS first_failed_step FROM events GROUP BY user_id""")
def trace_rollup(t):
    s = t.events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.concat(F.lit("step"), (F.col("event_id") % 6).cast("string")).alias("step"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("value").alias("duration_ms"))
    return A.trace_rollup(s)


@query("run_records", "SELECT event_id AS case_id, event_type AS status, 'a' || user_id AS answer_text, 'R' || user_id || ',R1' AS rule_ids, event_type AS goal_predicate, 'm' || (event_id % 3) AS missing_facts, 'parse=ACCEPT;rule=' || event_type AS decisions, CASE WHEN event_type = 'error' THEN 'E' || user_id END AS failure_code FROM events")
def run_records(t):
    e = t.events
    s = lambda p: F.concat(F.lit(p), F.col("user_id").cast("string"))
    rep = lambda st, d: F.struct(F.lit(st).alias("stage"), d.alias("decision"))
    r = e.select(F.col("event_id").alias("case_id"), F.col("event_type").alias("status"), F.struct(s("a").alias("text")).alias("answer"), F.array(s("R"), F.lit("R1")).alias("rules"), F.struct(F.col("event_type").alias("predicate")).alias("goal"),
                 F.array(F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string"))).alias("missing"), F.array(rep("parse", F.lit("ACCEPT")), rep("rule", F.col("event_type"))).alias("reports"), F.struct(F.when(F.col("event_type") == "error", s("E")).alias("code")).alias("failure"))
    return A.run_records(r)


@query("audit_summary", """WITH k AS (SELECT 'status' AS kind, event_type AS key FROM events UNION ALL SELECT 'quality', 'q' || (user_id % 4) FROM events UNION ALL SELECT 'warning', 'w' || (user_id % 25) FROM events UNION ALL SELECT 'warning', 'w' || (event_id % 30) FROM events UNION ALL SELECT 'reason', 'r' || (user_id % 15) FROM events WHERE event_id % 2 = 0
 UNION ALL SELECT 'error_stage', 's' || (user_id % 13) FROM events WHERE event_type = 'error'), n AS (SELECT kind, key, count(*) AS n FROM k GROUP BY ALL)
SELECT kind, key, n FROM n QUALIFY kind IN ('status', 'quality') OR row_number() OVER (PARTITION BY kind ORDER BY n DESC, key) <= 10""")
def audit_summary(t):
    m = lambda p, c, k: F.concat(F.lit(p), (F.col(c) % k).cast("string"))
    r = t.events.select(F.col("event_type").alias("status"), m("q", "user_id", 4).alias("quality"), F.array(m("w", "user_id", 25), m("w", "event_id", 30)).alias("warnings"), F.when(F.col("event_id") % 2 == 0, F.array(m("r", "user_id", 15))).alias("reasons"),
                        F.when(F.col("event_type") == "error", m("s", "user_id", 13)).alias("error_stage"))
    return A.audit_summary(r)


@query("stage_drop", """WITH c AS (SELECT conv_id AS run_id, turn AS seq, role || turn AS stage, length(text) % 3 <> 0 AS ok FROM conversations), g AS (SELECT run_id, count(*) AS n_stages, arg_max(stage, seq) FILTER (ok) AS last_answer_stage, min(seq) FILTER (ok) AS f FROM c GROUP BY 1),
l AS (SELECT c.run_id, arg_min(stage, seq) AS lost_at FROM c JOIN g USING (run_id) WHERE NOT ok AND seq > f GROUP BY 1) SELECT run_id, n_stages, last_answer_stage, lost_at FROM g LEFT JOIN l USING (run_id)""")
def stage_drop(t):
    c = t.conversations.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.concat("role", F.col("turn").cast("string")).alias("stage"), (F.length("text") % 3 != 0).alias("has_answer"))
    return A.stage_drop(c)
