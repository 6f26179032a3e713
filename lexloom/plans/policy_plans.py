"""Queries for policies over candidate tables."""

from pyspark.sql import functions as F

from lexloom.operators import policy as P
from lexloom.plans.registry import query


def _sql(t, text, **extra):
    return t.spark.sql(text, **{n: getattr(t, n) for n in ("orders", "lineitem", "customer", "supplier", "nation", "part", "events", "conversations", "documents", "labels") if "{" + n + "}" in text}, **extra)


def _own(text):
    for n in ("orders", "lineitem", "customer", "supplier", "nation", "part", "events", "conversations", "documents", "labels"):
        text = text.replace("{" + n + "}", n)
    return text


CAND = """SELECT l_orderkey AS case_id, concat('R', cast(l_partkey AS string), '_', cast(l_suppkey AS string)) AS rule_id, o_orderdate AS asked_at, l_extendedprice / 1000 AS score, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_partkey % 7 = 0 THEN 'n/a' WHEN l_partkey % 7 = 1 THEN NULL ELSE cast(cast(date_trunc('month', l_shipdate) AS date) AS string) END AS valid_from,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE concat(cast(year(l_shipdate) AS string), '-12-31') END AS valid_to,
  l_partkey % 4 = 0 AS has_exceptions, l_suppkey % 5 = 0 AS has_overrides, CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE cast(l_quantity AS int) END AS priority
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""
REASON = """CASE WHEN try_cast(valid_from AS TIMESTAMP) IS NOT NULL AND asked_at < try_cast(valid_from AS TIMESTAMP) THEN 'not_yet_effective' WHEN try_cast(valid_to AS TIMESTAMP) IS NOT NULL AND asked_at > try_cast(valid_to AS TIMESTAMP) THEN 'expired' ELSE '' END"""


@query("temporal_filter", f"WITH c AS ({_own(CAND)}) SELECT case_id, rule_id, l_linenumber FROM c WHERE {REASON} = ''")
def temporal_filter(t):
    return P.temporal_filter(_sql(t, CAND), at="asked_at")[0].select("case_id", "rule_id", "l_linenumber")


@query("temporal_rejected", f"WITH c AS ({_own(CAND)}) SELECT case_id, rule_id, l_linenumber, {REASON} AS temporal_reason FROM c WHERE {REASON} <> ''")
def temporal_rejected(t):
    return P.temporal_filter(_sql(t, CAND), at="asked_at")[1].select("case_id", "rule_id", "l_linenumber", "temporal_reason")


@query("rescore_rules", f"""WITH c AS ({_own(CAND)}) SELECT case_id, rule_id, l_linenumber, round(score + CASE WHEN {REASON} = '' THEN 0.2 ELSE -0.5 END + CASE WHEN has_exceptions THEN 0.1 ELSE 0 END
  + CASE WHEN has_overrides THEN 0.1 ELSE 0 END + 0.01 * (coalesce(priority, 50) - 50), 6) AS rescored FROM c""")
def rescore_rules(t):
    return P.rescore_rules(_sql(t, CAND).withColumnRenamed("asked_at", "at")).select("case_id", "rule_id", "l_linenumber", F.round("rescored", 6).alias("rescored"))


CONF = """SELECT l_suppkey AS case_id, concat('R', cast(l_orderkey AS string), '_', cast(l_linenumber AS string), '_', cast(l_partkey AS string)) AS rule_id, l_returnflag AS head_predicate, cast(l_partkey % 5 AS string) AS arg,
  CASE WHEN l_linenumber = 2 THEN concat('R', cast(l_orderkey AS string), '_1_', cast(l_partkey AS string)) WHEN l_linenumber = 7 THEN concat('R', cast(l_orderkey AS string), '_7_', cast(l_partkey AS string)) END AS exception_of,
  CASE WHEN l_linenumber = 5 THEN concat('R', cast(l_orderkey AS string), '_5_', cast(l_partkey AS string)) ELSE 'none' END AS override_id,
  l_tax AS compatibility, cast(l_quantity AS int) AS priority, least(2.0, 0.15 + 0.03 * l_linenumber) AS specificity, l_extendedprice AS score FROM {lineitem}"""


@query("prune_conflicts", f"""WITH c AS ({_own(CONF)}), k AS (SELECT DISTINCT case_id, head_predicate, arg, rule_id FROM c),
b AS (SELECT c.*, EXISTS (SELECT 1 FROM k WHERE k.case_id = c.case_id AND k.head_predicate = c.head_predicate AND k.arg = c.arg AND k.rule_id = c.exception_of)::INT AS eb,
  EXISTS (SELECT 1 FROM k WHERE k.case_id = c.case_id AND k.head_predicate = c.head_predicate AND k.arg = c.arg AND k.rule_id = c.override_id)::INT AS ob FROM c),
w AS (SELECT *, count(*) OVER (PARTITION BY case_id, head_predicate, arg) AS n, first_value(rule_id) OVER (PARTITION BY case_id, head_predicate, arg ORDER BY eb DESC, ob DESC, compatibility DESC, priority DESC, specificity DESC, score DESC, rule_id) AS winner_rule_id FROM b)
SELECT case_id, rule_id, winner_rule_id, CASE WHEN n = 1 THEN 'unique_in_bucket' WHEN rule_id = winner_rule_id THEN 'winner' ELSE 'conflict_lower_rank' END AS status FROM w""")
def prune_conflicts(t):
    c = _sql(t, CONF).withColumn("head_args", F.array("arg")).withColumn("overrides", F.array("override_id"))
    return P.prune_conflicts(c).select("case_id", "rule_id", "winner_rule_id", "status")


QS = """SELECT conv_id * 100 + turn AS question_id, text, CASE WHEN turn = 2 THEN 'tax_question' WHEN turn = 3 THEN 'employment' ELSE '' END AS intent, CASE WHEN conv_id % 9 = 0 THEN 'labor' WHEN conv_id % 9 = 1 THEN 'nothing' END AS user_hint FROM {conversations}"""
TAXW, LABW = ["tion", "avec"], ["then", "keit"]
BR = [P.Bridge("b_tax", ["ing", "heit"]), P.Bridge("b_labor", [r"th[a-z]+\s+of"]), P.Bridge("b_other", ["zzz"])]


@query("match_bridges", f"""WITH q AS ({_own(QS)}) SELECT question_id, concat_ws(',', CASE WHEN regexp_matches(lower(text), 'ing|heit') THEN 'b_tax' END, CASE WHEN regexp_matches(lower(text), 'th[a-z]+\\s+of') THEN 'b_labor' END) AS bridges FROM q""")
def match_bridges(t):
    return P.match_bridges(_sql(t, QS), BR).select("question_id", F.array_join("bridges", ",").alias("bridges"))


@query("route_domains", f"""WITH q AS ({_own(QS)}), b AS (SELECT *, regexp_matches(lower(text), 'ing|heit') AS bt, regexp_matches(lower(text), 'th[a-z]+\\s+of') AS bl FROM q),
h AS (SELECT *, len(regexp_extract_all(lower(text), 'tion|avec')) + CASE WHEN contains(intent, 'tax') THEN 2 ELSE 0 END + bt::INT AS tx, len(regexp_extract_all(lower(text), 'then|keit')) + CASE WHEN intent = 'employment' THEN 2 ELSE 0 END + bl::INT AS lb FROM b),
o AS (SELECT *, coalesce(user_hint = 'labor', false) AS hint, CASE WHEN bt OR bl THEN 'bridges:' || concat_ws(',', CASE WHEN bt THEN 'b_tax' END, CASE WHEN bl THEN 'b_labor' END) END AS via FROM h)
SELECT question_id, CASE WHEN hint THEN 'labor' WHEN tx > 0 AND lb > 0 THEN CASE WHEN tx >= lb THEN 'tax' ELSE 'labor' END WHEN tx > 0 THEN 'tax' WHEN lb > 0 THEN 'labor' ELSE 'enterprise' END AS primary_domain,
  CASE WHEN NOT hint AND tx > 0 AND lb > 0 THEN CASE WHEN tx >= lb THEN 'labor' ELSE 'tax' END END AS secondary_domain,
  round((CASE WHEN hint THEN 1.0 WHEN tx > 0 AND lb > 0 THEN least(0.95, 0.55 + 0.1 * greatest(tx, lb)) WHEN tx > 0 THEN least(0.95, 0.5 + 0.1 * tx) WHEN lb > 0 THEN least(0.95, 0.5 + 0.1 * lb) ELSE 0.35 END)::DOUBLE, 4) AS confidence,
  CASE WHEN hint THEN 'user_domain_selection' ELSE concat_ws(';', via, CASE WHEN tx > 0 AND lb > 0 THEN CASE WHEN tx >= lb THEN 'mixed_signals_tax_primary' ELSE 'mixed_signals_labor_primary' END WHEN tx > 0 THEN 'keyword_tax' WHEN lb > 0 THEN 'keyword_labor' ELSE 'default_enterprise' END) END AS reasons FROM o""")
def route_domains(t):
    r = P.route_domains(P.match_bridges(_sql(t, QS), BR), TAXW, LABW)
    return r.select("question_id", "primary_domain", "secondary_domain", "confidence", F.array_join("reasons", ";").alias("reasons"))


EM = [P.BridgeFact("b_tax", ["tion"], "taxpayer({entity})", "taxpayer(x)"), P.BridgeFact("b_labor", ["the"], "employer({entity})", None), P.BridgeFact("b_tax", ["that"], None, "taxpayer(x)")]


@query("emit_bridge_facts", """
WITH c AS (SELECT conv_id * 1000 + turn AS case_id, text, regexp_matches(lower(text), 'ing|heit') AS bt, regexp_matches(lower(text), 'th[a-z]+\\s+of') AS bl FROM conversations),
d AS (SELECT *, NOT bt AND NOT bl AS fr FROM c), e AS (SELECT conv_id * 1000 + turn AS case_id, role || turn AS entity, turn AS n FROM conversations WHERE role <> 'system'),
f AS (SELECT case_id, 0 AS no, 'b_tax' AS b, 'taxpayer(' AS tp, 'taxpayer(x)' AS fb FROM d WHERE (fr OR bt) AND contains(lower(text), 'tion') UNION ALL SELECT case_id, 1, 'b_labor', 'employer(', NULL FROM d WHERE (fr OR bl) AND contains(lower(text), 'the')
  UNION ALL SELECT case_id, 2, 'b_tax', NULL, 'taxpayer(x)' FROM d WHERE (fr OR bt) AND contains(lower(text), 'that')),
g AS (SELECT case_id, no, n, b, tp || entity || ')' AS fact_key FROM f JOIN e USING (case_id) WHERE tp IS NOT NULL),
h AS (SELECT * FROM g UNION ALL SELECT case_id, no, 0, b, fb FROM f WHERE fb IS NOT NULL AND (case_id, no) NOT IN (SELECT (case_id, no) FROM g)
  UNION ALL SELECT case_id, 3, 0, 'b_labor', 'declared(k)' FROM d WHERE fr OR bl)
SELECT case_id, fact_key, b AS bridge_id FROM h QUALIFY row_number() OVER (PARTITION BY case_id, fact_key ORDER BY no, n, b) = 1""")
def emit_bridge_facts(t):
    c = t.conversations
    cases = P.match_bridges(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), "text"), BR)
    ent = c.filter("role <> 'system'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("case_id"), F.concat("role", F.col("turn").cast("string")).alias("entity"), F.col("turn").alias("pos"))
    return P.emit_bridge_facts(cases, ent, EM, {"b_labor": ["declared(k)"]})


PC = """SELECT l_suppkey AS case_id, concat('R', cast(l_partkey AS string)) AS rule_id, CASE cast(l_partkey % 4 AS int) WHEN 0 THEN 'tax' WHEN 1 THEN 'labor' WHEN 2 THEN 'shared' ELSE 'enterprise' END AS domain,
  CASE WHEN l_partkey % 11 = 0 THEN 'shared' ELSE 'domain' END AS layer, CASE WHEN l_partkey % 13 = 0 THEN 'tax' ELSE '' END AS scope, max(l_extendedprice) AS score FROM {lineitem} GROUP BY 1, 2, 3, 4, 5"""
CX = "SELECT s_suppkey AS case_id, CASE WHEN s_suppkey % 2 = 0 THEN 'tax' ELSE 'enterprise' END AS p1, CASE WHEN s_suppkey % 3 = 0 THEN 'labor' ELSE 'tax' END AS s1, s_suppkey % 5 <> 0 AS include_shared, s_suppkey % 4 AS nb FROM {supplier}"
OKC = "(include_shared AND (layer = 'shared' OR scope = 'shared' OR domain = 'shared')) OR domain = p1 OR (scope <> '' AND scope = p1)"


def _ctx(t):
    return _sql(t, CX).select("case_id", F.array("p1").alias("primary_domains"), F.array("s1").alias("secondary_domains"), "include_shared",
                              F.when(F.col("nb") == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("b"))).alias("bridges"))


@query("primary_filter", f"WITH c AS ({_own(PC)}), x AS ({_own(CX)}) SELECT case_id, rule_id, {OKC} AS kept FROM c JOIN x USING (case_id)")
def primary_filter(t):
    kept, rej = P.primary_filter(_sql(t, PC), _ctx(t))
    return kept.select("case_id", "rule_id", F.lit(True).alias("kept")).union(rej.select("case_id", "rule_id", F.lit(False)))


@query("secondary_merge", f"WITH c AS ({_own(PC)}), x AS ({_own(CX)}), j AS (SELECT *, {OKC} AS ok FROM c JOIN x USING (case_id)) SELECT case_id, rule_id, false AS expanded FROM j WHERE ok UNION ALL SELECT case_id, rule_id, true FROM j WHERE NOT ok AND nb <> 0 AND domain = s1")
def secondary_merge(t):
    kept, _ = P.primary_filter(_sql(t, PC), _ctx(t))
    return P.secondary_merge(kept, _sql(t, PC), _ctx(t)).select("case_id", "rule_id", "expanded")


BG = "SELECT concat('B', cast(n_nationkey AS string)) AS bridge_id, concat('d', cast(n_regionkey AS string)) AS from_domain, concat('d', cast(n_nationkey % 4 AS string)) AS to_domain, n_nationkey % 6 AS priority, n_nationkey % 3 <> 0 AS applicable FROM {nation}"
BC = "SELECT c_custkey AS case_id, concat('d', cast(c_nationkey % 5 AS string)) AS target_domain FROM {customer}"


@query("best_bridge", f"WITH b AS ({_own(BG)}), c AS ({_own(BC)}), w AS (SELECT to_domain, bridge_id FROM b WHERE applicable QUALIFY row_number() OVER (PARTITION BY to_domain ORDER BY priority DESC, bridge_id) = 1) "
       "SELECT case_id, target_domain, bridge_id, CASE WHEN bridge_id IS NULL THEN 'no_applicable_bridge_to_' || target_domain ELSE 'bridge_crossing_succeeded' END AS reason FROM c LEFT JOIN w ON target_domain = to_domain")
def best_bridge(t):
    return P.best_bridge(_sql(t, BC), _sql(t, BG)).select("case_id", "target_domain", "bridge_id", "reason")


@query("exposed_facts", f"WITH b AS ({_own(BG)}), c AS ({_own(BC)}), w AS (SELECT DISTINCT to_domain FROM b WHERE applicable), o AS (SELECT o_orderkey AS fact_id, o_custkey AS case_id, unnest(['d' || (o_orderkey % 5), 'd' || (o_orderkey % 5 + 1)]) AS d FROM orders) "
       "SELECT case_id, target_domain, fact_id FROM c JOIN w ON target_domain = to_domain JOIN o USING (case_id) WHERE d = target_domain")
def exposed_facts(t):
    d = lambda i: F.concat(F.lit("d"), (F.col("o_orderkey") % 5 + i).cast("string"))
    facts = t.orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("fact_id"), F.array(d(0), d(1)).alias("to_domains"))
    return P.exposed_facts(P.best_bridge(_sql(t, BC), _sql(t, BG)), facts).select("case_id", "target_domain", "fact_id")


@query("domain_reach", f"""WITH RECURSIVE b AS ({_own(BG)}), c AS ({_own(BC)}), al AS (SELECT case_id, unnest(['d1', 'd' || (case_id % 3), 'd3']) AS d FROM c),
r(case_id, domain, hop) AS (SELECT case_id, target_domain, 0 FROM c UNION SELECT r.case_id, b.to_domain, hop + 1 FROM r JOIN b ON b.from_domain = r.domain JOIN al ON al.case_id = r.case_id AND al.d = b.to_domain WHERE hop < 3)
SELECT case_id, domain, min(hop)::INT AS hop FROM r GROUP BY ALL""")
def domain_reach(t):
    cases = _sql(t, BC).select("case_id", F.col("target_domain").alias("domain"), F.array(F.lit("d1"), F.concat(F.lit("d"), (F.col("case_id") % 3).cast("string")), F.lit("d3")).alias("allowed"))
    return P.domain_reach(cases, _sql(t, BG), 3)


JD = """SELECT o_orderkey, concat('d', cast(o_orderkey % 4 AS string)) AS current_domain, concat('d', cast(o_custkey % 5 AS string)) AS target_domain, cast(o_orderkey % 3 AS int) AS hops, cast(o_custkey % 4 AS int) AS n_unmet, cast(o_orderkey % 2 AS int) AS n_bridges FROM {orders}"""


@query("jump_decision", f"""WITH x AS ({_own(JD)}), y AS (SELECT *, CASE WHEN hops >= 2 THEN 0 WHEN current_domain = target_domain THEN 1 WHEN target_domain = 'd0' THEN 2 WHEN target_domain = 'd1' AND n_bridges = 0 THEN 3 WHEN target_domain = 'd1' THEN 4 WHEN n_unmet >= 2 THEN 5 ELSE 6 END AS k FROM x)
SELECT o_orderkey, ['blocked','stay_primary','stay_primary','blocked','jump_secondary','activate_shared','blocked'][k + 1] AS decision,
 ['policy_max_hops_exceeded (' || hops || '/2)','already_in_domain','target_in_primary_domains','secondary_jump_requires_bridge','secondary_domain_with_bridge','unmet_requirements_threshold (' || n_unmet || '/2)','target_domain_not_accessible'][k + 1] AS reason FROM y""")
def jump_decision(t):
    r = _sql(t, JD).withColumn("primary_domains", F.array(F.lit("d0"))).withColumn("secondary_domains", F.array(F.lit("d1")))
    return P.jump_decision(r).select("o_orderkey", "decision", "reason")


FU = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE cast(l_linenumber % 4 AS int) WHEN 0 THEN 'parse_verification' WHEN 1 THEN 'backward_verification' WHEN 2 THEN 'forward_verification' ELSE 'answer_verification' END AS mode, l_partkey % 3 <> 0 AS symbolic_ok,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_quantity / 50 END AS entail, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE (50 - l_quantity) / 50 * l_discount * 10 END AS contra, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE (50 - l_quantity) / 50 * (1 - l_discount * 10) END AS neutral,
  CASE WHEN l_suppkey % 5 = 0 THEN NULL WHEN l_suppkey % 5 = 1 THEN 'entailment' WHEN l_suppkey % 5 = 2 THEN 'contradiction' ELSE 'neutral' END AS label,
  CASE cast(l_orderkey % 5 AS int) WHEN 0 THEN 'backward_weak_grounding' WHEN 1 THEN 'forward_proof_error' WHEN 2 THEN 'answer_subject_action_mismatch' ELSE '' END AS code,
  CASE cast(l_orderkey % 3 AS int) WHEN 0 THEN 'conditional' WHEN 1 THEN 'none' ELSE 'final' END AS application_status, CASE WHEN l_orderkey % 2 = 0 THEN 'deadline' ELSE 'other' END AS focus FROM {lineitem}"""


@query("fuse_decisions", f"""WITH f AS ({_own(FU)}), a AS (SELECT *, coalesce(entail, 0) AS e, coalesce(neutral, 0) AS n, coalesce(contra, 0) AS x FROM f),
b AS (SELECT *, CASE WHEN label IS NULL THEN CASE WHEN symbolic_ok THEN 'ACCEPT' ELSE 'REJECT' END WHEN x >= 0.7 THEN 'REJECT' WHEN NOT symbolic_ok THEN CASE WHEN e >= 0.7 THEN 'REPAIR' ELSE 'REJECT' END WHEN e >= 0.7 THEN 'ACCEPT' WHEN x >= 0.35 THEN 'REJECT' ELSE 'REPAIR' END AS d0,
  CASE WHEN label IS NULL THEN 'nli_skipped' WHEN x >= 0.7 THEN 'nli_contradiction_high' WHEN NOT symbolic_ok THEN CASE WHEN e >= 0.7 THEN 'nli_entailment_despite_symbolic_fail' WHEN x >= 0.35 THEN 'nli_contradiction_moderate_with_symbolic_fail' ELSE 'symbolic_failed' END
   WHEN e >= 0.7 THEN 'nli_entailment_aligned' WHEN x >= 0.35 THEN 'nli_contradiction_moderate' WHEN n >= greatest(e, x, 0.45) THEN 'nli_neutral' ELSE 'nli_uncertain' END AS diagnostic,
  label IS NOT NULL AND (x >= 0.7 OR (label = 'contradiction' AND greatest(e, n, x) >= 0.35)) AS fl FROM a),
c AS (SELECT *, CASE WHEN fl AND mode = 'parse_verification' AND symbolic_ok AND focus = 'deadline' AND d0 = 'REJECT' THEN 'REPAIR' ELSE d0 END AS d1 FROM b),
d AS (SELECT *, CASE WHEN fl AND d1 <> 'REJECT' THEN CASE WHEN mode = 'parse_verification' AND symbolic_ok THEN 'REPAIR' ELSE 'REJECT' END ELSE d1 END AS d2 FROM c),
g AS (SELECT *, CASE WHEN mode <> 'answer_verification' AND d2 = 'ACCEPT' AND label IS NOT NULL AND n >= greatest(e, x, 0.45) THEN 'REPAIR' ELSE d2 END AS d3 FROM d),
h AS (SELECT *, CASE WHEN mode = 'backward_verification' AND code = 'backward_weak_grounding' THEN 'REJECT' WHEN mode = 'forward_verification' AND code = 'forward_proof_error' THEN CASE WHEN application_status = 'conditional' THEN CASE WHEN d3 = 'ACCEPT' THEN 'REPAIR' ELSE d3 END ELSE 'REJECT' END ELSE d3 END AS d4 FROM g)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, diagnostic, CASE WHEN mode = 'answer_verification' AND d4 = 'REJECT' AND application_status <> 'final' AND NOT fl AND code IN ('', 'answer_subject_action_mismatch') THEN 'ACCEPT' ELSE d4 END AS decision FROM h""")
def fuse_decisions(t):
    f = _sql(t, FU).withColumn("error_codes", F.when(F.col("code") == "", F.array().cast("array<string>")).otherwise(F.array("code")))
    return P.fuse_decisions(f).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "diagnostic", "decision")


@query("fuse_basic", f"""WITH f AS ({_own(FU)}), a AS (SELECT *, coalesce(entail, 0) AS e, coalesce(neutral, 0) AS n, coalesce(contra, 0) AS x FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN NOT symbolic_ok THEN 'REJECT' WHEN label IS NULL THEN 'ACCEPT' WHEN x >= 0.7 THEN 'REJECT' WHEN e >= 0.7 THEN 'ACCEPT' WHEN n >= greatest(e, x) AND n >= 0.5 THEN 'ACCEPT'
  WHEN label = 'contradiction' THEN 'REJECT' WHEN label = 'entailment' AND greatest(e, n, x) >= 0.45 THEN 'ACCEPT' WHEN label = 'neutral' THEN 'ACCEPT' ELSE 'REPAIR' END AS decision FROM a""")
def fuse_basic(t):
    return P.fuse_basic(_sql(t, FU)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "decision")


@query("overlap_entailment", """
WITH p AS (SELECT a.conv_id, a.turn, regexp_replace(lower(trim(a.text)), '\\s+', ' ', 'g') AS p, regexp_replace(lower(trim(b.text)), '\\s+', ' ', 'g') AS h FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
w AS (SELECT *, list_distinct(regexp_extract_all(p, '[a-z0-9_]{4,}')) AS pw, list_distinct(regexp_extract_all(h, '[a-z0-9_]{4,}')) AS hw FROM p), j AS (SELECT *, CASE WHEN len(pw) > 0 AND len(hw) > 0 THEN len(list_intersect(pw, hw)) / len(hw) END AS o,
  CAST(('0x' || substr(sha256(p || '||' || h), 1, 8)) AS BIGINT) / 4294967295.0 AS s FROM w),
k AS (SELECT *, CASE WHEN h = '' THEN 0 WHEN contains(p, h) OR contains(h, p) THEN 1 WHEN o >= 0.45 THEN 2 WHEN o <= 0.05 AND len(hw) >= 3 THEN 3 WHEN s > 0.72 THEN 4 WHEN s < 0.18 THEN 5 ELSE 6 END AS c FROM j)
SELECT conv_id, turn, ['neutral','entailment','entailment','contradiction','entailment','contradiction','neutral'][c + 1] AS label, round(CASE c WHEN 1 THEN 0.92 WHEN 2 THEN 0.55 + 0.35 * o WHEN 3 THEN 0.4 WHEN 4 THEN 0.55 + 0.2 * s WHEN 5 THEN 0.45 ELSE 0.5 END, 6) AS label_score FROM k""")
def overlap_entailment(t):
    c = t.conversations
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    p = c.select("conv_id", "turn", F.col("text").alias("premise")).join(nxt, ["conv_id", "turn"])
    return P.overlap_entailment(p, draw=True).select("conv_id", "turn", "label", F.round("label_score", 6).alias("label_score"))


PQ = """SELECT o_orderkey AS question_id, CASE WHEN o_orderkey % 17 = 0 THEN ' a ' ELSE o_orderpriority END AS text, CASE WHEN o_custkey % 7 = 0 THEN '' ELSE 's' END AS subject, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 'act' END AS action,
  CASE WHEN o_orderstatus = 'F' THEN 'm' ELSE '' END AS modality, CASE cast(o_orderkey % 4 AS int) WHEN 0 THEN 'deadline' WHEN 1 THEN 'unknown' WHEN 2 THEN 'applicability' ELSE 'permission' END AS focus,
  CASE cast(o_custkey % 4 AS int) WHEN 0 THEN 'deadline' WHEN 1 THEN 'unknown' WHEN 2 THEN 'obligation' ELSE 'weird' END AS goal, o_custkey % 3 AS na, CASE WHEN o_orderkey % 11 = 0 THEN 'plain' ELSE 'p(x)' END AS atom FROM {orders}"""


@query("parse_checks", f"""WITH q AS ({_own(PQ)}), c AS (SELECT question_id, 'question_text_length' AS "check", CASE WHEN length(trim(text)) < 4 THEN 'fail' ELSE 'pass' END AS status, 'parse_slot_error' AS code FROM q
 UNION ALL SELECT question_id, 'subject_presence', CASE WHEN subject = '' THEN 'fail' ELSE 'pass' END, 'parse_slot_error' FROM q
 UNION ALL SELECT question_id, 'action_presence', CASE WHEN action IS NULL AND focus = 'deadline' THEN 'skip' WHEN action IS NULL AND focus <> 'unknown' THEN 'fail' ELSE 'pass' END, 'parse_slot_error' FROM q
 UNION ALL SELECT question_id, 'modality_presence', CASE WHEN modality = '' THEN 'skip' ELSE 'pass' END, '' FROM q
 UNION ALL SELECT question_id, 'goal_predicate_schema', CASE WHEN goal = 'weird' THEN 'fail' ELSE 'pass' END, 'goal_construction_error' FROM q
 UNION ALL SELECT question_id, 'goal_arity', CASE WHEN goal <> 'unknown' AND na = 0 THEN 'fail' ELSE 'pass' END, 'goal_construction_error' FROM q
 UNION ALL SELECT question_id, 'focus_vs_goal', 'fail', 'goal_construction_error' FROM q WHERE focus <> 'unknown' AND goal = 'unknown'
 UNION ALL SELECT question_id, 'focus_goal_alignment', CASE WHEN focus <> goal AND NOT (focus = 'applicability' AND goal = 'obligation') THEN 'fail' ELSE 'pass' END, 'layer1_layer2_misalignment' FROM q WHERE focus <> 'unknown' AND goal <> 'unknown'
 UNION ALL SELECT question_id, 'condition_atoms', CASE WHEN atom = 'plain' THEN 'fail' ELSE 'pass' END, 'fact_extraction_error' FROM q)
SELECT question_id, "check", status, CASE WHEN status = 'fail' THEN code END AS code FROM c""")
def parse_checks(t):
    q = _sql(t, PQ).withColumn("goal_args", F.when(F.col("na") == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))).withColumn("condition_atoms", F.array("atom"))
    return P.parse_checks(q, ["deadline", "obligation", "permission", "applicability"], {f: f for f in ("deadline", "applicability", "permission")})


RC = """SELECT p_partkey AS question_id, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE rule_id END AS rule_id, p_size % 4 <> 0 AS head_matches, CASE WHEN p_size % 6 = 0 THEN '' ELSE logic_form END AS logic_form, head_predicate, p_size % 3 AS n_head_args,
  CASE cast(p_size % 5 AS int) WHEN 0 THEN 'exception_applies' WHEN 1 THEN 'deadline' WHEN 2 THEN 'threshold' ELSE 'applies_if' END AS bp FROM {rules}"""


@query("rule_checks", f"""WITH q AS ({RC.replace('{rules}', 'rules')}), c AS (SELECT question_id, 'rule_presence' AS "check", CASE WHEN rule_id IS NULL THEN 'fail' ELSE 'pass' END AS status, 'rule_extraction_error' AS code FROM q
 UNION ALL SELECT question_id, 'head_vs_goal', CASE WHEN NOT head_matches THEN 'fail' ELSE 'pass' END, 'rule_schema_error' FROM q WHERE rule_id IS NOT NULL
 UNION ALL SELECT question_id, 'logic_form_present', CASE WHEN logic_form = '' THEN 'fail' ELSE 'pass' END, 'rule_schema_error' FROM q WHERE rule_id IS NOT NULL
 UNION ALL SELECT question_id, 'body_exception', 'pass', '' FROM q WHERE rule_id IS NOT NULL AND bp = 'exception_applies'
 UNION ALL SELECT question_id, 'threshold_structure', CASE WHEN logic_form = 'threshold' AND bp <> 'threshold' THEN 'fail' ELSE 'pass' END, 'rule_threshold_error' FROM q WHERE rule_id IS NOT NULL
 UNION ALL SELECT question_id, 'deadline_structure', CASE WHEN bp = 'deadline' OR n_head_args >= 2 THEN 'pass' ELSE 'fail' END, 'rule_deadline_error' FROM q WHERE rule_id IS NOT NULL AND logic_form = 'deadline')
SELECT question_id, bool_and(status <> 'fail') AS ok, coalesce(string_agg(DISTINCT code, ';' ORDER BY code) FILTER (status = 'fail'), '') AS error_codes, count(*) AS n_checks FROM c GROUP BY ALL""", uses=["rules"])
def rule_checks(t):
    q = t.spark.sql(RC, rules=t.rules).withColumn("body_predicates", F.array("bp"))
    c = P.rule_checks(q)
    n = c.groupBy("question_id").agg(F.count("*").alias("n_checks"))
    return P.checks_ok(c).join(n, "question_id").withColumn("error_codes", F.array_join("error_codes", ";"))


PLC = """SELECT l_orderkey AS question_id, l_linenumber, concat(cast(l_orderkey AS string), '_', cast(l_linenumber AS string), '_', cast(l_partkey AS string), '_', cast(l_suppkey AS string)) AS qid, CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE cast(l_partkey % 5 AS string) END AS selected, cast(l_suppkey % 5 AS string) AS p1, l_tax * 10 - 0.5 AS compatibility, l_discount > 0.08 AS weak_grounding,
  CASE WHEN l_linenumber = 3 THEN 'arity_mismatch' ELSE '' END AS unification_failure, cast(l_partkey % 3 AS string) AS m1, cast(l_suppkey % 3 AS string) AS r1, CASE WHEN l_orderkey % 3 = 0 THEN 'deadline' ELSE '' END AS goal_family, CASE WHEN l_partkey % 2 = 0 THEN 'deadline' ELSE 'dossier' END AS rule_family,
  l_returnflag = 'A' AS goal_achieved, l_returnflag <> 'R' AS goal_reached, cast(l_linenumber % 3 AS int) AS n_steps, CASE WHEN l_suppkey % 4 = 0 THEN 'constraint_failed' WHEN l_suppkey % 4 = 1 THEN 'exception_triggered' ELSE 'none' END AS reason, CASE WHEN l_linestatus = 'O' THEN '' ELSE 'ket luan' END AS conclusion,
  CASE WHEN l_suppkey % 6 = 0 THEN 'khac' ELSE 'co ket luan' END AS answer, CASE WHEN l_linenumber = 1 THEN 'action_missing' ELSE 'modality_off' END AS dg, CASE WHEN l_linenumber = 2 THEN 'conditional' ELSE 'final' END AS application_status FROM {lineitem}"""


def _ok(checks):
    return P.checks_ok(checks, "question_id").select("question_id", "ok", F.array_join("error_codes", ";").alias("error_codes"))


@query("plan_checks", f"""WITH q AS ({_own(PLC)}), c AS (SELECT qid, 'backward_rule_selection_error' AS code, selected IS NULL AS bad FROM q UNION ALL SELECT qid, 'backward_unification_error', selected <> p1 OR unification_failure <> '' FROM q WHERE selected IS NOT NULL
 UNION ALL SELECT qid, 'requirement_construction_error', m1 <> r1 FROM q WHERE selected IS NOT NULL UNION ALL SELECT qid, 'backward_semantic_family_mismatch', (goal_family <> '' AND goal_family <> rule_family) OR compatibility < -0.25 FROM q WHERE selected IS NOT NULL
 UNION ALL SELECT qid, 'backward_weak_grounding', weak_grounding FROM q WHERE selected IS NOT NULL)
SELECT qid AS question_id, NOT bool_or(bad) AS ok, coalesce(string_agg(DISTINCT code, ';' ORDER BY code) FILTER (bad), '') AS error_codes FROM c GROUP BY qid""")
def plan_checks(t):
    q = _sql(t, PLC).drop("question_id").withColumnRenamed("qid", "question_id").select("*", F.array("p1").alias("planned"), F.array("m1").alias("missing"), F.array("r1").alias("requirement"))
    return _ok(P.plan_checks(q))


@query("forward_checks", f"""WITH q AS ({_own(PLC)}), c AS (SELECT qid, 'forward_conclusion_error' AS code, goal_achieved <> goal_reached OR (reason <> 'none' AND goal_achieved) OR (goal_achieved AND conclusion = '') AS bad FROM q
 UNION ALL SELECT qid, 'forward_proof_error', (goal_achieved AND n_steps = 0) OR coalesce(selected <> p1, false) FROM q UNION ALL SELECT qid, 'forward_constraint_error', goal_achieved AND reason = 'constraint_failed' FROM q UNION ALL SELECT qid, 'forward_exception_error', goal_achieved AND reason = 'exception_triggered' FROM q)
SELECT qid AS question_id, NOT bool_or(bad) AS ok, coalesce(string_agg(DISTINCT code, ';' ORDER BY code) FILTER (bad), '') AS error_codes FROM c GROUP BY qid""")
def forward_checks(t):
    q = _sql(t, PLC).drop("question_id").withColumnRenamed("qid", "question_id").withColumn("step_rules", F.array("p1"))
    return _ok(P.forward_checks(q))


@query("answer_checks", f"""WITH q AS ({_own(PLC)}), c AS (SELECT qid, "check", CASE WHEN application_status = 'conditional' THEN 'skip' WHEN bad THEN 'fail' ELSE 'pass' END AS status FROM (
  SELECT qid, application_status, CASE WHEN dg = 'action_missing' THEN 'action_vs_goal' ELSE 'modality_vs_expected' END AS "check", true AS bad FROM q UNION ALL SELECT qid, application_status, 'answer_entails_conclusion', answer = 'khac' FROM q WHERE conclusion <> ''))
SELECT qid AS question_id, "check", status FROM c""")
def answer_checks(t):
    q = _sql(t, PLC).drop("question_id").withColumnRenamed("qid", "question_id").withColumn("diagnostics", F.array("dg"))
    return P.answer_checks(q).select("question_id", "check", "status")


GR = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE cast(l_partkey % 5 AS int) WHEN 0 THEN 'tax' WHEN 1 THEN 'labor' WHEN 2 THEN 'shared' WHEN 3 THEN '' ELSE 'other' END AS domain, CASE WHEN l_partkey % 11 = 0 THEN 'shared' ELSE 'domain' END AS layer, CASE WHEN l_partkey % 7 = 0 THEN 'bridge' ELSE 'user' END AS origin,
  l_suppkey % 3 <> 0 AS include_shared, cast(l_suppkey % 2 AS int) AS n_bridges, l_orderkey % 2 = 0 AS strict, CASE WHEN l_linenumber % 2 = 0 THEN 'rb1' ELSE 'rb2' END AS rulebase_id FROM {lineitem}"""


def _gate(t, kind):
    g = _sql(t, GR).select("*", F.array(F.lit("tax")).alias("primary_domains"), F.array(F.lit("labor")).alias("secondary_domains"), F.array(F.lit("rb1")).alias("active_rulebases"))
    return P.domain_gate(g, kind).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "admitted", "reason")


@query("domain_gate_rules", f"""WITH g AS ({_own(GR)}), r AS (SELECT *, CASE WHEN layer = 'shared' OR domain = 'shared' THEN CASE WHEN include_shared THEN '' ELSE 'unification_rejected_by_domain_shared_disabled' END WHEN domain = 'tax' THEN ''
  WHEN domain = 'labor' THEN CASE WHEN n_bridges = 0 THEN 'unification_rejected_by_domain_no_bridge' ELSE '' END WHEN strict THEN 'unification_rejected_by_domain' ELSE '' END AS r0 FROM g), s AS (SELECT *, CASE WHEN r0 = '' AND strict AND rulebase_id <> 'rb1' THEN 'rule_rejected_rulebase_not_active' ELSE r0 END AS reason FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, reason = '' AS admitted, reason FROM s""")
def domain_gate_rules(t):
    return _gate(t, "rule")


@query("domain_gate_facts", f"""WITH g AS ({_own(GR)}), r AS (SELECT *, CASE WHEN origin = 'bridge' OR domain = 'shared' THEN CASE WHEN include_shared THEN '' ELSE 'fact_rejected_shared_disabled' END WHEN domain IN ('tax', '') THEN ''
  WHEN domain = 'labor' THEN CASE WHEN n_bridges = 0 THEN 'fact_rejected_secondary_requires_bridge' ELSE '' END ELSE 'fact_rejected_domain_mismatch' END AS reason FROM g) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, reason = '' AS admitted, reason FROM r""")
def domain_gate_facts(t):
    return _gate(t, "fact")


TA = "SELECT o_custkey AS case_id, concat('d', cast(o_orderkey % 4 AS string)) AS to_domain, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('B', cast(o_orderkey % 29 AS string)) END AS bridge_id FROM {orders}"


@query("transition_audit", f"""WITH t AS ({_own(TA)}), h AS (SELECT case_id, count(DISTINCT bridge_id) AS n FROM t GROUP BY 1 HAVING n > 6)
SELECT case_id, 'hop_count_exceeded: ' || n || ' > 6' AS error FROM h UNION ALL SELECT DISTINCT case_id, 'invalid_target_domain: ' || to_domain FROM t WHERE to_domain NOT IN ('d0', 'd1', 'd' || (case_id % 4)) UNION ALL SELECT DISTINCT case_id, 'unregistered_bridge: ' || bridge_id FROM t WHERE bridge_id IS NOT NULL AND bridge_id NOT IN (SELECT 'B' || n_nationkey FROM nation)""")
def transition_audit(t):
    ctx = t.customer.select(F.col("c_custkey").alias("case_id"), F.array(F.lit("d0"), F.lit("d1"), F.concat(F.lit("d"), (F.col("c_custkey") % 4).cast("string"))).alias("domains"))
    return P.transition_audit(_sql(t, TA), ctx, t.nation.select(F.concat(F.lit("B"), F.col("n_nationkey").cast("string")).alias("bridge_id")), 6)


@query("repair_target", "WITH c AS (SELECT CASE event_type WHEN 'view' THEN 'parse_slot_error' WHEN 'click' THEN 'forward_proof_error' WHEN 'error' THEN 'retrieval_empty_error' WHEN 'signup' THEN 'answer_overclaim' ELSE 'other_code' END AS code FROM events) "
       "SELECT code, count(*) AS n, CASE code WHEN 'parse_slot_error' THEN 'parser' WHEN 'forward_proof_error' THEN 'forward_proof_construction' WHEN 'retrieval_empty_error' THEN 'retrieval' WHEN 'answer_overclaim' THEN 'answer_generation' ELSE 'unspecified' END AS stage FROM c GROUP BY code")
def repair_target(t):
    code = F.expr("CASE event_type WHEN 'view' THEN 'parse_slot_error' WHEN 'click' THEN 'forward_proof_error' WHEN 'error' THEN 'retrieval_empty_error' WHEN 'signup' THEN 'answer_overclaim' ELSE 'other_code' END")
    return P.repair_target(t.events.select(code.alias("code")))
