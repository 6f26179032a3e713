"""Queries for rule application over facts."""

from pyspark.sql import functions as F

from lexloom.common import cut_lineage
from lexloom.operators import rules as L
from lexloom.plans.registry import query

U = ["facts", "candidates", "atoms", "constraints"]
TRUTH = """tr AS (SELECT p.case_id, p.rule_id, role, seq, key, CASE WHEN f.fact_key IS NULL OR value_bool IS NULL THEN 'missing' WHEN value_bool THEN 'true' ELSE 'false' END AS status
  FROM candidates p JOIN atoms a ON a.rule_id = p.rule_id LEFT JOIN facts f ON f.case_id = p.case_id AND f.fact_key = a.key)"""
CONS = """ca AS (SELECT case_id, fact_key, try_cast(regexp_extract(fact_key, ',(.*)\\)', 1) AS DOUBLE) AS num, regexp_extract(fact_key, '\\((.*),', 1) AS m FROM facts WHERE fact_key LIKE 'carrier(%'),
cb AS (SELECT case_id, m, min(num) AS num FROM ca GROUP BY ALL),
cl AS (SELECT p.case_id, p.rule_id, c.*  EXCLUDE (rule_id), coalesce(n1.value_num, n2.value_num, n3.value_num, cb.num) AS v, n3.fact_key IS NOT NULL AS known, n3.value_bool AS flag
  FROM candidates p JOIN constraints c ON c.rule_id = p.rule_id LEFT JOIN facts n1 ON n1.case_id = p.case_id AND n1.fact_key = 'numeric:' || metric LEFT JOIN facts n2 ON n2.case_id = p.case_id AND n2.fact_key = 'metric:' || metric
  LEFT JOIN facts n3 ON n3.case_id = p.case_id AND n3.fact_key = session_key LEFT JOIN cb ON cb.case_id = p.case_id AND cb.m = metric),
ce AS (SELECT case_id, rule_id, seq, session_key, kind, CASE WHEN kind = 'threshold' THEN v END AS value,
  CASE WHEN kind <> 'threshold' THEN CASE WHEN known AND NOT flag THEN 'failed' WHEN known THEN 'satisfied' ELSE 'missing_input' END
    WHEN known AND NOT flag THEN 'failed' WHEN unit = 'phan_tram' AND v > 0 AND v <= 1 AND target > 1 THEN 'unknown' WHEN unit = 'phan_tram' AND v > 1 AND target > 0 AND target <= 1 THEN 'unknown'
    WHEN v IS NULL AND known THEN 'unknown' WHEN v IS NULL THEN 'missing_input' WHEN target IS NULL THEN 'unknown' WHEN op = '~' THEN 'unknown'
    WHEN CASE op WHEN '>=' THEN v >= target WHEN 'lte' THEN v <= target WHEN 'gt' THEN v > target WHEN '<' THEN v < target ELSE abs(v - target) < 1e-9 END THEN 'satisfied' ELSE 'failed' END AS status FROM cl)"""
CHECKS = f"{TRUTH}, {CONS}, ck AS (SELECT * FROM tr UNION ALL SELECT case_id, rule_id, 'constraint', seq, session_key, status FROM ce)"


def _rows(t):
    """The candidates with their checks."""
    return L.with_checks(t.candidates, t.atoms, t.constraints, t.facts)


def _rule_rows(t):
    """Nested rules from parts."""
    args = lambda *xs: F.array(*[F.col(x) if isinstance(x, str) else x for x in xs])
    term = lambda p, a: F.struct(p.alias("predicate"), a.alias("args"))
    body = F.array_compact(F.array(
        F.when(F.col("p_size") % 2 == 0, term(F.lit("applies_if"), args("p_brand", "p_name"))), F.when(F.col("p_size") % 3 == 0, term(F.lit("unless"), args("p_type"))),
        F.when(F.col("p_size") % 5 == 0, term(F.lit("exception_applies"), args("p_name"))), F.when(F.col("p_size") % 7 == 0, term(F.lit("deadline"), args(F.lit("30"), F.lit("day")))),
        F.when(F.col("p_size") % 4 == 0, term(F.lower("p_type"), args("p_brand")))))
    aux = F.array_compact(F.array(F.when(F.col("p_size") % 6 == 0, term(F.lit("dossier"), args("p_name")))))
    return t.rules.select(F.col("p_partkey").cast("string").alias("rule_id"), "logic_form", term(F.col("logic_form"), args("p_name", F.lit(">="))).alias("head"), body.alias("body"), aux.alias("aux"))


@query("explode_rules", """
WITH r AS (SELECT p_partkey::VARCHAR AS rule_id, logic_form, p_size AS z, p_name AS n, p_brand AS b, p_type AS y FROM rules),
c AS (SELECT rule_id, 'head' AS origin, logic_form AS role, logic_form || '(' || n || ',>=)' AS key, 0 AS seq FROM r WHERE logic_form IN ('threshold','deadline','dossier')
 UNION ALL SELECT rule_id, 'body', 'positive', 'applies_if(' || b || ',' || n || ')', 1 FROM r WHERE z % 2 = 0 UNION ALL SELECT rule_id, 'body', 'unless', 'unless(' || y || ')', 2 FROM r WHERE z % 3 = 0
 UNION ALL SELECT rule_id, 'body', 'exception', 'exception_applies(' || n || ')', 3 FROM r WHERE z % 5 = 0 UNION ALL SELECT rule_id, 'body', 'deadline', 'deadline(30,day)', 4 FROM r WHERE z % 7 = 0
 UNION ALL SELECT rule_id, 'body', 'positive', lower(y) || '(' || b || ')', 5 FROM r WHERE z % 4 = 0 UNION ALL SELECT rule_id, 'aux', 'dossier', 'dossier(' || n || ')', 1 FROM r WHERE z % 6 = 0)
SELECT rule_id, origin, role, key, (row_number() OVER (PARTITION BY rule_id, origin ORDER BY seq) - 1)::INT AS seq FROM c""", uses=["rules"])
def explode_rules(t):
    return L.explode_rules(_rule_rows(t)).select("rule_id", "origin", "role", "key", "seq")


@query("atom_truth", f"WITH {TRUTH} SELECT case_id, rule_id, role, seq, key, status FROM tr", uses=U)
def atom_truth(t):
    return L.atom_truth(t.candidates, t.atoms, t.facts)


@query("constraint_eval", f"WITH {CONS} SELECT case_id, rule_id, session_key, kind, round(value, 6) AS value, status FROM ce", uses=U)
def constraint_eval(t):
    return L.constraint_eval(t.candidates, t.constraints, t.facts).select("case_id", "rule_id", "session_key", "kind", F.round("value", 6).alias("value"), "status")


PLAN = CHECKS + """,
pa AS (SELECT case_id, rule_id, count(*) FILTER (role = 'positive') AS np, count(*) FILTER (role = 'positive' AND status = 'true') AS nt,
  count(*) FILTER ((role = 'positive' AND status <> 'true') OR (role = 'unless' AND status = 'missing')) AS ma, count(*) FILTER (role = 'exception' AND status = 'missing') AS me,
  count(*) FILTER (role = 'constraint' AND status = 'missing_input') AS mc, count(*) FILTER (role = 'unless' AND status = 'true') AS nb,
  list_sort(list(DISTINCT key) FILTER ((role = 'positive' AND status <> 'true') OR (role IN ('unless', 'exception') AND status = 'missing') OR (role = 'constraint' AND status = 'missing_input'))) AS mk FROM ck GROUP BY ALL),
pl AS (SELECT p.case_id, p.rule_id, round(0.28 * score + 22.0 * exact_head + 24.0 * coalesce(nt, 0) / greatest(1, coalesce(np, 0)) + 6.0 * least(1.0, 0.08 * n_bindings) + 14.0 / (1.0 + coalesce(ma + me + mc, 0)) + 12.0 / (1.0 + coalesce(mc + me, 0)), 9) AS total,
  CASE WHEN nb > 0 THEN 'blocked' WHEN ma + me + mc > 0 THEN 'needs_input' ELSE 'ready' END AS status, coalesce(shared AND compatibility < 0.5 AND coalesce(nt, 0) = 0 AND exact_head < 0.5, false) AS weak_grounding, coalesce(array_to_string(mk, ';'), '') AS missing_keys
  FROM candidates p LEFT JOIN pa USING (case_id, rule_id)),
pk AS (SELECT *, (row_number() OVER (PARTITION BY case_id ORDER BY total DESC, rule_id))::INT AS rank FROM pl QUALIFY rank <= 3)"""


def _plan(t):
    return L.backward_plan(_rows(t), k=3)


@query("backward_plan", f"WITH {PLAN} SELECT case_id, rule_id, round(total, 5) AS total, status, weak_grounding, missing_keys, rank FROM pk", uses=U)
def backward_plan(t):
    return _plan(t).withColumn("total", F.round("total", 5)).withColumn("missing_keys", F.array_join("missing_keys", ";"))


@query("pick_rule", f"WITH {PLAN}, ok AS (SELECT *, rank = 3 AND case_id % 3 = 0 AS pf FROM pk WHERE NOT (rank = 1 AND case_id % 2 = 0)) SELECT case_id, rule_id, rank, pf AS preferred FROM ok QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY pf DESC, rank) = 1", uses=U)
def pick_rule(t):
    p = cut_lineage(_plan(t))
    return L.pick_rule(p, p.filter("rank = 1 AND case_id % 2 = 0"), p.filter("rank = 3 AND case_id % 3 = 0")).select("case_id", "rule_id", "rank", "preferred")


FWD = CHECKS + """,
fl AS (SELECT case_id, rule_id, seq, key, CASE role WHEN 'positive' THEN 1 WHEN 'unless' THEN 2 WHEN 'exception' THEN 3 ELSE 4 END AS stage,
  CASE role WHEN 'positive' THEN 'positive_condition_missing' WHEN 'unless' THEN CASE status WHEN 'true' THEN 'negative_condition_blocked' ELSE 'unless_condition_unknown' END
   WHEN 'exception' THEN CASE status WHEN 'true' THEN 'exception_triggered' ELSE 'exception_unknown' END ELSE 'constraint_' || status END AS reason FROM ck
  WHERE (role = 'positive' AND status <> 'true') OR (role IN ('unless', 'exception') AND status <> 'false') OR (role = 'constraint' AND status IN ({}))),
ff AS (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY case_id, rule_id ORDER BY stage, seq) = 1),
fw AS (SELECT p.case_id, p.rule_id, reason IS NULL AS goal_reached, CASE WHEN reason = 'constraint_missing_input' THEN reason ELSE coalesce(reason, 'none') END AS reason, coalesce(key, '') AS detail FROM candidates p LEFT JOIN ff USING (case_id, rule_id))"""
HYBRID = FWD.format("'failed', 'unknown', 'missing_input'")
READING = FWD.format("'failed', 'unknown'")


@query("forward_eval", f"WITH {HYBRID} SELECT * FROM fw", uses=U)
def forward_eval(t):
    return L.forward_eval(_rows(t))


@query("forward_eval_rule_reading", f"WITH {READING} SELECT * FROM fw", uses=U)
def forward_eval_rule_reading(t):
    return L.forward_eval(_rows(t), mode="rule_reading")


@query("best_path", f"WITH {HYBRID}, {PLAN[len(CHECKS) + 2:]}, bj AS (SELECT k.case_id, k.rule_id, rank, goal_reached, reason FROM pk k JOIN fw USING (case_id, rule_id)), "
       "bw AS (SELECT case_id, min(rank) FILTER (goal_reached) AS w, max(rank) AS l FROM bj GROUP BY 1) "
       "SELECT b.case_id, max(rule_id) FILTER (rank = coalesce(w, l)) AS rule_id, bool_or(goal_reached) AS goal_reached, max(reason) FILTER (rank = coalesce(w, l)) AS reason, "
       "coalesce(string_agg(rule_id || ':' || reason, ';' ORDER BY rank) FILTER (NOT goal_reached AND rank < coalesce(w, 99)), '') AS failed_paths FROM bj b JOIN bw USING (case_id) GROUP BY b.case_id", uses=U)
def best_path(t):
    own = ["score", "exact_head", "n_bindings", "shared", "compatibility", "checks"]
    told = L.forward_eval(_rows(t), keep=own)
    return L.best_path(L.backward_plan(told, k=3, keep=["goal_reached", "reason", "detail"]))


REQ = CHECKS + """, rq AS (SELECT *, CASE role WHEN 'positive' THEN status <> 'true' WHEN 'constraint' THEN status = 'missing_input' ELSE status = 'missing' END AS un FROM ck),
rs AS (SELECT case_id, rule_id, coalesce(list_sort(list(DISTINCT key) FILTER (role <> 'unless' AND un)), []) AS a, coalesce(list_sort(list(DISTINCT key) FILTER (role = 'unless' AND un)), []) AS b,
  coalesce(list_sort(list(DISTINCT key) FILTER (NOT un)), []) AS c FROM rq GROUP BY ALL)"""


@query("requirement_set", f"WITH {REQ} SELECT case_id, rule_id, array_to_string(a, ';') AS unmet_required, array_to_string(b, ';') AS unmet_optional, array_to_string(list_filter(c, lambda x: NOT list_contains(list_concat(a, b), x)), ';') AS satisfied FROM rs", uses=U)
def requirement_set(t):
    r = L.requirement_set(_rows(t))
    return r.select("case_id", "rule_id", *[F.array_join(c, ";").alias(c) for c in ("unmet_required", "unmet_optional", "satisfied")])


@query("order_missing", f"""WITH {HYBRID}, mk AS (SELECT DISTINCT case_id, key FROM ck WHERE (role = 'positive' AND status <> 'true') OR (role <> 'positive' AND status IN ('missing', 'missing_input'))),
pr AS (SELECT case_id, detail AS key, min(CASE reason WHEN 'constraint_missing_input' THEN 8 WHEN 'unless_condition_unknown' THEN 12 WHEN 'positive_condition_missing' THEN 18 WHEN 'exception_unknown' THEN 22 WHEN 'constraint_unknown' THEN 28
  WHEN 'constraint_failed' THEN 55 WHEN 'negative_condition_blocked' THEN 82 WHEN 'exception_triggered' THEN 88 ELSE 99 END) AS p FROM fw GROUP BY ALL)
SELECT case_id, key, coalesce(p, 50)::INT AS priority FROM mk LEFT JOIN pr USING (case_id, key)""", uses=U)
def order_missing(t):
    keys = F.expr("transform(filter(checks, c -> (c.role = 'positive' AND c.status <> 'true') OR (c.role <> 'positive' AND c.status IN ('missing', 'missing_input'))), c -> c.key)")
    return L.order_missing(L.forward_eval(_rows(t), keep=["checks"]).withColumn("keys", keys))


@query("proof_steps", f"""WITH {HYBRID}, g AS (SELECT case_id, rule_id, string_agg(key, ';' ORDER BY seq) FILTER (role = 'positive') AS p, string_agg(key, ';' ORDER BY seq) FILTER (role = 'unless') AS u,
  string_agg(key, ';' ORDER BY seq) FILTER (role = 'exception') AS e, string_agg(key, ';' ORDER BY seq) FILTER (role = 'constraint') AS k FROM ck GROUP BY ALL)
SELECT case_id, rule_id, coalesce(p, '') AS supporting_atoms, coalesce(u, '') AS negative_checks, coalesce(e, '') AS exception_checks, coalesce(k, '') AS applied_constraints FROM fw LEFT JOIN g USING (case_id, rule_id) WHERE goal_reached""", uses=U)
def proof_steps(t):
    s = L.proof_steps(L.forward_eval(_rows(t), keep=["checks"]))
    return s.select("case_id", "rule_id", *[F.array_join(x, ";").alias(x) for x in ("supporting_atoms", "negative_checks", "exception_checks", "applied_constraints")])


GOALS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE cast(l_orderkey % 5 AS int) WHEN 0 THEN 'obligation' WHEN 1 THEN 'must' WHEN 2 THEN 'deadline' WHEN 3 THEN 'sanction' ELSE 'Obligation' END AS goal_predicate,
  CASE cast(l_partkey % 5 AS int) WHEN 0 THEN 'obligation' WHEN 1 THEN 'must' WHEN 2 THEN 'deadline' WHEN 3 THEN 'legal_effect' ELSE 'threshold' END AS head_predicate,
  CASE WHEN l_orderkey % 3 = 0 THEN 'company_x' ELSE 'agency' END AS g1, CASE WHEN l_partkey % 3 = 0 THEN 'enterprise_x' WHEN l_partkey % 3 = 1 THEN 'agency' ELSE 'tax agency' END AS h1,
  CASE cast(l_orderkey % 4 AS int) WHEN 0 THEN 'nop_ho_so' WHEN 1 THEN 'nop_thue' WHEN 2 THEN 'thong_bao' ELSE 'company_x' END AS g2,
  CASE cast(l_suppkey % 4 AS int) WHEN 0 THEN 'nop_ho_so_thue' WHEN 1 THEN 'tien_thue' WHEN 2 THEN 'gui_thong_bao' ELSE 'agency' END AS h2, CASE WHEN l_linenumber = 7 THEN 'extra' ELSE '' END AS g3
FROM {lineitem}"""


def _goal_pairs(t):
    p = t.spark.sql(GOALS, lineitem=t.lineitem)
    return p.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "goal_predicate", "head_predicate", F.array("g1", "g2", "g3").alias("goal_args"), F.array("h1", "h2").alias("head_args"))


JAC = "(len(list_intersect(string_split(replace({0}, '_', ' '), ' '), string_split(replace({1}, '_', ' '), ' '))) / len(list_distinct(list_concat(string_split(replace({0}, '_', ' '), ' '), string_split(replace({1}, '_', ' '), ' ')))))"
FAM = "CASE lower({0}) WHEN 'obligation' THEN 'obligation' WHEN 'must' THEN 'obligation' WHEN 'deadline' THEN 'deadline' WHEN 'sanction' THEN 'legal_effect' WHEN 'legal_effect' THEN 'legal_effect' ELSE 'threshold' END"
GRP = "CASE WHEN regexp_matches({0}, 'thong_bao|gui') THEN 'n' WHEN regexp_matches({0}, 'nop|ho_so') THEN 's' WHEN regexp_matches({0}, 'thue|tien') THEN 'p' ELSE 'o' END"


@query("unify", "WITH g AS (" + GOALS.replace("{lineitem}", "lineitem") + f"""),
a AS (SELECT *, {FAM.format('goal_predicate')} AS gf, {FAM.format('head_predicate')} AS hf, lower(goal_predicate) AS gp, {GRP.format('g2')} AS gg, {GRP.format('h2')} AS hg, g1 LIKE '%\\_x' ESCAPE '\\' AS v1, h1 LIKE '%\\_x' ESCAPE '\\' AS w1, g2 LIKE '%\\_x' ESCAPE '\\' AS v2 FROM g),
b AS (SELECT *, {JAC.format('g1', 'h1')} >= 0.34 AS s1, gf IN ('obligation', 'legal_effect') AS rel,
   len(list_intersect(string_split(g2, '_'), string_split(h2, '_'))) AS i2, {JAC.format('g2', 'h2')} AS j2, {JAC.format('h1', 'h2')} >= 0.34 AS again FROM a),
c AS (SELECT *, v1 OR w1 OR s1 AS ok1, CASE WHEN v2 AND v1 THEN again OR (rel AND (j2 >= 0.45 OR (i2 >= 2 AND j2 >= 0.4))) WHEN v2 THEN TRUE ELSE j2 >= 0.34 OR (rel AND (j2 >= 0.45 OR (i2 >= 2 AND j2 >= 0.4))) END AS ok2 FROM b),
d AS (SELECT *, CASE WHEN gp <> head_predicate AND gf <> hf THEN 'predicate_mismatch' WHEN gp <> head_predicate AND ((gg = 'n' AND hg IN ('p', 's')) OR (gg = 's' AND hg IN ('n', 'p')) OR (gg = 'p' AND hg IN ('n', 's'))) THEN 'action_group_conflict'
  WHEN g3 <> '' THEN 'arity_mismatch' WHEN NOT (ok1 AND ok2) THEN 'term_unification_failed' ELSE '' END AS failure FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, failure, CASE WHEN failure <> '' THEN 0 ELSE (CASE WHEN v1 OR w1 THEN 1 ELSE 0 END + CASE WHEN v2 AND NOT v1 THEN 1 ELSE 0 END) END::INT AS n_bindings FROM d""")
def unify(t):
    return L.unify(_goal_pairs(t)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "failure", F.size("bindings").alias("n_bindings"))


CHAIN_RULES = """SELECT concat('C', cast(p_partkey AS string)) AS rule_id, concat('d(', cast(p_partkey % 40 AS string), ')') AS head_key, concat(CASE WHEN p_size % 2 = 0 THEN 'carrier(view,' ELSE 'carrier(click,' END, cast(p_partkey % 60 AS string), ')') AS atom_key FROM {part}
UNION ALL SELECT concat('C', cast(p_partkey AS string)), concat('d(', cast(p_partkey % 40 AS string), ')'), concat('d(', cast((p_partkey + 1) % 40 AS string), ')') FROM {part} WHERE p_size % 5 <> 0"""
CLOSE = "cr AS (" + CHAIN_RULES.replace("{part}", "part") + """), rn AS (SELECT rule_id, count(DISTINCT atom_key) AS n FROM cr GROUP BY 1), rh AS (SELECT DISTINCT rule_id, head_key FROM cr), f0 AS (SELECT DISTINCT case_id, fact_key, 0 AS rd FROM facts)"""


def _round(i):
    return f"""n{i} AS (SELECT DISTINCT case_id, head_key AS fact_key FROM (SELECT k.case_id, c.rule_id, count(DISTINCT atom_key) AS h FROM f{i - 1} k JOIN cr c ON c.atom_key = k.fact_key GROUP BY ALL) JOIN rn USING (rule_id) JOIN rh USING (rule_id) WHERE h = n),
f{i} AS (SELECT * FROM f{i - 1} UNION ALL SELECT case_id, fact_key, {i} FROM n{i} WHERE (case_id, fact_key) NOT IN (SELECT (case_id, fact_key) FROM f{i - 1}))"""


@query("derive_closure", f"WITH {CLOSE}, {', '.join(_round(i) for i in range(1, 13))} SELECT case_id, fact_key, rd::INT AS round FROM f12", uses=["facts"])
def derive_closure(t):
    return L.derive_closure(t.facts, t.spark.sql(CHAIN_RULES, part=t.part))


@query("quality_gate", """
SELECT rule_id AS id, CASE WHEN trim(coalesce(action, '')) = '' THEN 'unknown_goal_atom' WHEN contains(coalesce(source_ref, ''), ',') AND notes = 'cu' THEN 'noncanonical_goal_surface' WHEN canonical_predicate IS NULL THEN 'unknown_rule_head'
  WHEN rule_type = 'khac' AND subject IS NULL THEN 'weak_shared_template' WHEN rule_type = 'khac' THEN 'unknown_rule_head' WHEN subject IS NULL AND condition IS NULL AND exception IS NULL THEN 'weak_shared_template' ELSE '' END AS reason FROM seeds""", uses=["seeds"])
def quality_gate(t):
    s = t.seeds
    p = s.select(F.col("rule_id").alias("id"), F.when(F.trim("action") == "", "unknown").otherwise("dang ky").alias("goal_predicate"), F.array(F.when(F.col("notes") == "cu", F.col("source_ref"))).alias("goal_args"),
                 F.col("canonical_predicate").alias("head_predicate"), F.array("exception").alias("head_args"), F.when(F.col("rule_type") != "khac", F.col("rule_type")).alias("logic_form"),
                 F.array("condition").alias("body_predicates"), F.col("subject").isNull().alias("shared"))
    return L.quality_gate(p).select("id", "reason")


@query("goal_head_bridge", """
WITH x AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'deadline' WHEN 1 THEN 'obligation' ELSE 'gui_thong_bao' END AS gp, CASE o_custkey % 3 WHEN 0 THEN 'gui_thong_bao' WHEN 1 THEN 'dang_ky_moi' ELSE 'nop_ho_so' END AS ev,
  CASE o_orderkey % 4 WHEN 0 THEN 1 ELSE 0 END AS sc, CASE o_custkey % 5 WHEN 0 THEN 'thong_bao_thay_doi_noi_dung_dang_ky_doanh_nghiep' WHEN 1 THEN 'gui_thong_bao' WHEN 2 THEN 'dang_ky_moi' WHEN 3 THEN 'nop_ho_so_thue' ELSE 'obligation' END AS hp FROM orders),
y AS (SELECT *, CASE WHEN ev = 'gui_thong_bao' THEN 'n' WHEN ev = 'dang_ky_moi' THEN 'r' ELSE '' END AS gt, CASE WHEN contains(hp, 'thong_bao') THEN 'n' WHEN hp LIKE 'dang_ky%' THEN 'r' ELSE '' END AS ht, CASE WHEN hp LIKE 'thong_bao_thay%' THEN 1 ELSE 0 END AS hs FROM x)
SELECT o_orderkey, CASE WHEN gp = hp THEN '' WHEN gp <> 'deadline' THEN 'predicate_mismatch' WHEN ev = 'gui_thong_bao' AND hs = 1 THEN CASE WHEN sc = 1 THEN '' ELSE 'event_mismatch' END
  WHEN sc <> hs OR gt <> ht OR NOT (contains(hp, ev) OR contains(ev, hp)) THEN 'event_mismatch' ELSE '' END AS bridge_failure FROM y""")
def goal_head_bridge(t):
    e = lambda s: F.expr(s)
    p = t.orders.select("o_orderkey", e("CASE o_orderkey % 3 WHEN 0 THEN 'deadline' WHEN 1 THEN 'obligation' ELSE 'gui_thong_bao' END").alias("goal_predicate"),
                        e("CASE o_custkey % 3 WHEN 0 THEN 'gui_thong_bao' WHEN 1 THEN 'dang_ky_moi' ELSE 'nop_ho_so' END").alias("goal_event"),
                        e("CASE o_orderkey % 4 WHEN 0 THEN 'thay_doi_noi_dung_dang_ky_doanh_nghiep' ELSE '' END").alias("goal_scope"), F.lit("").alias("goal_subtype"),
                        e("CASE o_custkey % 5 WHEN 0 THEN 'thong_bao_thay_doi_noi_dung_dang_ky_doanh_nghiep' WHEN 1 THEN 'gui_thong_bao' WHEN 2 THEN 'dang_ky_moi' WHEN 3 THEN 'nop_ho_so_thue' ELSE 'obligation' END").alias("head_predicate"))
    return L.goal_head_bridge(p).select("o_orderkey", "bridge_failure")


@query("validate_proofs", """
WITH s AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS i, role, text FROM conversations)
SELECT conv_id AS chain_id, 'step' || i || ':missing_rule_id' AS issue FROM s WHERE role = 'user' AND length(text) % 3 = 0 UNION ALL
SELECT conv_id, 'step' || i || ':missing_derived_atom' FROM s WHERE role = 'user' AND length(text) % 2 = 0""")
def validate_proofs(t):
    step = F.struct("turn", F.when(F.col("role") == "user", "ok").otherwise("failed").alias("status"), F.when(F.length("text") % 2 != 0, F.col("text")).alias("derived_atom"),
                    F.when(F.length("text") % 3 != 0, F.col("role")).otherwise("").alias("rule_id"))
    chains = t.conversations.groupBy(F.col("conv_id").alias("chain_id")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return L.validate_proofs(chains)
