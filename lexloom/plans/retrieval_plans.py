"""Queries for ranking and matching."""

from pyspark.sql import functions as F

from lexloom.functions.slots import normalize_family
from lexloom.functions.text import fold_text
from lexloom.operators import ranked
from lexloom.operators import retrieval as R
from lexloom.plans.registry import query

BM25_CTE = """
tk AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}') AS t FROM {items}),
sz AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tk),
tf AS (SELECT item_id, dl, term, count(*) AS tf FROM (SELECT item_id, len(t) AS dl, unnest(t) AS term FROM tk) GROUP BY ALL),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
ix AS (SELECT item_id, term, tf, dl, df, ln(1.0 + (n - df + 0.5) / (df + 0.5)) AS idf, avgdl FROM tf JOIN dfq USING (term), sz)
"""
SCORE_CTE = BM25_CTE + """,
qt AS (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}')) AS term FROM {queries}),
sc AS (SELECT query_id, item_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN ix USING (term) GROUP BY ALL)
"""
SCORES = SCORE_CTE.format(items="chunks", queries="questions")


@query("bm25_index", f"WITH {BM25_CTE.format(items='chunks')} SELECT item_id, term, tf, dl::INT AS dl, df, round(idf, 6) AS idf FROM ix", uses=["chunks"])
def bm25_index(t):
    return R.bm25_index(t.chunks).withColumn("idf", F.round("idf", 6))


@query("bm25_scores", f"WITH {SCORES} SELECT query_id, item_id, round(score, 6) AS score FROM sc", uses=["chunks", "questions"])
def bm25_scores(t):
    return R.bm25_scores(t.questions, t.chunks).withColumn("score", F.round("score", 6))


@query("bm25_topk", f"""WITH {SCORES}, rk AS (SELECT query_id, item_id, round(score, 6) AS score FROM sc),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM rk)
SELECT query_id, item_id, score, round(score / max(score) OVER (PARTITION BY query_id), 4) AS norm, rank::INT AS rank FROM r2 WHERE rank <= 5""",
       uses=["chunks", "questions"])
def bm25_topk(t):
    return R.normalize_scores(ranked.blockmax_topk(t.questions, ranked.blockmax_index(t.chunks), 5, 6)).withColumn("norm", F.round("norm", 4))


@query("normalize_scores", f"WITH {SCORES} SELECT query_id, item_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS norm FROM sc",
       uses=["chunks", "questions"])
def normalize_scores(t):
    return R.normalize_scores(R.bm25_scores(t.questions, t.chunks), store=True).select("query_id", "item_id", F.round("norm", 6).alias("norm"))


@query("hybrid_combine", """
WITH l AS (SELECT l_suppkey AS query_id, l_partkey AS item_id, sum(l_quantity) AS score FROM lineitem GROUP BY ALL),
s AS (SELECT l_suppkey AS query_id, l_partkey AS item_id, max(l_tax) AS score FROM lineitem GROUP BY ALL),
ln AS (SELECT query_id, item_id, score / (CASE WHEN max(score) OVER w = 0 THEN 1e-9 ELSE max(score) OVER w END) AS x FROM l WINDOW w AS (PARTITION BY query_id)),
sn AS (SELECT query_id, item_id, score / (CASE WHEN max(score) OVER w = 0 THEN 1e-9 ELSE max(score) OVER w END) AS y FROM s WINDOW w AS (PARTITION BY query_id))
SELECT query_id, item_id, round(0.35 * coalesce(x, 0) + 0.65 * coalesce(y, 0), 9) AS hybrid FROM ln FULL JOIN sn USING (query_id, item_id)""")
def hybrid_combine(t):
    base = t.lineitem.select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("item_id"), "l_returnflag", "l_quantity", "l_tax")
    lex = base.groupBy("query_id", "item_id").agg(F.sum("l_quantity").alias("score"))
    st = base.groupBy("query_id", "item_id").agg(F.max("l_tax").alias("score"))
    return R.hybrid_combine(lex, st).withColumn("hybrid", F.round("hybrid", 9))


PROSE_ALIASES = {"with": ["alpha term", "beta"], "que": ["beta", "gamma"], "must": ["duty"], "deadline": ["thời hạn", "ngày"]}


@query("expand_query", """
WITH x AS (SELECT query_id, trim(text) AS s, list_concat(
   CASE WHEN goal_predicate = 'must' THEN ['duty'] WHEN goal_predicate = 'deadline' THEN ['thời hạn', 'ngày'] ELSE [] END,
   CASE WHEN contains(lower(text), 'with') THEN ['alpha term', 'beta'] ELSE [] END,
   CASE WHEN contains(lower(text), 'que') THEN CASE WHEN contains(lower(text), 'with') THEN ['gamma'] ELSE ['beta', 'gamma'] END ELSE [] END) AS e FROM questions)
SELECT query_id, concat_ws(' ', s, nullif(array_to_string(e, ' '), '')) AS expanded FROM x""", uses=["questions"])
def expand_query(t):
    return R.expand_query(t.questions, PROSE_ALIASES).select("query_id", "expanded")


VARIANTS = """(SELECT query_id, 0 AS variant_no, 'primary' AS variant, text FROM questions UNION ALL
  SELECT query_id, 1, 'conclusion_centric', conclusion FROM questions UNION ALL SELECT query_id, 2, 'source_ref_centric', source_ref FROM questions)"""
VARIANT_SCORES = BM25_CTE.format(items="chunks") + f""",
qv AS (SELECT query_id, variant_no, variant, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}')) AS term FROM {VARIANTS}),
sv AS (SELECT query_id, item_id, variant_no, variant, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qv JOIN ix USING (term) GROUP BY ALL),
mq AS (SELECT query_id, item_id, score, variant FROM sv QUALIFY row_number() OVER (PARTITION BY query_id, item_id ORDER BY score DESC, variant_no) = 1)
"""


def _variants(q):
    v = lambda i, n, c: q.select("query_id", F.lit(i).alias("variant_no"), F.lit(n).alias("variant"), F.col(c).alias("text"))
    return v(0, "primary", "text").union(v(1, "conclusion_centric", "conclusion")).union(v(2, "source_ref_centric", "source_ref"))


@query("multi_query_max", f"WITH {VARIANT_SCORES} SELECT query_id, item_id, score, variant FROM mq", uses=["chunks", "questions"])
def multi_query_max(t):
    return R.multi_query_max(_variants(t.questions), t.chunks).select("query_id", "item_id", F.round("score", 6).alias("score"), "variant")


FOLD = "trim(regexp_replace(strip_accents(lower({0})), '[\\s\\x{{00a0}}]+', ' ', 'g'))"
EVIDENCE = VARIANT_SCORES + f""",
ck AS (SELECT *, {FOLD.format('text')} AS f FROM chunks),
qq AS (SELECT *, {FOLD.format('text')} AS fq, {FOLD.format('conclusion')} AS fc FROM questions),
st AS (SELECT q.query_id, c.item_id, coalesce(mq.score, 0) AS bm,
  CASE WHEN mq.variant <> 'primary' THEN 0.1 ELSE 0 END + CASE WHEN q.rule_id = c.rule_id THEN 6.0 ELSE 0 END
  + CASE WHEN length(q.source_ref) > 8 AND contains(c.text, substr(q.source_ref, 1, 40)) THEN 3.5 WHEN length(q.source_ref) > 8 AND contains(c.text, substr(q.source_ref, 1, 24)) THEN 2.5 ELSE 0 END
  + CASE WHEN q.article = c.article THEN 2.5 ELSE 0 END + CASE WHEN q.clause = c.clause THEN 1.8 ELSE 0 END
  + CASE WHEN fc <> '' AND contains(c.f, fc) THEN 2.2 ELSE 0 END
  + 0.12 * len(list_filter(string_split(fq, ' '), lambda w: length(w) > 3 AND contains(c.f, w))) AS s
  FROM qq q CROSS JOIN ck c LEFT JOIN mq ON mq.query_id = q.query_id AND mq.item_id = c.item_id),
ev AS (SELECT query_id, item_id, round(0.42 * bm / (CASE WHEN max(bm) OVER w = 0 THEN 1e-9 ELSE max(bm) OVER w END)
   + 0.58 * s / (CASE WHEN max(s) OVER w = 0 THEN 1e-9 ELSE max(s) OVER w END), 5) AS score FROM st WINDOW w AS (PARTITION BY query_id)),
et AS (SELECT query_id, item_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id))::INT AS rank FROM ev QUALIFY rank <= 5)
"""


def _evidence(t):
    return ranked.evidence_topk(t.questions, t.chunks, 5, _variants(t.questions))


@query("evidence_topk", f"WITH {EVIDENCE} SELECT query_id, item_id, score, rank FROM et", uses=["chunks", "questions"])
def evidence_topk(t):
    return _evidence(t)


@query("provenance_rescue", f"""WITH {EVIDENCE},
hit AS (SELECT DISTINCT query_id FROM et JOIN chunks c USING (item_id) JOIN questions q USING (query_id) WHERE c.article = q.article),
al AS (SELECT query_id, cast(item_id AS VARCHAR) AS snippet, score, rank FROM et
  UNION ALL SELECT query_id, 'rule_provenance:' || rule_id, 0.35, 0 FROM questions WHERE rule_id IS NOT NULL AND query_id NOT IN (SELECT query_id FROM hit)),
p AS (SELECT query_id, snippet, score, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS position FROM al)
SELECT * FROM p WHERE position <= 5""", uses=["chunks", "questions"])
def provenance_rescue(t):
    return R.provenance_rescue(_evidence(t), t.chunks, t.questions, 5)


FAMILY_SQL = """CASE {0} WHEN 'must' THEN 'obligation' WHEN 'sanction' THEN 'legal_effect' WHEN 'eligibility' THEN 'applicability'
  WHEN 'obligation' THEN 'obligation' WHEN 'permission' THEN 'permission' WHEN 'prohibition' THEN 'prohibition' WHEN 'deadline' THEN 'deadline'
  WHEN 'threshold' THEN 'threshold' WHEN 'applicability' THEN 'applicability' WHEN 'legal_effect' THEN 'legal_effect' WHEN 'procedure' THEN 'procedure'
  WHEN 'dossier' THEN 'dossier' ELSE '' END"""
GOALS = "CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'must' WHEN 1 THEN 'permission' WHEN 2 THEN 'unknown' WHEN 3 THEN 'economy' WHEN 4 THEN 'no_such' ELSE '' END"


@query("candidate_pool", f"""
WITH q AS (SELECT o_orderkey AS query_id, {GOALS} AS g FROM orders), q2 AS (SELECT query_id, g, {FAMILY_SQL.format('g')} AS f FROM q),
r AS (SELECT rule_id, head_predicate AS h, {FAMILY_SQL.format("CASE WHEN head_predicate = '' THEN logic_form ELSE head_predicate END")} AS f FROM rules),
p AS (SELECT q2.query_id, r.rule_id, 1 AS tier FROM q2 JOIN r ON q2.g = r.h WHERE g NOT IN ('', 'unknown')
  UNION ALL SELECT q2.query_id, r.rule_id, 2 FROM q2 JOIN r ON q2.f = r.f WHERE g NOT IN ('', 'unknown') AND q2.f <> '' AND g NOT IN (SELECT h FROM r)),
n AS (SELECT query_id, max(tier) AS tier, count(*) AS n_rules FROM p GROUP BY query_id)
SELECT query_id, coalesce(tier, 3)::INT AS tier, coalesce(n_rules, (SELECT count(*) FROM r))::BIGINT AS n_rules FROM q2 LEFT JOIN n USING (query_id)""", uses=["rules"])
def candidate_pool(t):
    # Pool sizes per question: the pairs of a common goal repeat for every question that asks it, so the pool
    # is built once per distinct goal and joined back.
    q = t.orders.select(F.col("o_orderkey").alias("query_id"), F.expr(GOALS).alias("goal_predicate"))
    goals = q.select(F.col("goal_predicate").alias("query_id"), "goal_predicate").distinct()
    fam = normalize_family(F.when(F.col("head_predicate") == "", F.col("logic_form")).otherwise(F.col("head_predicate")))
    rules = t.rules.withColumn("family", fam)
    pairs, whole = R.candidate_pool(goals, rules)
    n_all = rules.agg(F.count("*").alias("n")).scalar()
    sizes = pairs.groupBy("query_id").agg(F.max("tier").alias("tier"), F.count("*").alias("n_rules")).unionByName(
        whole.select("query_id", F.lit(3).alias("tier"), n_all.alias("n_rules")))
    return q.join(sizes.withColumnRenamed("query_id", "goal_predicate"), "goal_predicate").select("query_id", "tier", "n_rules")


# (query, rule) rows for the structured score, built from order lines: order = question, part = rule.
PAIR_SQL = """
SELECT l_orderkey AS query_id, concat('R', cast(l_partkey AS string), '_', cast(l_linenumber AS string)) AS rule_id, l_quantity, l_tax, l_linenumber,
  CASE cast(l_orderkey % 4 AS int) WHEN 0 THEN 'must' WHEN 1 THEN 'deadline' WHEN 2 THEN 'unknown' ELSE 'eligibility' END AS q_goal,
  CASE cast(l_orderkey % 3 AS int) WHEN 0 THEN 'permission' WHEN 1 THEN 'unknown' ELSE 'obligation' END AS q_focus,
  CASE cast(l_partkey % 4 AS int) WHEN 0 THEN 'must' WHEN 1 THEN 'deadline' WHEN 2 THEN 'unknown' ELSE 'sanction' END AS r_head,
  CASE cast(l_partkey % 3 AS int) WHEN 0 THEN 'obligation' WHEN 1 THEN 'threshold' ELSE 'legal_effect' END AS r_form,
  concat('ev', cast(l_orderkey % 5 AS string)) AS q_event, concat('ev', cast(l_partkey % 5 AS string)) AS r_event,
  concat('c', cast(l_orderkey % 3 AS string), ',c', cast(3 + l_orderkey % 2 AS string)) AS q_cond,
  concat('c', cast(l_partkey % 3 AS string), ',c', cast(3 + l_partkey % 2 AS string), ',c', cast(5 + l_partkey % 4 AS string)) AS r_cond,
  concat('nop ', lower(p_type)) AS q_text, replace(p_name, ' ', '_') AS r_name, concat('nop ho so ', p_name) AS r_blob,
  CASE WHEN l_orderkey % 2 = 0 THEN 'nop_ho_so' ELSE '' END AS q_action, l_partkey % 10 = 0 AS r_shared,
  CASE WHEN l_orderkey % 7 = 0 THEN 'filing' WHEN l_orderkey % 7 = 1 THEN 'paying' ELSE 'other' END AS q_group,
  CASE WHEN l_partkey % 3 = 0 THEN 'filing' WHEN l_partkey % 3 = 1 THEN 'paying' ELSE 'other' END AS r_group
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""


def _pairs(t):
    p = t.spark.sql(PAIR_SQL, lineitem=t.lineitem, part=t.part)
    e = F.array().cast("array<string>")
    return p.select(
        "*", F.split("q_cond", ",").alias("q_conditions"), F.split("r_cond", ",").alias("r_conditions"),
        F.array(F.lit("X"), F.lit("red_bolt")).alias("q_args"), F.array("r_name").alias("r_args"), F.lit("").alias("q_object"),
        F.lit("").alias("q_subject"), F.lit("").alias("q_time"), F.lit("").alias("q_exception"), F.lit("").alias("q_domain_text"),
        F.lit("").alias("r_domain"), F.col("r_blob").alias("r_action"), e.alias("q_context"), e.alias("r_context"))


_WS = "list_distinct(string_split(replace({0}, '_', ' '), ' '))"
_JAC = "(len(list_intersect(" + _WS + ", " + _WS.replace("{0}", "{1}") + ")) / len(list_distinct(list_concat(" + _WS + ", " + _WS.replace("{0}", "{1}") + "))))"
STRUCT_SQL = "WITH pr AS (" + PAIR_SQL.replace("{lineitem}", "lineitem").replace("{part}", "part") + """),
f AS (SELECT *, CASE q_goal WHEN 'must' THEN 'obligation' WHEN 'eligibility' THEN 'applicability' WHEN 'deadline' THEN 'deadline' ELSE CASE WHEN q_focus = 'unknown' THEN '' ELSE q_focus END END AS qf,
  CASE r_head WHEN 'must' THEN 'obligation' WHEN 'sanction' THEN 'legal_effect' WHEN 'deadline' THEN 'deadline' ELSE r_form END AS rf,
  len(list_intersect(string_split(q_cond, ','), string_split(r_cond, ','))) AS i FROM pr),
g AS (SELECT *, CASE WHEN q_action <> '' THEN """ + _JAC.format("q_action", "r_blob") + """ ELSE 0 END AS ao FROM f),
h AS (SELECT *, CASE WHEN q_goal = r_head THEN 10.0 ELSE 0 END AS t_head, CASE WHEN q_focus <> 'unknown' AND q_focus = r_form THEN 5.0 ELSE 0 END AS t_focus,
  CASE WHEN q_focus = 'permission' AND r_form = 'threshold' THEN -3.0 WHEN q_focus = 'permission' THEN 1.0 ELSE 0 END AS t_pen,
  2.0 * """ + _JAC.format("'red_bolt'", "r_name") + """ AS t_arg, 1.5 * """ + _JAC.format("q_text", "r_name") + """ AS t_act,
  CASE WHEN q_event = r_event THEN 7.0 ELSE 0 END AS t_event,
  CASE WHEN i > 0 THEN 6.0 * i / (5 - i) + CASE WHEN i = 2 THEN 2 ELSE 0 END ELSE 0 END AS t_cond,
  CASE WHEN qf = '' OR rf = '' THEN 0 WHEN qf = rf THEN 3.5 - CASE WHEN qf = 'deadline' AND ao < 0.35 THEN 2.5 ELSE 0 END
    ELSE -(3.5 + CASE WHEN r_shared THEN 2.0 ELSE 0 END + CASE WHEN qf IN ('obligation','permission','applicability','legal_effect') AND rf IN ('deadline','threshold') THEN 2.5 ELSE 0 END) END AS t_fam,
  2.2 * ao AS t_ao, qf = 'deadline' AND ao < 0.35 AS dm FROM g),
s AS (SELECT *, t_head + t_focus + t_pen + t_arg + t_act + t_event + t_cond + CASE WHEN t_event > 0 AND t_cond > 0.01 THEN 2.5 ELSE 0 END + t_fam + t_ao
  + CASE WHEN r_shared AND NOT (t_head > 0 OR t_arg > 0.01 OR t_cond > 0.01 OR t_act > 0.01) THEN -3.5 ELSE 0 END AS total FROM h)
"""


@query("structured_score", STRUCT_SQL + "SELECT query_id, rule_id, round(t_cond, 5) AS cond, round(t_fam::DOUBLE, 5) AS fam, round(greatest(total, 0)::DOUBLE, 5) AS structured_total FROM s")
def structured_score(t):
    s = R.structured_score(_pairs(t))
    return s.select("query_id", "rule_id", F.round("condition_atom_overlap", 5).alias("cond"), F.round("goal_family_match", 5).alias("fam"),
                    F.round("structured_total", 5).alias("structured_total"))


RANK_SQL = STRUCT_SQL + """, u AS (SELECT *, l_quantity / 50.0 AS bn, CASE WHEN t_event > 0 THEN 1 ELSE 0 END AS es, least(1.0, t_cond / 6.0) AS cs,
  CASE WHEN q_group = r_group AND q_group <> 'other' THEN 2.0 WHEN q_group <> 'other' AND r_group <> 'other' THEN -3.5 ELSE 0 END AS gs FROM s),
v AS (SELECT *, 2.75 * es + 2.25 * cs + 2.0 * CASE WHEN t_fam > 0 THEN 1 ELSE 0 END + 1.75 * least(1.0, t_ao / 2.0) + gs
   + 0.05 * bn * CASE WHEN qf <> '' AND rf <> '' AND qf <> rf THEN 0.2 ELSE 1 END * CASE WHEN dm THEN 0.4 ELSE 1 END AS tot,
   bool_or(es = 1 AND cs >= 0.35) OVER (PARTITION BY query_id) AS act FROM u),
w AS (SELECT *, CASE WHEN act THEN CASE WHEN es = 1 AND cs >= 0.35 THEN 2 WHEN es = 0 AND cs < 0.2 THEN 0 ELSE 1 END ELSE 1 END AS prio FROM v),
rk AS (SELECT query_id, rule_id, round(tot, 5) AS total, prio::INT AS priority, q_group, r_group, bn, q_action, r_blob, q_event, r_event,
  (row_number() OVER (PARTITION BY query_id ORDER BY prio DESC, round(tot, 5) DESC, bn DESC, rule_id))::INT AS rank FROM w)
"""


def _ranked(t):
    s = R.structured_score(_pairs(t)).withColumn("bm25_norm", F.col("l_quantity") / 50.0)
    qf = normalize_family(F.when(F.col("q_goal") != "unknown", F.col("q_goal")).otherwise(F.when(F.col("q_focus") != "unknown", F.col("q_focus")).otherwise("")))
    rf = normalize_family(F.when(F.col("r_head") != "unknown", F.col("r_head")).otherwise(F.col("r_form")))
    s = s.withColumn("family_differs", (qf != "") & (rf != "") & (qf != rf))
    return R.rank_rules(s, 3).withColumn("total", F.round("total", 5))


@query("rank_rules", RANK_SQL + "SELECT query_id, rule_id, total, priority, rank FROM rk WHERE rank <= 3")
def rank_rules(t):
    return _ranked(t).select("query_id", "rule_id", "total", "priority", "rank")


LIFT_SQL = RANK_SQL + """, t3 AS (SELECT * FROM rk WHERE rank <= 3),
l1 AS (SELECT *, max(CASE WHEN rank = 1 THEN r_group END) OVER (PARTITION BY query_id) AS g1,
   min(CASE WHEN r_group = q_group THEN rank END) OVER (PARTITION BY query_id) AS nope,
   arg_min(rank, (-total, rank)) FILTER (r_group = q_group) OVER (PARTITION BY query_id) AS lift FROM t3),
l2 AS (SELECT *, CASE WHEN g1 <> q_group AND rank = lift THEN 1 WHEN g1 <> q_group AND rank < lift THEN rank + 1 ELSE rank END AS position FROM l1)
"""


@query("action_group_override", LIFT_SQL + "SELECT query_id, rule_id, position::INT AS position FROM l2")
def action_group_override(t):
    return R.action_group_override(_ranked(t)).select("query_id", "rule_id", "position")


@query("chunk_rerank", LIFT_SQL + """, a AS (SELECT *, round(CASE WHEN q_action = '' THEN 0 ELSE CASE WHEN contains(r_blob, q_action) THEN 2.2 ELSE 0 END + 1.8 * """
       + _JAC.format("q_action", "r_blob") + """ END + CASE WHEN q_event = r_event THEN 2.0 ELSE -1.8 END, 5) AS adj FROM l2)
SELECT query_id, rule_id, adj AS adjustment, (row_number() OVER (PARTITION BY query_id ORDER BY adj DESC, total + adj DESC, bn DESC, position))::INT AS final_rank FROM a""")
def chunk_rerank(t):
    e = F.array().cast("array<string>")
    r = R.action_group_override(_ranked(t)).select(
        "query_id", "rule_id", "total", "bm25_norm", "position", "q_action", F.col("r_blob").alias("evidence"), e.alias("q_subtypes"), e.alias("e_subtypes"),
        F.array("q_event").alias("q_scopes"), F.array("r_event").alias("e_scopes"), F.lit(False).alias("generic_only"))
    return R.chunk_rerank(r).select("query_id", "rule_id", F.round("adjustment", 5).alias("adjustment"), "final_rank")


SCOPED_IN = """
SELECT l_suppkey AS query_id, concat('R', cast(l_partkey AS string), '_', cast(l_orderkey AS string), '_', cast(l_linenumber AS string)) AS rule_id,
  concat(CASE WHEN l_partkey % 10 = 0 THEN 'shared' ELSE CASE cast(l_partkey % 3 AS int) WHEN 0 THEN 'tax' WHEN 1 THEN 'labor' ELSE 'enterprise' END END, '|', cast(l_partkey AS string)) AS global_key,
  CASE cast(l_partkey % 3 AS int) WHEN 0 THEN 'tax' WHEN 1 THEN 'labor' ELSE 'enterprise' END AS domain,
  CASE WHEN l_partkey % 10 = 0 THEN 'shared' ELSE 'domain' END AS layer, l_extendedprice AS score FROM {lineitem}"""
ROUTE_IN = """SELECT s_suppkey AS query_id, CASE cast(s_suppkey % 3 AS int) WHEN 0 THEN 'tax' WHEN 1 THEN 'labor' ELSE 'enterprise' END AS primary_domain,
  CASE cast(s_suppkey % 3 AS int) WHEN 0 THEN 'labor' WHEN 1 THEN 'tax' ELSE 'tax' END AS secondary_domain, s_suppkey % 4 <> 0 AS include_shared, s_suppkey % 2 = 0 AS allow_expansion FROM {supplier}"""


@query("scoped_retrieve", "WITH c AS (" + SCOPED_IN.replace("{lineitem}", "lineitem") + "), r AS (" + ROUTE_IN.replace("{supplier}", "supplier") + """),
s AS (SELECT query_id, rule_id, global_key, score, CASE WHEN layer = 'shared' THEN CASE WHEN include_shared THEN 'shared' END WHEN domain = primary_domain THEN domain
   WHEN allow_expansion AND domain = secondary_domain THEN 'secondary:' || domain END AS scope FROM c JOIN r USING (query_id)),
a AS (SELECT *, CASE WHEN scope = 'shared' THEN 0 WHEN scope LIKE 'secondary:%' THEN 2 ELSE 1 END AS sn FROM s WHERE scope IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, rule_id) <= 8),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id, global_key ORDER BY score DESC, sn, rule_id) = 1)
SELECT query_id, rule_id, global_key, scope, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, sn, rule_id))::INT AS rank FROM b QUALIFY rank <= 20""")
def scoped_retrieve(t):
    return R.scoped_retrieve(t.spark.sql(SCOPED_IN, lineitem=t.lineitem), t.spark.sql(ROUTE_IN, supplier=t.supplier))


@query("link_subgoals", f"""
WITH s AS (SELECT conv_id AS case_id, turn AS snippet_id, {FOLD.format('text')} AS f FROM conversations WHERE role = 'assistant'),
g AS (SELECT conv_id AS case_id, turn AS goal_no, text AS subgoal, list_filter(string_split({FOLD.format('text')}, ' '), lambda w: length(w) > 2) AS ws FROM conversations WHERE role <> 'assistant'),
p AS (SELECT s.case_id, snippet_id, goal_no, subgoal, len(list_filter(ws, lambda w: contains(f, w)))::INT AS hits FROM s JOIN g USING (case_id))
SELECT case_id, snippet_id, goal_no, subgoal, hits FROM p WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY case_id, snippet_id ORDER BY hits DESC, goal_no) = 1""")
def link_subgoals(t):
    c = t.conversations
    s = c.filter("role = 'assistant'").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("snippet_id"), "text")
    g = c.filter("role <> 'assistant'").select(F.col("conv_id").alias("case_id"), F.col("turn").alias("goal_no"), F.col("text").alias("subgoal"))
    return R.link_subgoals(s, g)


@query("citations", """
WITH e AS (SELECT l_orderkey AS a, l_linenumber AS rk, l_partkey % 5 AS ch, CASE WHEN l_linenumber % 2 = 0 THEN 'Điều ' || (l_partkey % 3) ELSE '' END AS ac, p_name AS sd, p_brand || chr(10) || p_type AS tx
  FROM lineitem JOIN part ON l_partkey = p_partkey),
d AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY a, ch, ac, sd ORDER BY rk, tx) = 1),
u AS (SELECT a, rk, concat_ws(' — ', nullif(ac, ''), sd) AS label, replace(tx, chr(10), ' ') AS excerpt, ch::VARCHAR AS source FROM d
  UNION ALL SELECT o_orderkey, 1000000, 'ref ' || o_orderpriority, o_orderstatus, 'rule:R' || o_custkey FROM orders)
SELECT a AS answer_id, label, excerpt, source, (row_number() OVER (PARTITION BY a ORDER BY rk, source, label, excerpt))::INT AS citation_no FROM u""")
def citations(t):
    ev = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("rank"), (F.col("l_partkey") % 5).alias("chunk_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Điều "), (F.col("l_partkey") % 3).cast("string"))).otherwise("").alias("article_clause"),
        F.col("p_name").alias("source_doc"), F.concat("p_brand", F.lit("\n"), "p_type").alias("text"))
    own = t.orders.select(F.col("o_orderkey").alias("answer_id"), F.concat(F.lit("R"), "o_custkey").alias("rule_id"),
                          F.concat(F.lit("ref "), "o_orderpriority").alias("source_ref"), F.col("o_orderstatus").alias("source_text"))
    return R.citations(ev, own)


RAW_SQL = f"""
tx AS (SELECT doc_id AS text_id, {FOLD.format('text')} AS b, source AS sr FROM documents),
pt AS (SELECT DISTINCT item_id AS entry_id, {FOLD.format('text')} AS p FROM benchmark UNION SELECT DISTINCT entry_id, trim(p) FROM (SELECT item_id AS entry_id, unnest(string_split({FOLD.format('text')}, '.')) AS p FROM benchmark)),
pw AS (SELECT *, list_filter(string_split(p, ' '), lambda w: length(w) > 2) AS ws FROM pt WHERE length(p) >= 2),
tw AS (SELECT text_id, sr, b, list_distinct(regexp_extract_all(b, '[\\p{{L}}\\p{{N}}_]+')) AS bw FROM tx),
s0 AS (SELECT text_id, entry_id, p, contains(b, p) AS whole, len(ws) AS nw, CASE WHEN len(ws) = 0 THEN 0 ELSE len(list_filter(ws, lambda w: list_contains(bw, w))) / len(ws) END AS ratio FROM tw CROSS JOIN pw),
rw AS (SELECT text_id, entry_id, max(CASE WHEN whole THEN 0.72 + least(0.27, length(p) / 120.0) WHEN nw = 0 THEN 0 WHEN ratio >= 0.85 THEN 0.42 + 0.12 * ratio
   WHEN ratio >= 0.66 THEN 0.22 + 0.18 * ratio WHEN ratio >= 0.34 THEN 0.12 + 0.12 * ratio ELSE 0 END) AS raw FROM s0 GROUP BY ALL HAVING raw > 0)
"""


def _raw(t):
    """Patterns of an entry: the whole benchmark text, and each of its sentences."""
    texts = t.documents.select(F.col("doc_id").alias("text_id"), "text")
    b = t.benchmark.select(F.col("item_id").alias("entry_id"), fold_text("text").alias("pattern"))
    parts = b.select("entry_id", F.explode(F.split("pattern", r"\.")).alias("pattern")).select("entry_id", F.trim("pattern"))
    return R.pattern_scores(texts, b.union(parts))


@query("pattern_scores", f"WITH {RAW_SQL} SELECT text_id, entry_id, round(raw, 6) AS raw FROM rw")
def pattern_scores(t):
    return _raw(t).withColumn("raw", F.round("raw", 6))


@query("condition_match", f"""WITH {RAW_SQL},
e AS (SELECT item_id AS entry_id, 'pred' || (item_id % 9) AS predicate, 'd' || (item_id % 3) AS domain, item_id % 4 = 0 AS generic, item_id % 10 AS priority FROM benchmark),
h AS (SELECT doc_id AS text_id, CASE WHEN doc_id % 2 = 0 THEN 'd' || (doc_id % 3) ELSE '' END AS dh FROM documents),
j AS (SELECT text_id, entry_id, predicate, round(raw, 6) AS raw, generic, priority, domain, dh, max(CASE WHEN NOT generic THEN raw END) OVER (PARTITION BY text_id) AS bs,
   dh <> '' AND domain <> dh AS off FROM rw JOIN e USING (entry_id) JOIN h USING (text_id)),
k AS (SELECT *, round((raw + priority / 1000.0) * CASE WHEN generic AND coalesce(bs, 0) >= 0.58 THEN 0.82 ELSE 1 END + 0.05
   + CASE WHEN dh = '' THEN 0 WHEN off THEN -0.12 ELSE 0.08 END - CASE WHEN raw >= 0.6 AND off THEN 0.18 ELSE 0 END, 6) AS rr FROM j),
n AS (SELECT *, row_number() OVER w AS rn, lead(rr) OVER w AS rr2, lead(predicate) OVER w AS p2, lead(off) OVER w AS b2 FROM k
   WINDOW w AS (PARTITION BY text_id ORDER BY rr DESC, raw DESC, entry_id)),
m AS (SELECT h.text_id, predicate, raw, rr, rr2, p2, b2, off, CASE WHEN p2 IS NULL THEN 1.0 ELSE rr - rr2 END AS gap,
   coalesce(rr IS NOT NULL AND NOT (off AND rr < 0.64) AND (rr >= 0.48 OR (raw >= 0.58 AND NOT off) OR (raw >= 0.5 AND rr >= 0.42)), false) AS ok
   FROM h LEFT JOIN n ON n.text_id = h.text_id AND rn = 1)
SELECT text_id, CASE WHEN ok THEN predicate ELSE 'stated_condition' END AS predicate, coalesce(raw, 0.0) AS raw, coalesce(rr, 0.0) AS rerank,
  CASE WHEN ok AND gap >= 0.08 THEN '' WHEN gap < 0.1 AND rr2 > 0.38 AND p2 <> predicate AND NOT b2 THEN 'close_contextual_alternatives'
   WHEN NOT ok THEN 'no_usable_contextual_match' WHEN gap < 0.06 AND rr2 > 0.35 THEN 'contextual_score_tie' ELSE '' END AS ambiguity FROM m""")
def condition_match(t):
    d = F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string"))
    texts = t.documents.select(F.col("doc_id").alias("text_id"), F.when(F.col("doc_id") % 2 == 0, d).otherwise("").alias("domain_hint"), F.lit("").alias("family_hint"))
    e = t.benchmark.selectExpr("item_id AS entry_id", "concat('pred', item_id % 9) AS predicate", "concat('d', item_id % 3) AS domain", "'' AS family",
                               "item_id % 4 = 0 AS generic", "item_id % 10 AS priority")
    m = R.condition_match(_raw(t).withColumn("raw", F.round("raw", 6)), e, texts)
    return m.withColumn("rerank", F.round("rerank", 6))


def _mentions_sql():
    """Positions of a role's mentions are the lengths of the gaps and mentions before them."""
    per = " UNION ALL ".join(
        f"SELECT unit_id AS text_id, '{role}' AS role, {R.ROLE_PRIORITY[role]} AS prio, regexp_extract_all(text, '(?i){rx}') AS hits, regexp_split_to_array(text, '(?i){rx}') AS gaps FROM clauses"
        for role, rx in R.MENTION_PATTERNS)
    return f"""WITH h AS ({per}), n AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM h),
m AS (SELECT text_id, role, prio, trim(hits[i]) AS surface, length(hits[i]) AS len, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0))::INT AS start FROM n),
o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY text_id, lower(surface), start ORDER BY len, prio, role) = 1)
SELECT text_id, surface, start, role, row_number() OVER (PARTITION BY text_id ORDER BY prio, start, len, role) = 1 AS is_primary FROM o"""


@query("entity_mentions", _mentions_sql(), uses=["clauses"])
def entity_mentions(t):
    return R.entity_mentions(t.clauses.select(F.col("unit_id").alias("text_id"), "text"))


CUES = [("deadline", 2.0, ["by", "par", "von"]), ("deadline", 1.5, ["was"]), ("obligation", 2.5, ["with", "avec", "mit"]),
        ("permission", 2.0, ["from", "pour", "für"]), ("permission", 1.0, ["that"])]


def _any(*ws):
    return "(" + " OR ".join(f"contains(l, '{w}')" for w in ws) + ")"


@query("focus_score", f"""
WITH x AS (SELECT conv_id, turn, {FOLD.format("text")} AS l FROM conversations),
s AS (SELECT conv_id, turn, CASE WHEN {_any('by', 'par', 'von')} THEN 2.0 ELSE 0.0 END + CASE WHEN {_any('was')} THEN 1.5 ELSE 0.0 END AS d,
  CASE WHEN {_any('with', 'avec', 'mit')} THEN 2.5 ELSE 0.0 END AS o, CASE WHEN {_any('from', 'pour', 'fur')} THEN 2.0 ELSE 0.0 END + CASE WHEN {_any('that')} THEN 1.0 ELSE 0.0 END AS p FROM x)
SELECT conv_id * 100 + turn AS text_id, d::DOUBLE AS score_deadline, o::DOUBLE AS score_obligation, p::DOUBLE AS score_permission,
  CASE WHEN greatest(d, o, p) = 0 THEN 'unknown' WHEN d = greatest(d, o, p) THEN 'deadline' WHEN o = greatest(d, o, p) THEN 'obligation' ELSE 'permission' END AS focus FROM s""")
def focus_score(t):
    return R.focus_score(t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("text_id"), "text"), CUES)


@query("split_intents", """
WITH p AS (SELECT conv_id * 100 + turn AS text_id, list_filter(list_transform(regexp_split_to_array(text, '(?i)\\s+(?:and|et|und)\\s+|[;?]\\s*'), lambda x: trim(x)), lambda x: x <> '') AS l FROM conversations)
SELECT text_id, (i - 1)::INT AS intent_no, l[i] AS intent FROM (SELECT text_id, l, unnest(range(1, len(l) + 1)) AS i FROM p)""")
def split_intents(t):
    return R.split_intents(t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("text_id"), "text"), ["and", "et", "und"])
