"""Queries for vocabularies and registries."""

from pyspark.sql import functions as F

from lexloom.common import cut_lineage
from lexloom.functions.text import slug
from lexloom.operators import vocab as V
from lexloom.plans.canonical_plans import TERMS, _terms
from lexloom.plans.registry import query

SLUG = "coalesce(nullif(trim(regexp_replace(strip_accents(replace(lower({0}), 'đ', 'd')), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown')"
CONF = "CASE WHEN NOT rv AND (CASE WHEN sc >= 72 THEN 'cao' WHEN sc >= 48 THEN 'trung_binh' ELSE 'thap' END) = 'thap' THEN 'trung_binh' WHEN sc >= 72 THEN 'cao' WHEN sc >= 48 THEN 'trung_binh' ELSE 'thap' END AS confidence, CASE WHEN rv THEN 'co' ELSE 'khong' END AS needs_review"

PRED = f"""
pw AS (SELECT coalesce(nullif(trim(canonical_predicate), ''), CASE WHEN trim(action) <> '' THEN {SLUG.format('action')} END) AS canonical, rule_id, rule_type, typed_predicate AS typed,
  CASE WHEN family = 'must' THEN 'obligation' END AS fam, nullif(trim(summary), '') AS summ, nullif(trim(action), '') AS act FROM seeds),
pb AS (SELECT canonical, arg_min(fam, rule_id) FILTER (fam IS NOT NULL) AS fam, coalesce(arg_min(summ, rule_id) FILTER (summ IS NOT NULL), arg_min(act, rule_id) FILTER (act IS NOT NULL), '') AS summary, count(*) AS n FROM pw WHERE canonical IS NOT NULL GROUP BY 1),
pt1 AS (SELECT canonical, rule_type, count(*) AS m FROM pw GROUP BY ALL), pt2 AS (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY m DESC, rule_type) AS rn FROM pt1),
pm AS (SELECT canonical, string_agg(rule_type || '(' || m || ')', '; ' ORDER BY rn) FILTER (rn <= 5) AS when_used, count(*) AS n_types, max(m) AS top_n, max(rule_type) FILTER (rn = 1) AS mode FROM pt2 GROUP BY 1),
ty AS (SELECT canonical, typed FROM (SELECT canonical, typed, count(*) AS m FROM pw WHERE typed IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY m DESC, typed) = 1),
pi AS (SELECT canonical, string_agg(rule_id, '; ' ORDER BY rule_id) AS ids FROM (SELECT DISTINCT canonical, rule_id FROM pw QUALIFY row_number() OVER (PARTITION BY canonical ORDER BY rule_id) <= 5) GROUP BY 1),
pv AS (SELECT canonical, coalesce(fam, CASE WHEN contains(canonical, 'dang_ky') THEN 'procedure' ELSE 'khac' END) AS family, coalesce(typed, mode || ':' || canonical) AS typed, summary, when_used, n_types, top_n / n AS top_share, typed IS NOT NULL AS ht, ids FROM pb JOIN pm USING (canonical) LEFT JOIN ty USING (canonical) JOIN pi USING (canonical)),
pq AS (SELECT *, 100 - CASE WHEN ht THEN 0 ELSE 42 END - CASE WHEN family = 'khac' THEN 28 ELSE 0 END - CASE WHEN length(canonical) < 12 THEN 18 ELSE 0 END - CASE WHEN n_types >= 3 THEN 12 ELSE 0 END - CASE WHEN n_types >= 2 AND top_share < 0.55 THEN 15 ELSE 0 END AS sc FROM pv),
pr AS (SELECT *, sc < 58 OR NOT ht OR (family = 'khac' AND length(canonical) < 16) AS rv FROM pq)"""


@query("predicate_vocab", f"WITH {PRED} SELECT canonical, family, typed, summary, when_used, ids AS example_rule_ids, sc::INT AS score, {CONF} FROM pr", uses=["seeds"])
def predicate_vocab(t):
    return V.predicate_vocab(t.seeds).select("canonical", "family", "typed", "summary", "when_used", "example_rule_ids", "score", "needs_review", "confidence")


def _groups(rows, keys, n_raws, n_ids):
    k = ", ".join(keys)
    return f"""rw AS ({rows}), rd AS (SELECT DISTINCT {k}, raw FROM rw), rs AS (SELECT {k}, count(*) AS n_variants, max(length(raw)) AS max_raw_len FROM rd GROUP BY ALL),
rf AS (SELECT {k}, string_agg(raw, ' | ' ORDER BY raw) AS raw_variants FROM (SELECT * FROM rd QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY raw) <= {n_raws}) GROUP BY ALL),
ri AS (SELECT {k}, string_agg(rule_id, '; ' ORDER BY rule_id) AS example_rule_ids FROM (SELECT * FROM (SELECT DISTINCT {k}, rule_id FROM rw) QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY rule_id) <= {n_ids}) GROUP BY ALL),
gr AS (SELECT * FROM rs JOIN rf USING ({k}) JOIN ri USING ({k}))"""


OE_QA = """qa AS (SELECT *, 100 - CASE WHEN n_variants >= 8 THEN 30 WHEN n_variants >= 5 THEN 18 ELSE 0 END - CASE WHEN length(canonical) < 6 THEN 22 ELSE 0 END - CASE WHEN max_raw_len > 180 THEN 25 ELSE 0 END - CASE WHEN family = 'khac' THEN 15 ELSE 0 END AS sc FROM fm),
qr AS (SELECT *, sc < 55 OR n_variants >= 6 OR max_raw_len > 220 AS rv FROM qa)"""
OBJ_ROWS = f"SELECT rule_id, raw, {SLUG.format('raw')} AS canonical FROM (SELECT rule_id, trim(unnest(list_concat([object], regexp_split_to_array(coalesce(dossier, ''), '[;；]\\s*')))) AS raw FROM seeds) WHERE length(raw) >= 2 AND length({SLUG.format('raw')}) >= 3"
OBJ = f"""{_groups(OBJ_ROWS, ['canonical'], 4, 5)}, fm AS (SELECT *, CASE WHEN regexp_matches(canonical, 'ho_so|ban|giay|mau|bieu') THEN 'ho_so_tai_lieu' WHEN regexp_matches(canonical, 'von|gop|phan_von') THEN 'von_gop_von'
  WHEN regexp_matches(canonical, 'co_phan|co_dong|thanh_vien') THEN 'co_phan_thanh_vien' ELSE 'khac' END AS family FROM gr), {OE_QA}"""


@query("object_vocab", f"WITH {OBJ} SELECT canonical, family, n_variants, raw_variants, example_rule_ids, sc::INT AS score, {CONF} FROM qr", uses=["seeds"])
def object_vocab(t):
    return V.object_vocab(t.seeds).select("canonical", "family", "n_variants", "raw_variants", "example_rule_ids", "score", "needs_review", "confidence")


EFF_ROWS = f"SELECT rule_id, raw, {SLUG.format('raw')} AS canonical FROM (SELECT rule_id, trim(unnest([effect, result])) AS raw FROM seeds) WHERE length(raw) >= 3 AND length({SLUG.format('raw')}) >= 4"
EFF = f"""{_groups(EFF_ROWS, ['canonical'], 3, 5)}, fm AS (SELECT *, CASE WHEN canonical LIKE 'duoc\\_%' ESCAPE '\\' THEN 'tich_cuc_duoc' WHEN canonical LIKE 'bi\\_%' ESCAPE '\\' THEN 'tieu_cuc_bi'
  WHEN contains(canonical, 'cap_giay') THEN 'cap_giay' ELSE 'khac' END AS family FROM gr), {OE_QA}"""


@query("effect_vocab", f"WITH {EFF} SELECT canonical, family, n_variants, raw_variants, example_rule_ids, sc::INT AS score, {CONF} FROM qr", uses=["seeds"])
def effect_vocab(t):
    return V.effect_vocab(t.seeds).select("canonical", "family", "n_variants", "raw_variants", "example_rule_ids", "score", "needs_review", "confidence")


ENT_ROWS = f"""SELECT rule_id, kind, raw, {SLUG.format('raw')} AS canonical FROM (SELECT rule_id, unnest(['subject','subject_type','subject_role','authority','authority','scope']) AS kind,
  trim(unnest([subject, subject_type, subject_role, receiver, handler, scope])) AS raw FROM seeds) WHERE length(raw) >= 2 AND length({SLUG.format('raw')}) >= 2"""
ENT = f"""{_groups(ENT_ROWS, ['kind', 'canonical'], 6, 8)}, qa AS (SELECT *, 100 - CASE WHEN n_variants >= 7 THEN 32 WHEN n_variants >= 4 THEN 18 ELSE 0 END - CASE WHEN length(canonical) < 4 THEN 28 ELSE 0 END - CASE WHEN max_raw_len > 120 THEN 20 ELSE 0 END AS sc FROM gr),
qr AS (SELECT *, sc < 52 OR n_variants >= 5 OR length(canonical) < 3 AS rv FROM qa)"""


@query("entity_vocab", f"WITH {ENT} SELECT kind, canonical, n_variants, raw_variants, example_rule_ids, sc::INT AS score, {CONF} FROM qr", uses=["seeds"])
def entity_vocab(t):
    return V.entity_vocab(t.seeds).select("kind", "canonical", "n_variants", "raw_variants", "example_rule_ids", "score", "needs_review", "confidence")


MET = f"""mr AS (SELECT rule_id, CASE WHEN metric IS NULL THEN 'unknown_metric' ELSE {SLUG.format('metric')} END AS mc, CASE WHEN unit IS NULL THEN '' ELSE {SLUG.format('unit')} END AS uc, metric AS raw
  FROM seeds WHERE rule_type = 'quy_tac_nguong_dinh_luong' AND coalesce(metric, unit) IS NOT NULL),
mg AS (SELECT mc, uc, count(*) AS n_rules FROM mr GROUP BY ALL), ml AS (SELECT mc, count(DISTINCT raw) AS n_labels FROM mr GROUP BY ALL),
mi AS (SELECT mc, uc, string_agg(rule_id, '; ' ORDER BY rule_id) AS ids FROM (SELECT * FROM (SELECT DISTINCT mc, uc, rule_id FROM mr) QUALIFY row_number() OVER (PARTITION BY mc, uc ORDER BY rule_id) <= 5) GROUP BY ALL),
mq AS (SELECT *, 100 - CASE WHEN mc = 'unknown_metric' THEN 45 ELSE 0 END - CASE WHEN uc = '' THEN 22 ELSE 0 END - CASE WHEN n_labels >= 4 THEN 20 WHEN n_labels >= 2 THEN 10 ELSE 0 END AS sc FROM mg JOIN ml USING (mc) JOIN mi USING (mc, uc)),
mv AS (SELECT *, sc < 55 OR mc = 'unknown_metric' AS rv FROM mq)"""


@query("metric_vocab", f"WITH {MET} SELECT mc AS metric_canonical, uc AS unit_canonical, n_rules, n_labels, ids AS example_rule_ids, sc::INT AS score, {CONF} FROM mv", uses=["seeds"])
def metric_vocab(t):
    return V.metric_vocab(t.seeds).select("metric_canonical", "unit_canonical", "n_rules", "n_labels", "example_rule_ids", "score", "needs_review", "confidence")


@query("add_lexicon_terms", f"WITH {PRED}, lx AS (SELECT DISTINCT replace(p_name, ' ', '_') || CASE WHEN p_size % 2 = 0 THEN '_x' ELSE '' END AS canonical FROM part) "
       "SELECT canonical, family, confidence FROM (SELECT canonical, family, " + CONF + " FROM pr) UNION ALL SELECT canonical, 'tu_lexicon', 'thap' FROM lx WHERE canonical NOT IN (SELECT canonical FROM pr)", uses=["seeds"])
def add_lexicon_terms(t):
    lex = t.part.select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_size") % 2 == 0, "_x").otherwise("")).alias("normalized"), F.lit("").alias("group"))
    return V.add_lexicon_terms(V.predicate_vocab(t.seeds), lex).select("canonical", "family", "confidence")


# Names for the refinement: effects with tails, built from parts.
NAMES = """CASE cast(p_partkey % 6 AS int) WHEN 0 THEN concat('duoc_cap_', replace(p_name, ' ', '_'), '_tru_truong_hop_khac') WHEN 1 THEN concat('bi_thu_hoi_', replace(p_name, ' ', '_'), '_neu_vi_pham_tru_khi_co')
  WHEN 2 THEN concat('cong_ty_', replace(p_name, ' ', '_')) WHEN 3 THEN concat('khi_', lower(p_type)) WHEN 4 THEN concat('a_neu_', replace(p_name, ' ', '_')) ELSE replace(p_name, ' ', '_') END"""
CUT = """CASE cast(p_partkey % 6 AS int) WHEN 0 THEN concat('duoc_cap_', replace(p_name, ' ', '_')) WHEN 1 THEN concat('bi_thu_hoi_', replace(p_name, ' ', '_')) ELSE """ + NAMES + " END"
EFFN = f"en AS (SELECT DISTINCT {NAMES} AS canonical, {CUT} AS base FROM part)"


def _effects(t):
    return t.part.select(F.expr(NAMES).alias("canonical")).distinct().select("canonical", F.lit("khong").alias("needs_review"), F.lit("").alias("example_rule_ids"))


@query("refine_effects", f"WITH {EFFN} SELECT base AS canonical, CASE WHEN base <> min(canonical) THEN 'co' ELSE 'khong' END AS needs_review, count(*) AS n_merged, CASE WHEN base LIKE 'duoc%' AND base <> min(canonical) THEN 'tach_exception_khoi_effect' WHEN base <> min(canonical) THEN 'tach_condition_khoi_effect' ELSE '' END AS notes FROM en WHERE canonical NOT LIKE 'cong_ty_%' GROUP BY base")
def refine_effects(t):
    return V.refine_effects(_effects(t))[0]


@query("effect_fragments", f"WITH {EFFN} SELECT CASE WHEN base LIKE 'duoc%' THEN 'exception' ELSE 'condition' END AS fragment_kind, canonical AS original_canonical, substr(canonical, length(base) + 2) AS tail_slug FROM en WHERE base <> canonical")
def effect_fragments(t):
    return V.refine_effects(_effects(t))[1]


@query("moved_predicates", f"WITH {EFFN}, mv AS (SELECT canonical FROM en WHERE canonical LIKE 'cong_ty_%'), pn AS (SELECT DISTINCT replace(p_name, ' ', '_') AS canonical FROM part) SELECT canonical, false AS added FROM pn UNION ALL SELECT canonical, true FROM mv WHERE canonical NOT IN (SELECT canonical FROM pn)")
def moved_predicates(t):
    vocab = t.part.select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("canonical")).distinct()
    return V.merge_predicates(vocab, V.refine_effects(_effects(t))[2].select("canonical")).select("canonical", "added")


@query("refine_objects", f"WITH {EFFN} SELECT canonical, canonical LIKE 'khi_%' OR contains(canonical, 'tru_truong_hop') AS dropped FROM en")
def refine_objects(t):
    kept, dropped = V.refine_objects(_effects(t))
    return kept.select("canonical", F.lit(False).alias("dropped")).union(dropped.select("canonical", F.lit(True)))


@query("normalize_with_vocab", f"""
WITH {PRED}, pk AS (SELECT canonical FROM pr), ov AS (SELECT DISTINCT canonical FROM ({OBJ_ROWS})), ev AS (SELECT DISTINCT canonical FROM ({EFF_ROWS})),
bo AS (SELECT DISTINCT {SLUG.format('object')} AS canonical FROM seeds WHERE rule_type = 'khac' AND object IS NOT NULL),
tv AS (SELECT DISTINCT kind, canonical FROM ({ENT_ROWS})), {MET},
kk AS (SELECT *, CASE WHEN canonical_predicate IS NOT NULL THEN {SLUG.format('canonical_predicate')} END AS cp, CASE WHEN typed_predicate IS NOT NULL THEN {SLUG.format("split_part(typed_predicate, ':', 2)")} END AS tp,
  CASE WHEN action <> '' THEN {SLUG.format('action')} END AS ac, {SLUG.format('object')} AS ob, {SLUG.format('effect')} AS e1, {SLUG.format('result')} AS e2, {SLUG.format('subject')} AS su, {SLUG.format('subject_type')} AS st,
  {SLUG.format('handler')} AS a1, {SLUG.format('receiver')} AS a2, {SLUG.format('scope')} AS so, CASE WHEN metric IS NULL THEN '' ELSE {SLUG.format('metric')} END AS mm, CASE WHEN unit IS NULL THEN '' ELSE {SLUG.format('unit')} END AS uu FROM seeds),
lk AS (SELECT kk.*, coalesce(p1.canonical, p2.canonical, p3.canonical) AS predicate, CASE WHEN bo.canonical IS NULL THEN o.canonical END AS oc, bo.canonical IS NOT NULL AS cut, CASE WHEN effect IS NOT NULL AND f1.canonical IS NOT NULL THEN f1.canonical WHEN result IS NOT NULL THEN f2.canonical END AS ec,
  CASE WHEN subject IS NOT NULL THEN s1.canonical END AS sc, s2.canonical AS stc, coalesce(CASE WHEN handler IS NOT NULL THEN h1.canonical END, CASE WHEN receiver IS NOT NULL THEN h2.canonical END) AS hc, CASE WHEN scope IS NOT NULL THEN g.canonical END AS gc,
  EXISTS (SELECT 1 FROM mg WHERE mg.mc = mm AND (mg.uc = uu OR mg.uc = '')) AS mok FROM kk LEFT JOIN pk p1 ON p1.canonical = cp LEFT JOIN pk p2 ON p2.canonical = tp LEFT JOIN pk p3 ON p3.canonical = ac LEFT JOIN ov o ON o.canonical = ob LEFT JOIN bo ON bo.canonical = ob
  LEFT JOIN ev f1 ON f1.canonical = e1 LEFT JOIN ev f2 ON f2.canonical = e2 LEFT JOIN tv s1 ON s1.kind = 'subject' AND s1.canonical = su LEFT JOIN tv s2 ON s2.kind = 'subject_type' AND s2.canonical = st
  LEFT JOIN tv h1 ON h1.kind = 'authority' AND h1.canonical = a1 LEFT JOIN tv h2 ON h2.kind = 'authority' AND h2.canonical = a2 LEFT JOIN tv g ON g.kind = 'scope' AND g.canonical = so),
nt AS (SELECT *, concat_ws(';', CASE WHEN predicate IS NULL THEN 'predicate_fallback' END, CASE WHEN cut THEN 'object_slug_was_split_fragment' WHEN oc IS NULL THEN 'object_unmapped' END, CASE WHEN coalesce(effect, result) IS NOT NULL AND ec IS NULL THEN 'effect_unmapped' END,
  CASE WHEN subject IS NOT NULL AND sc IS NULL THEN 'subject_unmapped' END, CASE WHEN stc IS NULL THEN 'subject_type_unmapped' END, CASE WHEN coalesce(handler, receiver) IS NOT NULL AND hc IS NULL THEN 'authority_unmapped' END,
  CASE WHEN scope IS NOT NULL AND gc IS NULL THEN 'scope_unmapped' END, CASE WHEN coalesce(metric, unit) IS NOT NULL AND NOT mok THEN 'metric_unmapped' END) AS nts FROM lk)
SELECT rule_id, predicate, oc AS object_canonical, ec AS effect_canonical, hc AS authority_canonical, nts AS notes, CASE WHEN nts = '' THEN 'full' ELSE 'partial' END AS status FROM nt""", uses=["seeds"])
def normalize_with_vocab(t):
    s = t.seeds
    # The vocabularies are stage tables: they are written once and then looked up several times.
    fragments = s.filter("rule_type = 'khac' AND object IS NOT NULL").select(slug("object").alias("canonical"))
    n = V.normalize_with_vocab(s, *[cut_lineage(v(s)) for v in (V.predicate_vocab, V.object_vocab, V.effect_vocab, V.entity_vocab, V.metric_vocab)], fragments)
    return n.select("rule_id", "predicate", "object_canonical", "effect_canonical", "authority_canonical", F.array_join("notes", ";").alias("notes"), "status")


@query("shared_predicates", f"WITH {TERMS}, nm AS (SELECT rule_id, unnest(list_distinct(list_filter([hp, CASE WHEN b1 IS NOT NULL THEN 'applies_if' END, CASE WHEN b2 IS NOT NULL THEN 'unless' END], lambda x: x IS NOT NULL))) AS name, subject_type FROM sg) "
       "SELECT name, count(*) AS n, count(DISTINCT subject_type) AS n_domains FROM nm GROUP BY name HAVING n > 1", uses=["seeds"])
def shared_predicates(t):
    return V.shared_registry(_terms(t), "predicates")


ENTS = ["unknown", "Công ty", "Doanh nghiệp"]


@query("promote_shared_rules", f"WITH {TERMS}, nm AS (SELECT a2 AS name, count(*) AS n FROM sg WHERE a2 IN ('unknown', 'Công ty', 'Doanh nghiệp') GROUP BY a2 HAVING n > 1) SELECT p_brand AS rule_id, CASE WHEN p_size % 2 = 0 THEN 'Công ty' ELSE 'absent' END AS trigger FROM part WHERE CASE WHEN p_size % 2 = 0 THEN 'Công ty' ELSE 'absent' END IN (SELECT name FROM nm)", uses=["seeds"])
def promote_shared_rules(t):
    reg = V.shared_registry(_terms(t), "entities", ENTS)
    tpl = t.part.select(F.col("p_brand").alias("rule_id"), F.when(F.col("p_size") % 2 == 0, "Công ty").otherwise("absent").alias("trigger"))
    return V.promote_shared_rules(reg, tpl).select("rule_id", "trigger")


@query("map_group_ids", "SELECT group_id, count(*) AS n_rules, count(DISTINCT rule_type) AS n_types, count(DISTINCT frame_id) AS n_frames, min(rule_id) AS first_rule_id FROM seeds GROUP BY group_id", uses=["seeds"])
def map_group_ids(t):
    return V.map_group_ids(t.seeds)
