"""Queries for canonical rules, dedupe, gates and partitions."""

from pyspark.sql import functions as F

from lexloom.operators import canonical as C
from lexloom.plans.registry import query

FORM = """CASE rule_type WHEN 'quy_tac_nghia_vu' THEN 'obligation' WHEN 'quy_tac_quyen' THEN 'permission' WHEN 'quy_tac_nguong_dinh_luong' THEN 'threshold'
  WHEN 'quy_tac_thoi_han' THEN 'deadline' WHEN 'quy_tac_ho_so' THEN 'dossier' WHEN 'quy_tac_dieu_kien' THEN 'applicability'
  ELSE CASE nature WHEN 'bat_buoc' THEN 'obligation' WHEN 'quyen' THEN 'permission' WHEN 'cam' THEN 'prohibition' ELSE 'deadline' END END"""
HEAD = f"CASE WHEN family = 'must' THEN 'obligation' ELSE {FORM} END"
BODY = "CASE WHEN condition IS NULL THEN '' ELSE 'condition:' || condition END"
# Rule type 'khac' is not listed; every other form is a canonical family, so the family of the form is the form.


@query("to_canonical", f"""
SELECT rule_id, 'tax_' || replace(doc_code, ' ', '_') AS rulebase_id, {FORM} AS logic_form, {HEAD} AS head,
  concat_ws(',', 'X', CASE WHEN coalesce(canonical_predicate, '') NOT IN ('', {HEAD}) THEN canonical_predicate END) AS args, {BODY} AS body,
  nullif(trim(split_part(source_ref, ',', 1)), '') AS source_article, nullif(trim(split_part(source_ref, ',', 2)), '') AS source_clause
FROM seeds""", uses=["seeds"])
def to_canonical(t):
    c = C.to_canonical(t.seeds, "tax")
    return c.select("rule_id", "rulebase_id", "logic_form", F.col("canonical_head.predicate").alias("head"), F.array_join("canonical_head.args", ",").alias("args"),
                    F.array_join(F.transform("canonical_body", lambda b: F.concat(b["predicate"], F.lit(":"), b["text"])), "|").alias("body"),
                    "source_article", "source_clause")


@query("dedupe_by_key", "SELECT frame_id, rule_id, rule_type FROM seeds QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY rule_id) = 1", uses=["seeds"])
def dedupe_by_key(t):
    return C.dedupe_by_key(t.seeds.select("frame_id", "rule_id", "rule_type"), "frame_id", ["rule_id"])


CONTENT_COLS = ["doc_code", "rule_type", "effect", "result", "subject", "subject_type", "exception"]
RICH = C.Richness(["effect", "dossier", "result", "metric", "threshold", "condition", "exception"], ["handler", "receiver", "anchor"], "summary", "source_text")
_FILLED = lambda cols: " + ".join(f"CASE WHEN trim(coalesce({c}, '')) = '' THEN 0 ELSE 1 END" for c in cols)


@query("dedupe_by_content", f"""
WITH f AS (SELECT rule_id, notes, sha256(concat_ws('␞', {", ".join(f"trim(coalesce({c}, ''))" for c in CONTENT_COLS)})) AS fp,
  3 * ({_FILLED(RICH.key_cols)}) + {_FILLED(RICH.side_cols)} + least(length(trim(summary)), 350) / 70.0 + least(length(trim(source_text)), 500) / 125.0 AS sc FROM seeds),
r AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY round(sc, 6) DESC, rule_id) AS rn FROM f),
l AS (SELECT fp, string_agg(rule_id, '|' ORDER BY rule_id) AS ids FROM r WHERE rn > 1 GROUP BY fp)
SELECT rule_id, CASE WHEN ids IS NULL THEN notes ELSE concat_ws(';', nullif(notes, ''), 'dedup_theo_noi_dung', 'giu_ban_day_du_hon', 'merged_rule_ids=' || ids) END AS notes
FROM r LEFT JOIN l USING (fp) WHERE rn = 1""", uses=["seeds"])
def dedupe_by_content(t):
    return C.dedupe_by_content(t.seeds, CONTENT_COLS, RICH, keep=["rule_id", "notes"])


def _terms(t):
    """Rule rows with nested head and body, built from seeds."""
    head = F.struct(F.when(F.col("family") == "must", "obligation").otherwise(F.col("nature")).alias("predicate"),
                    F.array(F.lit("X"), F.when(F.col("rule_type") == "khac", F.lit("unknown")).otherwise(F.col("subject"))).alias("args"))
    body = F.array_compact(F.array(
        F.when(F.col("condition").isNotNull(), F.struct(F.lit("applies_if").alias("predicate"), F.array(F.replace("condition", F.lit(" "), F.lit("_"))).alias("args"), F.lit("atom").alias("type"))),
        F.when(F.col("exception").isNotNull(), F.struct(F.lit("unless").alias("predicate"), F.array("doc_code").alias("args"), F.when(F.col("scope").isNotNull(), "raw_text").otherwise("atom").alias("type")))))
    return t.seeds.select(
        "rule_id", "rule_type", C.logic_form("rule_type", "nature").alias("logic_form"), head.alias("head"), body.alias("body"), "source_ref",
        F.col("doc_code").alias("source_doc"), F.col("subject_type").alias("domain"), F.lit(None).cast("string").alias("source_ref_full"), "source_text",
        F.when(F.col("handler").isNotNull(), "reasoning_partial").when(F.col("receiver").isNotNull(), "reasoning_fallback").otherwise("reasoning_ready").alias("readiness"),
        F.when(F.col("subject_role").isNotNull(), F.lit("no_match")).alias("fallback_kind"),
        F.when(F.col("subject_type") == "tổ chức", "full").when(F.col("nature") == "cam", "none").otherwise("partial").alias("normalization_status"),
        F.when(F.col("anchor").isNotNull(), "slug_shortened").otherwise(F.col("notes")).alias("notes"),
        F.when(F.col("effect").isNull(), "fallback_family_level").otherwise("direct").alias("canonical_status"), F.col("receiver").alias("authority"), "object", "effect")


TERMS = f"""tm AS (SELECT *, CASE WHEN family = 'must' THEN 'obligation' ELSE nature END AS hp, {FORM} AS form,
  CASE WHEN rule_type = 'khac' THEN 'unknown' ELSE subject END AS a2,
  CASE WHEN condition IS NOT NULL THEN 'applies_if(' || replace(condition, ' ', '_') || ')' END AS b1, CASE WHEN exception IS NOT NULL THEN 'unless(' || doc_code || ')' END AS b2 FROM seeds),
sg AS (SELECT *, hp || '(' || concat_ws(',', 'X', a2) || ')' AS ht, concat_ws('|', b1, b2) AS bt,
  CASE WHEN handler IS NOT NULL THEN 'reasoning_partial' WHEN receiver IS NOT NULL THEN 'reasoning_fallback' ELSE 'reasoning_ready' END AS ready FROM tm)"""


@query("merge_by_signature", f"""WITH {TERMS}
SELECT sha256(concat_ws('␞', form, ht, bt)) AS signature, min(rule_id) AS rule_id, form AS logic_form, count(*) - 1 AS merged_variants FROM sg GROUP BY form, ht, bt""", uses=["seeds"])
def merge_by_signature(t):
    return C.merge_by_signature(_terms(t))[0]


@query("merged_provenance", f"""WITH {TERMS}, p AS (SELECT sha256(concat_ws('␞', form, ht, bt)) AS signature, * FROM sg)
SELECT DISTINCT * FROM (SELECT signature, 'rule_ids' AS kind, rule_id AS value FROM p UNION ALL SELECT signature, 'source_refs', source_ref FROM p
  UNION ALL SELECT signature, 'source_docs', doc_code FROM p UNION ALL SELECT signature, 'source_domains', subject_type FROM p) WHERE value <> ''""", uses=["seeds"])
def merged_provenance(t):
    return C.merge_by_signature(_terms(t))[1]


@query("derive_domain", """
SELECT rule_id, pack, 'Aggregated from statute pack ' || pack || CASE WHEN notes = '' THEN '.' ELSE '. ' || notes END AS review_notes,
  rule_id AS ids, doc_code AS docs, concat_ws(',', pack, 'tax') AS domains FROM (SELECT *, CASE WHEN rule_type = 'khac' THEN 'b' ELSE 'a' END AS pack FROM seeds)""", uses=["seeds"])
def derive_domain(t):
    s = t.seeds.select("rule_id", "doc_code", "rule_type", F.col("notes").alias("review_notes"), F.array("rule_id").alias("derived_from_rule_ids"),
                       F.array().cast("array<string>").alias("derived_from_docs"))
    a = s.filter("rule_type <> 'khac'").withColumn("pack", F.lit("a")).withColumn("source_domains", F.array(F.lit("a")))
    b = s.filter("rule_type = 'khac'").withColumn("pack", F.lit("b")).withColumn("source_domains", F.array(F.lit("b")))
    r = C.derive_domain([a, b], "tax")[0]
    return r.select("rule_id", "pack", "review_notes", F.array_join("derived_from_rule_ids", ",").alias("ids"), F.array_join("derived_from_docs", ",").alias("docs"),
                    F.array_join("source_domains", ",").alias("domains"))


ROLES = TERMS + """,
vr AS (SELECT *, concat_ws('|', form, source_ref, ht, bt) AS sx, count(*) OVER (PARTITION BY form, source_ref, ht, bt) AS nv,
  row_number() OVER (PARTITION BY form, source_ref, ht, bt ORDER BY CASE ready WHEN 'reasoning_ready' THEN 3 WHEN 'reasoning_partial' THEN 2 ELSE 1 END DESC, rule_id) AS rn FROM sg),
vd AS (SELECT *, CASE WHEN nv = 1 THEN 'unique_variant' WHEN rn = 1 THEN 'primary_variant' ELSE 'redundant_variant' END AS role FROM vr)"""


@query("variant_roles", f"""WITH {ROLES}
SELECT rule_id, 'sig_' || substr(sha256(sx), 1, 16) AS signature, 'fp_' || substr(sha256(concat_ws('|', form, source_ref, hp || '(' || concat_ws(',', 'X', CASE WHEN rule_type = 'khac' THEN '<unresolved>' ELSE coalesce(a2, '<null>') END) || ')', bt)), 1, 16) AS fingerprint,
  nv AS n_variants, role AS duplicate_role FROM vd""", uses=["seeds"])
def variant_roles(t):
    return C.variant_roles(_terms(t)).select("rule_id", "signature", "fingerprint", "n_variants", "duplicate_role")


@query("logic_form_override", """
WITH o AS (SELECT rule_id, rule_type, CASE rule_type WHEN 'quy_tac_nghia_vu' THEN 'obligation' WHEN 'quy_tac_quyen' THEN 'permission' WHEN 'quy_tac_nguong_dinh_luong' THEN 'threshold'
   WHEN 'quy_tac_thoi_han' THEN 'deadline' WHEN 'quy_tac_ho_so' THEN 'dossier' WHEN 'quy_tac_dieu_kien' THEN 'applicability' ELSE 'generic_rule' END AS base,
  rule_type = 'quy_tac_nguong_dinh_luong' AND deadline_value IS NOT NULL AS c1,
  rule_type = 'quy_tac_nguong_dinh_luong' AND coalesce(metric, op, threshold, deadline_value, deadline_unit) IS NULL AS c2,
  CASE nature WHEN 'cam' THEN 'prohibition' WHEN 'quyen' THEN 'permission' WHEN 'bat_buoc' THEN 'obligation'
    ELSE CASE WHEN coalesce(handler, receiver) IS NOT NULL THEN 'authority_action' WHEN dossier IS NOT NULL THEN 'dossier' WHEN exception IS NOT NULL AND condition IS NULL THEN 'exception'
     WHEN coalesce(effect, result) IS NOT NULL THEN 'legal_effect' WHEN condition IS NOT NULL THEN 'applicability' ELSE 'authority_action' END END AS other,
  rule_type = 'quy_tac_dieu_kien' AND condition IS NULL AND exception IS NOT NULL AS c4 FROM seeds)
SELECT rule_id, CASE WHEN c1 THEN 'deadline' WHEN c2 THEN other WHEN c4 THEN 'exception' ELSE base END AS logic_form,
  CASE WHEN c1 THEN 'override_threshold_to_deadline_time_metric' WHEN c2 THEN 'override_threshold_to_nonquant_semantic_form' WHEN c4 THEN 'override_condition_to_exception_when_only_exception_text' ELSE '' END AS override_note FROM o""", uses=["seeds"])
def logic_form_override(t):
    return C.logic_form_override(t.seeds).select("rule_id", "logic_form", "override_note")


PART = ROLES + """,
bl AS (SELECT *, list_filter([CASE WHEN a2 IS NULL OR a2 = 'unknown' OR contains(a2, ' ') THEN 'head_has_unresolved_or_invalid_atom' END,
   CASE WHEN exception IS NOT NULL AND scope IS NOT NULL THEN 'body_contains_raw_text_clause' END, CASE WHEN exception IS NOT NULL THEN 'body_has_unresolved_or_invalid_atom' END,
   CASE WHEN role = 'redundant_variant' THEN 'redundant_variant_not_selected_for_reasoning' END, CASE WHEN subject_role IS NOT NULL THEN 'fallback_kind:no_match' END], lambda x: x IS NOT NULL) AS bk FROM vd),
pt AS (SELECT *, CASE WHEN ready = 'reasoning_ready' AND len(bk) = 0 THEN 'exportable_clean' ELSE 'traceability_only' END AS part,
  ready = 'reasoning_partial' AND role <> 'redundant_variant' AND subject_role IS NULL AND exception IS NULL AND NOT (a2 IS NULL OR a2 = 'unknown' OR contains(a2, ' ')) AS safe FROM bl)"""


def _clean_head(t):
    """`_terms` with a single-word second argument on part of the rows, so that some rules are exportable."""
    r = _terms(t)
    second = F.when(F.element_at("head.args", 2) == "doanh  nghiep", F.lit("doanh_nghiep")).otherwise(F.element_at("head.args", 2))
    return r.withColumn("head", F.struct(F.col("head.predicate").alias("predicate"), F.array(F.lit("X"), second).alias("args")))


PART_ADJ = PART.replace("ELSE subject END AS a2", "WHEN subject = 'doanh  nghiep' THEN 'doanh_nghiep' ELSE subject END AS a2")


def _partitioned(t):
    return C.export_partition(C.variant_roles(_clean_head(t)))


@query("export_partition", f"WITH {PART_ADJ} SELECT rule_id, array_to_string(bk, ';') AS blockers, part AS partition, safe AS safe_partial FROM pt", uses=["seeds"])
def export_partition(t):
    return _partitioned(t).select("rule_id", F.array_join("blockers", ";").alias("blockers"), "partition", "safe_partial")


GATE = PART_ADJ + """,
g0 AS (SELECT *, CASE WHEN subject_type = 'tổ chức' THEN 'full' WHEN nature = 'cam' THEN 'none' ELSE 'partial' END AS ns, anchor IS NOT NULL AS short,
  list_filter([CASE WHEN part <> 'exportable_clean' THEN 'not_selected_for_reasoning' END, CASE WHEN part <> 'exportable_clean' THEN 'not_exportable_clean' END,
   CASE WHEN part <> 'exportable_clean' THEN 'problog_not_exportable' END, CASE WHEN ready <> 'reasoning_ready' THEN 'logic_readiness_not_ready' END,
   CASE WHEN subject_role IS NOT NULL THEN 'fallback_kind_set' END, CASE WHEN len(bk) > 0 THEN 'export_blockers_non_empty' END, CASE WHEN role = 'redundant_variant' THEN 'redundant_variant' END], lambda x: x IS NOT NULL) AS s1 FROM pt),
g1 AS (SELECT *, CASE WHEN ns = 'full' THEN [] WHEN ns = 'partial' AND (safe OR (ready = 'reasoning_ready' AND NOT short)) THEN [] WHEN ns = 'partial' THEN ['partial_not_reasoning_safe'] ELSE ['normalization_not_full_or_safe_partial'] END AS s2,
  CASE WHEN form NOT IN ('obligation','permission','prohibition','deadline','threshold','dossier') THEN ['logic_form_unknown'] ELSE list_filter([CASE WHEN effect IS NULL THEN 'fallback_family_level_predicate' END,
    CASE WHEN short THEN 'truncated_head_or_body_atom' END], lambda x: x IS NOT NULL) END AS s3 FROM g0),
gt AS (SELECT *, CASE WHEN len(s1) > 0 THEN s1 WHEN len(s2) > 0 THEN s2 ELSE s3 END AS rs FROM g1)"""


def _gated(t):
    return C.core_gate(_partitioned(t))


@query("core_gate", f"""WITH {GATE} SELECT rule_id, array_to_string(rs, ';') AS reasons, len(rs) = 0 AS in_core,
  CASE WHEN len(rs) > 0 THEN '' ELSE concat_ws(';', 'stable_for_unification', CASE WHEN ns = 'full' THEN 'full_normalization' END, role,
    CASE WHEN form IN ('obligation','permission','prohibition') THEN 'clean_normative_rule' WHEN form = 'deadline' THEN 'clean_deadline_rule' WHEN form = 'threshold' THEN 'clean_threshold_rule' END) END AS tags FROM gt""", uses=["seeds"])
def core_gate(t):
    return _gated(t).select("rule_id", F.array_join("reasons", ";").alias("reasons"), "in_core", F.array_join("tags", ";").alias("tags"))


@query("core_report", f"""WITH {GATE}, lg AS (SELECT 'total_rules' AS metric, '' AS key FROM gt UNION ALL SELECT CASE WHEN len(rs) = 0 THEN 'core_rules' ELSE 'excluded_rules' END, '' FROM gt
  UNION ALL SELECT 'exportable_clean', '' FROM gt WHERE part = 'exportable_clean' UNION ALL SELECT 'core_by_form', form FROM gt WHERE len(rs) = 0 UNION ALL SELECT 'reason', unnest(rs) FROM gt)
SELECT metric, key, count(*) AS n FROM lg GROUP BY ALL""", uses=["seeds"])
def core_report(t):
    return C.core_report(_gated(t))


@query("core_category", """
WITH c AS (SELECT rule_id, CASE WHEN rule_type = 'khac' THEN 'procedure_step' WHEN deadline_value = '7' THEN '' ELSE nature END AS lf, CASE WHEN canonical_predicate IS NULL THEN '' WHEN family = 'must' THEN 'obligation' ELSE canonical_predicate END AS hp, source_ref, source_text FROM
   (SELECT * REPLACE (CASE nature WHEN 'bat_buoc' THEN 'obligation' ELSE nature END AS nature) FROM seeds))
SELECT rule_id, CASE WHEN lf = 'procedure_step' THEN 'traceability_only' WHEN lf = '' OR hp = '' THEN 'excluded_from_core' WHEN lf = 'obligation' AND hp = 'obligation' THEN 'traceability_only'
  WHEN source_ref = '' OR source_text = '' THEN 'traceability_only' ELSE 'exportable_clean' END AS category,
 CASE WHEN lf = 'procedure_step' THEN 'procedure_step_not_exportable' WHEN lf = '' THEN 'logic_form_excluded_or_unknown' WHEN hp = '' THEN 'missing_canonical_head_predicate'
  WHEN lf = 'obligation' AND hp = 'obligation' THEN 'generic_normative_predicate' WHEN source_ref = '' OR source_text = '' THEN 'missing_source_trace' ELSE '' END AS reason FROM c""", uses=["seeds"])
def core_category(t):
    s = t.seeds.select("rule_id", F.expr("CASE WHEN rule_type = 'khac' THEN 'procedure_step' WHEN deadline_value = '7' THEN NULL WHEN nature = 'bat_buoc' THEN 'Obligation' ELSE nature END").alias("logic_form"),
                       F.expr("CASE WHEN canonical_predicate IS NULL THEN NULL WHEN family = 'must' THEN 'obligation' ELSE canonical_predicate END").alias("head_predicate"),
                       "source_ref", F.col("source_text").alias("surface_text"))
    return C.core_category(s).select("rule_id", "category", "reason")


@query("filter_logic_form", f"SELECT rule_id, {FORM} AS logic_form FROM seeds WHERE {FORM} = 'deadline'", uses=["seeds"])
def filter_logic_form(t):
    return C.filter_logic_form(t.seeds.select("rule_id", C.logic_form("rule_type", "nature").alias("logic_form")), "deadline")


@query("text_chunks", r"""
WITH b AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\. ', '.' || chr(10) || ' ' || chr(10), 'g'), '\n\s*\n'), lambda x: trim(x, ' ' || chr(10) || chr(13) || chr(9))), lambda x: length(x) >= 80) AS l FROM documents)
SELECT 'txt:' || doc_id || ':' || lpad(i::VARCHAR, 5, '0') AS chunk_id, l[i] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM b)""")
def text_chunks(t):
    files = t.documents.select(F.col("doc_id").cast("string").alias("file"), F.regexp_replace("text", r"\. ", ".\n \n").alias("text"))
    return C.text_chunks(files).select("chunk_id", "text")


@query("merge_chunks", """
WITH r AS (SELECT 'rb:' || subject_type || ':' || frame_id AS chunk_id, concat_ws(chr(10), nullif(source_text, ''), nullif(summary, '')) AS text, group_id FROM seeds),
f AS (SELECT * FROM r WHERE text <> '')
SELECT chunk_id, min(text) AS text, count(DISTINCT group_id) AS n_links FROM f GROUP BY chunk_id""", uses=["seeds"])
def merge_chunks(t):
    r = t.seeds.select(F.col("frame_id").alias("rule_id"), "group_id", F.col("subject_type").alias("domain"), F.col("source_text").alias("surface_text"),
                       F.col("summary").alias("verbalized"), F.col("doc_code").alias("source_doc"))
    one, _ = C.merge_chunks(C.rule_chunks(r))
    # Rule ids of a chunk are the groups of its frame here.
    text = F.concat_ws("\n", F.nullif("surface_text", F.lit("")), F.nullif("verbalized", F.lit("")))
    links = C.merge_chunks(r.select(F.concat(F.lit("rb:"), "domain", F.lit(":"), "rule_id").alias("chunk_id"), text.alias("text"), "source_doc",
                                    F.col("group_id").alias("rule_id"), F.lit("rulebase_runtime").alias("origin")).filter("text <> ''"))[1]
    return one.select("chunk_id", "text").join(links.groupBy("chunk_id").agg(F.count("*").alias("n_links")), "chunk_id")


@query("rule_collisions", "SELECT frame_id AS rule_id, count(DISTINCT (subject_type, doc_code, source_ref)) AS n_keys FROM seeds GROUP BY frame_id HAVING n_keys > 1", uses=["seeds"])
def rule_collisions(t):
    r = t.seeds.select(F.col("frame_id").alias("rule_id"), F.col("subject_type").alias("domain"), F.lit("rb").alias("rulebase_id"), "doc_code", F.col("source_ref").alias("article"))
    return C.rule_collisions(r)


def _layers(t):
    s = t.seeds.select(F.col("frame_id").alias("rule_id"), F.col("rule_id").alias("row_id"), "rule_type")
    return [("shared", s.filter("rule_type = 'khac'")), ("domain", s.filter("rule_type = 'quy_tac_ho_so'")), ("statute", s.filter("rule_type NOT IN ('khac', 'quy_tac_ho_so')"))]


LAYER = """WITH l AS (SELECT frame_id AS rule_id, rule_id AS row_id, CASE rule_type WHEN 'khac' THEN 0 WHEN 'quy_tac_ho_so' THEN 1 ELSE 2 END AS n FROM seeds),
m AS (SELECT rule_id, row_id, CASE n WHEN 0 THEN 'shared' WHEN 1 THEN 'domain' ELSE 'statute' END AS layer, row_number() OVER (PARTITION BY rule_id ORDER BY n, row_id) AS rn FROM l)
SELECT rule_id, row_id, layer FROM m WHERE rn """


@query("merge_registry", LAYER + "= 1", uses=["seeds"])
def merge_registry(t):
    return C.merge_registry(_layers(t), ["row_id"])[0].select("rule_id", "row_id", "layer")


@query("registry_duplicates", LAYER + "> 1", uses=["seeds"])
def registry_duplicates(t):
    return C.merge_registry(_layers(t), ["row_id"])[1].select("rule_id", "row_id", "layer")


BLOCKS = {"identity": ["frame_id", "group_id"], "core": ["subject", "action", "object"], "threshold": ["metric", "op", "threshold"], "quality": ["notes"]}


@query("nest_rules", "SELECT rule_id, " + ", ".join(
    f"to_json(struct_pack({', '.join(f'{c} := nullif(trim({c}), {chr(39) * 2})' for c in cols)}))::VARCHAR AS {b}" for b, cols in BLOCKS.items()) + " FROM seeds", uses=["seeds"])
def nest_rules(t):
    n = C.nest_rules(t.seeds, BLOCKS)
    return n.select("rule_id", *[F.to_json(b, {"ignoreNullFields": "false"}).alias(b) for b in BLOCKS])


@query("validate_shared", """
SELECT rule_id, rule_type <> 'khac' AND notes = '' AND canonical_predicate IS NOT NULL AND (condition IS NOT NULL OR coalesce(subject, '') <> '') AS valid FROM seeds""", uses=["seeds"])
def validate_shared(t):
    s = t.seeds.select("rule_id", F.when(F.col("rule_type") == "khac", "tax").otherwise("shared").alias("domain"), F.when(F.col("notes") == "", "shared").otherwise("domain").alias("layer"),
                       F.lit("obligation").alias("logic_form"), F.struct(F.col("canonical_predicate").alias("predicate"), F.array("subject").alias("args")).alias("head"),
                       F.array(F.struct(F.coalesce("condition", F.lit("unknown")).alias("predicate"))).alias("body"))
    return C.validate_shared(s).select("rule_id", "valid")
