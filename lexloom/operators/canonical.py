"""Canonical rules: conversion, content dedupe, signatures, gates and partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.common import as_col, case_when, first_nonblank, first_row, head_of, is_blank, lookup, none_if_blank, tags, text_or_empty, top_k
from lexloom.functions import patterns as P
from lexloom.functions.slots import normalize_family
from lexloom.functions.text import slug, stable_hash

# Words in the legal nature that decide a form when the rule type is not listed.
NATURE_FORMS = [(("bat_buoc", "nghia_vu"), "obligation"), (("duoc_phep", "quyen"), "permission"), (("bi_cam", "cam"), "prohibition"),
                (("thoi_han",), "deadline"), (("nguong",), "threshold"), (("ngoai_le",), "exception"), (("dieu_kien",), "applicability"),
                (("co_quan", "co_trach_nhiem"), "authority_action"), (("ket_qua",), "legal_effect"), (("ho_so",), "dossier")]


def _says(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def logic_form(rule_type: Column | str, nature: Column | str) -> Column:
    """Rule type table first, then words of the legal nature, else obligation."""
    kind = F.lower(F.trim(text_or_empty(rule_type)))
    nat = F.lower(text_or_empty(nature))
    by_nature = case_when([(_says(nat, ws), f) for ws, f in NATURE_FORMS], "obligation")
    return lookup(kind, P.RULE_TYPE_FORMS, by_nature)


def to_canonical(seeds: DataFrame, domain: str, rulebase_id: str | None = None) -> DataFrame:
    """Rule seeds -> canonical rules with nested head and body and provenance arrays."""
    form = logic_form("rule_type", "nature")
    pred = F.trim(text_or_empty("canonical_predicate"))
    family = first_nonblank(normalize_family("family"), normalize_family("__form"))
    head = first_nonblank("__family", "__pred", "__form")
    args = F.when((F.col("__pred") != "") & (F.col("__pred") != F.col("__head")), F.array(F.lit("X"), F.col("__pred"))).otherwise(F.array(F.lit("X")))
    cond = text_or_empty("condition")
    clause = F.struct(F.lit("condition").alias("predicate"), cond.alias("text"))
    code = F.translate(F.lower(text_or_empty("doc_code")), "/ ", "__")
    base = F.lit(rulebase_id) if rulebase_id else F.when(code != "", F.concat(F.lit(domain + "_"), code)).otherwise(F.lit(domain + "_rulebase"))
    ref = F.split(text_or_empty("source_ref"), ",")
    s = (seeds.withColumn("__form", form).withColumn("__pred", pred).withColumn("__family", family).withColumn("__head", head))
    return s.select(
        "rule_id", F.lit(domain).alias("domain"), F.lit("statute").alias("layer"), base.alias("rulebase_id"),
        F.col("doc_code").alias("source_doc"), none_if_blank(F.element_at(ref, 1)).alias("source_article"),
        none_if_blank(F.try_element_at(ref, F.lit(2))).alias("source_clause"), F.col("unit_id").alias("source_unit_id"), "source_ref",
        F.col("source_text").alias("surface_text"), F.array("rule_id").alias("derived_from_rule_ids"),
        F.when(is_blank("doc_code"), F.array().cast("array<string>")).otherwise(F.array("doc_code")).alias("derived_from_docs"),
        F.array(F.lit(domain)).alias("source_domains"), F.col("__form").alias("logic_form"),
        F.struct(F.col("__head").alias("predicate"), args.alias("args")).alias("canonical_head"),
        F.when(F.lower(cond).isin("", "n/a", "không"), F.array().cast("array<struct<predicate:string,text:string>>"))
         .otherwise(F.array(clause)).alias("canonical_body"),
        F.coalesce(none_if_blank("summary"), F.lit("")).alias("verbalized"), text_or_empty("notes").alias("review_notes"),
        F.col("frame_id").alias("generated_from_frame_id"))


def dedupe_by_key(rules: DataFrame, key: str = "rule_id", order: Sequence[str] = ("seq",)) -> DataFrame:
    """First row per key in the stated order."""
    return first_row(rules, [key], [F.asc(c) for c in order])


class Richness(NamedTuple):
    """Columns that decide which duplicate is kept."""

    key_cols: Sequence[str]
    side_cols: Sequence[str]
    summary: str
    source: str
    bare_prefix: str = "ngưỡng/điều kiện định lượng:"  # fixed value


def richness(r: Richness) -> Column:
    """3 per filled key slot, 1 per filled side slot, capped text lengths, less 2 for a bare short summary."""
    filled = lambda cols: sum((F.when(is_blank(c), 0).otherwise(1) for c in cols), F.lit(0))
    summ, src = F.trim(text_or_empty(r.summary)), F.trim(text_or_empty(r.source))
    bare = F.startswith(F.lower(summ), F.lit(r.bare_prefix)) & (F.length(summ) < 55)
    return (3 * filled(r.key_cols) + filled(r.side_cols) + F.least(F.length(summ), F.lit(350)) / 70.0
            + F.least(F.length(src), F.lit(500)) / 125.0 - F.when(bare, 2.0).otherwise(0.0))


def content_fingerprint(cols: Sequence[str]) -> Column:
    clean = lambda c: F.when(F.lower(F.trim(text_or_empty(c))) == "nan", F.lit("")).otherwise(F.trim(text_or_empty(c)))
    return F.sha2(F.concat_ws("␞", *[clean(c) for c in cols]), 256)


def dedupe_by_content(rows: DataFrame, cols: Sequence[str], rich: Richness, id_col: str = "rule_id",
                      notes_chars: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Keep the richest row per content; name the merged ids in its notes. `keep` are the columns to return (all without).

    One pass: the best row and all ids of a content meet once, since all of them are named. Where `notes_chars` is given,
    only the ids that can stand in so many characters are gathered, so that a huge group of copies stays cheap.
    """
    names = list(rows.columns if keep is None else keep)
    carried = list(dict.fromkeys([*names, id_col, "notes"]))
    w = rows.select(F.unhex(content_fingerprint(cols)).alias("__fp"), (-richness(rich)).alias("__less"), F.col(id_col).alias("__id"), F.struct(*carried).alias("__row"))
    best = F.min_by("__row", F.struct("__less", "__id")).alias("__row")
    if notes_chars is None:
        out = w.groupBy("__fp").agg(best, F.collect_list("__id").alias("__ids"))
    else:  # the kept id may be among the few
        few = top_k(w.select("__fp", "__id"), ["__fp"], [F.asc("__id")], notes_chars // 2 + 1).groupBy("__fp").agg(F.collect_list("__id").alias("__ids"))
        out = w.groupBy("__fp").agg(best).join(few, "__fp", "left")
    out = out.select("__row.*", F.array_sort(F.filter("__ids", lambda x: ~x.eqNullSafe(F.col(f"__row.{id_col}")))).alias("__ids"))
    text = head_of(F.array_join("__ids", "|"), notes_chars)
    parts = F.filter(F.transform(F.split(text_or_empty("notes"), ";"), lambda x: F.trim(x)), lambda x: x != "")
    extra = F.array(F.lit("dedup_theo_noi_dung"), F.lit("giu_ban_day_du_hon"), F.concat(F.lit("merged_rule_ids="), text))
    notes = F.when(F.coalesce(F.size("__ids"), F.lit(0)) <= 0, text_or_empty("notes")).otherwise(F.array_join(F.array_union(parts, extra), ";"))
    return out.withColumn("notes", notes).select(*names)


def term_text(t: Column) -> Column:
    return F.concat(t["predicate"], F.lit("("), F.array_join(t["args"], ","), F.lit(")"))


def rule_signature(form: str = "logic_form", head: str = "head", body: str = "body") -> Column:
    """Form, head and body with sorted body terms, as one hash."""
    terms = F.array_join(F.array_sort(F.transform(as_col(body), term_text)), "|")
    return F.sha2(F.concat_ws("␞", as_col(form), term_text(as_col(head)), terms), 256)


def merge_by_signature(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules with the same form, head and body -> (merged, provenance).

    merged has one row per signature (first rule id, number of merged variants);
    provenance has one row per (signature, kind, value). The lists stay in long form
    because one signature may gather a large share of all rules.
    """
    s = rules.withColumn("signature", rule_signature())
    merged = s.groupBy("signature").agg(F.min("rule_id").alias("rule_id"), F.first("logic_form").alias("logic_form"),
                                        (F.count("*") - 1).alias("merged_variants"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in
                      (("rule_ids", "rule_id"), ("source_refs", "source_ref"), ("source_docs", "source_doc"), ("source_domains", "domain"))])
    prov = s.select("signature", F.explode(kinds).alias("p")).select("signature", "p.kind", "p.value").filter("value <> ''").distinct()
    return merged, prov


def derive_domain(packs: Sequence[DataFrame], domain: str) -> tuple[DataFrame, DataFrame]:
    """Union of statute packs with layer `domain`; (rules, counts per pack)."""
    rules = packs[0]
    for p in packs[1:]:
        rules = rules.unionByName(p, allowMissingColumns=True)
    own = lambda arr, v: F.array_distinct(F.concat(F.coalesce(as_col(arr), F.array().cast("array<string>")), v))
    code = F.when(is_blank("doc_code"), F.array().cast("array<string>")).otherwise(F.array("doc_code"))
    rules = (rules.withColumn("layer", F.lit("domain"))
             .withColumn("review_notes", F.trim(F.concat(F.lit("Aggregated from statute pack "), "pack", F.lit(". "), text_or_empty("review_notes"))))
             .withColumn("derived_from_rule_ids", own("derived_from_rule_ids", F.array("rule_id")))
             .withColumn("derived_from_docs", own("derived_from_docs", code))
             .withColumn("source_domains", own("source_domains", F.array(F.lit(domain)))))
    return rules, rules.groupBy("pack").agg(F.count("*").alias("rule_count"))


def _coarse_arg(a: Column) -> Column:
    """Argument generalised for near-duplicate grouping."""
    s = F.trim(F.coalesce(a, F.lit("<null>")))
    low = F.lower(s)
    parts = F.filter(F.split(s, "_"), lambda x: x != "")
    vague = low.isin("unknown", "null") | low.rlike("^(?:unresolved_|anchor_|unspecified_)|_unresolved")
    long = F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, 4), "_")).otherwise(F.substring(s, 1, 60))
    return F.when(a.isNull(), F.lit("<null>")).when(s == "", F.lit("<empty>")).when(vague, F.lit("<unresolved>")).when(F.length(s) > 60, long).otherwise(s)


# Readiness levels by rank.
READINESS = {"reasoning_ready": 3, "reasoning_partial": 2, "reasoning_fallback": 1}


def variant_roles(rules: DataFrame) -> DataFrame:
    """Signatures, fingerprint, cluster id and the role of each variant.

    Reads rule_id, logic_form, head, body, source_ref_full, source_ref, source_text, readiness. Counts and winner come
    from one pre-aggregated group-by joined back, so a group of copies of any size is never in one task.
    """
    coarse = lambda t: F.struct(t["predicate"].alias("predicate"), F.transform(t["args"], _coarse_arg).alias("args"))
    body = lambda f: F.array_join(F.array_sort(F.transform("body", lambda t: term_text(f(t)))), "|")
    same = lambda t: t
    ref = F.coalesce(none_if_blank("source_ref_full"), none_if_blank("source_ref"), F.lit(""))
    form = F.coalesce(none_if_blank("logic_form"), F.lit("generic_rule"))
    source = F.coalesce(F.nullif(ref, F.lit("")), F.when(~is_blank("source_text"), F.substring(slug("source_text"), 1, 50)), F.col("rule_id"))
    tag = lambda p, c, n: F.concat(F.lit(p), stable_hash(c, n))
    key = F.concat_ws("|", form, ref, term_text(F.col("head")), body(same))
    r = rules.select(
        "*", key.alias("__key"), tag("sig_", F.concat_ws("|", form, ref, term_text(F.col("head")), body(same)), 16).alias("signature"),
        tag("fp_", F.concat_ws("|", form, ref, term_text(coarse(F.col("head"))), body(coarse)), 16).alias("fingerprint"),
        tag("cluster_", F.concat_ws("|", form, F.coalesce(none_if_blank("head.predicate"), F.lit("generic")), source), 12).alias("cluster_id"),
        F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in READINESS.items() for x in kv]), F.col("readiness")), F.lit(1)).alias("__ready"))
    # The full text of the signature decides groups; its hash names them.
    best = r.groupBy("__key").agg(F.count("*").alias("n_variants"), F.min(F.struct(-F.col("__ready"), F.col("rule_id"))).alias("__best"))
    r = r.join(best, "__key")
    primary = F.col("rule_id") == F.col("__best.rule_id")
    role = F.when(F.col("n_variants") == 1, F.lit("unique_variant")).when(primary, F.lit("primary_variant")).otherwise(F.lit("redundant_variant"))
    return r.withColumn("duplicate_role", role).withColumn("is_primary", role != "redundant_variant").drop("__ready", "__best", "__key")


# Words that make an obligation a dossier rule.
DOSSIER_WORDS = ["hồ sơ", "giấy tờ", "thành phần", "tài liệu", "mẫu đơn"]


def logic_form_override(rows: DataFrame) -> DataFrame:
    """Logic form by rule type with the ordered overrides and the note of the one applied."""
    kind = text_or_empty("rule_type")
    quant = kind == "quy_tac_nguong_dinh_luong"
    timed = ~is_blank("deadline_value") & ~is_blank("deadline_unit")
    bits = [c for c in ("metric", "op", "threshold", "low", "high", "range_kind", "deadline_value", "deadline_unit") if c in rows.columns]
    no_bits = F.lit(True)
    for c in bits:
        no_bits = no_bits & is_blank(c)
    nat = slug(text_or_empty("nature"))
    other = case_when([
        (_says(nat, ["cam"]), "prohibition"), (_says(nat, ["co_the", "duoc_quyen", "quyen"]), "permission"),
        (_says(nat, ["bat_buoc", "nghia_vu", "phai"]), "obligation"), (~is_blank("handler") | ~is_blank("receiver"), "authority_action"),
        (~is_blank("dossier"), "dossier"), (~is_blank("exception") & is_blank("condition"), "exception"),
        (~is_blank("effect") | ~is_blank("result"), "legal_effect"), (~is_blank("condition"), "applicability")], "authority_action")
    act = F.lower(F.concat_ws(" ", "action", "canonical_predicate"))
    papers = (kind == "quy_tac_nghia_vu") & (F.length(F.trim(text_or_empty("dossier"))) >= 15) & _says(act, DOSSIER_WORDS)
    base = lookup(kind, P.RULE_TYPE_FORMS, F.lit("generic_rule"))
    only_exc = (base == "applicability") & is_blank("condition") & ~is_blank("exception")
    form = case_when([(quant & timed, "deadline"), (quant & no_bits, other), (papers, "dossier"), (only_exc, "exception")], base)
    note = case_when([(quant & timed, "override_threshold_to_deadline_time_metric"),
                      (quant & no_bits, "override_threshold_to_nonquant_semantic_form"), (papers, "override_obligation_to_dossier_core"),
                      (only_exc, "override_condition_to_exception_when_only_exception_text")], "")
    return rows.withColumn("logic_form", form).withColumn("override_note", note)


def _bad_atom(a: Column) -> Column:
    s = F.trim(a)
    return a.isNull() | (s == "") | F.lower(s).isin("unknown", "null") | F.lower(s).rlike("^unresolved_|_$") | F.contains(s, F.lit(" "))


def export_partition(rules: DataFrame) -> DataFrame:
    """Blocker list, exportable_clean / traceability_only and the safe-partial flag.

    Reads head, body (with `type`), readiness, duplicate_role, fallback_kind.
    """
    fallback = ~is_blank("fallback_kind")
    blockers = F.array_compact(F.array(
        F.when(F.exists("head.args", _bad_atom), F.lit("head_has_unresolved_or_invalid_atom")),
        F.when(F.exists("body", lambda b: b["type"] == "raw_text"), F.lit("body_contains_raw_text_clause")),
        F.when(F.exists("body", lambda b: F.exists(b["args"], _bad_atom)), F.lit("body_has_unresolved_or_invalid_atom")),
        F.when(F.col("duplicate_role") == "redundant_variant", F.lit("redundant_variant_not_selected_for_reasoning")),
        F.when(fallback, F.concat(F.lit("fallback_kind:"), "fallback_kind"))))
    r = rules.withColumn("blockers", blockers)
    kept = F.col("duplicate_role").isin("primary_variant", "unique_variant")
    shape = F.arrays_overlap("blockers", F.array(*[F.lit(x) for x in (
        "head_has_unresolved_or_invalid_atom", "body_contains_raw_text_clause", "body_has_unresolved_or_invalid_atom")]))
    clean = (F.col("readiness") == "reasoning_ready") & kept & ~fallback & (F.size("blockers") == 0)
    return r.select("*", F.when(clean, F.lit("exportable_clean")).otherwise(F.lit("traceability_only")).alias("partition"),
                    ((F.col("readiness") == "reasoning_partial") & ~shape & ~fallback & kept).alias("safe_partial"))


# Limits and tables of the core gate.
CORE_FORMS = ["obligation", "permission", "prohibition", "deadline", "threshold", "exception", "applicability_condition",
              "authority_action", "legal_effect", "dossier"]
EXCLUDED_FORMS = ["procedure_step"]
RISKY_NOTES = ["truncat", "shortened", "capped", "placeholder", "dossier_predicate_fallback", "incomplete"]
CUT_SUFFIXES = ["_mot_t", "_mot_th", "_mot_tho", "_co_l", "_dieu_l", "_cong_ngh", "_cua_con", "_thu_t", "_phap_l"]
MAX_ATOM, LONG_EFFECT, LONG_ANCHOR = 96, 100, 88


# Actions that say nothing by themselves.
GENERIC_ACTIONS = ["dang_ky", "thong_bao", "xem_xet", "cap_nhat", "nop_ho_so", "chuan_bi_ho_so", "thuc_hien"]


def core_gate(rules: DataFrame, generic_actions: Sequence[str] = GENERIC_ACTIONS) -> DataFrame:
    """Structural, normalisation and semantic gates in that order; the first that fails gives the reasons.

    Reads the columns of `export_partition` plus normalization_status, notes, canonical_status, authority, object,
    effect. Adds `reasons` (empty when in the core), `tags` and `in_core`.
    """
    c = F.col
    structural = tags(
        (c("partition") != "exportable_clean", "not_selected_for_reasoning"), (c("partition") != "exportable_clean", "not_exportable_clean"),
        (c("partition") != "exportable_clean", "problog_not_exportable"), (~c("readiness").eqNullSafe("reasoning_ready"), "logic_readiness_not_ready"),
        (~is_blank("fallback_kind"), "fallback_kind_set"), (F.size("blockers") > 0, "export_blockers_non_empty"),
        (c("duplicate_role").eqNullSafe("redundant_variant"), "redundant_variant"),
        (~F.coalesce(c("duplicate_role"), F.lit("")).isin("primary_variant", "unique_variant", "redundant_variant"), "duplicate_role_not_primary_or_unique"))
    notes = F.lower(text_or_empty("notes"))
    safe = c("safe_partial") | ((c("readiness") == "reasoning_ready") & ~_says(notes, RISKY_NOTES))
    status = text_or_empty("normalization_status")
    norm = tags(((status == "partial") & ~safe, "partial_not_reasoning_safe"),
                (~status.isin("full", "partial"), "normalization_not_full_or_safe_partial"))
    atoms = F.array_compact(F.concat(F.array("head.predicate"), c("head.args"),
                                     F.flatten(F.transform("body", lambda b: F.concat(F.array(b["predicate"]), b["args"])))))
    low = F.transform(atoms, lambda a: F.lower(a))
    form, args = text_or_empty("logic_form"), c("head.args")
    arg = lambda i: F.coalesce(F.try_element_at(args, F.lit(i)), F.lit(""))
    normative = c("head.predicate").isin("obligation", "permission", "prohibition")
    suffix = "(?:" + "|".join(CUT_SUFFIXES) + ")$"
    short_case = (arg(2) == "truong_hop") | (F.startswith(F.lower(arg(2)), F.lit("truong_hop_")) & (F.length(arg(2)) < 18)) | ((F.lower(arg(2)) == "tru_truong_hop") & (F.size(args) == 2))
    inner = tags(
        (c("canonical_status") == "fallback_family_level", "fallback_family_level_predicate"),
        (F.exists(low, lambda a: a.rlike("unresolved_|placeholder|._$")), "unresolved_semantic_role"),
        (F.exists(atoms, lambda a: F.length(a) > MAX_ATOM), "unsafe_for_unification"),
        (F.exists(low, lambda a: (F.length(a) >= 24) & a.rlike(suffix)) | _says(notes, ["truncated", "shortened", "capped"]), "truncated_head_or_body_atom"),
        (normative & arg(2).isin(list(generic_actions) or ["\u0000"]), "generic_predicate_not_canonical"),
        ((form == "legal_effect") & ((F.length(text_or_empty("object")) > LONG_EFFECT) | (F.length(text_or_empty("effect")) > LONG_EFFECT)), "unsafe_effect_or_object"),
        ((form == "authority_action") & text_or_empty("authority").isin("", "unknown"), "unsafe_authority_action_incomplete"),
        ((form == "dossier") & _says(notes, ["dossier_predicate_fallback", "placeholder"]), "unsafe_dossier_placeholder"),
        (form.isin("exception", "applicability_condition") & (F.size(args) >= 2) & short_case, "unsafe_generic_condition_anchor"),
        ((form == "deadline") & (F.length(arg(4)) > LONG_ANCHOR), "unsafe_deadline_anchor"))
    semantic = (F.when(form.isin(EXCLUDED_FORMS), F.array(F.lit("logic_form_out_of_core_scope")))
                .when(~form.isin(CORE_FORMS), F.array(F.lit("logic_form_unknown"))).otherwise(inner))
    r = rules.withColumn("__s", structural).withColumn("__n", norm).withColumn("__m", semantic)
    reasons = F.when(F.size("__s") > 0, c("__s")).when(F.size("__n") > 0, c("__n")).otherwise(c("__m"))
    clean_tag = lookup(form, {"deadline": "clean_deadline_rule", "threshold": "clean_threshold_rule", "exception": "clean_exception_rule",
                              "applicability_condition": "clean_applicability_rule", "obligation": "clean_normative_rule",
                              "permission": "clean_normative_rule", "prohibition": "clean_normative_rule"})
    kept = F.array_compact(F.array(F.lit("stable_for_unification"), F.when(status == "full", F.lit("full_normalization")),
                                   F.when(c("duplicate_role").isin("primary_variant", "unique_variant"), c("duplicate_role")), clean_tag))
    r = r.withColumn("reasons", reasons).drop("__s", "__n", "__m")
    ok = F.size("reasons") == 0
    return r.withColumn("in_core", ok).withColumn("tags", F.when(ok, kept).otherwise(F.array().cast("array<string>")))


def core_category(rules: DataFrame) -> DataFrame:
    """Category of a canonical rule with its reason."""
    form, head = F.lower(F.trim(text_or_empty("logic_form"))), F.lower(F.trim(text_or_empty("head_predicate")))
    generic = form.isin("obligation", "permission", "prohibition") & head.isin("obligation", "permission", "prohibition")
    rows = [(form == "procedure_step", "traceability_only", "procedure_step_not_exportable"),
            (form == "", "excluded_from_core", "logic_form_excluded_or_unknown"),
            (head == "", "excluded_from_core", "missing_canonical_head_predicate"),
            (generic, "traceability_only", "generic_normative_predicate"),
            (is_blank("source_ref") | is_blank("surface_text"), "traceability_only", "missing_source_trace")]
    return rules.withColumn("category", case_when([(a, b) for a, b, _ in rows], "exportable_clean")).withColumn(
        "reason", case_when([(a, c) for a, _, c in rows], ""))


def filter_logic_form(rules: DataFrame, form: str) -> DataFrame:
    return rules.filter(F.lower(F.trim("logic_form")) == form)


def core_report(gated: DataFrame) -> DataFrame:
    """(metric, key, n): totals, counts by form and the reason histogram, in long form and one scan."""
    rows = F.concat(
        F.array(F.struct(F.lit("total_rules").alias("metric"), F.lit("").alias("key")),
                F.struct(F.when(F.col("in_core"), F.lit("core_rules")).otherwise(F.lit("excluded_rules")).alias("metric"), F.lit("").alias("key"))),
        F.when(F.col("partition") == "exportable_clean", F.array(F.struct(F.lit("exportable_clean").alias("metric"), F.lit("").alias("key"))))
         .otherwise(F.array().cast("array<struct<metric:string,key:string>>")),
        F.when(F.col("in_core"), F.array(F.struct(F.lit("core_by_form").alias("metric"), F.coalesce("logic_form", F.lit("unknown")).alias("key"))))
         .otherwise(F.array().cast("array<struct<metric:string,key:string>>")),
        F.transform("reasons", lambda x: F.struct(F.lit("reason").alias("metric"), x.alias("key"))))
    return gated.select(F.explode(rows).alias("r")).groupBy("r.metric", "r.key").agg(F.count("*").alias("n"))


def text_chunks(files: DataFrame, min_chars: int = 80) -> DataFrame:
    """Blank-line paragraphs of each text with a running number among those long enough."""
    blocks = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda b: F.trim(b, F.lit(" \n\r\t"))), lambda b: F.length(b) >= min_chars)
    p = files.select("file", F.posexplode(blocks).alias("i", "text"))
    no = F.col("i") + 1
    return p.select(F.concat(F.lit("txt:"), "file", F.lit(":"), F.lpad(no.cast("string"), 5, "0")).alias("chunk_id"), "text",
                    F.col("file").alias("source_doc"), F.lit(None).cast("string").alias("rule_id"), F.lit("text_file").alias("origin"))


def rule_chunks(rules: DataFrame) -> DataFrame:
    """One passage per rule that has any text."""
    text = F.concat_ws("\n", none_if_blank("surface_text"), none_if_blank("verbalized"))
    r = rules.select(F.concat(F.lit("rb:"), "domain", F.lit(":"), "rule_id").alias("chunk_id"), text.alias("text"), "source_doc", "rule_id",
                     F.lit("rulebase_runtime").alias("origin"))
    return r.filter("text <> ''")


def merge_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per chunk id, first text wins; links chunk id - rule id without repeats)."""
    c = chunks.filter(~is_blank("chunk_id"))
    one = first_row(c.select("chunk_id", "text", "source_doc", "origin"), ["chunk_id"], [F.asc("origin"), F.asc("text")])
    links = c.filter("rule_id IS NOT NULL").select("chunk_id", "rule_id").distinct()
    return one, links


def rule_collisions(rules: DataFrame) -> DataFrame:
    """Rule ids used for more than one global key (domain, rulebase, document, article, id)."""
    key = F.concat_ws("|", *[text_or_empty(c) for c in ("domain", "rulebase_id", "doc_code", "article", "rule_id")])
    g = rules.select("rule_id", key.alias("k")).distinct().groupBy("rule_id").agg(F.count("*").alias("n_keys"))
    return g.filter("n_keys > 1")


def merge_registry(layers: Sequence[tuple[str, DataFrame]], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Concatenate layers in precedence order; (first row per rule id, the other rows)."""
    every = None
    for i, (name, df) in enumerate(layers):
        df = df.withColumn("layer_no", F.lit(i)).withColumn("layer", F.lit(name))
        every = df if every is None else every.unionByName(df, allowMissingColumns=True)
    pos = F.struct("layer_no", *order)
    best = every.groupBy("rule_id").agg(F.min(pos).alias("__best"))
    marked = every.join(best, "rule_id").withColumn("__kept", F.col("__best") == pos).drop("__best")
    return marked.filter("__kept").drop("__kept"), marked.filter("NOT __kept").drop("__kept")


def nest_rules(rows: DataFrame, blocks: Mapping[str, Sequence[str]]) -> DataFrame:
    """Flat columns -> one struct per block, blanks as NULL."""
    return rows.select("rule_id", *[F.struct(*[none_if_blank(F.col(c).cast("string")).alias(c) for c in cols]).alias(b)
                                    for b, cols in blocks.items()])


def validate_shared(rules: DataFrame) -> DataFrame:
    """Adds `valid`: shared domain and layer, known head and form, usable body or arguments."""
    known = lambda c: ~F.lower(F.trim(text_or_empty(c))).isin("", "unknown")
    body = F.exists("body", lambda b: ~F.lower(F.trim(F.coalesce(b["predicate"], F.lit("")))).isin("", "unknown"))
    args = F.exists("head.args", lambda a: F.trim(F.coalesce(a, F.lit(""))) != "")
    ok = (F.col("domain") == "shared") & (F.col("layer") == "shared") & known("head.predicate") & known("logic_form") & (body | args)
    return rules.withColumn("valid", F.coalesce(ok, F.lit(False)))
