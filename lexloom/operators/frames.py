"""Legal frames, predicate lexicon and rule seeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.common import case_when, first_nonblank, first_row, has_phrase, head_of, is_blank, none_if_blank, tags, text_or_empty
from lexloom.functions.slots import deadline_slots, quantity_slots, threshold_fields, THRESHOLD_FIELDS
from lexloom.functions.text import slug, squeeze, stable_hash

# Frame type of a candidate type.
FRAME_TYPES = {"document_requirement": "document_rule", "deadline": "deadline_rule", "authority_action": "authority_rule", "duty": "obligation_rule", "notification": "obligation_rule",
               "registration_obligation": "obligation_rule", "prohibition": "prohibition_rule", "permission": "permission_rule", "threshold": "threshold_rule", "legal_effect": "effect_rule",
               "condition": "condition_rule", "procedure": "procedure_rule"}


def extract_frames(candidates: DataFrame) -> DataFrame:
    """Frames from candidates with filled spans; dropped verdicts are removed.

    Reads ns_id, unit_id, cand_text, candidate_type, subject_span, action_span and the spans of `fill_slots`.
    """
    kind = case_when([(F.col("candidate_type") == k, v) for k, v in FRAME_TYPES.items()], "other_rule")
    q, d = quantity_slots("cand_text"), deadline_slots("cand_text")
    c = candidates.select("*", kind.alias("frame_type"), q.alias("__q"), d.alias("__d"))
    docs = F.when(F.col("frame_type") == "document_rule", F.col("document_span"))
    core = sum((F.when(is_blank(x), 0).otherwise(1) for x in ("subject_span", "action_span", "condition_span")), F.lit(0))
    verdict = F.when((F.col("frame_type") == "other_rule") | (core == 0), "dropped").when(core == 1, "low_confidence").otherwise("ok")
    f = c.select(F.concat(F.lit("F_"), "ns_id").alias("frame_id"), "ns_id", "unit_id", "frame_type", F.col("subject_span").alias("subject"), F.col("action_span").alias("action"), F.col("condition_span").alias("condition"),
                 F.col("__d.value").alias("deadline_value"), F.col("__d.unit").alias("deadline_unit"), F.col("__d.anchor").alias("anchor"), docs.alias("documents"), F.col("authority_span").alias("authority"),
                 F.col("exception_span").alias("exception"), F.col("effect_span").alias("effect"), F.col("object_span").alias("object"), F.col("__q.count_limit").alias("count_limit"),
                 F.col("__q.ratio_limit").alias("ratio_limit"), F.col("cand_text").alias("source_text"), verdict.alias("verdict"))
    return f.filter("verdict <> 'dropped'")


def exception_frames(frames: DataFrame, min_chars: int = 14) -> DataFrame:
    """Frames plus a second row for each with a qualifying exception span."""
    second = frames.filter(F.length(F.trim(text_or_empty("exception"))) >= min_chars).withColumn("frame_type", F.lit("exception_rule"))
    second = second.withColumn("frame_id", F.concat("frame_id", F.lit("_EX"))).withColumn("source_text", F.col("exception"))
    return frames.unionByName(second)


CORE_SLOTS = ["frame_type", "subject", "action", "object"]
BONUS_SLOTS = ["condition", "deadline_value", "documents", "authority", "exception", "effect"]


def frame_completeness(frames: DataFrame) -> DataFrame:
    """Adds n_core (of 4), n_bonus (of 6) and one of five levels."""
    n = lambda cols: sum((F.when(is_blank(F.col(c)), 0).otherwise(1) for c in cols), F.lit(0))
    f = frames.withColumn("n_core", n(CORE_SLOTS)).withColumn("n_bonus", n(BONUS_SLOTS))
    a, b = F.col("n_core"), F.col("n_bonus")
    return f.withColumn("level", case_when([((a == 4) & (b >= 2), "rat_day_du"), ((a == 4) | ((a == 3) & (b >= 2)), "day_du"), ((a == 3) | ((a == 2) & (b >= 2)), "trung_binh"), (a == 2, "so_sai")], "thieu"))


def split_flags(frames: DataFrame) -> DataFrame:
    """Adds split_reasons and n_parts: why a frame should be split further."""
    n_docs = F.size(F.filter(F.split(text_or_empty("documents"), r"[;；]\s*"), lambda x: F.trim(x) != ""))
    n_cond = F.size(F.filter(F.split(text_or_empty("condition"), r"(?iu)\s+(?:hoặc|và)\s+"), lambda x: F.trim(x) != ""))
    reasons = tags((n_docs >= 2, "nhieu_ho_so"), (n_cond >= 2, "nhieu_dieu_kien"), (~is_blank("exception") & ~is_blank("action"), "co_ngoai_le"), (~is_blank("deadline_value") & ~is_blank("documents"), "han_va_ho_so"),
                   (F.length(text_or_empty("source_text")) > 220, "qua_dai"))
    return frames.select("*", reasons.alias("split_reasons"), F.greatest(n_docs, n_cond, F.lit(1)).alias("n_parts"))


def score_frames(frames: DataFrame, candidates: DataFrame) -> DataFrame:
    """0 redo / 1 fix / 2 keep per frame, with candidate text joined on ns_id (left)."""
    j = frames.join(candidates.select("ns_id", "cand_text", "candidate_type"), "ns_id", "left")
    hard = tags((is_blank("frame_type") | F.col("cand_text").isNull(), "type"), (is_blank("subject"), "subject"), (is_blank("action"), "action"),
                (has_phrase(text_or_empty("cand_text"), [r"nếu", r"trường\s+hợp"]) & is_blank("condition"), "condition"))
    soft = tags(((F.col("candidate_type") == "deadline") & is_blank("deadline_value"), "deadline"), ((F.col("candidate_type") == "document_requirement") & is_blank("documents"), "documents"),
                ((F.col("candidate_type") == "authority_action") & is_blank("authority"), "authority"))
    j = j.withColumn("hard_errors", hard).withColumn("soft_errors", soft)
    s = F.when(F.size("hard_errors") > 0, 0).when(F.size("soft_errors") > 0, 1).otherwise(2)
    return j.withColumn("rubric", s).withColumn("verdict", F.when(s == 0, "redo").when(s == 1, "fix").otherwise("keep"))


# Slots each generic frame type needs.
REQUIRED_SLOTS = {"obligation": ["subject", "predicate"], "prohibition": ["subject", "predicate"], "permission": ["subject", "predicate"], "deadline": ["deadline"],
                  "document_requirement": ["document"], "authority_action": ["authority", "predicate"], "threshold": ["threshold"]}


def validate_frames(frames: DataFrame, required: Mapping[str, Sequence[str]] = REQUIRED_SLOTS) -> DataFrame:
    """Adds errors and ok. Reads frame_type, subject, predicate, deadline, document, authority, threshold."""
    c = F.col
    slots = list(dict.fromkeys(s for v in required.values() for s in v))
    missing = [(c("frame_type").isin([k for k, v in required.items() if s in v]) & is_blank(s), f"missing_required_slot:{s}") for s in slots]
    short = lambda col, n: c(col).isNotNull() & (F.length(F.trim(col)) < n)
    more = [(c("frame_type").isin("deadline", "threshold") & c("deadline").isNull() & c("threshold").isNull(), "missing_temporal_threshold_value"),
            ((c("frame_type") == "authority_action") & short("authority", 4), "authority_too_short"), (short("subject", 3), "subject_too_short"), (short("predicate", 4), "predicate_too_short"),
            ((c("frame_type") == "document_requirement") & c("document").isNull(), "document_requirement_missing_document")]
    f = frames.withColumn("errors", tags(*missing, *more))
    return f.withColumn("ok", F.size("errors") == 0)


def enrich_frames(frames: DataFrame, units: DataFrame, short: int = 80, vague: Sequence[str] = ("việc", "nội dung", "trường hợp")) -> DataFrame:
    """Grounding text (a short source is extended by heading and unit text), then documents, object and effect are filled and vague objects cleared."""
    u = units.select("unit_id", F.col("heading").alias("u_heading"), F.col("text").alias("u_text"))
    j = frames.join(u, "unit_id", "left")
    src = text_or_empty("source_text")
    ground = squeeze(F.when(F.length(src) >= short, src).otherwise(F.concat_ws(" ", src, "u_heading", "u_text")))
    j = j.withColumn("grounding", ground)
    doc = F.nullif(F.regexp_extract("grounding", r"(?iu)(hồ\s+sơ\s+bao\s+gồm[^.]{0,200})", 1), F.lit(""))
    obj = F.nullif(F.regexp_extract("grounding", r"(?iu)(?:nộp|chuyển\s+nhượng|sở\s+hữu)\s+([^.;,]{3,60})", 1), F.lit(""))
    eff = F.nullif(F.regexp_extract("grounding", r"(?iu)((?:bị\s+thu\s+hồi|hết\s+hiệu\s+lực)[^.;]{0,80})", 1), F.lit(""))
    clear = F.lower(F.trim(text_or_empty("object"))).isin(list(vague))
    filled = tags((is_blank("documents") & doc.isNotNull(), "bo_sung_ho_so"), ((is_blank("object") | clear) & obj.isNotNull(), "bo_sung_doi_tuong"), (is_blank("effect") & eff.isNotNull(), "bo_sung_ket_qua"))
    j = j.withColumn("notes_added", filled)
    return (j.withColumn("documents", first_nonblank("documents", doc)).withColumn("object", first_nonblank(F.when(~clear, F.col("object")), obj))
            .withColumn("effect", first_nonblank("effect", eff)).drop("u_heading", "u_text"))


def apply_overrides(rows: DataFrame, patches: DataFrame, key: str, columns: Sequence[str], note: str) -> DataFrame:
    """Curated patches by key: NULL leaves a value, blank clears it, anything else replaces it; the note is added once."""
    p = patches.select(key, *[F.col(c).alias("p_" + c) for c in columns], F.lit(True).alias("__hit"))
    j = rows.join(p, key, "left")
    for c in columns:
        v = F.col("p_" + c)
        j = j.withColumn(c, F.when(v.isNull(), F.col(c)).when(F.trim(v) == "", F.lit(None)).otherwise(v))
    parts = F.filter(F.split(text_or_empty("notes"), ";"), lambda x: F.trim(x) != "")
    return j.withColumn("notes", F.when(F.col("__hit"), F.array_join(F.array_union(parts, F.array(F.lit(note))), ";")).otherwise(F.col("notes"))).drop("__hit", *["p_" + c for c in columns])


# Prefixes of an action that decide its normalised predicate and group, in order.
PREDICATE_RULES = [("dang_ky", "dang_ky", "thu_tuc"), ("nop_ho_so", "nop_ho_so", "ho_so"), ("nop", "nop", "ho_so"), ("thong_bao", "thong_bao", "thu_tuc"), ("cap", "cap_giay", "co_quan"), ("thu_hoi", "thu_hoi", "co_quan"),
                   ("chuyen_nhuong", "chuyen_nhuong", "giao_dich"), ("phai", "nghia_vu", "nghia_vu"), ("khong_duoc", "cam", "cam"), ("duoc", "quyen", "quyen")]


def _lexicon_rows(frames: DataFrame, name_chars: int | None) -> DataFrame:
    parts = lambda c: F.filter(F.transform(F.split(text_or_empty(c), r"[;；]\s*"), lambda x: F.trim(x)), lambda x: x != "")
    row = lambda role: lambda x: F.struct(F.lit(role).alias("role"), x.alias("surface"))
    every = F.concat(F.transform(F.filter(F.array(F.trim(text_or_empty("action"))), lambda x: x != ""), row("action")), F.transform(parts("condition"), row("condition")), F.transform(parts("documents"), row("document")))
    e = frames.select("frame_id", F.posexplode(every).alias("i", "r")).select("frame_id", "i", "r.*").withColumn("__s", slug("surface"))
    s = F.col("__s")
    pred = case_when([(F.startswith(s, F.lit(p)), n) for p, n, _ in PREDICATE_RULES])
    group = case_when([(F.startswith(s, F.lit(p)), g) for p, _, g in PREDICATE_RULES], "khac")
    return e.select("frame_id", "i", "role", "surface", F.coalesce(pred, head_of(s, name_chars)).alias("normalized"), group.alias("grp"), F.when(pred.isNull(), "can_ra_soat").otherwise("chuan_hoa").alias("status"))


def build_lexicon(frames: DataFrame, name_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries, surface map): first surface per (predicate, group, role); last predicate per surface."""
    r = _lexicon_rows(frames, name_chars)
    entries = first_row(r, ["normalized", "grp", "role"], [F.asc("frame_id"), F.asc("i")]).select("normalized", "grp", "role", "surface", "status")
    surfaces = first_row(r, ["surface"], [F.desc("frame_id"), F.desc("i")]).select("surface", "normalized")
    return entries, surfaces


def build_rule_seeds(frames: DataFrame, surfaces: DataFrame, max_docs: int | None = None, max_exceptions: int | None = None, max_conditions: int | None = None) -> DataFrame:
    """Seeds of each frame: main, deadline, documents, exceptions, threshold, condition parts, outcome.

    Parts of a frame are cut only where a maximum is given. Ids come from the content, not from a counter.
    """
    every_part = lambda c, rx: F.filter(F.transform(F.split(text_or_empty(c), rx), lambda x: F.trim(x)), lambda x: x != "")
    parts = lambda c, rx, n: every_part(c, rx) if n is None else F.slice(every_part(c, rx), 1, n)
    row = lambda kind, item: F.struct(F.lit(kind).alias("rule_type"), item.alias("item"))
    main = {"obligation_rule": "quy_tac_nghia_vu", "prohibition_rule": "quy_tac_cam_doan", "permission_rule": "quy_tac_quyen", "deadline_rule": "quy_tac_thoi_han", "document_rule": "quy_tac_ho_so",
            "authority_rule": "quy_tac_hanh_dong_co_quan", "threshold_rule": "quy_tac_nguong_dinh_luong", "effect_rule": "quy_tac_ket_qua_phap_ly", "exception_rule": "quy_tac_ngoai_le", "procedure_rule": "quy_tac_thu_tuc"}
    kind = case_when([(F.col("frame_type") == k, v) for k, v in main.items()], "quy_tac_dieu_kien")
    first = F.struct(kind.alias("rule_type"), F.lit("").alias("item"))
    opt = lambda cond, kind_, item: F.filter(F.array(F.when(cond, row(kind_, item))), lambda x: x.isNotNull())
    every = F.concat(F.array(first), opt(~is_blank("deadline_value"), "quy_tac_thoi_han", F.concat_ws(" ", "deadline_value", "deadline_unit")),
                     F.transform(parts("documents", r"[;；]\s*", max_docs), lambda x: row("quy_tac_ho_so", x)), F.transform(parts("exception", r"[;；]\s*", max_exceptions), lambda x: row("quy_tac_ngoai_le", x)),
                     opt(~is_blank("count_limit") | ~is_blank("ratio_limit"), "quy_tac_nguong_dinh_luong", first_nonblank("ratio_limit", "count_limit")),
                     F.transform(parts("condition", r"(?iu)[;；]\s*|\s+hoặc\s+", max_conditions), lambda x: row("quy_tac_dieu_kien", x)), opt(~is_blank("effect"), "quy_tac_ket_qua_phap_ly", F.col("effect")))
    s = frames.select("frame_id", "unit_id", "subject", "action", "source_text", F.posexplode(every).alias("seq", "r")).select("*", "r.rule_type", "r.item").drop("r")
    s = s.withColumn("rule_id", F.concat(F.lit("R_"), stable_hash(F.concat_ws("|", "frame_id", "rule_type", "seq", "item"), 64))).withColumn("group_id", F.concat(F.lit("G_"), stable_hash("frame_id", 64)))
    lex = surfaces.select(F.col("surface").alias("__s"), F.col("normalized").alias("canonical_predicate"))
    return s.withColumn("__s", F.trim(text_or_empty("action"))).join(lex, "__s", "left").drop("__s")


def refine_seeds(seeds: DataFrame) -> DataFrame:
    """Threshold fields of quantitative seeds, an effect for four rule types, and note tags added once.

    Reads rule_type, text, effect, notes.
    """
    s = seeds.withColumn("__t", threshold_fields("text"))
    quant = F.col("rule_type") == "quy_tac_nguong_dinh_luong"
    for c in THRESHOLD_FIELDS:
        old = none_if_blank(c) if c in seeds.columns else F.lit(None).cast("string")
        s = s.withColumn(c, F.when(quant, F.coalesce(old, F.col("__t")[c])).otherwise(old))
    # Default effects.
    default = case_when([(F.col("rule_type") == k, v) for k, v in (("quy_tac_nghia_vu", "phát sinh nghĩa vụ"), ("quy_tac_cam_doan", "không được thực hiện"), ("quy_tac_quyen", "được thực hiện"), ("quy_tac_thoi_han", "phải đúng thời hạn"))])
    added = is_blank("effect") & default.isNotNull()
    tag = tags((quant & F.col("__t")["metric"].isNotNull(), "bo_sung_nguong"), (added, "bo_sung_he_qua"))
    parts = F.filter(F.split(text_or_empty("notes"), ";"), lambda x: F.trim(x) != "")
    return (s.withColumn("notes", F.array_join(F.array_union(parts, tag), ";")).withColumn("effect", first_nonblank("effect", default))).drop("__t")
