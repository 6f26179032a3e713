"""Controlled vocabularies, their quality scores, and lookups of rules against them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.common import case_when, cut_lineage, first_nonblank, first_row, is_blank, none_if_blank, smallest_k, tags, text_or_empty, top_k
from lexloom.functions.slots import normalize_family
from lexloom.functions.text import slug


def confidence(score: Column, review: Column) -> Column:
    """cao / trung_binh / thap; a low score without a review need is medium."""
    base = F.when(score >= 72, F.lit("cao")).when(score >= 48, F.lit("trung_binh")).otherwise(F.lit("thap"))
    return F.when(~review & (base == "thap"), F.lit("trung_binh")).otherwise(base)


def _qa(df: DataFrame, score: Column, review: Column) -> DataFrame:
    df = df.withColumn("score", score)
    review = review(F.col("score"))
    return df.select("*", F.when(review, F.lit("co")).otherwise(F.lit("khong")).alias("needs_review"),
                     confidence(F.col("score"), review).alias("confidence"))


def _less(cond: Column, n: int) -> Column:
    return F.when(cond, F.lit(-n)).otherwise(F.lit(0))


def object_effect_qa(df: DataFrame) -> DataFrame:
    """Reads n_variants, max_raw_len, canonical, family."""
    n, raw, name = F.col("n_variants"), F.col("max_raw_len"), F.length("canonical")
    score = (F.lit(100) + F.when(n >= 8, -30).when(n >= 5, -18).otherwise(0) + _less(name < 6, 22) + _less(raw > 180, 25)
             + _less(F.col("family") == "khac", 15))
    return _qa(df, score, lambda s: (s < 55) | (n >= 6) | (raw > 220))


def entity_qa(df: DataFrame) -> DataFrame:
    n, raw, name = F.col("n_variants"), F.col("max_raw_len"), F.length("canonical")
    score = F.lit(100) + F.when(n >= 7, -32).when(n >= 4, -18).otherwise(0) + _less(name < 4, 28) + _less(raw > 120, 20)
    return _qa(df, score, lambda s: (s < 52) | (n >= 5) | (name < 3))


def metric_qa(df: DataFrame) -> DataFrame:
    n, unknown = F.col("n_labels"), F.col("metric_canonical") == "unknown_metric"
    score = F.lit(100) + _less(unknown, 45) + _less(F.col("unit_canonical") == "", 22) + F.when(n >= 4, -20).when(n >= 2, -10).otherwise(0)
    return _qa(df, score, lambda s: (s < 55) | unknown)


def predicate_qa(df: DataFrame) -> DataFrame:
    c = F.col
    score = (F.lit(100) + _less(~c("has_typed"), 42) + _less(c("family") == "khac", 28) + _less(F.length("canonical") < 12, 18)
             + _less(c("n_types") >= 3, 12) + _less((c("n_types") >= 2) & (c("top_share") < 0.55), 15))
    return _qa(df, score, lambda s: (s < 58) | ~c("has_typed") | ((c("family") == "khac") & (F.length("canonical") < 16)))


def example_ids(rows: DataFrame, keys: Sequence[str], k: int, order: str = "rule_id") -> DataFrame:
    """First k distinct rule ids per key, joined by `; `. Never more than k ids of a key meet in one task."""
    ids = rows.groupBy(*keys, "rule_id").agg(F.min(order).alias("__o")) if order != "rule_id" else rows.select(*keys, "rule_id").distinct().withColumn("__o", F.col("rule_id"))
    few = top_k(ids, keys, [F.asc("__o"), F.asc("rule_id")], k)
    return few.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__o", "rule_id"))), lambda x: x["rule_id"]), "; ").alias("example_rule_ids"))


def variant_groups(rows: DataFrame, keys: Sequence[str], n_raws: int, n_ids: int) -> DataFrame:
    """Per key: distinct raw forms, their longest length, the first raw forms as text, example rule ids."""
    raws = rows.select(*keys, "raw").distinct()
    stats = raws.groupBy(*keys).agg(F.count("*").alias("n_variants"), F.max(F.length("raw")).alias("max_raw_len"))
    few = top_k(raws, keys, [F.asc("raw")], n_raws).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("raw")), " | ").alias("raw_variants"))
    return stats.join(few, list(keys)).join(example_ids(rows, keys, n_ids), list(keys))


# Name parts that decide a family, in order.
PREDICATE_FAMILIES = [("dang_ky", "procedure"), ("cap_giay", "authority_action"), ("thu_hoi", "authority_action"), ("thong_bao", "procedure"),
                      ("cap_nhat", "procedure"), ("nop_ho_so", "dossier"), ("ap_dung", "applicability")]
OBJECT_FAMILIES = [(("ho_so", "ban", "giay", "mau", "bieu"), "ho_so_tai_lieu"), (("von", "gop", "phan_von"), "von_gop_von"),
                   (("co_phan", "co_dong", "thanh_vien"), "co_phan_thanh_vien"), (("giay_chung_nhan", "gcn"), "giay_chung_nhan")]
EFFECT_PREFIXES = [("duoc_", "tich_cuc_duoc"), ("bi_", "tieu_cuc_bi"), ("phai_", "nghia_vu_phai")]
EFFECT_PARTS = [(("cap_giay", "duoc_cap"), "cap_giay"), (("thu_hoi",), "thu_hoi"), (("cap_nhat", "csdl"), "cap_nhat_du_lieu"), (("cong_bo",), "cong_bo")]


def has_part(c: Column | str, parts: Sequence[str]) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def has_prefix(c: Column | str, parts: Sequence[str]) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(False)
    for p in parts:
        out = out | F.startswith(c, F.lit(p))
    return out


def predicate_vocab(seeds: DataFrame) -> DataFrame:
    """One row per predicate: family, typed form, rule-type mix, examples and quality.

    The seeds are read twice: once counted by their raw name, type and typed form, once cut to the first rows per raw name.
    Both small tables are stored, so the slug and all later steps run on them.
    """
    raw = first_nonblank("canonical_predicate", "action")
    w = seeds.select(raw.alias("raw"), is_blank("canonical_predicate").alias("is_act"), "rule_id", none_if_blank("rule_type").alias("rule_type"), none_if_blank("typed_predicate").alias("typed"),
                     F.nullif(normalize_family("family"), F.lit("")).alias("family"), none_if_blank("summary").alias("summary"), none_if_blank("action").alias("act")).filter("raw IS NOT NULL")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("rule_id", c)))[c].alias(c)
    name = F.when(F.col("is_act"), slug("raw")).otherwise(F.col("raw"))
    small = cut_lineage(w.groupBy("raw", "is_act", "rule_type", "typed").agg(F.count("*").alias("n")).withColumn("canonical", name), "predicates")
    # Per filling of the three texts the first five rows hold the first of each text and the first five ids.
    texts = ["family", "summary", "act"]
    early = w.select("raw", "is_act", "rule_id", *texts, *[F.col(c).isNotNull().alias(f"has_{c}") for c in texts])
    early = smallest_k(early, ["raw", "is_act", *[f"has_{c}" for c in texts]], "rule_id", 5).withColumn("canonical", name)
    ids = cut_lineage(early.select("canonical", "rule_id", *texts), "predicate_ids")
    base = ids.groupBy("canonical").agg(*[first(c) for c in texts]).join(small.groupBy("canonical").agg(F.sum("n").alias("n")), "canonical")
    types = small.filter("rule_type IS NOT NULL").groupBy("canonical", "rule_type").agg(F.sum("n").alias("m"))
    top5 = top_k(types, ["canonical"], [F.desc("m"), F.asc("rule_type")], 5)
    lead = F.struct((-F.col("m")).alias("o"), F.col("rule_type").alias("t"))
    mix = top5.groupBy("canonical").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(lead)), lambda x: F.concat(x["t"], F.lit("("), (-x["o"]).cast("string"), F.lit(")"))), "; ").alias("when_used"),
        F.min(lead)["t"].alias("mode_type"), F.max("m").alias("top_n"))
    n_types = types.groupBy("canonical").agg(F.count("*").alias("n_types"))
    typed = small.filter("typed IS NOT NULL").groupBy("canonical", "typed").agg(F.sum("n").alias("m"))
    typed = typed.groupBy("canonical").agg(F.min_by("typed", F.struct(-F.col("m"), F.col("typed"))).alias("typed"))
    out = (base.join(mix, "canonical", "left").join(n_types, "canonical", "left").join(typed, "canonical", "left").join(example_ids(ids, ["canonical"], 5), "canonical"))
    guess = case_when([(F.contains(F.col("canonical"), F.lit(p)), f) for p, f in PREDICATE_FAMILIES], "khac")
    out = out.select("canonical", F.coalesce("family", guess).alias("family"),
                     F.coalesce("typed", F.concat(F.coalesce("mode_type", F.lit("unknown")), F.lit(":"), "canonical")).alias("typed"),
                     F.coalesce("summary", "act", F.lit("")).alias("summary"), F.coalesce("when_used", F.lit("")).alias("when_used"),
                     F.coalesce("n_types", F.lit(0)).alias("n_types"), F.coalesce(F.col("top_n") / F.col("n"), F.lit(1.0)).alias("top_share"),
                     F.col("typed").isNotNull().alias("has_typed"), "example_rule_ids")
    return predicate_qa(out)


def _named(rows: DataFrame, min_raw: int, min_name: int, n_ids: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with their slug, cut to the first `n_ids` rule ids per raw text.

    That is all the vocabularies need: every raw text stays, and the smallest ids of a name are among the smallest of
    its raw texts. The cut happens before the shuffle, the slug runs on distinct texts only, and the few rows are stored.
    """
    r = rows.withColumn("raw", none_if_blank("raw")).filter(F.length("raw") >= min_raw)
    r = smallest_k(r.select(*keys, "raw", "rule_id"), [*keys, "raw"], "rule_id", n_ids).withColumn("canonical", slug("raw"))
    return cut_lineage(r.filter(F.length("canonical") >= min_name), "named")


def object_vocab(seeds: DataFrame) -> DataFrame:
    """Objects and the parts of dossier lists."""
    parts = F.transform(F.split(text_or_empty("dossier"), r"[;；]\s*"), lambda x: F.trim(x))
    rows = seeds.select("rule_id", F.explode(F.array_distinct(F.concat(F.array(F.trim("object")), parts))).alias("raw"))
    g = variant_groups(_named(rows, 2, 3, 5), ["canonical"], 4, 5)
    family = case_when([(has_part("canonical", ps), f) for ps, f in OBJECT_FAMILIES], "khac")
    return object_effect_qa(g.withColumn("family", family))


def effect_vocab(seeds: DataFrame) -> DataFrame:
    rows = seeds.select("rule_id", F.explode(F.array_distinct(F.array(F.trim("effect"), F.trim("result")))).alias("raw"))
    g = variant_groups(_named(rows, 3, 4, 5), ["canonical"], 3, 5)
    family = case_when([(has_prefix("canonical", [p]), f) for p, f in EFFECT_PREFIXES] + [(has_part("canonical", ps), f) for ps, f in EFFECT_PARTS], "khac")
    return object_effect_qa(g.withColumn("family", family))


# Columns of a seed that name an entity, with its kind.
ENTITY_COLUMNS = [("subject", "subject"), ("subject_type", "subject_type"), ("subject_role", "subject_role"), ("receiver", "authority"),
                  ("handler", "authority"), ("scope", "scope")]


def entity_rows(seeds: DataFrame, columns: Sequence[tuple[str, str]] = ENTITY_COLUMNS) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("raw")) for c, kind in columns])
    r = seeds.select("rule_id", F.explode(F.array_distinct(pairs)).alias("p")).select("rule_id", "p.kind", "p.raw")
    return _named(r, 2, 2, 8, ["kind"])


def entity_vocab(seeds: DataFrame) -> DataFrame:
    return entity_qa(variant_groups(entity_rows(seeds), ["kind", "canonical"], 6, 8))


def metric_rows(seeds: DataFrame) -> DataFrame:
    m, u = none_if_blank("metric"), none_if_blank("unit")
    r = seeds.filter(m.isNotNull() | u.isNotNull())
    return r.select("rule_id", "rule_type", F.when(m.isNotNull(), slug(m)).otherwise("unknown_metric").alias("metric_canonical"),
                    F.when(u.isNotNull(), slug(u)).otherwise("").alias("unit_canonical"), m.alias("raw"))


def metric_vocab(seeds: DataFrame, quantitative: str = "quy_tac_nguong_dinh_luong") -> DataFrame:
    """By (metric, unit) over the quantitative rows, or over all rows when there is none."""
    flag = seeds.agg(F.coalesce(F.bool_or(F.col("rule_type") == quantitative), F.lit(False)).alias("any")).select("any").scalar()
    rows = metric_rows(seeds).filter((F.col("rule_type") == quantitative) | ~flag)
    keys = ["metric_canonical", "unit_canonical"]
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n_rules")).join(example_ids(rows, keys, 5), keys)
    raws = rows.filter("raw IS NOT NULL").select("metric_canonical", "raw").distinct()
    labels = raws.groupBy("metric_canonical").agg(F.count("*").alias("n_labels"))
    few = top_k(raws, ["metric_canonical"], [F.asc("raw")], 6).groupBy("metric_canonical").agg(F.array_join(F.array_sort(F.collect_list("raw")), " | ").alias("raw_variants"))
    g = groups.join(labels, "metric_canonical", "left").join(few, "metric_canonical", "left")
    return metric_qa(g.withColumn("n_labels", F.coalesce("n_labels", F.lit(0))).withColumn("raw_variants", F.coalesce("raw_variants", F.lit(""))))


def add_lexicon_terms(vocab: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Lexicon predicates that are not in the vocabulary, appended as low-confidence rows."""
    lex = lexicon.filter(~is_blank("normalized")).select(
        F.col("normalized").alias("canonical"), F.coalesce(none_if_blank("group"), F.lit("tu_lexicon")).alias("family"), F.col("normalized").alias("typed"),
        F.lit("tham_chieu_lexicon_chua_xuat_hien_trong_seed").alias("when_used"), F.lit("co").alias("needs_review"), F.lit("thap").alias("confidence"))
    lex = lex.dropDuplicates(["canonical"])
    return vocab.unionByName(lex.join(vocab.select("canonical"), "canonical", "left_anti"), allowMissingColumns=True)


# Markers that open an exception or a condition inside an effect name.
TAIL_MARKERS = [("_tru_truong_hop", "exception"), ("_ngoai_tru_", "exception"), ("_neu_", "condition"), ("_neu_co_", "condition"), ("_khi_", "condition"),
                ("_doi_voi_", "scope"), ("_trong_thoi_han_", "condition"), ("_ke_tu_", "condition"), ("_theo_yeu_cau_", "condition"),
                ("_gia_su_", "condition"), ("_tru_khi_", "condition")]
# Object names that are discourse or conditions.
DISCOURSE_PREFIXES = ["khi_", "neu_", "tru_truong_hop", "ap_dung_", "phai_co_cac_giay", "trong_thoi_han_", "theo_quy_dinh", "truong_hop_", "doi_voi_", "dang_ky_thanh_lap"]
DISCOURSE_PARTS = ["tru_truong_hop", "khi_dang_ky", "khi_thay_doi", "khi_ho_so", "khi_trinh", "ap_dung_doi_voi", "hop_dong_da_ky_voi_khach_hang"]
# Effect names that are actions.
ACTION_PREFIXES = ["cong_ty_", "chap_thuan_thi_co_quan"]
ACTION_PARTS = ["cho_co_quan_thue", "cap_nhat_kip_thoi", "theo_yeu_cau_cua", "phai_nop_phi"]


def split_tail(c: Column | str, markers: Sequence[tuple[str, str]] = TAIL_MARKERS, min_base: int = 8) -> Column:
    """struct(base, kind, tail): cut at the earliest marker that leaves a base of `min_base` characters."""
    s = F.trim(F.col(c) if isinstance(c, str) else c)
    spots = []
    for i, (m, kind) in enumerate(markers):
        at = F.instr(s, m)
        base = F.rtrim(F.substring(s, F.lit(1), at - 1), F.lit("_"))
        spots.append(F.when((at > 0) & (F.length(base) >= min_base), F.struct(at.alias("at"), F.lit(i).alias("no"), F.lit(kind).alias("kind"), base.alias("base"))))
    best = F.array_min(F.array_compact(F.array(*spots)))
    return F.struct(F.coalesce(best["base"], s).alias("base"), best["kind"].alias("kind"),
                    F.ltrim(F.substring(s, best["at"], F.length(s)), F.lit("_")).alias("tail"))


def refine_effects(effects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(effects, fragments, moved): action-like names move to predicates, tails are split off, equal names merge."""
    c = F.col("canonical")
    acts = (has_prefix(c, ACTION_PREFIXES) | has_part(c, ACTION_PARTS)
            | (has_prefix(c, ["nguoi_"]) & has_part(c, ["nop_", "dang_ky_", "thuc_hien_", "gui_"]))
            | (has_part(c, ["phai_thuc_hien"]) & (F.length(c) > 55)) | (has_prefix(c, ["co_quan_"]) & (F.length(c) > 95)))
    e = effects.withColumn("__act", acts).withColumn("__t", split_tail("canonical"))
    moved = e.filter("__act").select("canonical", F.concat(F.lit("chuyen_tu_effect:"), "canonical").alias("typed"), "example_rule_ids",
                                     F.lit("chuyen_action_ra_khoi_effect").alias("notes"))
    kept = e.filter("NOT __act")
    frag = kept.filter("__t.kind IS NOT NULL").select(F.col("__t.kind").alias("fragment_kind"), F.col("canonical").alias("original_canonical"),
                                                      F.substring("__t.tail", 1, 400).alias("tail_slug"))
    note = F.when(F.col("__t.kind") == "exception", "tach_exception_khoi_effect").when(F.col("__t.kind").isNotNull(), "tach_condition_khoi_effect").otherwise("")
    rows = kept.select(F.col("__t.base").alias("canonical"), F.when(F.col("__t.kind").isNotNull(), "co").otherwise(F.col("needs_review")).alias("needs_review"),
                       note.alias("notes"), F.col("canonical").alias("original"))
    first = F.struct("original")
    out = rows.groupBy("canonical").agg(F.min_by("needs_review", first).alias("needs_review"), F.count("*").alias("n_merged"),
                                        F.array_join(F.array_sort(F.array_remove(F.collect_set("notes"), "")), "; ").alias("notes"))
    return out, frag, moved


def refine_objects(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): names that start like or contain a condition or discourse phrase are dropped."""
    c = F.lower("canonical")
    drop = has_prefix(c, DISCOURSE_PREFIXES) | has_part(c, DISCOURSE_PARTS) | (has_prefix(c, ["tru_"]) & has_part(c, ["truong"]))
    o = objects.withColumn("__d", drop)
    return o.filter("NOT __d").drop("__d"), o.filter("__d").drop("__d")


def extend_vocab(vocab: DataFrame, extra: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Vocabulary rows, then rows of each extra table whose key is not yet present (first table wins)."""
    rows = vocab.withColumn("__src", F.lit(0))
    for i, e in enumerate(extra, 1):
        rows = rows.unionByName(e.dropDuplicates(list(keys)).withColumn("__src", F.lit(i)), allowMissingColumns=True)
    return first_row(rows, keys, [F.asc("__src")]).withColumn("added", F.col("__src") > 0).drop("__src")


def merge_predicates(vocab: DataFrame, moved: DataFrame) -> DataFrame:
    return extend_vocab(vocab, [moved], ["canonical"])


PAIR = "\x01"  # between metric and unit in one text


def _vocabulary(predicates: DataFrame, objects: DataFrame, effects: DataFrame, entities: DataFrame, metrics: DataFrame) -> DataFrame:
    """(kind, key, entry): all vocabularies in one table, one row per key."""
    one = lambda df, kind, key, family=None: df.select(kind.alias("kind"), key.alias("key"), F.struct(F.col("canonical"), (family if family is not None else F.lit(None).cast("string")).alias("family")).alias("entry"))
    c = F.col("canonical")
    pair = metrics.select("unit_canonical", F.col("metric_canonical").alias("canonical"))
    parts = [one(predicates, F.lit("predicate"), c, F.col("family")), one(objects, F.lit("object"), c), one(effects, F.lit("effect"), c), one(entities, F.col("kind"), c),
             one(pair, F.lit("metric"), F.concat("canonical", F.lit(PAIR), F.coalesce("unit_canonical", F.lit(""))))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("key IS NOT NULL").groupBy("kind", "key").agg(F.min("entry").alias("entry"))


def _slots() -> list[tuple[str, str, Column, Column]]:
    """Slot, kind of vocabulary, text, whether it is filled."""
    filled = lambda c: ~is_blank(c)
    tail = F.trim(F.element_at(F.split("typed_predicate", ":", 2), -1))
    plain = [("canonical_predicate", "predicate"), ("action", "predicate"), ("object", "object"), ("effect", "effect"), ("result", "effect"), ("subject", "subject"),
             ("subject_type", "subject_type"), ("handler", "authority"), ("receiver", "authority"), ("scope", "scope")]
    pair = F.concat(F.when(filled("metric"), F.col("metric")).otherwise(""), F.lit(PAIR), F.when(filled("unit"), F.col("unit")).otherwise(""))
    return [*[(c, kind, F.col(c), filled(c)) for c, kind in plain], ("typed_predicate", "predicate", tail, filled("typed_predicate")), ("metric", "metric", pair, filled("metric") | filled("unit"))]


def _resolved(texts: DataFrame, vocabulary: DataFrame, blocked: DataFrame) -> DataFrame:
    """(kind, raw, hit, blocked) of distinct (kind, raw): each text gets its key once, and a second key to fall back on."""
    half = lambda i: F.element_at(F.split("raw", PAIR), i)
    part = lambda i: F.when(half(i) == "", "").otherwise(slug(half(i)))
    key = F.when(F.col("kind") == "metric", F.concat(part(1), F.lit(PAIR), part(2))).otherwise(slug("raw"))
    keyed = texts.withColumn("key", key).withColumn("other", F.when(F.col("kind") == "metric", F.concat(F.split_part("key", F.lit(PAIR), F.lit(1)), F.lit(PAIR))).when(F.col("kind") == "effect", split_tail("key")["base"]))
    keyed = keyed.join(vocabulary.select("kind", "key", F.col("entry").alias("first")), ["kind", "key"], "left")
    keyed = keyed.join(vocabulary.select("kind", F.col("key").alias("other"), F.col("entry").alias("second")), ["kind", "other"], "left")
    cut = blocked.select(F.lit("object").alias("kind"), F.col("canonical").alias("key")).distinct().withColumn("cut", F.lit(True))
    return keyed.join(cut, ["kind", "key"], "left").select("kind", "raw", F.coalesce("first", "second").alias("hit"), F.coalesce("cut", F.lit(False)).alias("blocked"))


def normalize_with_vocab(rules: DataFrame, predicates: DataFrame, objects: DataFrame, effects: DataFrame, entities: DataFrame,
                         metrics: DataFrame, blocked_objects: DataFrame) -> DataFrame:
    """Vocabulary entry of each slot of a rule by prioritised lookups, with notes and full / partial status.

    All filled slots of all rules are taken as (kind, text); every distinct one is slugged and looked up once. Each slot
    then joins the looked-up texts of its kind, so rules are not multiplied, and not shuffled where these are few.
    """
    slots = _slots()
    each = F.array_compact(F.array(*[F.when(full, F.struct(F.lit(kind).alias("kind"), raw.alias("raw"))) for _, kind, raw, full in slots]))
    texts = rules.select(F.explode(each).alias("s"))
    known = cut_lineage(_resolved(texts.select("s.*").distinct(), _vocabulary(predicates, objects, effects, entities, metrics), blocked_objects), "slot_texts")
    met = rules.select("rule_id", *[F.when(full, raw).alias(f"{name}__raw") for name, _, raw, full in slots])
    for name, kind, *_ in slots:
        own = known.where(F.col("kind") == kind).select(F.col("raw").alias(f"{name}__raw"), F.col("hit").alias(name), *([F.col("blocked")] if name == "object" else []))
        met = met.join(own, f"{name}__raw", "left").withColumn(f"{name}__raw", F.col(f"{name}__raw").isNotNull())
    met = met.withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    c, has = F.col, lambda *names: reduce(or_, [F.col(f"{n}__raw") for n in names])
    pred, eff, auth = F.coalesce("canonical_predicate", "typed_predicate", "action"), F.coalesce("effect", "result"), F.coalesce("handler", "receiver")
    obj = F.when(~c("blocked"), c("object"))
    notes = tags((pred.isNull(), "predicate_fallback"), (c("blocked"), "object_slug_was_split_fragment"), (~c("blocked") & has("object") & obj.isNull(), "object_unmapped"),
                 (has("effect", "result") & eff.isNull(), "effect_unmapped"), (has("subject") & c("subject").isNull(), "subject_unmapped"), (has("subject_type") & c("subject_type").isNull(), "subject_type_unmapped"),
                 (has("handler", "receiver") & auth.isNull(), "authority_unmapped"), (has("scope") & c("scope").isNull(), "scope_unmapped"), (has("metric") & c("metric").isNull(), "metric_unmapped"))
    return met.select("rule_id", pred["canonical"].alias("predicate"), pred["family"].alias("predicate_family"), obj["canonical"].alias("object_canonical"), eff["canonical"].alias("effect_canonical"),
                      c("subject.canonical").alias("subject_canonical"), c("subject_type.canonical").alias("subject_type_canonical"), auth["canonical"].alias("authority_canonical"),
                      c("scope.canonical").alias("scope_canonical"), c("metric.canonical").alias("metric_canonical"), notes.alias("notes"),
                      F.when(F.size(notes) == 0, F.lit("full")).otherwise(F.lit("partial")).alias("status"))


# Entities that rulebases share.
KNOWN_ENTITIES = ["doanh_nghiep", "nguoi_lao_dong", "co_quan_thue"]


def shared_registry(rules: DataFrame, kind: str, known: Sequence[str] = KNOWN_ENTITIES, min_count: int = 2, min_domains: int = 1) -> DataFrame:
    """Entities (every occurrence in head and body arguments) or predicates (once per rule) used more than once.

    The reference counts in total, not by rulebase; `min_domains` adds the stricter test.
    """
    terms = F.concat(F.array(F.struct(F.col("head.predicate").alias("predicate"), F.col("head.args").alias("args"))),
                     F.transform("body", lambda b: F.struct(b["predicate"].alias("predicate"), b["args"].alias("args"))))
    if kind == "entities":
        names = F.filter(F.flatten(F.transform(terms, lambda x: x["args"])), lambda a: a.isin(list(known)))
    else:
        names = F.array_distinct(F.filter(F.transform(terms, lambda x: x["predicate"]), lambda p: F.coalesce(p, F.lit("")) != ""))
    g = rules.select("domain", F.explode(names).alias("name")).groupBy("name", "domain").agg(F.count("*").alias("n"))
    g = g.groupBy("name").agg(F.sum("n").alias("n"), F.count("*").alias("n_domains"))
    return g.filter((F.col("n") >= min_count) & (F.col("n_domains") >= min_domains))


def promote_shared_rules(registry: DataFrame, templates: DataFrame) -> DataFrame:
    """Template rules whose trigger entity is in the registry."""
    return templates.join(registry.select(F.col("name").alias("trigger")), "trigger", "left_semi")


def map_group_ids(seeds: DataFrame) -> DataFrame:
    """Rows, rule types and frames per rule group."""
    return seeds.groupBy("group_id").agg(F.count("*").alias("n_rules"), F.count_distinct("rule_type").alias("n_types"), F.count_distinct("frame_id").alias("n_frames"),
                                         F.min("rule_id").alias("first_rule_id"))
