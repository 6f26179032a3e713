"""Ranking of rules and passages for whole tables of questions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.common import HELD_ROWS, as_col, case_when, cut_lineage, first_row, head_of, has_phrase, lookup, shortened, tags, text_or_empty, top_k
from lexloom.functions.scan import Scanner, contained
from lexloom.functions.slots import normalize_family
from lexloom.functions.text import fold_text, token_overlap, tokens, word_set
from lexloom.operators import ranked

K1, B = 1.5, 0.75  # fixed values of the ranking formula
TEXT_BLOCK, PATTERN_CHUNK = 512, 8192


def _postings(items: DataFrame, keep_terms: DataFrame | None, fold: bool) -> DataFrame:
    """(item_id, dl, term, tf), hash-partitioned by item_id.

    The terms are cut to `keep_terms` before the only shuffle. Every later step that
    groups by item or by (query, item) reuses this partitioning.
    """
    t = items.select("item_id", tokens("text", fold).alias("toks"))
    t = t.select("item_id", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
    if keep_terms is not None:
        t = t.join(keep_terms, "term", "left_semi")
    t = t.groupBy("item_id", "dl", "term").agg(F.count("*").alias("tf"))
    return t


def corpus_size(items: DataFrame, fold: bool = False) -> DataFrame:
    """One row: number of items and mean token count."""
    return items.select(F.size(tokens("text", fold)).alias("dl")).agg(
        F.count("*").alias("n_items"), F.avg("dl").alias("avgdl"))


def bm25_index(items: DataFrame, fold: bool = False) -> DataFrame:
    """(item_id, term, tf, dl, df, idf) for a corpus of (item_id, text)."""
    tf = _postings(items, None, fold)
    n = corpus_size(items, fold).select("n_items").scalar()
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return tf.join(df.withColumn("idf", idf), "term").select("item_id", "term", "tf", "dl", "df", "idf")


def bm25_scores(queries: DataFrame, items: DataFrame, fold: bool = False,
                query_keys: Sequence[str] = ("query_id",)) -> DataFrame:
    """(query keys, item_id, score) of every item that shares a term with the query.

    Items without a shared term score 0 in the reference; those rows are not
    materialised. A term repeated in the query counts once per repetition.
    """
    return ranked.all_scores(queries, items, list(query_keys), fold)


def normalize_scores(scores: DataFrame, score: str = "score", key: str = "query_id",
                     out: str = "norm", store: bool = False) -> DataFrame:
    """score / best score of the query's pool; a pool whose best is 0 divides by 1e-9.

    With `store` the best scores are a table of their own, small enough to go to the scores instead of the scores to them.
    """
    best = scores.groupBy(key).agg(F.max(score).alias("__max"))
    best = cut_lineage(best, "best") if store else best
    best = best.withColumn("__max", F.when(F.col("__max") == 0, F.lit(1e-9)).otherwise(F.col("__max")))
    return scores.join(best, key).withColumn(out, F.col(score) / F.col("__max")).drop("__max")


def hybrid_combine(lexical: DataFrame, structured: DataFrame, w_lex: float = 0.35, w_struct: float = 0.65) -> DataFrame:
    """Weighted sum of two normalised score tables; a missing side counts as 0."""
    a = normalize_scores(lexical).select("query_id", "item_id", F.col("norm").alias("lex"))
    b = normalize_scores(structured).select("query_id", "item_id", F.col("norm").alias("struct"))
    x, y = F.coalesce("lex", F.lit(0.0)), F.coalesce("struct", F.lit(0.0))
    return a.join(b, ["query_id", "item_id"], "full_outer").select(
        "query_id", "item_id", (w_lex * x + w_struct * y).alias("hybrid"))


def top_items(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """Best k items per query, ties by item id."""
    return top_k(scores, ["query_id"], [F.desc(score), F.asc("item_id")], k, rank="rank")


# Light query aliases.
QUERY_ALIASES = {
    "obligation": ["nghĩa vụ", "bắt buộc", "phải thực hiện"],
    "permission": ["được phép", "có quyền", "có thể"],
    "prohibition": ["không được", "cấm", "nghiêm cấm"],
    "deadline": ["thời hạn", "trong vòng", "ngày"],
    "procedure": ["thủ tục", "trình tự", "hồ sơ"],
    "legal_consequence": ["hậu quả", "trách nhiệm", "xử lý"],
    "gui_phieu_lay_y_kien": ["phiếu lấy ý kiến", "lấy ý kiến"],
    "nop_ho_so": ["nộp hồ sơ", "hồ sơ đăng ký"],
    "thong_bao": ["thông báo", "báo cho"],
}


def expand_query(queries: DataFrame, aliases: Mapping[str, Sequence[str]] = QUERY_ALIASES, limit: int | None = None) -> DataFrame:
    """Append the alias phrases whose key occurs in the text or equals the goal predicate; the first `limit` of them if given."""
    low = F.lower("text")
    goal = F.lower(F.trim(text_or_empty("goal_predicate")))
    none = F.array().cast("array<string>")
    words = lambda ws: F.array(*[F.lit(w) for w in ws])
    by_goal = F.concat(*[F.when(goal == k, words(v)).otherwise(none) for k, v in aliases.items()])
    by_text = F.concat(*[F.when(F.contains(low, F.lit(k)), words(v)).otherwise(none) for k, v in aliases.items()])
    extra = F.array_distinct(F.concat(by_goal, by_text))
    extra = extra if limit is None else F.slice(extra, 1, limit)
    blank = F.trim(text_or_empty("text")) == ""
    full = F.array_join(F.concat(F.array(F.trim("text")), extra), " ")
    return queries.withColumn("expanded", F.when(blank, F.lit("")).otherwise(full))


def multi_query_max(variants: DataFrame, items: DataFrame, digits: int = 6) -> DataFrame:
    """Best score over a query's variants, rounded to `digits`, and the variant that gave it.

    `variants(query_id, variant, variant_no, text)`; the lowest number is the primary
    one and wins ties. Scores are compared rounded: variants of the same words are a tie whatever the order of the sums.
    """
    s = bm25_scores(variants, items, query_keys=("query_id", "variant_no", "variant")).withColumn("score", F.round("score", digits))
    best = s.groupBy("query_id", "item_id").agg(
        F.max("score").alias("score"),
        F.max_by("variant", F.struct(F.col("score"), -F.col("variant_no"))).alias("variant"))
    return best


def contained_tokens(needles: DataFrame, items: DataFrame, gram: int = 4) -> DataFrame:
    """(item_id, needle): every item whose text has the needle as a substring of a word.

    Exact. The containment test runs on the distinct words of the corpus, blocked by the needle's first `gram`
    characters (shorter needles by their whole text); the words then join back by equality.
    """
    words = items.select("item_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word")).filter("word <> ''")
    vocab = words.select("word").distinct()
    heads = needles.select("needle").distinct().filter("needle <> ''")
    hits = None
    for n in range(1, gram + 1):
        part = heads.filter(F.length("needle") >= n) if n == gram else heads.filter(F.length("needle") == n)
        part = part.select("needle", F.substring("needle", 1, n).alias("g"))
        grams = F.array_distinct(F.regexp_extract_all("word", F.lit("(?=(.{%d}))" % n), 1))
        found = (vocab.select("word", F.explode(grams).alias("g")).join(part, "g")
                 .filter(F.contains(F.col("word"), F.col("needle"))).select("word", "needle"))
        hits = found if hits is None else hits.unionByName(found)
    hits = cut_lineage(hits.distinct(), "hits")
    return words.join(hits, "word").select("item_id", "needle").distinct()


def evidence_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, bm25: DataFrame | None = None,
                  question_chars: int | None = None, conclusion_chars: int | None = None) -> DataFrame:
    """Best k passages per query from lexical and structured signals.

    queries(query_id, text, conclusion, rule_id, article, clause, source_ref) and
    chunks(item_id, text, rule_id or rule_ids, article, clause). `bm25(query_id, item_id, score,
    variant)` may be given by `multi_query_max`. Passages without any signal are not listed.

    Candidate pairs come from equality joins (shared term, shared rule id, contained
    token of the question, the conclusion or the head of the source reference). A pair that shares only its article or clause has no other signal, so for
    those the first k passages per key are enough; every signal is then computed on
    the union.
    """
    bm25 = bm25 if bm25 is not None else bm25_scores(queries, chunks).withColumn("variant", F.lit("primary"))
    folded = chunks.select("item_id", fold_text("text").alias("text"))
    q = queries.select("*", fold_text(head_of("text", question_chars)).alias("__q"),
                       fold_text(head_of(text_or_empty("conclusion"), conclusion_chars)).alias("__c"))

    longest = lambda text: F.element_at(F.array_sort(F.filter(F.split(text, " "), lambda w: w != ""), lambda a, b: F.length(b) - F.length(a)), 1)
    ref_head = fold_text(F.substring(text_or_empty("source_ref"), 1, 24))
    needles = (q.select("query_id", F.explode(F.split("__q", " ")).alias("needle")).filter(F.length("needle") > 3)
               .groupBy("query_id", "needle").agg(F.count("*").alias("times"))
               .union(q.filter("__c <> ''").select("query_id", longest("__c").alias("needle"), F.lit(0).alias("times")))
               .union(q.filter(F.length(text_or_empty("source_ref")) > 8).select("query_id", longest(ref_head).alias("needle"), F.lit(0).alias("times")).filter("needle IS NOT NULL")))
    needles = cut_lineage(needles, "needles")
    found = (contained_tokens(needles, folded).join(needles, "needle")
             .select("query_id", "item_id", F.lit(None).cast("double").alias("bm25"), F.lit(None).cast("string").alias("variant"),
                     "times"))

    rules = F.col("rule_ids") if "rule_ids" in chunks.columns else F.array("rule_id")
    by_rule = q.join(chunks.select("item_id", F.explode(rules).alias("rule_id")), "rule_id").select("query_id", "item_id").distinct()
    order = [F.asc("item_id")]
    keyed = chunks.select("item_id", "article", "clause")
    by_key = []
    for keys in (["article"], ["clause"], ["article", "clause"]):
        heads = top_k(keyed.dropna(subset=keys), keys, order, k)
        by_key.append(q.select("query_id", *keys).join(heads.select("item_id", *keys), keys).select("query_id", "item_id"))

    pairs = bm25.select("query_id", "item_id", F.col("score").alias("bm25"), "variant", F.lit(0).cast("bigint").alias("times"))
    pairs = pairs.unionByName(found)
    for more in [by_rule, *by_key]:
        pairs = pairs.unionByName(more, allowMissingColumns=True)
    pairs = pairs.groupBy("query_id", "item_id").agg(
        F.max("bm25").alias("bm25"), F.max("variant").alias("variant"), (0.12 * F.sum("times")).alias("token_overlap"))
    # The text is folded once per passage, before it meets its queries.
    side = chunks.select("item_id", "text", fold_text("text").alias("c_folded"), rules.alias("c_rules"),
                         F.col("article").alias("c_article"), F.col("clause").alias("c_clause"))
    full = pairs.join(side, "item_id").join(
        q.select("query_id", "__c", "rule_id", "article", "clause", "source_ref"), "query_id")

    ref = text_or_empty("source_ref")
    long_ref = F.length(ref) > 8
    head = lambda n: F.contains(F.col("text"), F.substring(ref, 1, n))
    boosts = {
        "lexical_variant": F.when(F.col("variant") != "primary", 0.1),
        "rule_id_match": F.when(F.array_contains("c_rules", F.col("rule_id")), 6.0),
        "source_ref_substring": F.when(long_ref & head(40), 3.5).when(long_ref & head(24), 2.5),
        "article_align": F.when(F.col("article") == F.col("c_article"), 2.5),
        "clause_align": F.when(F.col("clause") == F.col("c_clause"), 1.8),
        "conclusion_overlap": F.when((F.col("__c") != "") & F.contains(F.col("c_folded"), F.col("__c")), 2.2),
        "question_token_overlap": F.col("token_overlap"),
    }
    boosts = {n: F.coalesce(b, F.lit(0.0)) for n, b in boosts.items()}
    total = sum(boosts.values(), F.lit(0.0))
    full = full.select("query_id", "item_id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), total.alias("structured"),
                       *[b.alias(n) for n, b in boosts.items()])
    full = cut_lineage(full, "evidence")
    pos = lambda c: F.when(F.max(c) == 0, F.lit(1e-9)).otherwise(F.max(c))
    best = full.groupBy("query_id").agg(pos("bm25").alias("__b"), pos("structured").alias("__s"))
    full = full.join(best, "query_id").withColumn("score", 0.42 * F.col("bm25") / F.col("__b") + 0.58 * F.col("structured") / F.col("__s"))
    return top_items(full.drop("__b", "__s"), k)


def provenance_rescue(top: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = 5, score: float = 0.35) -> DataFrame:
    """Put the rule's own text first when no listed passage shares the rule's article; cut to k again. The ranking is computed once."""
    top = cut_lineage(top, "listed")
    hit = (top.join(chunks.select("item_id", F.col("article").alias("c_article")), "item_id")
           .join(queries.select("query_id", "article"), "query_id").filter("article = c_article").select("query_id").distinct())
    miss = queries.filter("rule_id IS NOT NULL").select("query_id", "rule_id").join(hit, "query_id", "left_anti")
    own = miss.select("query_id", F.concat(F.lit("rule_provenance:"), "rule_id").alias("snippet"),
                      F.lit(score).alias("score"), F.lit(0).alias("rank"))
    listed = top.select("query_id", F.col("item_id").cast("string").alias("snippet"), "score", "rank")
    return top_k(listed.unionByName(own), ["query_id"], [F.asc("rank")], k, rank="position").drop("rank")


def candidate_pool(queries: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules to be scored per query: same head predicate, else same family, else all.

    Returns `(pairs, whole)`: the (query_id, rule_id, tier) pairs of the first two tiers,
    and the queries of the third tier, which stand for "every rule" and are not expanded.
    """
    q = queries.select("query_id", F.lower(F.trim(text_or_empty("goal_predicate"))).alias("goal"))
    q = q.withColumn("family", normalize_family("goal"))
    r = rules.select("rule_id", "head_predicate", "family")
    known = q.filter("goal NOT IN ('', 'unknown')")
    heads = r.select(F.col("head_predicate").alias("goal")).distinct()
    families = r.filter("family <> ''").select("family").distinct()
    exact = known.join(heads, "goal", "left_semi")
    rest = known.join(heads, "goal", "left_anti")
    same = rest.join(families, "family", "left_semi")
    pairs = (exact.join(r.withColumnRenamed("family", "f"), F.col("goal") == F.col("head_predicate"))
             .select("query_id", "rule_id", F.lit(1).alias("tier"))
             .union(same.join(r, "family").select("query_id", "rule_id", F.lit(2).alias("tier"))))
    whole = q.filter("goal IN ('', 'unknown')").select("query_id").union(
        rest.join(families, "family", "left_anti").select("query_id"))
    return pairs, whole


def _set_overlap(x: Column, y: Column) -> Column:
    """Jaccard of two word arrays, 0 when either is empty."""
    inter = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(inter / (F.size(x) + F.size(y) - inter))


def _sum_overlap(left: Column, right: Column) -> Column:
    """Sum of overlaps over two arrays of word arrays."""
    return F.aggregate(left, F.lit(0.0), lambda acc, g: acc + F.aggregate(
        right, F.lit(0.0), lambda a, h: a + _set_overlap(g, h)))


# What speaks for and against a rule when a registration deadline is asked for.
REGISTRATION_ANCHORS = ["thay doi noi dung dang ky doanh nghiep", "thong bao thay doi noi dung dang ky doanh nghiep", "dang ky doanh nghiep", "enterprise_registration", "deadline"]
REGISTRATION_DOMAINS = ["enterprise", "enterprise_registration", "shared"]
DEADLINE_HEADS = ["deadline", "regulatory_deadline", "regulatory_deadline_requirement"]
TAX_ATTRACTORS = ["thuc_hien_nop_thay_so_tien_thue_bi_cuong_che", "cuong che thue", "nop thay tien thue", "nguoi nop thue bi cuong che", "thue bi cuong che", "nop_thay", "cuong_che"]
OTHER_FAMILY_TERMS = ["thuc_hien_nop_thay_so_tien_thue_bi_cuong_che", "cuong che thue", "nop thay tien thue", "nguoi nop thue bi cuong che", "ben thu ba"]
LABOR_DOMAINS = ["labor", "lao_dong"]
ANCHOR_TERMS = ["head_predicate_match", "event_type_match", "goal_family_match", "goal_head_arg_overlap", "condition_atom_overlap", "action_modality_overlap", "action_object_match"]


def _holds_any(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def _asked_terms(columns: Sequence[str], blob: Column) -> dict[str, Column]:
    """Terms of the optional inputs q_subject_type and q_registration_deadline; without the column a term is 0."""
    c, zero = F.col, F.lit(0.0)
    on = lambda cond, v: F.when(F.coalesce(cond, F.lit(False)), F.lit(v)).otherwise(zero)
    kind = text_or_empty("q_subject_type") if "q_subject_type" in columns else F.lit("")
    asked = c("q_registration_deadline") if "q_registration_deadline" in columns else F.lit(False)
    boost = on(_holds_any(blob, REGISTRATION_ANCHORS), 4.0) + on(F.lower(c("r_domain")).isin(REGISTRATION_DOMAINS), 1.5) + on(F.lower(c("r_head")).isin(DEADLINE_HEADS), 1.5)
    return {
        "subject_type_guess": on(~kind.isin("", "unknown") & F.contains(blob, kind), 0.8),
        "registration_boost": F.when(F.coalesce(asked, F.lit(False)), boost).otherwise(zero),
        "tax_attractor_penalty": on(asked & _holds_any(blob, TAX_ATTRACTORS), -22.0),
        "family_mismatch_penalty": on(asked & _holds_any(blob, OTHER_FAMILY_TERMS), -10.0),
    }


def _attractor_penalty(columns: Sequence[str]) -> Column:
    """What a rule that fits everything loses (optional inputs r_generic and compatibility): more with few anchors and a short question."""
    if "r_generic" not in columns:
        return F.lit(0.0)
    c = F.col
    anchor = sum((F.greatest(F.lit(0.0), c(t)) for t in ANCHOR_TERMS), F.lit(0.0))
    on = lambda cond, v: F.when(F.coalesce(cond, F.lit(False)), F.lit(v)).otherwise(0.0)
    clash = on(c("compatibility") < 0, 1.3) if "compatibility" in columns else F.lit(0.0)
    lost = on(anchor < 2, 1.8) + on(anchor < 4, 0.8) + on(F.size(word_set("q_text")) <= 3, 0.7) + clash + on(F.lower(c("r_domain")).isin(LABOR_DOMAINS) & (anchor < 3), 0.8)
    return F.when(c("r_generic"), -lost).otherwise(0.0)


def structured_score(pairs: DataFrame, placeholders: str = r"^(?:[A-Z]\w*|_.*|unknown.*)$") -> DataFrame:
    """Additive structured terms of one (query, rule) row, with the breakdown and a floor at 0.

    Reads q_goal, q_focus, q_args, q_text, q_action, q_object, q_event, q_conditions, q_subject, q_time,
    q_exception, q_domain_text and r_head, r_form, r_args, r_event, r_conditions, r_blob, r_action, r_domain,
    r_shared, q_context, r_context; where they are there also q_subject_type, q_registration_deadline, r_generic and
    compatibility.
    """
    c = F.col
    zero = F.lit(0.0)
    on = lambda cond, v: F.when(cond, F.lit(float(v))).otherwise(zero)
    named = lambda arr: F.filter(arr, lambda x: ~x.rlike(placeholders))
    words = lambda arr: F.transform(arr, lambda x: word_set(x))
    columns = pairs.columns
    # Word sets once per row and column; the terms below work on arrays only.
    pairs = pairs.select("*", words(named("q_args")).alias("__ga"), words(named("r_args")).alias("__ra"), words(c("r_args")).alias("__rall"), word_set("q_text").alias("__qt"),
                         word_set("q_action").alias("__qa"), word_set("q_object").alias("__qo"), word_set("r_action").alias("__rw"), word_set("r_blob").alias("__rb"),
                         word_set("q_time").alias("__qm"), word_set("q_exception").alias("__qe"), fold_text("r_blob").alias("__blob"))
    q_family = normalize_family(F.when(~c("q_goal").isin("", "unknown"), c("q_goal")).otherwise(
        F.when(c("q_focus") != "unknown", c("q_focus")).otherwise(F.lit(""))))
    r_family = normalize_family(F.when(~c("r_head").isin("", "unknown"), c("r_head")).otherwise(c("r_form")))
    inter, union = F.size(F.array_intersect("q_conditions", "r_conditions")), F.size(F.array_union("q_conditions", "r_conditions"))
    q_size = F.size(F.array_distinct("q_conditions"))
    both = (F.size("q_conditions") > 0) & (F.size("r_conditions") > 0) & (inter > 0)
    cond = F.when(both, 6.0 * inter / union + F.when(inter == q_size, 2.0).when(inter >= 2, 1.0).otherwise(0.0)).otherwise(zero)
    event = on((c("q_event") != "") & ((c("q_event") == c("r_event")) | F.array_contains("r_conditions", c("q_event"))), 7)
    over = lambda x, y: _set_overlap(c(x), c(y))
    anchor = F.greatest(over("__qa", "__rw"), over("__qo", "__rb"))
    structural = ["deadline", "threshold", "dossier", "procedure"]
    normative = ["permission", "obligation", "prohibition", "applicability", "legal_effect"]
    loose_deadline = (q_family == "deadline") & (anchor < 0.35)
    same_family = 3.5 - on(loose_deadline, 2.5)
    other_family = -(F.lit(3.5) + on(c("r_shared"), 2.0) + on(q_family.isin(normative) & r_family.isin(structural), 2.5))
    family = F.when((q_family == "") | (r_family == ""), zero).when(q_family == r_family, same_family).otherwise(other_family)
    blob = c("__blob")
    timed = (F.trim("q_time") != "") & blob.rlike("thoi han|ngày|deadline|han")
    missing = F.size(F.array_except("r_context", "q_context"))
    enforced = F.array_contains(F.array_except("r_context", "q_context"), "tax_enforcement")
    terms = {
        "head_predicate_match": on(c("q_goal") == c("r_head"), 10),
        "logic_form_focus_match": on((c("q_focus") != "unknown") & (c("q_focus") == c("r_form")), 5),
        "focus_logic_penalty": F.when((c("q_focus") == "permission") & c("r_form").isin(structural), -3.0)
                                .when((c("q_focus") == "permission") & c("r_form").isin("obligation", "legal_effect"), 1.0).otherwise(zero),
        "goal_head_arg_overlap": 2.0 * _sum_overlap(c("__ga"), c("__ra")),
        "action_modality_overlap": 1.5 * _sum_overlap(F.array("__qt"), c("__rall")),
        "event_type_match": event,
        "condition_atom_overlap": cond,
        "event_atom_alignment_bonus": on((event > 0) & (cond > 0.01), 2.5),
        "subject_id_in_rule": on((c("q_subject") != "") & F.contains(c("r_blob"), c("q_subject")), 1),
        "time_deadline_relevance": F.when(timed, 1.2 * over("__qm", "__rb")).otherwise(zero),
        "exception_relevance": 1.2 * over("__qe", "__rb"),
        "metadata_domain": on((c("r_domain") != "") & F.contains(fold_text("q_domain_text"), c("r_domain")), 0.5),
        "goal_family_match": family,
        "action_object_match": 2.2 * over("__qa", "__rb") + 1.8 * over("__qo", "__rb"),
        "context_mismatch_penalty": -(2.2 * missing + on(enforced, 1.8)),
        **_asked_terms(columns, blob),
    }
    out = pairs.select(*columns, *[v.cast("double").alias(n) for n, v in terms.items()], loose_deadline.alias("deadline_mismatch"))
    anchored = (c("head_predicate_match") > 0) | (c("goal_head_arg_overlap") > 0.01) | (c("condition_atom_overlap") > 0.01) | (c("action_modality_overlap") > 0.01)
    out = out.withColumn("shared_anchor_penalty", F.when(c("r_shared") & ~anchored, F.lit(-3.5)).otherwise(zero)).withColumn("attractor_penalty", _attractor_penalty(columns))
    names = [*terms, "shared_anchor_penalty", "attractor_penalty"]
    total = sum((c(n) for n in names), zero)
    return out.withColumn("structured_total", F.greatest(total, zero))


def rank_rules(pairs: DataFrame, k: int = 8) -> DataFrame:
    """Order scored pairs by the capped semantic signals; best k per query.

    Reads the columns of `structured_score` plus `bm25_norm`, `q_group`, `r_group`, `family_differs`.
    """
    c = F.col
    flag = lambda x: F.when(x > 0, 1.0).otherwise(0.0)
    group = (F.when((c("q_group") == c("r_group")) & (c("q_group") != "other"), 2.0)
             .when((c("q_group") != "other") & (c("r_group") != "other"), -3.5).otherwise(0.0))
    cond = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("condition_atom_overlap")) / 6.0)
    action = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c("action_object_match")) / 2.0)
    s = pairs.select("*", flag(c("event_type_match")).alias("event_sig"), cond.alias("cond_sig"), group.alias("group_score"))
    semantic = (0.75 * flag(c("metadata_domain")) + 2.75 * c("event_sig") + 2.25 * c("cond_sig") + 2.0 * flag(c("goal_family_match"))
                + 1.75 * action - 2.25 * F.greatest(F.lit(0.0), -c("context_mismatch_penalty")) + c("group_score"))
    tie = 0.05 * c("bm25_norm") * F.when(c("family_differs"), 0.2).otherwise(1.0) * F.when(c("deadline_mismatch"), 0.4).otherwise(1.0)
    s = s.withColumn("total", semantic + tie)
    strong = (c("event_sig") >= 1) & (c("cond_sig") >= 0.35)
    weak = (c("event_sig") <= 0) & (c("cond_sig") < 0.2)
    s = s.withColumn("strong", strong)
    active = s.filter("strong").select("query_id").distinct().withColumn("active", F.lit(True))
    s = s.join(active, "query_id", "left")
    priority = F.when(c("active"), F.when(c("strong"), 2).when(weak, 0).otherwise(1)).otherwise(1)
    s = s.withColumn("priority", priority).drop("active", "strong")
    return top_k(s, ["query_id"], [F.desc("priority"), F.desc("total"), F.desc("bm25_norm"), F.asc("rule_id")], k, rank="rank")


def action_group_override(ranked: DataFrame) -> DataFrame:
    """When the first rule's action group is not the query's, lift the best rule of the query's group.

    Works on the top-k rows only, so the groups are at most k rows; they are read once, where the ranking left them.
    """
    q = Window.partitionBy("query_id")
    fits = F.col("r_group") == F.col("q_group")
    r = ranked.select("*", F.max(F.when(F.col("rank") == 1, F.col("r_group"))).over(q).alias("first_group"), F.max(F.col("rank") == 1).over(q).alias("__led"),
                      F.min_by(F.when(fits, F.col("rank")), F.when(fits, F.struct(-F.col("total"), F.col("rank")))).over(q).alias("lift")).filter("__led").drop("__led")
    lifted = (F.col("first_group") != F.col("q_group")) & (F.col("rank") == F.col("lift"))
    moved = (F.col("first_group") != F.col("q_group")) & (F.col("rank") < F.col("lift"))
    pos = F.when(lifted, 1).when(moved, F.col("rank") + 1).otherwise(F.col("rank"))
    return r.withColumn("position", pos).drop("first_group", "lift")


def chunk_rerank(ranked: DataFrame) -> DataFrame:
    """Re-order the listed rules by an evidence adjustment.

    Reads q_action, evidence (folded text of the rule), q_subtypes, e_subtypes, q_scopes, e_scopes (arrays of
    labels) and generic_only (evidence has only generic hints).
    """
    c = F.col
    act = fold_text("q_action")
    action = F.when(act == "", 0.0).otherwise(
        F.when(F.contains(c("evidence"), act), 2.2).otherwise(0.0) + 1.8 * token_overlap(act, "evidence"))
    subtype = 1.6 * F.size(F.array_intersect("q_subtypes", "e_subtypes"))
    scope = 2.0 * F.size(F.array_intersect("q_scopes", "e_scopes"))
    asks, has = (lambda x: F.array_contains("q_subtypes", x)), (lambda x: F.array_contains("e_subtypes", x))
    pen = lambda cond, v: F.when(cond, F.lit(-v)).otherwise(0.0)
    conflict = (pen(asks("notification") & has("registration") & ~has("notification"), 2.4)
                + pen(asks("registration") & has("notification") & ~has("registration"), 2.0)
                + pen(asks("dossier") & has("issuance_update"), 1.2) + pen(asks("amendment") & has("issuance_update"), 1.2)
                + pen((F.size("q_scopes") > 0) & (F.size("e_scopes") > 0) & ~F.arrays_overlap("q_scopes", "e_scopes"), 1.8))
    generic = pen((F.size("q_scopes") > 0) & c("generic_only") & (F.size("e_scopes") == 0), 1.4)
    r = ranked.withColumn("adjustment", action + subtype + scope + generic + conflict)
    r = r.withColumn("final_score", c("total") + c("adjustment"))
    best = Window.partitionBy("query_id").orderBy(F.desc("adjustment"), F.desc("final_score"), F.desc("bm25_norm"), F.asc("position"))
    return r.withColumn("final_rank", F.row_number().over(best))


def scoped_retrieve(scored: DataFrame, routing: DataFrame, k_scope: int = 8, k_final: int = 20) -> DataFrame:
    """Top rules per scope, merged: best score per global key, then the overall top.

    scored(query_id, rule_id, global_key, domain, layer, score) and routing(query_id, primary_domain,
    secondary_domain, include_shared, allow_expansion).
    """
    s = scored.join(routing, "query_id")
    scope = (F.when((F.col("layer") == "shared"), F.when(F.col("include_shared"), F.lit("shared")))
             .when(F.col("domain") == F.col("primary_domain"), F.col("domain"))
             .when(F.col("allow_expansion") & (F.col("domain") == F.col("secondary_domain")), F.concat(F.lit("secondary:"), "domain")))
    s = s.withColumn("scope", scope).filter("scope IS NOT NULL").select("query_id", "rule_id", "global_key", "scope", "score")
    s = top_k(s, ["query_id", "scope"], [F.desc("score"), F.asc("rule_id")], k_scope)
    rank = case_when([(F.col("scope") == "shared", 0), (F.startswith(F.col("scope"), F.lit("secondary:")), 2)], 1)
    s = s.withColumn("scope_no", rank)
    s = first_row(s, ["query_id", "global_key"], [F.desc("score"), F.asc("scope_no"), F.asc("rule_id")])
    return top_k(s, ["query_id"], [F.desc("score"), F.asc("scope_no"), F.asc("rule_id")], k_final, rank="rank").drop("scope_no")


def link_subgoals(snippets: DataFrame, subgoals: DataFrame) -> DataFrame:
    """Per snippet the subgoal of its case with most contained words (> 2 letters); first one on ties.

    snippets(case_id, snippet_id, text), subgoals(case_id, goal_no, subgoal). Both sides are short lists of
    one case, joined on the case.
    """
    words = F.filter(F.split(fold_text("subgoal"), " "), lambda w: F.length(w) > 2)
    g = subgoals.select("case_id", "goal_no", "subgoal", words.alias("words"))
    s = snippets.select("case_id", "snippet_id", fold_text("text").alias("folded"))
    hits = F.size(F.filter("words", lambda w: F.contains(F.col("folded"), w)))
    pairs = s.join(g, "case_id").withColumn("hits", hits).filter("hits > 0").drop("folded", "words")
    return first_row(pairs, ["case_id", "snippet_id"], [F.desc("hits"), F.asc("goal_no")])


def citations(evidence: DataFrame, rules: DataFrame, limit: int | None = None, excerpt_chars: int | None = None,
              source_chars: int | None = None, ref_chars: int | None = None) -> DataFrame:
    """Distinct passages per answer in rank order, then the rule's own reference; cut only where a limit is given.

    evidence(answer_id, rank, chunk_id, article_clause, source_doc, text); rules(answer_id, rule_id, source_ref, source_text).
    """
    label = F.concat_ws(" — ", F.nullif(F.trim(text_or_empty("article_clause")), F.lit("")),
                        F.nullif(shortened(F.trim("source_doc"), source_chars), F.lit("")))
    label = F.when(label == "", F.lit("Tham chiếu pháp lý")).otherwise(label)

    def excerpt(c: str) -> Column:
        t = F.replace(F.trim(text_or_empty(c)), F.lit("\n"), F.lit(" "))
        return shortened(t, excerpt_chars)

    ev = evidence.withColumn("__key", F.concat_ws("|", "chunk_id", text_or_empty("article_clause"), text_or_empty("source_doc")))
    ev = first_row(ev, ["answer_id", "__key"], [F.asc("rank"), F.asc("text")])
    ev = ev.select("answer_id", F.col("rank").alias("ord"), label.alias("label"), excerpt("text").alias("excerpt"), F.col("chunk_id").cast("string").alias("source"))
    own = rules.filter(F.trim(text_or_empty("source_ref")) != "").select(
        "answer_id", F.lit(1 << 30).alias("ord"),
        shortened(F.col("source_ref"), ref_chars).alias("label"),
        excerpt("source_text").alias("excerpt"), F.concat(F.lit("rule:"), "rule_id").alias("source"))
    place = F.row_number().over(Window.partitionBy("answer_id").orderBy("ord", "source", "label", "excerpt"))
    out = ev.unionByName(own).withColumn("citation_no", place).drop("ord")
    return out if limit is None else out.where(F.col("citation_no") <= limit)


class _Patterns:
    """A chunk of patterns with an automaton over all of them; see `pattern_scores`."""

    def __init__(self, entries: Sequence, patterns: Sequence[str]):
        self.entries, self.patterns = list(dict.fromkeys(entries)), list(dict.fromkeys(patterns))
        entry, place = {e: i for i, e in enumerate(self.entries)}, {p: i for i, p in enumerate(self.patterns)}
        self.of = np.array([(entry[e], place[p]) for e, p in zip(entries, patterns)]).reshape(-1, 2)
        own = [[w for w in p.split(" ") if len(w) > 2] for p in self.patterns]
        self.size, self.place = np.array([len(w) for w in own]), place
        self.bonus = np.array([0.72 + min(0.27, len(p) / 120.0) for p in self.patterns])
        words: dict[str, list[int]] = {}
        for i, ws in enumerate(own):
            for w in ws:
                words.setdefault(w, []).append(i)
        self.words = {w: np.array(rows) for w, rows in words.items()}

    def score(self, held: set[str], words: Iterable[str]) -> np.ndarray:
        """Best score per entry of a text that holds these patterns and consists of these distinct words."""
        rows = [self.words[w] for w in words if w in self.words]
        hits = np.bincount(np.concatenate(rows), minlength=len(self.patterns)) if rows else np.zeros(len(self.patterns), int)
        ratio = hits / np.maximum(self.size, 1)
        raw = np.select([self.size == 0, ratio >= 0.85, ratio >= 0.66, ratio >= 0.34], [0.0, 0.42 + 0.12 * ratio, 0.22 + 0.18 * ratio, 0.12 + 0.12 * ratio], 0.0)
        whole = [self.place[p] for p in held]
        raw[whole] = self.bonus[whole]
        best = np.zeros(len(self.entries))
        np.maximum.at(best, self.of[:, 0], raw[self.of[:, 1]])
        return best


def pattern_scores(texts: DataFrame, patterns: DataFrame, chunk: int = PATTERN_CHUNK) -> DataFrame:
    """(text_id, entry_id, raw): best pattern score of each lexicon entry in each text.

    texts(text_id, text), patterns(entry_id, pattern). A whole phrase scores .72 + up to .27 by length; else the
    share of its words (> 2 letters) found as whole words decides. Blocks of texts meet chunks of patterns; an automaton
    over a chunk is walked once per text, and only scores above 0 leave the task.
    """
    p = patterns.select("entry_id", fold_text("pattern").alias("pattern")).filter(F.length("pattern") >= 2).distinct()
    p = cut_lineage(p, "patterns")
    chunks = max(1, -(-p.count() // chunk))
    blocks = max(1, -(-texts.count() // TEXT_BLOCK))
    t = texts.select("text_id", fold_text(text_or_empty("text")).alias("text"))
    t = t.select("text_id", "text", F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("words"), F.pmod(F.xxhash64("text_id"), F.lit(blocks)).alias("block"), F.explode(_numbers(chunks)).alias("chunk"))
    asked = p.select("entry_id", "pattern", F.pmod(F.xxhash64("entry_id", "pattern"), F.lit(chunks)).alias("in_chunk"), F.explode(_numbers(blocks)).alias("in_block"))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((texts, "text_id"), (patterns, "entry_id"))]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, raws, rows = [], [], []
        if right.num_rows:
            own = _Patterns(right.column("entry_id").to_pylist(), right.column("pattern").to_pylist())
            for i, (held, words) in enumerate(zip(contained(own.patterns, left.column("text").to_pylist()), left.column("words").to_pylist())):
                best = own.score(held, words)
                found = np.flatnonzero(best)
                rows += [i] * len(found)
                ids += [own.entries[k] for k in found]
                raws += best[found].tolist()
        return pa.table([left.column("text_id").combine_chunks().take(pa.array(rows, pa.int64())), pa.array(ids, right.schema.field("entry_id").type), pa.array(raws, pa.float64())], names=["text_id", "entry_id", "raw"])

    met = t.groupBy("block", "chunk").cogroup(asked.groupBy("in_block", "in_chunk")).applyInArrow(run, f"text_id {kinds[0]}, entry_id {kinds[1]}, raw double")
    return met if chunks == 1 else met.groupBy("text_id", "entry_id").agg(F.max("raw").alias("raw"))


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def _contenders(s: DataFrame, scores: Sequence[str], k: int) -> DataFrame:
    """The rows of s(text_id, entry_id, generic, raw, ...) that are among the k best of their text and kind by one of the scores at least.

    Tasks cut their rows as they come, without sorting all of them, so more rows than these may be left.
    """
    def cut(t: pa.Table) -> pa.Table:
        kind = pc.fill_null(pc.cast(t.column("generic").combine_chunks(), pa.int8()), 2).to_numpy(zero_copy_only=False).astype(np.int64)
        code = t.column("text_id").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) * 3 + kind
        keep = np.zeros(t.num_rows, bool)
        for name in scores:
            at = pc.sort_indices(pa.table({"code": code, "score": t.column(name), "raw": t.column("raw"), "entry": t.column("entry_id")}),
                                 [("code", "ascending"), ("score", "descending"), ("raw", "descending"), ("entry", "ascending")]).to_numpy()
            first = np.flatnonzero(np.diff(code[at], prepend=-1))
            keep[at[np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))) < k]] = True
        return t.filter(pa.array(keep))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, limit = [], 0, HELD_ROWS
        for b in batches:
            held, rows = [*held, b], rows + b.num_rows
            if rows < limit:
                continue
            t = cut(pa.Table.from_batches(held))
            if t.num_rows > HELD_ROWS:  # too many texts to hold: the shuffle brings them together
                yield from t.to_batches()
                held, rows, limit = [], 0, HELD_ROWS
            else:
                held, rows, limit = t.to_batches(), t.num_rows, t.num_rows + HELD_ROWS
        if held:
            yield from cut(pa.Table.from_batches(held)).to_batches()

    return s.mapInArrow(run, s.schema)


def condition_match(scores: DataFrame, entries: DataFrame, texts: DataFrame) -> DataFrame:
    """Best lexicon entry per text after the context re-rank, with an ambiguity reason or the fallback label.

    entries(entry_id, predicate, domain, family, priority, generic); texts(text_id, text, domain_hint, family_hint).
    """
    c = F.col
    # The texts' hints are few beside the scores: these stream past them and are not sorted.
    s = scores.join(entries, "entry_id").join(texts.select("text_id", "domain_hint", "family_hint").hint("shuffle_hash"), "text_id")
    off = (text_or_empty("domain_hint") != "") & (c("domain") != c("domain_hint"))
    wrong = (text_or_empty("family_hint") != "") & (c("family") != c("family_hint"))
    dom = F.when(text_or_empty("domain_hint") == "", 0.0).when(off, -0.12).otherwise(0.08)
    fam = F.when(text_or_empty("family_hint") == "", 0.0).when(wrong, -0.14).otherwise(0.08)

    def rerank(factor: Column) -> Column:
        eff = (c("raw") + c("priority") / 1000.0) * factor
        return eff + 0.05 + dom + fam - F.when((c("raw") >= 0.6) & (off | wrong), 0.18).otherwise(0.0)

    # A generic entry counts less where a specific one of the text is good. Which holds is known when all scores of a text
    # are; until then the best two of either case stay, and the best specific ones.
    s = s.select("text_id", "entry_id", "predicate", "generic", "raw", rerank(F.lit(1.0)).alias("full"), rerank(F.when(c("generic"), 0.82).otherwise(1.0)).alias("less"), off.alias("off"), wrong.alias("wrong"))
    s = _contenders(s, ["full", "less", "raw"], 2)
    specific = F.max(F.when(~c("generic"), c("raw"))).over(Window.partitionBy("text_id"))
    s = s.withColumn("rerank", F.when(F.coalesce(specific, F.lit(0.0)) >= 0.58, c("less")).otherwise(c("full"))).drop("full", "less", "generic")
    placed = Window.partitionBy("text_id").orderBy(F.desc("rerank"), F.desc("raw"), F.asc("entry_id"))
    following = [F.lead(x).over(placed).alias(name) for x, name in ((c("predicate"), "p2"), (c("rerank"), "rerank2"), (c("off") | c("wrong"), "bad2"))]
    best = s.select("*", F.row_number().over(placed).alias("n"), *following).filter("n = 1").drop("n")
    m = texts.select("text_id").join(best, "text_id", "left")
    gap = F.when(c("p2").isNull(), 1.0).otherwise(c("rerank") - c("rerank2"))
    usable = (c("rerank").isNotNull() & ~(c("wrong") & (c("rerank") < 0.62)) & ~(c("off") & (c("rerank") < 0.64))
              & ((c("rerank") >= 0.48) | ((c("raw") >= 0.58) & ~c("off") & ~c("wrong")) | ((c("raw") >= 0.5) & (c("rerank") >= 0.42) & ~c("wrong"))))
    usable = F.coalesce(usable, F.lit(False))
    close = (gap < 0.1) & (c("rerank2") > 0.38) & (c("p2") != c("predicate")) & ~c("bad2")
    tie = (gap < 0.06) & (c("rerank2") > 0.35)
    reason = case_when([(close, "close_contextual_alternatives"), (~usable, "no_usable_contextual_match"), (tie, "contextual_score_tie")], "")
    reason = F.when(usable & (gap >= 0.08), F.lit("")).otherwise(reason)
    return m.select("text_id", F.when(usable, c("predicate")).otherwise(F.lit("stated_condition")).alias("predicate"),
                    F.coalesce("raw", F.lit(0.0)).alias("raw"), F.coalesce("rerank", F.lit(0.0)).alias("rerank"), reason.alias("ambiguity"))


# Mention patterns, their roles and the roles' priority.
MENTION_PATTERNS = [
    ("labor_leasing_enterprise", r"(?:doanh nghiệp cho thuê lại lao động|doanh nghiep cho thue lai lao dong)[^?.]{0,40}"),
    ("employer", r"(?:người sử dụng lao động|nguoi su dung lao dong|bên sử dụng lao động|ben su dung lao dong)[^?.]{0,40}"),
    ("employee", r"(?:người lao động|nguoi lao dong)[^?.]{0,40}"),
    ("taxpayer", r"(?:người nộp thuế|nguoi nop thue|người đóng thuế|nguoi dong thue|người chịu thuế|nguoi chiu thue)[^?.]{0,40}"),
    ("business_household", r"(?:hộ kinh doanh|ho kinh doanh)[^?.]{0,30}"),
    ("company", r"(?:công ty|cong ty|doanh nghiệp|doanh nghiep)[^?.]{0,40}"),
    ("member", r"(?:thành viên|thanh vien)(?:\s+công ty|\s+cong ty)?[^?.]{0,40}"),
    ("shareholder", r"(?:cổ đông|co dong)[^?.]{0,30}"),
    ("legal_representative", r"(?:người đại diện|dai dien|đại diện pháp luật)[^?.]{0,40}"),
    ("founder", r"(?:nhà đầu tư|nha dau tu|sáng lập|sang lap)[^?.]{0,30}"),
    ("authority", r"(?:cơ quan|co quan|sở kế hoạch)[^?.]{0,30}"),
]
ROLE_PRIORITY = {"employer": 1, "employee": 1, "labor_leasing_enterprise": 1, "taxpayer": 2, "business_household": 2, "enterprise": 3,
                 "company": 3, "member": 4, "shareholder": 4, "legal_representative": 5, "founder": 5, "authority": 9, "unknown": 10}


def entity_mentions(texts: DataFrame, patterns: Sequence[tuple[str, str]] = MENTION_PATTERNS,
                    priority: Mapping[str, int] = ROLE_PRIORITY) -> DataFrame:
    """Every mention (text_id, surface, start, role, is_primary); one per (surface, start).

    One walk over each text, inside the row: no shuffle.
    """
    kind = texts.schema["text_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner([[rx] for _, rx in patterns], whole=False)
        for b in batches:
            row, rows = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                best: dict[tuple[str, int], tuple] = {}
                for k, a, z in scanner.spans(text or ""):
                    role, surface = patterns[k][0], text[a:z].strip(" ")
                    own = (z - a, priority.get(role, 10), role, surface)
                    best[surface.lower(), a] = min(own, best.get((surface.lower(), a), own))
                lead = min(((p, a, n, role) for (_, a), (n, p, role, _) in best.items()), default=None)
                for (_, a), (_, p, role, surface) in sorted(best.items(), key=lambda x: (x[0][1], x[1])):
                    row.append(i)
                    rows.append((surface, a, role, (p, a, role) == (lead[0], lead[1], lead[3])))
            surface, start, role, first = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(surface, pa.string()), pa.array(start, pa.int32()), pa.array(role, pa.string()), pa.array(first, pa.bool_())],
                                             names=["text_id", "surface", "start", "role", "is_primary"])

    return texts.select("text_id", "text").mapInArrow(run, f"text_id {kind}, surface string, start int, role string, is_primary boolean")


def focus_score(texts: DataFrame, cues: Sequence[tuple[str, float, Sequence[str]]], default: str = "unknown") -> DataFrame:
    """Score each focus by its weighted cue sets; best focus per text, earlier focus on ties.

    cues: (focus, weight, phrases). Each cue set counts once when any of its phrases occurs; accents and case are folded.
    """
    names = list(dict.fromkeys(f for f, _, _ in cues))
    low = fold_text("text")

    def hit(phrases: Sequence[str]) -> Column:
        out = F.lit(False)
        for p in phrases:
            out = out | F.contains(low, fold_text(F.lit(p)))
        return out

    score = {n: sum((F.when(hit(ph), F.lit(float(w))).otherwise(0.0) for f, w, ph in cues if f == n), F.lit(0.0)) for n in names}
    best = F.greatest(*[score[n] for n in names], F.lit(0.0))
    focus = case_when([((score[n] == best) & (best > 0), n) for n in names], default)
    return texts.select("text_id", *[score[n].alias(f"score_{n}") for n in names], focus.alias("focus"))


def split_intents(texts: DataFrame, connectors: Sequence[str]) -> DataFrame:
    """One row per intent of a question, split on connector phrases."""
    rx = r"(?iu)\s+(?:" + "|".join(connectors) + r")\s+|[;?]\s*"
    parts = F.filter(F.transform(F.split("text", rx), lambda x: F.trim(x)), lambda x: x != "")
    return texts.select("text_id", F.posexplode(parts).alias("intent_no", "intent"))
