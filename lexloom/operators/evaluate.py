"""Evaluation and monitoring reports over result, gold, log and stage tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.common import case_when, first_row, head_of, is_blank, none_if_blank, share, tags, text_or_empty, top_k


def _empty() -> Column:
    return F.array().cast("array<string>")


def _lowered(c: str) -> Column:
    return F.array_distinct(F.transform(F.coalesce(c, _empty()), lambda x: F.lower(x)))


def _some(c: str) -> Column:
    return F.size(F.coalesce(c, _empty())) > 0


def _overlap() -> Column:
    gold, pred = _lowered("gold_missing"), _lowered("missing_facts")
    return F.size(F.array_intersect(gold, pred)) / F.size(gold)


def score_irac(joined: DataFrame) -> DataFrame:
    """Adds I, R, A, C, L (0 to 1) and their mean to results joined with gold.

    Reads status, predicted_domains, selected_rule_id, citations, proof_present, v_forward, v_rule, v_parse,
    missing_facts and domain, mode, gold_missing, must_answer, must_cite.
    """
    half = lambda cond: F.when(F.coalesce(cond, F.lit(False)), 0.5).otherwise(0.0)
    quarter = lambda cond: F.when(F.coalesce(cond, F.lit(False)), 0.25).otherwise(0.0)
    status, domain = text_or_empty("status"), text_or_empty("domain")
    near = F.exists(F.coalesce("predicted_domains", _empty()), lambda d: F.contains(d, domain) | F.contains(domain, d))
    cited, proof = _some("citations"), F.coalesce("proof_present", F.lit(False))
    pred, gold = _some("missing_facts"), _some("gold_missing")
    b_mode = half(pred) + F.when(pred & gold, 0.5 * _overlap()).when(pred, 0.25).otherwise(0.0)
    a_mode = (F.when(F.coalesce("must_answer", F.lit(True)) & (status == "success"), 0.75).when(status.isin("success", "partial"), 0.4).otherwise(0.0)
              + quarter(F.col("must_cite") & cited))
    dims = {
        "I": half(~status.isin("error", "")) + half((domain == "") | near), "R": half(~is_blank("selected_rule_id")) + half(cited),
        "A": half(proof) + quarter(~text_or_empty("v_forward").isin("N/A", "")) + quarter(F.col("v_rule") == "PASS"),
        "C": F.when(F.contains(text_or_empty("mode"), F.lit("B")), b_mode).otherwise(a_mode),
        "L": half(cited) + quarter(proof) + quarter(F.col("v_parse") == "PASS"),
    }
    dims = {k: F.least(v, F.lit(1.0)) for k, v in dims.items()}
    # The mean is taken before anything is rounded.
    return joined.select("*", *[F.round(v, 4).alias(k) for k, v in dims.items()], F.round(sum(dims.values(), F.lit(0.0)) / 5, 4).alias("score"))


def score_verifiability(joined: DataFrame) -> DataFrame:
    """Adds grounded, proof, verified and missing_fact_correct (NULL without B in the mode)."""
    proof = F.coalesce("proof_present", F.lit(False))
    checks = [text_or_empty(c) for c in ("v_parse", "v_rule", "v_forward", "v_answer")]
    none_ran = F.lit(True)
    for c in checks:
        none_ran = none_ran & c.isin("N/A", "")
    verified = ~none_ran & (checks[0] != "FAIL") & (checks[3] != "FAIL")
    asks = F.contains(text_or_empty("mode"), F.lit("B"))
    missing = F.when(asks, F.when(~_some("missing_facts"), 0).when(~_some("gold_missing"), 1).otherwise((_overlap() >= 0.5).cast("int")))
    return joined.select("*", (_some("citations") & proof).cast("int").alias("grounded"), proof.cast("int").alias("proof"),
                         verified.cast("int").alias("verified"), missing.alias("missing_fact_correct"))


def gold_join(results: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored pairs, results without gold, error rows)."""
    errors = results.filter("error IS NOT NULL")
    ok = results.filter("error IS NULL")
    return ok.join(gold, "id"), ok.join(gold.select("id"), "id", "left_anti"), errors


def infer_mode(answer: Column | str, missing: Column) -> Column:
    has = ~is_blank(answer)
    return F.when(has & missing, "A+B").when(missing, "B").otherwise("A")


def score_tables(scored: DataFrame) -> DataFrame:
    """Means and null-excluding percentages by domain, by question group and overall, in one pass.

    `level` comes from the grouping id, so a NULL key and a subtotal stay apart.
    """
    d, g = F.col("domain"), F.col("question_group")
    pct = lambda c: F.round(100.0 * F.avg(c), 1)
    agg = [F.count("*").alias("n"), *[F.round(F.avg(c), 4).alias(c) for c in ("I", "R", "A", "C", "L", "score")], pct("grounded").alias("grounded_pct"),
           pct("proof").alias("proof_pct"), pct("verified").alias("verified_pct"), pct("missing_fact_correct").alias("missing_fact_pct"),
           F.count("missing_fact_correct").alias("n_missing_fact"), F.grouping_id().alias("gid")]
    t = scored.groupingSets([[d], [g], []], d, g).agg(*agg)
    return t.withColumn("level", F.when(F.col("gid") == 1, "domain").when(F.col("gid") == 2, "question_group").otherwise("overall")).drop("gid")


def quality_summary(logs: DataFrame) -> DataFrame:
    """(metric, n, rate) counters of answer quality, one pass.

    Reads status, error_stage, has_proof and reports (array of decision, nli_status).
    """
    status, stage = F.lower(F.trim(text_or_empty("status"))), F.lower(F.trim(text_or_empty("error_stage")))
    fallback = (stage == "partial_answer_generated_after_forward_failure") | (F.contains(stage, F.lit("forward")) & F.contains(stage, F.lit("fail")))
    partial = (status == "partial") | fallback | ((status == "answered") & F.contains(stage, F.lit("partial")))
    dirty = F.exists("reports", lambda r: F.upper(F.trim(F.coalesce(r["decision"], F.lit("")))).isin("REPAIR", "REJECT")
                     | F.lower(F.coalesce(r["nli_status"], F.lit(""))).rlike("degraded|mock|skipped"))
    clean = (F.size("reports") > 0) & ~dirty
    answered = status == "answered"
    flags = {"answered": answered, "partial": partial, "forward_failure_fallback": fallback, "unification_broken": F.contains(stage, F.lit("unification_broken")),
             "verified_final": answered & ~partial & clean, "proof_with_unverified_verification": F.col("has_proof") & ~clean}
    one = logs.agg(F.count("*").alias("rows_total"), *[F.count_if(v).alias(k) for k, v in flags.items()])
    one = one.withColumn("answered_clean", F.greatest(F.col("answered") - F.col("partial"), F.lit(0)))
    names = ["rows_total", *flags, "answered_clean"]
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("bigint").alias("n")) for n in names])
    total = F.greatest(F.col("rows_total"), F.lit(1))
    return one.select("rows_total", F.explode(rows).alias("r")).select("r.metric", "r.n", F.round(F.col("r.n") / total, 6).alias("rate"))


def cross_domain_summary(logs: DataFrame) -> DataFrame:
    """One row: coverage of domains, bridges and proofs, jump sums and success rate.

    Reads activated, bridges, proof_domains (arrays), attempted, success, blocked, grounding.
    """
    has = lambda c: F.count_if(F.size(F.coalesce(c, _empty())) > 0)
    shared = F.exists(F.coalesce("activated", _empty()), lambda d: F.lower(F.trim(d)) == "shared")
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("bigint")
    s = logs.agg(F.count("*").alias("rows_total"), has("activated").alias("with_domains"), has("bridges").alias("with_bridges"), F.count_if(shared).alias("with_shared"),
                 has("proof_domains").alias("with_proof_domains"), F.count_if(~is_blank("grounding")).alias("with_grounding"),
                 total("attempted").alias("attempted"), total("success").alias("success"), total("blocked").alias("blocked"))
    return s.withColumn("success_rate", share(F.col("success"), F.col("attempted"), 6))


def cross_domain_frequencies(logs: DataFrame) -> DataFrame:
    """(kind, key, n) of domains, proof domains, bridges, domain pairs and pair + bridge, from one scan.

    `transitions` is an array of (from_domain, to_domain, bridge_id).
    """
    def part(kind: str, arr: Column) -> Column:
        return F.transform(F.filter(F.transform(arr, lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))

    arr = lambda c: F.coalesce(c, _empty())
    ok = F.filter("transitions", lambda t: (F.trim(F.coalesce(t["from_domain"], F.lit(""))) != "") & (F.trim(F.coalesce(t["to_domain"], F.lit(""))) != ""))
    pair = lambda t: F.concat(F.trim(t["from_domain"]), F.lit("->"), F.trim(t["to_domain"]))
    with_bridge = F.filter(ok, lambda t: F.trim(F.coalesce(t["bridge_id"], F.lit(""))) != "")
    rows = F.concat(part("domain", arr("activated")), part("proof_domain", arr("proof_domains")), part("bridge", arr("bridges")), part("pair", F.transform(ok, pair)),
                    part("pair_bridge", F.transform(with_bridge, lambda t: F.concat(pair(t), F.lit("::"), F.trim(t["bridge_id"])))))
    return logs.select(F.explode(rows).alias("r")).groupBy("r.kind", "r.key").agg(F.count("*").alias("n"))


def field_accuracy(cases: DataFrame) -> DataFrame:
    """(field, n_checked, n_pass, rate): pass rate per field where it was checked. `checks` is a map field -> boolean."""
    e = cases.select(F.explode("checks").alias("field", "ok")).filter("ok IS NOT NULL")
    return e.groupBy("field").agg(F.count("*").alias("n_checked"), F.count_if("ok").alias("n_pass")).withColumn("rate", F.round(F.col("n_pass") / F.col("n_checked"), 4))


def label_counts(cases: DataFrame) -> DataFrame:
    """(kind, key, n) of gap labels and tags, and how many cases fell back."""
    none = F.array().cast("array<struct<kind:string,key:string>>")
    s = lambda k, c: F.struct(F.lit(k).alias("kind"), c.alias("key"))
    rows = F.concat(F.when(F.col("gap_label") != "", F.array(s("gap_label", F.col("gap_label")))).otherwise(none), F.transform("tags", lambda x: s("tag", x)),
                    F.when(F.col("fallback"), F.array(s("fallback", F.lit("")))).otherwise(none))
    return cases.select(F.explode(rows).alias("r")).groupBy("r.kind", "r.key").agg(F.count("*").alias("n"))


def gap_label(rows: DataFrame) -> DataFrame:
    """Adds `gap_label`. Reads snapshot, wanted, allow_stated (expected) and predicate, stated_used, confidence, ambiguity."""
    c = F.col
    want, pred = text_or_empty("wanted"), text_or_empty("predicate")
    allow = F.coalesce("allow_stated", F.lit(False))
    conf = c("confidence")
    rules = [(~is_blank("snapshot") & (pred == F.trim("snapshot")), ""), (allow & c("stated_used"), ""),
             ((want != "") & (pred != "") & (pred != "stated_condition") & (pred != want), "wrong_predicate"),
             ((want != "") & (pred == "stated_condition"), "missing_trigger"), (c("stated_used") & (conf >= 0.55), "too_generic"), (c("stated_used"), "missing_trigger"),
             (text_or_empty("ambiguity").isin("close_lexicon_alternatives", "score_tie") | ((conf < 0.72) & (conf > 0.4)), "ambiguous_condition")]
    return rows.withColumn("gap_label", case_when([(F.coalesce(a, F.lit(False)), b) for a, b in rules], ""))


def calibrated_scores(rows: DataFrame, caps: Mapping[str, float] | None = None) -> DataFrame:
    """Per question type: counts, rates and per-case calibrated means; crashed cases are left out of every mean.

    The reference caps two of its means; `caps` (off by default) adds that.
    """
    c = F.col
    yes = lambda x: F.coalesce(c(x), F.lit(False))
    num = lambda x: F.when(yes(x), 1.0).otherwise(0.0)
    fd, status = F.upper(text_or_empty("final_decision")), text_or_empty("application_status")
    rule, grounded, proof = ~is_blank("selected_rule_id"), yes("grounded_answer"), yes("proof_present")
    fallback = status == "justified_fallback"
    mult = F.when((fd == "ACCEPT") & proof, 1.0).when((fd == "REPAIR") & yes("verification_success"), 0.8).when(fallback, 0.68).when((fd == "REJECT") & rule & grounded, 0.6).otherwise(0.3)
    analysis = F.when(c("question_type") == "fact_application", num("has_application")).otherwise(num("has_rule_text"))
    irac = (0.10 * num("useful") + 0.35 * num("has_rule_text") + 0.40 * analysis + 0.15 * num("grounded_answer")) * mult
    g = F.when(grounded & (fd != "REJECT"), 1.0).when(fallback & rule, 0.9).when((fd == "REJECT") & rule & grounded, 0.75).otherwise(0.0)
    p = F.when(~proof, 0.0).when(fd == "ACCEPT", 1.0).when(fd != "REJECT", 0.9).when(fallback, 0.85).when(rule, 0.75).otherwise(0.0)
    v = (F.when(fd == "ACCEPT", 1.0).when(fallback & rule & grounded & (fd != "REJECT"), 0.9).when((fd == "REPAIR") & grounded, 0.85)
         .when((fd == "REJECT") & fallback & rule & grounded, 0.75).otherwise(0.0))
    live = ~yes("backend_error")
    mean = lambda x: F.round(F.coalesce(F.avg(F.when(live, x)), F.lit(0.0)), 4)
    rate = lambda x: F.round(100.0 * F.avg(F.when(live, num(x))), 1)
    out = rows.groupBy("question_type").agg(
        F.count("*").alias("total"), F.count_if(live).alias("scored"), F.count_if(~live).alias("crashed"), rate("useful").alias("useful_pct"), rate("has_rule_text").alias("rule_pct"),
        mean(irac).alias("irac"), mean(g).alias("grounded"), mean(p).alias("proof"), mean(v).alias("verification"))
    if caps:
        cap = case_when([(c("question_type") == k, F.lit(x)) for k, x in caps.items()], F.lit(1.0))
        out = out.withColumn("irac", F.least("irac", cap))
    return out


def crash_causes(rows: DataFrame, chars: int | None = None) -> DataFrame:
    """(cause, n) of crashed cases; causes are told apart by their whole text, or by its first `chars` characters."""
    d = text_or_empty("error_detail")
    cause = (F.when(F.contains(d, F.lit("maximum recursion depth")), "maximum recursion depth exceeded").when(F.contains(d, F.lit("conclusion_line")), "conclusion_line unbound variable")
             .when(d == "", "unknown").otherwise(head_of(d, chars)))
    return rows.filter("backend_error").groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


def run_summary(cases: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """(run, metric, n) counts of each flag per run."""
    one = cases.groupBy("run").agg(*[F.count_if(v).alias(k) for k, v in flags.items()])
    return one.unpivot(["run"], list(flags), "metric", "n")


def run_delta(summary: DataFrame, runs: Sequence[str]) -> DataFrame:
    """Metrics side by side per run, with the difference of the last and first."""
    p = summary.groupBy("metric").pivot("run", list(runs)).agg(F.first("n"))
    p = p.na.fill(0, list(runs))
    return p.withColumn("delta", F.col(runs[-1]) - F.col(runs[0]))


def reject_causes(cases: DataFrame) -> DataFrame:
    """Last parse verification of each trace where it is REJECT, with scores and joined reasons.

    `trace` is an array of (stage, decision, score, reasons).
    """
    last = F.element_at(F.filter("trace", lambda t: t["stage"] == "parse_verification"), -1)
    hit = F.size(F.filter("trace", lambda t: t["stage"] == "parse_verification")) > 0
    c = cases.filter(hit).select("case_id", last.alias("t")).filter("t.decision = 'REJECT'")
    return c.select("case_id", F.col("t.score").alias("score"), F.array_join("t.reasons", "; ").alias("reasons"))


def diagnosis_table(cases: DataFrame, k: int = 5) -> DataFrame:
    """(diagnosis, n, example ids): effective focus from the top level, else from the last trace that has one.

    Reads case_id, focus, action, has_rule, has_proof, has_answer, degraded and trace (array of focus, action).
    """
    last = lambda f: F.try_element_at(F.filter(F.transform("trace", lambda t: t[f]), lambda x: x.isNotNull()), F.lit(-1))
    c = cases.select("case_id", F.coalesce("focus", last("focus")).alias("focus"), F.coalesce("action", last("action")).alias("action"), "has_rule", "has_proof", "has_answer", "degraded")
    flags = tags((is_blank("focus"), "no_focus"), (is_blank("action"), "empty_action"), (~F.col("has_rule"), "no_selected_rule"), (F.col("has_rule") & ~F.col("has_proof"), "rule_without_proof"),
                 (~F.col("has_answer"), "no_answer"), (F.col("degraded"), "degraded_answer"))
    e = c.select("case_id", F.explode(flags).alias("diagnosis"))
    few = top_k(e, ["diagnosis"], [F.asc("case_id")], k).groupBy("diagnosis").agg(F.array_join(F.array_sort(F.collect_list("case_id")), ",").alias("examples"))
    return e.groupBy("diagnosis").agg(F.count("*").alias("n")).join(few, "diagnosis")


def stage_funnel(units: DataFrame, candidates: DataFrame, frames: DataFrame, rules: DataFrame) -> DataFrame:
    """Per article key: rows at each stage and where the content was lost, from four aggregates joined outer.

    units(article_key, flagged); the others (article_key, id).
    """
    u = units.groupBy("article_key").agg(F.count("*").alias("units"), F.count_if("flagged").alias("flagged"))
    n = lambda d, name: d.groupBy("article_key").agg(F.count_distinct("id").alias(name))
    j = u.join(n(candidates, "candidates"), "article_key", "full_outer").join(n(frames, "frames"), "article_key", "full_outer").join(n(rules, "rules"), "article_key", "full_outer")
    j = j.na.fill(0, ["units", "flagged", "candidates", "frames", "rules"])
    c = F.col
    thin = ((c("flagged") >= 4) & (c("rules") <= F.greatest(F.lit(1), F.floor(c("flagged") / 4)))) | ((c("frames") >= 3) & (c("rules") == 1) & (c("candidates") >= 2))
    status = case_when([((c("units") == 0) | ((c("flagged") == 0) & (c("candidates") == 0)), "no_content"), (c("candidates") == 0, "lost_at_candidate"),
                        (c("frames") == 0, "lost_at_frame"), (c("rules") == 0, "lost_at_rule"), (thin, "thin")], "complete")
    return j.withColumn("status", status).withColumn("suspicious", (c("flagged") >= 3) & (c("rules") <= 2))


def rules_per_frame(rules: DataFrame) -> DataFrame:
    """(n_rules, n_frames): how many frames gave how many rules."""
    return rules.groupBy("frame_id").agg(F.count("*").alias("n_rules")).groupBy("n_rules").agg(F.count("*").alias("n_frames"))


def corpus_stats(units: DataFrame, by: str | None = None) -> DataFrame:
    """Distinct documents, chapters, articles, clauses and points (keys with a NULL part are not counted)."""
    levels = {"chapters": ["doc_id", "chapter"], "articles": ["doc_id", "article"], "clauses": ["doc_id", "article", "clause"], "points": ["doc_id", "article", "clause", "point"]}

    def distinct(cols: Sequence[str]) -> Column:
        full = F.lit(True)
        for c in cols:
            full = full & F.col(c).isNotNull()
        return F.count_distinct(F.when(full, F.struct(*cols)))

    g = units.groupBy(by) if by else units.groupBy()
    return g.agg(F.count_distinct("doc_id").alias("documents"), *[distinct(c).alias(n) for n, c in levels.items()], F.count("*").alias("units"))


def stratified_sample(failures: DataFrame, n: int, stratum: str = "domain", order: str = "case_id") -> DataFrame:
    """Round robin over the strata in name order, n rows in all."""
    r = top_k(failures, [stratum], [F.asc(order)], n, rank="turn")
    return r.orderBy("turn", stratum).limit(n)


def trace_presence(cases: DataFrame, canonical: DataFrame, runtime: DataFrame) -> DataFrame:
    """Per case: retrieved ids present in the canonical and the runtime rules, and runtime rules of the goal predicate.

    cases(case_id, goal, retrieved array); canonical(rule_id); runtime(rule_id, head_predicate).
    """
    e = cases.select("case_id", F.explode_outer("retrieved").alias("rule_id"))
    a = canonical.select("rule_id").distinct().withColumn("in_c", F.lit(1))
    b = runtime.select("rule_id").distinct().withColumn("in_r", F.lit(1))
    n = e.join(a, "rule_id", "left").join(b, "rule_id", "left").groupBy("case_id").agg(
        F.count("rule_id").alias("n_retrieved"), F.count("in_c").alias("in_canonical"), F.count("in_r").alias("in_runtime"))
    heads = runtime.groupBy(F.col("head_predicate").alias("goal")).agg(F.count("*").alias("n_goal_rules"))
    g = cases.select("case_id", "goal").join(heads, "goal", "left").select("case_id", F.coalesce("n_goal_rules", F.lit(0)).alias("n_goal_rules"))
    return n.join(g, "case_id")


def pending_cases(cases: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return cases.join(done.select(key), key, "left_anti")


def clarification_gain(before: DataFrame, after: DataFrame) -> DataFrame:
    """Newly satisfied keys, change in missing keys and steps, and gained answer or proof.

    Both sides: case_id, missing (array), n_steps, status, has_answer, has_proof.
    """
    b = before.select("case_id", *[F.col(c).alias("b_" + c) for c in ("missing", "n_steps", "status", "has_answer", "has_proof")])
    j = after.join(b, "case_id")
    return j.select("case_id", F.array_sort(F.array_except("b_missing", "missing")).alias("newly_satisfied"), (F.col("n_steps") - F.col("b_n_steps")).alias("step_delta"),
                    (F.col("status") != F.col("b_status")).alias("status_changed"), (F.col("has_answer") & ~F.col("b_has_answer")).alias("gained_answer"),
                    (F.col("has_proof") & ~F.col("b_has_proof")).alias("gained_proof"))


def answer_stats(answers: DataFrame) -> DataFrame:
    """Per domain: score mean and range, citation and hallucination rates, mode shares, answer lengths."""
    pct = lambda cond: F.round(100.0 * F.count_if(cond) / F.count("*"), 1)
    n = F.length(text_or_empty("answer"))
    return answers.groupBy("domain").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("score_avg"), F.min("score").alias("score_min"), F.max("score").alias("score_max"), pct(F.col("has_citation")).alias("citation_pct"),
        pct(F.col("hallucination")).alias("hallucination_pct"), *[pct(F.col("mode") == m).alias(f"mode_{a}_pct") for m, a in (("A", "a"), ("B", "b"), ("A+B", "ab"))],
        F.round(F.avg(n), 2).alias("len_avg"), F.min(n).alias("len_min"), F.max(n).alias("len_max"))


def integrity_report(units: DataFrame) -> DataFrame:
    """(kind, n_keys, n_max, n_extra): duplicate clause and point keys, clauses without a parent row, articles in several documents."""
    def dup(kind: str, cols: Sequence[str], where: Column) -> DataFrame:
        g = units.filter(where).groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1")
        return g.agg(F.lit(kind).alias("kind"), F.count("*").alias("n_keys"), F.coalesce(F.max("n"), F.lit(0)).alias("n_max"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_extra"))

    c = F.col
    clause, point = c("clause").isNotNull(), c("point").isNotNull()
    key = F.struct("doc_id", "article", "clause")
    own = units.filter(clause & ~point).select("doc_id", "article", "clause").distinct()
    orphan = units.filter(clause & point).select("doc_id", "article", "clause").distinct().join(own, ["doc_id", "article", "clause"], "left_anti")
    orphan = orphan.agg(F.lit("orphan_point_clause").alias("kind"), F.count("*").alias("n_keys"), F.lit(0).cast("bigint").alias("n_max"), F.lit(0).cast("bigint").alias("n_extra"))
    multi = units.select("article", "doc_id").distinct().groupBy("article").agg(F.count("*").alias("n")).filter("n > 1")
    multi = multi.agg(F.lit("article_in_many_documents").alias("kind"), F.count("*").alias("n_keys"), F.coalesce(F.max("n"), F.lit(0)).alias("n_max"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_extra"))
    return (dup("duplicate_clause", ["doc_id", "article", "clause"], clause & ~point).unionByName(dup("duplicate_point", ["doc_id", "article", "clause", "point"], clause & point))
            .unionByName(orphan).unionByName(multi))


def slot_fill_rates(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(slot, filled, blank) of each column, one pass."""
    one = rows.agg(*[F.count_if(~is_blank(F.col(c).cast("string"))).alias(c) for c in columns], F.count("*").alias("__n"))
    pairs = F.array(*[F.struct(F.lit(c).alias("slot"), F.col(c).alias("filled")) for c in columns])
    return one.select("__n", F.explode(pairs).alias("p")).select("p.slot", "p.filled", (F.col("__n") - F.col("p.filled")).alias("blank"))


def value_counts(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(slot, value, n) of each column, one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("slot"), F.coalesce(none_if_blank(F.col(c).cast("string")), F.lit("(blank)")).alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.slot", "p.value").agg(F.count("*").alias("n"))


def trace_rollup(spans: DataFrame) -> DataFrame:
    """Per run: spans, total and longest duration, failed spans and the first failing step in time."""
    bad = F.col("status") == "failed"
    return spans.groupBy("run_id").agg(F.count("*").alias("n_spans"), F.round(F.sum("duration_ms"), 2).alias("total_ms"), F.max("duration_ms").alias("max_ms"), F.count_if(bad).alias("n_failed"),
                                       F.min(F.when(bad, F.struct("seq", "step")))["step"].alias("first_failed_step"))


def run_records(responses: DataFrame) -> DataFrame:
    """Flatten a nested response to one batch row.

    Reads case_id, status, answer(text), rules (array of ids), goal(predicate), missing (array), reports (array of stage, decision), failure(code).
    """
    return responses.select("case_id", "status", F.col("answer.text").alias("answer_text"), F.array_join("rules", ",").alias("rule_ids"), F.col("goal.predicate").alias("goal_predicate"),
                            F.array_join("missing", ",").alias("missing_facts"), F.array_join(F.transform("reports", lambda r: F.concat(r["stage"], F.lit("="), r["decision"])), ";").alias("decisions"),
                            F.col("failure.code").alias("failure_code"))


def audit_summary(results: DataFrame, k: int = 10) -> DataFrame:
    """(kind, key, n): status and quality counts in full; the k most frequent warning codes, reasons and error stages."""
    s = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    many = lambda kind, c: F.transform(F.coalesce(c, _empty()), lambda x: s(kind, x))
    rows = F.concat(F.array(s("status", F.col("status")), s("quality", F.col("quality"))), many("warning", "warnings"), many("reason", "reasons"),
                    F.filter(F.array(s("error_stage", F.col("error_stage"))), lambda x: F.coalesce(x["key"], F.lit("")) != ""))
    n = results.select(F.explode(rows).alias("r")).groupBy("r.kind", "r.key").agg(F.count("*").alias("n"))
    listed = n.filter(F.col("kind").isin("status", "quality"))
    return listed.unionByName(top_k(n.filter(~F.col("kind").isin("status", "quality")), ["kind"], [F.desc("n"), F.asc("key")], k))


def stage_drop(checkpoints: DataFrame) -> DataFrame:
    """Per run: stages reached, the last stage with an answer, and the first later stage where it was gone.

    checkpoints(run_id, seq, stage, has_answer). Two small aggregates instead of an ordered window per run.
    """
    c = F.col
    at = F.struct("seq", "stage")
    g = checkpoints.groupBy("run_id").agg(F.count("*").alias("n_stages"), F.max(F.when(c("has_answer"), at)).alias("last_ok"), F.min(F.when(c("has_answer"), at)).alias("first_ok"))
    j = checkpoints.join(g.select("run_id", c("first_ok.seq").alias("first_seq")), "run_id").filter(~c("has_answer") & (c("seq") > c("first_seq")))
    lost = j.groupBy("run_id").agg(F.min(at).alias("lost"))
    return g.join(lost, "run_id", "left").select("run_id", "n_stages", c("last_ok.stage").alias("last_answer_stage"), c("lost.stage").alias("lost_at"))
