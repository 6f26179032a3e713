"""Policies over candidate tables: validity, conflicts, routing, bridges, gates, decisions, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.common import case_when, cut_lineage, first_row, has_phrase, is_blank, lookup, tags, text_or_empty, top_k
from lexloom.functions.slots import normalize_family


def temporal_check(candidates: DataFrame, at: str = "at", start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Adds `temporal_reason`: not_yet_effective, expired or ''. Open ends and unreadable dates pass."""
    t0, t1 = F.try_to_timestamp(F.col(start)), F.try_to_timestamp(F.col(end))
    return candidates.withColumn("temporal_reason", case_when([(F.coalesce(F.col(at) < t0, F.lit(False)), "not_yet_effective"),
                                                               (F.coalesce(F.col(at) > t1, F.lit(False)), "expired")], ""))


def temporal_filter(candidates: DataFrame, **kw: str) -> tuple[DataFrame, DataFrame]:
    c = temporal_check(candidates, **kw)
    return c.filter("temporal_reason = ''").drop("temporal_reason"), c.filter("temporal_reason <> ''")


def specificity(c: Column | str | None, body_size: Column) -> Column:
    own = F.lit(None).cast("double") if c is None else (F.col(c) if isinstance(c, str) else c)
    return F.coalesce(own, F.least(F.lit(2.0), 0.15 + 0.03 * body_size))


def prune_conflicts(candidates: DataFrame) -> DataFrame:
    """Adds `status` (unique_in_bucket / winner / conflict_lower_rank) and `winner_rule_id` per (case, head) bucket.

    Reads case_id, rule_id, head_predicate, head_args (array), exception_of, overrides (array), compatibility,
    priority, specificity, score. Bonuses are semi joins on (bucket, rule id); the winner is one aggregate joined
    back, so a bucket of any size is split over tasks.
    """
    key = F.concat_ws("|", "head_predicate", F.size("head_args").cast("string"), F.array_join("head_args", "␟", ""))
    c = candidates.withColumn("bucket", F.sha2(key, 256))
    ids = c.select("case_id", "bucket", F.col("rule_id").alias("other")).distinct()
    exc = c.filter("exception_of IS NOT NULL").select("case_id", "bucket", "rule_id", F.col("exception_of").alias("other"))
    exc = exc.join(ids, ["case_id", "bucket", "other"], "left_semi").select("case_id", "bucket", "rule_id").distinct().withColumn("eb", F.lit(1))
    ovr = c.select("case_id", "bucket", "rule_id", F.explode("overrides").alias("other"))
    ovr = ovr.join(ids, ["case_id", "bucket", "other"], "left_semi").select("case_id", "bucket", "rule_id").distinct().withColumn("ob", F.lit(1))
    on = ["case_id", "bucket", "rule_id"]
    c = c.join(exc, on, "left").join(ovr, on, "left").na.fill(0, ["eb", "ob"])
    order = F.struct((-F.col("eb")).alias("a"), (-F.col("ob")).alias("b"), (-F.col("compatibility")).alias("c"), (-F.col("priority")).alias("d"),
                     (-F.col("specificity")).alias("e"), (-F.col("score")).alias("f"), F.col("rule_id").alias("rule_id"))
    win = c.groupBy("case_id", "bucket").agg(F.min(order)["rule_id"].alias("winner_rule_id"), F.count("*").alias("n_bucket"))
    c = c.join(win, ["case_id", "bucket"])
    status = F.when(F.col("n_bucket") == 1, "unique_in_bucket").when(F.col("rule_id") == F.col("winner_rule_id"), "winner").otherwise("conflict_lower_rank")
    return c.withColumn("status", status).drop("eb", "ob", "n_bucket", "bucket")


# Domain words.
TAX_WORDS = ["thuế", "thue", "vat", "gtgt", "tncn", "khấu trừ", "khai thuế", "cơ quan thuế", "thu nhập chịu thuế", "tax", r"invoice\s*vat"]
LABOR_WORDS = ["lao động", "lao dong", "hợp đồng lao động", "hợp đồng lao dong", "bhxh", "tiền lương", "tien luong", "sa thải", "sa thai", "đình công",
               "nghỉ việc", "nghi viec", "employment", "labor contract", "trade union"]


def route_domains(questions: DataFrame, tax_words: Sequence[str] = TAX_WORDS, labor_words: Sequence[str] = LABOR_WORDS) -> DataFrame:
    """Primary and secondary domain, confidence and reasons per question; a valid user hint wins.

    Reads question_id, text, intent, user_hint, bridges (array of ids).
    """
    low, intent = F.lower(F.trim("text")), F.lower(text_or_empty("intent"))
    count = lambda ws: F.regexp_count(low, F.lit("(?iu)(?:" + "|".join(ws) + ")"))
    has = lambda c, *ws: c.rlike("|".join(ws))
    bridged = lambda w: F.when(F.exists("bridges", lambda b: F.contains(b, F.lit(w))), 1).otherwise(0)
    q = questions.select("question_id", "user_hint", "bridges",
                         (count(tax_words) + F.when(has(intent, "tax", "thuế"), 2).otherwise(0) + bridged("tax")).alias("tax"),
                         (count(labor_words) + F.when(has(intent, "labor", "lao động", "employment"), 2).otherwise(0) + bridged("labor")).alias("labor"))
    t, l = F.col("tax"), F.col("labor")
    hint = F.col("user_hint").isin("enterprise", "tax", "labor")
    both = (t > 0) & (l > 0)
    primary = F.when(hint, F.col("user_hint")).when(both, F.when(t >= l, "tax").otherwise("labor")).when(t > 0, "tax").when(l > 0, "labor").otherwise("enterprise")
    secondary = F.when(~F.coalesce(hint, F.lit(False)) & both, F.when(t >= l, "labor").otherwise("tax"))
    conf = F.when(hint, 1.0).when(both, F.least(F.lit(0.95), 0.55 + 0.1 * F.greatest(t, l))).when(t > 0, F.least(F.lit(0.95), 0.5 + 0.1 * t)).when(
        l > 0, F.least(F.lit(0.95), 0.5 + 0.1 * l)).otherwise(0.35)
    why = F.when(both, F.when(t >= l, "mixed_signals_tax_primary").otherwise("mixed_signals_labor_primary")).when(t > 0, "keyword_tax").when(
        l > 0, "keyword_labor").otherwise("default_enterprise")
    via = F.when(F.size("bridges") > 0, F.concat(F.lit("bridges:"), F.array_join("bridges", ",")))
    reasons = F.when(hint, F.array(F.lit("user_domain_selection"))).otherwise(F.array_compact(F.array(via, why)))
    return q.select("question_id", primary.alias("primary_domain"), secondary.alias("secondary_domain"), F.round(conf, 4).alias("confidence"), reasons.alias("reasons"),
                    (secondary.isNotNull()).alias("allow_expansion"))


class Bridge(NamedTuple):
    """Configured bridge: id, regexes that trigger it."""

    bridge_id: str
    patterns: Sequence[str]


# Built-in bridges.
BUILTIN_BRIDGES = [Bridge("builtin_employee_to_labor", [r"người\s+lao\s+động", "employee", "employer", r"người\s+sử\s+dụng\s+lao\s+động"]),
                   Bridge("builtin_tax_keywords", ["thuế|thue|vat|gtgt|tncn"])]


def match_bridges(texts: DataFrame, bridges: Sequence[Bridge] = BUILTIN_BRIDGES) -> DataFrame:
    """Adds `bridges`: ids whose patterns occur in the text, in table order. Row-local, no join."""
    low = F.lower("text")
    return texts.withColumn("bridges", tags(*[(low.rlike("(?iu)" + "|".join(b.patterns)), b.bridge_id) for b in bridges]))


class BridgeFact(NamedTuple):
    """Configured emission: bridge id, text fragments, fact template with `{entity}`, fallback fact."""

    bridge_id: str
    when_contains: Sequence[str]
    template: str | None
    fallback: str | None


def emit_bridge_facts(cases: DataFrame, entities: DataFrame, rules: Sequence[BridgeFact], declared: Mapping[str, Sequence[str]] | None = None,
                      max_entities: int | None = None) -> DataFrame:
    """(case_id, fact_key, bridge_id) emitted by triggered bridges; the first emitter of a key wins.

    cases(case_id, text, bridges), entities(case_id, entity, pos). An empty bridge list lets every rule try.
    """
    low = F.lower("text")
    any_of = lambda ws: case_when([(F.contains(low, F.lit(w.lower())), True) for w in ws], False)
    free = F.size("bridges") == 0
    row = lambda i, r: F.struct(F.lit(i).alias("no"), F.lit(r.bridge_id).alias("bridge_id"), F.lit(r.template).alias("template"), F.lit(r.fallback).alias("fallback"))
    hit = F.array_compact(F.array(*[F.when((free | F.array_contains("bridges", r.bridge_id)) & any_of(r.when_contains), row(i, r)) for i, r in enumerate(rules)]))
    fired = cases.select("case_id", F.explode(hit).alias("r")).select("case_id", "r.*")
    few = entities.withColumn("n", F.row_number().over(Window.partitionBy("case_id").orderBy("pos")))
    few = few if max_entities is None else few.where(F.col("n") <= max_entities)
    inst = (fired.filter("template LIKE '%{entity}%'").join(few.select("case_id", "entity", "n"), "case_id")
            .select("case_id", F.replace("template", F.lit("{entity}"), F.col("entity")).alias("fact_key"), "bridge_id", "no", "n"))
    inst = first_row(inst, ["case_id", "fact_key"], [F.asc("no"), F.asc("n")])
    fallback = fired.join(inst.select("case_id", "no").distinct(), ["case_id", "no"], "left_anti").filter("fallback IS NOT NULL")
    fallback = fallback.select("case_id", F.col("fallback").alias("fact_key"), "bridge_id", "no", F.lit(0).alias("n"))
    out = inst.unionByName(fallback)
    if declared:
        keys = F.array_compact(F.array(*[F.when(free | F.array_contains("bridges", b), F.struct(F.lit(k).alias("fact_key"), F.lit(b).alias("bridge_id")))
                                         for b, ks in declared.items() for k in ks]))
        meta = cases.select("case_id", F.explode(keys).alias("k")).select("case_id", "k.*", F.lit(len(rules)).alias("no"), F.lit(0).alias("n"))
        out = out.unionByName(meta)
    return first_row(out, ["case_id", "fact_key"], [F.asc("no"), F.asc("n"), F.asc("bridge_id")]).select("case_id", "fact_key", "bridge_id")


def primary_filter(candidates: DataFrame, context: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): shared rows when allowed, else rows of a primary domain or scope.

    candidates(case_id, rule_id, domain, layer, scope, score); context(case_id, primary_domains, include_shared, ...).
    """
    c = candidates.join(context.select("case_id", "primary_domains", "include_shared"), "case_id")
    shared = F.col("include_shared") & ((F.col("layer") == "shared") | (F.col("scope") == "shared") | (F.col("domain") == "shared"))
    ok = shared | F.array_contains("primary_domains", F.col("domain")) | ((F.col("scope") != "") & F.array_contains("primary_domains", F.col("scope")))
    c = c.withColumn("__ok", F.coalesce(ok, F.lit(False))).drop("primary_domains", "include_shared")
    return c.filter("__ok").drop("__ok"), c.filter("NOT __ok").drop("__ok").withColumn("reason", F.lit("domain_not_in_primary_phase"))


def secondary_merge(primary: DataFrame, candidates: DataFrame, context: DataFrame, allow: bool = True, need_bridge: bool = True) -> DataFrame:
    """Primary rows plus secondary-domain rows of cases where policy and a bridge allow them."""
    ctx = context.select("case_id", "secondary_domains", "bridges")
    open_case = F.lit(allow) & ((F.size("bridges") > 0) if need_bridge else F.lit(True))
    extra = (candidates.join(ctx, "case_id").filter(open_case & F.array_contains("secondary_domains", F.col("domain")))
             .join(primary.select("case_id", "rule_id"), ["case_id", "rule_id"], "left_anti").drop("secondary_domains", "bridges"))
    extra = first_row(extra, ["case_id", "rule_id"], [F.desc("score")])
    return primary.withColumn("expanded", F.lit(False)).unionByName(extra.withColumn("expanded", F.lit(True)))


def best_bridge(cases: DataFrame, bridges: DataFrame) -> DataFrame:
    """Applicable bridge of highest priority into each case's target domain (first id on ties)."""
    best = bridges.filter("applicable").groupBy("to_domain").agg(F.min(F.struct(-F.col("priority"), F.col("bridge_id")))["bridge_id"].alias("bridge_id"))
    j = cases.join(best, cases["target_domain"] == best["to_domain"], "left").drop("to_domain")
    return j.withColumn("reason", F.when(F.col("bridge_id").isNull(), F.concat(F.lit("no_applicable_bridge_to_"), "target_domain")).otherwise("bridge_crossing_succeeded"))


def exposed_facts(crossings: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of a case that are visible in the domain it crossed into. facts(case_id, fact_id, to_domains)."""
    f = facts.select("case_id", "fact_id", F.explode("to_domains").alias("target_domain"))
    return crossings.filter("bridge_id IS NOT NULL").select("case_id", "target_domain").join(f, ["case_id", "target_domain"])


def domain_reach(cases: DataFrame, bridges: DataFrame, max_hops: int) -> DataFrame:
    """(case_id, domain, hop): domains reachable through bridges into allowed domains within the hop limit.

    cases(case_id, domain) are the primaries, with `allowed` (array) of secondary domains.
    """
    allowed = cases.select("case_id", F.explode("allowed").alias("domain")).distinct()
    edges = bridges.select("from_domain", "to_domain").distinct()
    seen = cut_lineage(cases.select("case_id", "domain").distinct().withColumn("hop", F.lit(0)))
    edge = seen
    for i in range(1, max_hops + 1):
        nxt = (edge.select("case_id", F.col("domain").alias("from_domain")).join(edges, "from_domain")
               .select("case_id", F.col("to_domain").alias("domain")).distinct().join(allowed, ["case_id", "domain"], "left_semi")
               .join(seen, ["case_id", "domain"], "left_anti").withColumn("hop", F.lit(i)))
        edge = cut_lineage(nxt)
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
    return seen


def jump_decision(rows: DataFrame, max_hops: int = 2, allow_secondary: bool = True, need_bridge: bool = True, allow_shared: bool = True,
                  shared_threshold: int = 2) -> DataFrame:
    """Adds decision and reason. Reads current_domain, target_domain, primary_domains, secondary_domains, hops, n_unmet, n_bridges."""
    c = F.col
    in_primary, in_secondary = F.array_contains("primary_domains", c("target_domain")), F.array_contains("secondary_domains", c("target_domain"))
    sec = in_secondary
    rules = [
        (c("hops") >= max_hops, "blocked", F.concat(F.lit("policy_max_hops_exceeded ("), c("hops").cast("string"), F.lit(f"/{max_hops})"))),
        (c("current_domain") == c("target_domain"), "stay_primary", F.lit("already_in_domain")),
        (in_primary, "stay_primary", F.lit("target_in_primary_domains")),
        (sec & F.lit(not allow_secondary), "blocked", F.lit("policy_primary_to_secondary_disabled")),
        (sec & F.lit(need_bridge) & (c("n_bridges") == 0), "blocked", F.lit("secondary_jump_requires_bridge")),
        (sec, "jump_secondary", F.lit("secondary_domain_with_bridge")),
        (F.lit(allow_shared) & (c("n_unmet") >= shared_threshold), "activate_shared", F.concat(F.lit("unmet_requirements_threshold ("), c("n_unmet").cast("string"), F.lit(f"/{shared_threshold})"))),
    ]
    return rows.withColumn("decision", case_when([(a, b) for a, b, _ in rules], "blocked")).withColumn(
        "reason", case_when([(a, r) for a, _, r in rules], "target_domain_not_accessible"))


def rescore_rules(candidates: DataFrame) -> DataFrame:
    """Adds `rescored` with validity, exception, override and priority bonuses.

    The reference tests a tuple for truth, so an invalid rule still gets its bonus there; here validity is tested.
    """
    c = temporal_check(candidates)
    valid = F.when(F.col("at").isNull(), 0.0).when(F.col("temporal_reason") == "", 0.2).otherwise(-0.5)
    score = (F.col("score") + valid + F.when(F.col("has_exceptions"), 0.1).otherwise(0.0) + F.when(F.col("has_overrides"), 0.1).otherwise(0.0)
             + 0.01 * (F.coalesce("priority", F.lit(50)) - 50))
    return c.withColumn("rescored", score).drop("temporal_reason")


def fuse_decisions(rows: DataFrame, entail_at: float = 0.70, contra_at: float = 0.70, moderate: float = 0.35) -> DataFrame:
    """Fusion of the symbolic check and entailment scores, with per-mode overrides.

    Reads mode, symbolic_ok, entail, neutral, contra (all NULL when no model ran), label, error_codes (array),
    application_status, focus. Adds decision and diagnostic.
    """
    c = F.col
    none = c("label").isNull()
    ok, e, n, x = c("symbolic_ok"), F.coalesce("entail", F.lit(0.0)), F.coalesce("neutral", F.lit(0.0)), F.coalesce("contra", F.lit(0.0))
    base = [(none & ok, "ACCEPT", "nli_skipped"), (none, "REJECT", "nli_skipped"), (x >= contra_at, "REJECT", "nli_contradiction_high"),
            (~ok & (e >= entail_at), "REPAIR", "nli_entailment_despite_symbolic_fail"),
            (~ok & (x >= moderate), "REJECT", "nli_contradiction_moderate_with_symbolic_fail"), (~ok, "REJECT", "symbolic_failed"),
            (e >= entail_at, "ACCEPT", "nli_entailment_aligned"), (x >= moderate, "REJECT", "nli_contradiction_moderate"),
            (n >= F.greatest(e, x, F.lit(0.45)), "REPAIR", "nli_neutral")]
    d0 = case_when([(a, b) for a, b, _ in base], "REPAIR")
    diag0 = case_when([(a, g) for a, _, g in base], "nli_uncertain")
    flag = ~none & ((x >= contra_at) | ((c("label") == "contradiction") & (F.greatest(e, n, x) >= 0.35)))
    parse = c("mode") == "parse_verification"
    gated = c("mode").isin("parse_verification", "backward_verification", "forward_verification")
    codes = lambda *ws: F.arrays_overlap("error_codes", F.array(*[F.lit(w) for w in ws]))
    back = (c("mode") == "backward_verification") & codes("backward_semantic_family_mismatch", "backward_weak_grounding")
    proof = (c("mode") == "forward_verification") & codes("forward_proof_error")
    only_missing = F.size(F.array_except("error_codes", F.array(F.lit("answer_subject_action_mismatch"), F.lit("answer_time_quantity_mismatch")))) == 0
    d, fl = c("decision"), c("__flag")
    # One column per policy step, so that each step is computed once.
    r = rows.select("*", d0.alias("decision"), diag0.alias("diagnostic"), flag.alias("__flag"),
                    (~none & (n >= F.greatest(e, x, F.lit(0.45)))).alias("__calm"))
    r = r.withColumn("decision", F.when(fl & parse & ok & c("focus").isin("deadline", "obligation") & (d == "REJECT"), "REPAIR").otherwise(d))
    r = r.withColumn("decision", F.when(fl & (d != "REJECT"), F.when(parse & ok, "REPAIR").otherwise("REJECT")).otherwise(d))
    r = r.withColumn("decision", F.when(gated & (d == "ACCEPT") & c("__calm"), "REPAIR").otherwise(d))
    r = r.withColumn("decision", F.when(back, "REJECT").when(proof & (c("application_status") != "conditional"), "REJECT")
                     .when(proof & (d == "ACCEPT"), "REPAIR").otherwise(d))
    lift = (c("mode") == "answer_verification") & (d == "REJECT") & c("application_status").isin("conditional", "none") & ~fl & only_missing
    return r.withColumn("decision", F.when(lift, "ACCEPT").otherwise(d)).drop("__flag", "__calm")


def fuse_basic(rows: DataFrame, prefer_symbolic: bool = True, entail_at: float = 0.70, contra_at: float = 0.70) -> DataFrame:
    """The plain fusion table: symbolic failure rejects, then contradiction, entailment, neutral, label."""
    c = F.col
    none = c("label").isNull()
    e, n, x = F.coalesce("entail", F.lit(0.0)), F.coalesce("neutral", F.lit(0.0)), F.coalesce("contra", F.lit(0.0))
    calm = "ACCEPT" if prefer_symbolic else "REPAIR"
    top = F.greatest(e, n, x)
    rules = [(~c("symbolic_ok"), "REJECT", "symbolic_failed"), (none, calm, "nli_skipped"), (x >= contra_at, "REJECT", "nli_contradiction"),
             (e >= entail_at, "ACCEPT", "nli_entailment"), ((n >= F.greatest(e, x)) & (n >= 0.5), calm, "nli_neutral"),
             (c("label") == "contradiction", "REJECT", "nli_contradiction_label"), ((c("label") == "entailment") & (top >= 0.45), "ACCEPT", "nli_entailment_weak"),
             (c("label") == "neutral", calm, "nli_neutral")]
    return rows.withColumn("decision", case_when([(a, b) for a, b, _ in rules], "REPAIR")).withColumn("diagnostic", case_when([(a, g) for a, _, g in rules], "nli_weak"))


def overlap_entailment(pairs: DataFrame, draw: bool = False) -> DataFrame:
    """Adds label and label_score of (premise, hypothesis) by containment and word overlap.

    `draw` adds the reference's hash-based draw for undecided pairs; without it they are neutral.
    """
    norm = lambda c: F.regexp_replace(F.lower(F.trim(text_or_empty(c))), r"\s+", " ")
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[a-z0-9_]{4,}"), 0))
    p = pairs.select("*", norm("premise").alias("__p"), norm("hypothesis").alias("__h"))
    p = p.select("*", words(F.col("__p")).alias("__pw"), words(F.col("__h")).alias("__hw"))
    j = F.size(F.array_intersect("__pw", "__hw")) / F.size("__hw")
    both = (F.size("__pw") > 0) & (F.size("__hw") > 0)
    inside = F.contains(F.col("__p"), F.col("__h")) | F.contains(F.col("__h"), F.col("__p"))
    empty = F.col("__h") == ""
    hashed = F.conv(F.substring(F.sha2(F.concat("__p", F.lit("||"), "__h"), 256), 1, 8), 16, 10).cast("double") / float(0xFFFFFFFF)
    s = hashed if draw else F.lit(0.5)
    rules = [(empty, "neutral", F.lit(0.5)), (inside, "entailment", F.lit(0.92)), (both & (j >= 0.45), "entailment", 0.55 + 0.35 * j),
             (both & (j <= 0.05) & (F.size("__hw") >= 3), "contradiction", F.lit(0.4)), (s > 0.72, "entailment", 0.55 + 0.2 * s), (s < 0.18, "contradiction", F.lit(0.45))]
    return p.select(*pairs.columns, case_when([(a, b) for a, b, _ in rules], "neutral").alias("label"),
                    case_when([(a, v) for a, _, v in rules], F.lit(0.5)).alias("label_score"))


def _check(name: str, cond_fail: Column, code: str, cond_skip: Column | None = None, active: Column | None = None) -> Column:
    skip = F.lit(False) if cond_skip is None else cond_skip
    st = F.when(F.coalesce(skip, F.lit(False)), "skip").when(F.coalesce(cond_fail, F.lit(False)), "fail").otherwise("pass")
    row = F.struct(F.lit(name).alias("check"), st.alias("status"), F.when(st == "fail", F.lit(code)).alias("code"))
    return row if active is None else F.when(F.coalesce(active, F.lit(False)), row)


def _explode_checks(rows: DataFrame, key: str, checks: Sequence[Column]) -> DataFrame:
    return rows.select(key, F.explode(F.array_compact(F.array(*checks))).alias("c")).select(key, "c.*")


def parse_checks(rows: DataFrame, valid_goals: Sequence[str], focus_goal: Mapping[str, str]) -> DataFrame:
    """Named checks of parsed questions (question_id, check, status, code).

    Reads question_id, text, subject, action, modality, focus, goal, goal_args, condition_atoms.
    """
    c = F.col
    blank = is_blank
    known_focus = c("focus") != "unknown"
    known_goal = c("goal") != "unknown"
    want = lookup(c("focus"), focus_goal, F.lit("unknown"))
    off = (want != "unknown") & (c("goal") != want) & ~((c("focus") == "applicability") & c("goal").isin("obligation", "permission"))
    return _explode_checks(rows, "question_id", [
        _check("question_text_length", F.length(F.trim(text_or_empty("text"))) < 4, "parse_slot_error"),
        _check("subject_presence", blank("subject"), "parse_slot_error"),
        _check("action_presence", blank("action") & ~c("focus").isin("unknown", "exception"), "parse_slot_error",
               blank("action") & c("focus").isin("deadline", "exception")),
        _check("modality_presence", F.lit(False), "", blank("modality")),
        _check("goal_predicate_schema", known_goal & ~c("goal").isin(list(valid_goals)), "goal_construction_error"),
        _check("goal_arity", known_goal & (F.size("goal_args") < 1), "goal_construction_error"),
        _check("focus_vs_goal", F.lit(True), "goal_construction_error", active=known_focus & ~known_goal),
        _check("focus_goal_alignment", off, "layer1_layer2_misalignment", active=known_focus & known_goal),
        _check("condition_atoms", F.exists("condition_atoms", lambda a: ~F.contains(a, F.lit("("))), "fact_extraction_error"),
    ])


def rule_checks(rows: DataFrame) -> DataFrame:
    """Named checks of the selected rule. Reads question_id, rule_id, head_matches, logic_form, head_predicate, n_head_args, body_predicates."""
    c = F.col
    there = c("rule_id").isNotNull()
    form = text_or_empty("logic_form")
    has = lambda p: (c("head_predicate") == p) | F.array_contains("body_predicates", p)
    return _explode_checks(rows, "question_id", [
        _check("rule_presence", ~there, "rule_extraction_error"), _check("head_vs_goal", ~c("head_matches"), "rule_schema_error", active=there),
        _check("logic_form_present", form == "", "rule_schema_error", active=there),
        _check("body_exception", F.lit(False), "", active=there & F.array_contains("body_predicates", "exception_applies")),
        _check("threshold_structure", (form == "threshold") & ~has("threshold"), "rule_threshold_error", active=there),
        _check("deadline_structure", ~(F.array_contains("body_predicates", "deadline") | (c("n_head_args") >= 2)), "rule_deadline_error", active=there & (form == "deadline")),
    ])


def plan_checks(rows: DataFrame) -> DataFrame:
    """Named checks of a backward plan. Reads question_id, selected, planned (array), missing, requirement (arrays), goal_family,
    rule_family, compatibility, weak_grounding, unification_failure."""
    c = F.col
    there = c("selected").isNotNull()
    both = (F.size("missing") > 0) & (F.size("requirement") > 0)
    fams = ~c("goal_family").isin("", "unknown") & ~c("rule_family").isin("", "unknown")
    return _explode_checks(rows, "question_id", [
        _check("selected_rule", ~there, "backward_rule_selection_error"),
        _check("plan_membership", (F.size("planned") > 0) & ~F.array_contains("planned", c("selected")), "backward_unification_error", active=there),
        _check("unification", F.lit(True), "backward_unification_error", active=there & ~is_blank("unification_failure")),
        _check("missing_subset", both & (F.size(F.array_except("missing", "requirement")) > 0), "requirement_construction_error", active=there),
        _check("semantic_family_alignment", c("goal_family") != c("rule_family"), "backward_semantic_family_mismatch", active=there & fams),
        _check("retrieval_semantic_compatibility", c("compatibility") < -0.25, "backward_semantic_family_mismatch", active=there),
        _check("shared_generic_weak_grounding", c("weak_grounding"), "backward_weak_grounding", active=there),
    ])


def forward_checks(rows: DataFrame) -> DataFrame:
    """Named checks of a forward result. Reads question_id, goal_achieved, goal_reached, n_steps, reason, conclusion, step_rules (array), selected."""
    c = F.col
    won, reason = c("goal_achieved"), text_or_empty("reason")
    trace = lambda name, kinds, code: _check(name, won, code, active=reason.isin(kinds))
    return _explode_checks(rows, "question_id", [
        _check("flag_consistency", won != c("goal_reached"), "forward_conclusion_error"), _check("proof_steps", c("n_steps") == 0, "forward_proof_error", active=won),
        _check("failure_vs_success", ~reason.isin("none", "") & won, "forward_conclusion_error"),
        trace("constraint_trace", ["constraint_failed", "constraint_missing_input", "constraint_unknown"], "forward_constraint_error"),
        trace("exception_trace", ["exception_triggered"], "forward_exception_error"), trace("negative_trace", ["negative_condition_blocked"], "forward_exception_error"),
        _check("conclusion_nonempty", won & is_blank("conclusion"), "forward_conclusion_error"),
        _check("proof_rule_alignment", (F.size("step_rules") > 0) & ~F.array_contains("step_rules", c("selected")), "forward_proof_error", active=c("selected").isNotNull()),
    ])


def answer_checks(rows: DataFrame) -> DataFrame:
    """Named checks of an answer. Reads question_id, answer, conclusion, n_steps, diagnostics (array), application_status."""
    c = F.col
    relaxed = c("application_status").isin("conditional", "none")
    has = lambda w: F.exists("diagnostics", lambda d: F.contains(d, F.lit(w)))
    concl, ans = F.trim(text_or_empty("conclusion")), text_or_empty("answer")
    return _explode_checks(rows, "question_id", [
        _check("action_vs_goal", F.lit(True), "answer_subject_action_mismatch", relaxed, has("action")),
        _check("modality_vs_expected", F.lit(True), "answer_time_quantity_mismatch", relaxed, has("modality")),
        _check("answer_entails_conclusion", (ans != "") & ~F.contains(ans, concl), "answer_semantic_drift", relaxed, concl != ""),
        _check("answer_vs_proof_depth", F.lit(True), "answer_overclaim", active=(c("n_steps") > 3) & (F.length(ans) < 40)),
    ])


def checks_ok(checks: DataFrame, key: str = "question_id") -> DataFrame:
    """ok when no check failed, with the sorted distinct error codes."""
    return checks.groupBy(key).agg(F.bool_and(F.col("status") != "fail").alias("ok"), F.array_sort(F.collect_set("code")).alias("error_codes"))


def domain_gate(rows: DataFrame, kind: str = "rule", allow_secondary: bool = True, need_bridge: bool = True) -> DataFrame:
    """Adds admitted and reason for rules or facts. Reads domain, layer or origin, primary_domains, secondary_domains, n_bridges,
    include_shared, strict, active_rulebases, rulebase_id (the last three for rules)."""
    c = F.col
    dom = F.trim(text_or_empty("domain"))
    if kind == "fact":
        shared = (c("origin") == "bridge") | (dom == "shared")
        names = ("fact_rejected_shared_disabled", "fact_rejected_secondary_not_allowed", "fact_rejected_secondary_requires_bridge")
        last = F.when(dom == "", "").otherwise("fact_rejected_domain_mismatch")
    else:
        shared = (c("layer") == "shared") | (dom == "shared")
        names = ("unification_rejected_by_domain_shared_disabled", "unification_rejected_by_domain_secondary_disallowed", "unification_rejected_by_domain_no_bridge")
        last = F.when(c("strict"), "unification_rejected_by_domain").otherwise("")
    in2 = F.array_contains("secondary_domains", dom)
    reason = (F.when(shared, F.when(c("include_shared"), "").otherwise(names[0])).when(F.array_contains("primary_domains", dom), "")
              .when(in2 & F.lit(not allow_secondary), names[1]).when(in2 & F.lit(need_bridge) & (c("n_bridges") == 0), names[2]).when(in2, "").otherwise(last))
    if kind == "rule":
        idle = c("strict") & (F.size("active_rulebases") > 0) & ~is_blank("rulebase_id") & ~F.array_contains("active_rulebases", c("rulebase_id"))
        reason = F.when((reason == "") & F.coalesce(idle, F.lit(False)), "rule_rejected_rulebase_not_active").otherwise(reason)
    return rows.withColumn("reason", reason).withColumn("admitted", F.col("reason") == "")


def transition_audit(transitions: DataFrame, context: DataFrame, bridges: DataFrame, max_hops: int) -> DataFrame:
    """(case_id, error): too many hops, target domain not allowed, bridge not registered.

    transitions(case_id, to_domain, bridge_id); context(case_id, domains array of primary and secondary).
    """
    hops = transitions.filter("bridge_id IS NOT NULL").select("case_id", "bridge_id").distinct().groupBy("case_id").agg(F.count("*").alias("n")).filter(F.col("n") > max_hops)
    e1 = hops.select("case_id", F.concat(F.lit("hop_count_exceeded: "), F.col("n").cast("string"), F.lit(f" > {max_hops}")).alias("error"))
    j = transitions.join(context.select("case_id", "domains"), "case_id")
    e2 = j.filter(~F.array_contains("domains", F.col("to_domain"))).select("case_id", F.concat(F.lit("invalid_target_domain: "), "to_domain").alias("error"))
    e3 = (transitions.filter("bridge_id IS NOT NULL").join(bridges.select("bridge_id"), "bridge_id", "left_anti")
          .select("case_id", F.concat(F.lit("unregistered_bridge: "), "bridge_id").alias("error")))
    return e1.unionByName(e2.distinct()).unionByName(e3.distinct())


# Error codes and the stage that repairs them.
REPAIR_STAGE = {
    **{c: "parser" for c in ("parse_slot_error", "goal_construction_error", "fact_extraction_error", "layer1_layer2_misalignment")},
    **{c: "legal_frame_extractor_or_rule_builder" for c in ("rule_extraction_error", "rule_schema_error", "rule_modality_error", "rule_exception_error", "rule_deadline_error", "rule_threshold_error")},
    **{c: "selected_rule_ranking" for c in ("backward_rule_selection_error", "backward_semantic_family_mismatch", "backward_weak_grounding")},
    **{c: "backward_requirement_extraction" for c in ("backward_unification_error", "missing_fact_error", "requirement_construction_error")},
    **{c: "forward_reasoner" for c in ("forward_constraint_error", "forward_exception_error", "forward_conclusion_error")},
    "forward_proof_error": "forward_proof_construction",
    **{c: "answer_generation" for c in ("answer_semantic_drift", "answer_contradiction", "answer_overclaim", "answer_subject_action_mismatch", "answer_time_quantity_mismatch")},
    **{c: "retrieval" for c in ("retrieval_empty_error", "retrieval_low_recall_error", "retrieval_ranking_error")},
}


def repair_target(codes: DataFrame) -> DataFrame:
    """Responsible stage per error code, and how often each code occurs."""
    return codes.groupBy("code").agg(F.count("*").alias("n")).withColumn("stage", lookup(F.col("code"), REPAIR_STAGE, F.lit("unspecified")))
