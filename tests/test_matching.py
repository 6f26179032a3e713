import itertools
import math
import re

from lexloom.operators import canonical as C
from lexloom.operators import retrieval as R


def test_contained_tokens_is_exact(spark):
    items = [(1, "taxes paid duty-free"), (2, "a paid"), (3, "")]
    needles = ["tax", "pai", "a", "free", "uty-f", "zz", "paid"]
    i = spark.createDataFrame(items, "item_id int, text string")
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    got = {(r.item_id, r.needle) for r in R.contained_tokens(n, i).collect()}
    want = {(k, x) for (k, t), x in itertools.product(items, needles) if any(x in w for w in t.split())}
    assert got == want


def test_bm25_against_brute_force(spark):
    docs = {1: "aa bb bb cc", 2: "bb dd", 3: "zz", 4: "aa aa aa bb cc dd ee"}
    q = "aa bb bb"
    tok = {k: re.findall(r"[a-z0-9_]{2,}", v) for k, v in docs.items()}
    n, avg = len(docs), sum(map(len, tok.values())) / len(docs)
    want = {}
    for k, t in tok.items():
        s = 0.0
        for term in re.findall(r"[a-z0-9_]{2,}", q):
            f, df = t.count(term), sum(term in x for x in tok.values())
            if f:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / avg))
        if s:
            want[k] = round(s, 9)
    got = R.bm25_scores(spark.createDataFrame([(1, q)], "query_id int, text string"), spark.createDataFrame(list(docs.items()), "item_id int, text string"))
    assert {r.item_id: round(r.score, 9) for r in got.collect()} == want


def test_zero_scores_normalise_to_zero(spark):
    d = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.0)], "query_id int, item_id int, score double")
    assert [r.norm for r in R.normalize_scores(d).collect()] == [0.0, 0.0]


def test_mentions(spark):
    d = spark.createDataFrame([(1, "Hỏi: công ty A và người lao động B?")], "text_id int, text string")
    rows = {(r.role, r.start, r.is_primary) for r in R.entity_mentions(d).collect()}
    t = "Hỏi: công ty A và người lao động B?"
    assert ("company", t.index("công ty"), False) in rows and ("employee", t.index("người lao động"), True) in rows


def test_core_category(spark):
    rows = [("procedure_step", "x", "r", "s"), ("deadline", "", "r", "s"), ("obligation", "obligation", "r", "s"), ("deadline", "d", "", "s"), ("deadline", "d", "r", "s")]
    d = spark.createDataFrame(rows, "logic_form string, head_predicate string, source_ref string, surface_text string")
    assert sorted(r.category for r in C.core_category(d).collect()) == ["excluded_from_core", "exportable_clean"] + ["traceability_only"] * 3


def test_merge_registry_partitions(spark):
    a = spark.createDataFrame([("r1", "a1"), ("r2", "a2")], "rule_id string, row_id string")
    b = spark.createDataFrame([("r1", "b1"), ("r3", "b3")], "rule_id string, row_id string")
    kept, rest = C.merge_registry([("shared", a), ("domain", b)], ["row_id"])
    assert {r.row_id for r in kept.collect()} == {"a1", "a2", "b3"} and {r.row_id for r in rest.collect()} == {"b1"}


def test_evidence_by_source_reference_or_one_of_several_rules(spark):
    q = spark.createDataFrame([("q", "zz", "", "R2", "", "", "Nghị định 168/2025 điều bảy"), ("p", "zz", "", None, "", "", "short")],
                              "query_id string, text string, conclusion string, rule_id string, article string, clause string, source_ref string")
    c = spark.createDataFrame([(1, "theo Nghị định 168/2025 điều bảy quy định", ["R9"], "a", "b"), (2, "khác hẳn", ["R1", "R2"], "a", "b"), (3, "không liên quan", ["R1"], "a", "b"), (4, "cũng không", None, "a", "b")],
                              "item_id int, text string, rule_ids array<string>, article string, clause string")
    got = {(r.query_id, r.item_id): (r.source_ref_substring, r.rule_id_match) for r in R.evidence_topk(q, c).collect()}
    assert got == {("q", 1): (3.5, 0.0), ("q", 2): (0.0, 6.0)}


def test_registration_and_attractor_terms(spark):
    base = dict(q_goal="deadline", q_focus="deadline", q_args=["X"], q_text="dang ky", q_action="", q_object="", q_event="", q_conditions=[], q_subject="", q_time="", q_exception="", q_domain_text="", r_head="deadline",
                r_form="deadline", r_args=["Y"], r_event="", r_conditions=[], r_action="", r_domain="enterprise", r_shared=False, q_context=[], r_context=[], q_subject_type="company", q_registration_deadline=True, r_generic=False, compatibility=1.0)
    rows = [dict(base, k=1, r_blob="đăng ký doanh nghiệp company"), dict(base, k=2, r_blob="cưỡng chế thuế"), dict(base, k=3, r_blob="xyz", q_registration_deadline=False, r_head="unknown", r_form="threshold", r_generic=True, r_domain="labor", compatibility=-1.0)]
    schema = ", ".join(f"{c} {'array<string>' if isinstance(v, list) else 'boolean' if isinstance(v, bool) else 'double' if isinstance(v, float) else 'int' if c == 'k' else 'string'}" for c, v in rows[0].items())
    got = {
        r.k: r for r in R.structured_score(spark.createDataFrame([tuple(r[c] for c in rows[0]) for r in rows], schema)).collect()}
    assert (got[1].registration_boost, got[1].subject_type_guess, got[1].tax_attractor_penalty) == (7.0, 0.8, 0.0)
    assert (got[2].registration_boost, got[2].tax_attractor_penalty, got[2].family_mismatch_penalty) == (3.0, -22.0, -10.0)
    assert got[3].registration_boost == 0.0 and abs(got[3].attractor_penalty + 1.8 + 0.8 + 0.7 + 1.3 + 0.8) < 1e-9 and got[1].attractor_penalty == 0.0
