from pyspark.sql import functions as F

from lexloom.operators import evaluate as A
from lexloom.operators import policy as P
from lexloom.operators import rules as L


def test_unify_rejects_weak_overlap(spark):
    rows = [("obligation", ["enterprise_x", "nop_thue", "co_quan_thue"], "must", ["enterprise_x", "nop_ho_so", "co_quan_thue"]),
            ("obligation", ["company_x", "nop_thue", "co_quan_thue"], "obligation", ["cong_ty", "nop_thue", "co_quan_thue"]),
            ("deadline", ["a"], "must", ["a"]), ("must", ["a", "b"], "must", ["a"])]
    p = spark.createDataFrame(rows, "goal_predicate string, goal_args array<string>, head_predicate string, head_args array<string>")
    got = {(r.goal_predicate, tuple(r.goal_args)): (r.failure, r.bindings) for r in L.unify(p).collect()}
    assert got[("obligation", ("enterprise_x", "nop_thue", "co_quan_thue"))][0] == "term_unification_failed"
    assert got[("obligation", ("company_x", "nop_thue", "co_quan_thue"))] == ("", {"company_x": "cong_ty"})
    assert got[("deadline", ("a",))][0] == "predicate_mismatch"
    assert got[("must", ("a", "b"))][0] == "arity_mismatch"


def test_scope_bridge(spark):
    s = "thay_doi_noi_dung_dang_ky_doanh_nghiep"
    h = "thong_bao_" + s
    rows = [(1, "deadline", "gui_thong_bao", s, "notification", h), (2, "deadline", "gui_thong_bao", "khac", "notification", h), (3, "deadline", "gui_thong_bao", None, "notification", h)]
    p = spark.createDataFrame(rows, "id int, goal_predicate string, goal_event string, goal_scope string, goal_subtype string, head_predicate string")
    assert [r.bridge_failure for r in L.goal_head_bridge(p).orderBy("id").collect()] == ["", "event_mismatch", "event_mismatch"]


def facts(spark, rows):
    return spark.createDataFrame(rows, "case_id long, fact_key string, value_bool boolean, value_num double")


def test_unless_unknown_and_missing_input(spark):
    pairs = spark.createDataFrame([(1, "R1"), (1, "R2")], "case_id long, rule_id string")
    atoms = spark.createDataFrame([("R1", "positive", 0, "a(x)"), ("R1", "unless", 0, "b(x)"), ("R2", "positive", 0, "a(x)")], "rule_id string, role string, seq int, key string")
    cons = spark.createDataFrame([("R2", 0, "threshold", "constraint:m", "m", ">=", 30.0, "phan_tram")], "rule_id string, seq int, kind string, session_key string, metric string, op string, target double, unit string")
    f = facts(spark, [(1, "a(x)", True, None)])
    c = L.checks(L.atom_truth(pairs, atoms, f), L.constraint_eval(pairs, cons, f))
    got = {r.rule_id: r.reason for r in L.forward_eval(pairs, c).collect()}
    assert got == {"R1": "unless_condition_unknown", "R2": "constraint_missing_input"}
    assert {r.rule_id: r.reason for r in L.forward_eval(pairs, c, "rule_reading").collect()}["R2"] == "none"


def test_one_row_of_checks_per_candidate_says_what_the_long_table_says(spark):
    pairs = spark.createDataFrame([(c, r) for c in (1, 2, 3) for r in ("R1", "R2", "R3", "R4")], "case_id long, rule_id string")
    atoms = spark.createDataFrame([("R1", "positive", 0, "a(x)"), ("R1", "unless", 0, "b(x)"), ("R2", "exception", 0, "a(x)"), ("R2", "positive", 0, None)], "rule_id string, role string, seq int, key string")
    cons = spark.createDataFrame([("R1", 0, "threshold", "k", "m", ">=", 30.0, "phan_tram"), ("R1", 1, "threshold", None, None, "<", 1.0, None), ("R3", 0, "deadline", "d", None, None, None, None),
                                  ("R3", 1, "threshold", "m(9)", "m", "gt", 9.0, ""), ("R3", 2, "other", "z", "m", None, None, None)],
                                 "rule_id string, seq int, kind string, session_key string, metric string, op string, target double, unit string")
    f = facts(spark, [(1, "a(x)", True, None), (1, "b(x)", None, None), (1, "numeric:m", None, 40.0), (1, "k", True, 2.0), (2, "a(x)", False, None), (2, "o(m,12)", True, None), (2, "ngay", True, None)])
    rows = L.with_checks(pairs, atoms, cons, f)
    long = L.checks(L.atom_truth(pairs, atoms, f), L.constraint_eval(pairs, cons, f))
    got = sorted((r.case_id, r.rule_id, x.role, x.seq, str(x.key), x.status) for r in rows.collect() for x in r.checks)
    assert rows.count() == 12 and got == sorted((r.case_id, r.rule_id, r.role, r.seq, str(r.key), r.status) for r in long.collect())
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(L.forward_eval(rows), L.forward_eval(pairs, long)) and same(L.requirement_set(rows), L.requirement_set(long))
    told = L.forward_eval(rows, keep=["checks"])
    assert same(L.proof_steps(told), L.proof_steps(L.forward_eval(pairs, long), long))


def test_scale_mismatch_is_unknown(spark):
    pairs = spark.createDataFrame([(1, "R")], "case_id long, rule_id string")
    cons = spark.createDataFrame([("R", 0, "threshold", "k", "ty_le", ">=", 30.0, "phan_tram")], "rule_id string, seq int, kind string, session_key string, metric string, op string, target double, unit string")
    assert L.constraint_eval(pairs, cons, facts(spark, [(1, "numeric:ty_le", True, 0.3)])).first()["status"] == "unknown"
    assert L.constraint_eval(pairs, cons, facts(spark, [(1, "metric:ty_le", True, 40.0)])).first()["status"] == "satisfied"
    assert L.constraint_eval(pairs, cons, facts(spark, [(1, "ty_le(12)", True, None)])).first()["status"] == "failed"


def test_closure_chain(spark):
    f = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "case_id long, fact_key string")
    r = spark.createDataFrame([("r1", "c", "a"), ("r1", "c", "b"), ("r2", "d", "c")], "rule_id string, head_key string, atom_key string")
    got = {(x.case_id, x.fact_key): x.round for x in L.derive_closure(f, r).collect()}
    assert got == {(1, "a"): 0, (1, "b"): 0, (2, "a"): 0, (1, "c"): 1, (1, "d"): 2}


def test_closure_counts_rules_of_one_atom_set_once(spark, monkeypatch):
    sizes, cut = [], L.cut_lineage

    def counted(df, *a):
        out = cut(df, *a)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(L, "cut_lineage", counted)
    f = spark.createDataFrame([(c, "a") for c in range(20)], "case_id long, fact_key string")
    r = spark.createDataFrame([(f"r{i}", "c", "a") for i in range(300)] + [("s", "d", "c"), ("s", "e", "c"), ("n", "x", "a"), ("n", "x", None)],
                              "rule_id string, head_key string, atom_key string")
    got = {(x.case_id, x.fact_key): x.round for x in L.derive_closure(f, r).collect()}
    assert got == {(c, k): n for c in range(20) for k, n in (("a", 0), ("c", 1), ("d", 2), ("e", 2))}
    assert max(sizes) <= 60


def test_temporal(spark):
    rows = [(1, "2024-01-01", "2025-01-01", None), (2, "2024-01-01", None, "2023-01-01"), (3, "2024-01-01", None, None), (4, "2024-01-01", "xx", "")]
    d = spark.createDataFrame(rows, "id int, at string, valid_from string, valid_to string").withColumn("at", F.to_timestamp("at"))
    assert [r.temporal_reason for r in P.temporal_check(d).orderBy("id").collect()] == ["not_yet_effective", "expired", "", ""]


def test_fusion(spark):
    rows = [(1, True, "contradiction", 0.0, 0.2, 0.8), (2, True, "entailment", 0.8, 0.1, 0.1), (3, False, "entailment", 0.8, 0.1, 0.1), (4, True, None, None, None, None)]
    d = spark.createDataFrame(rows, "id int, symbolic_ok boolean, label string, entail double, neutral double, contra double").select(
        "*", F.lit("rule_verification").alias("mode"), F.array().cast("array<string>").alias("error_codes"), F.lit("final").alias("application_status"), F.lit("").alias("focus"))
    assert [r.decision for r in P.fuse_decisions(d).orderBy("id").collect()] == ["REJECT", "ACCEPT", "REPAIR", "ACCEPT"]


def test_missing_fact_and_all_na(spark):
    base = dict(citations=[], proof_present=False, v_parse="N/A", v_rule="N/A", v_forward="N/A", v_answer=None, missing_facts=[], gold_missing=["f"])
    d = spark.createDataFrame([{**base, "id": 1, "mode": "A"}, {**base, "id": 2, "mode": "B"}],
                              "id int, mode string, citations array<string>, proof_present boolean, v_parse string, v_rule string, v_forward string, v_answer string, missing_facts array<string>, gold_missing array<string>")
    got = [(r.missing_fact_correct, r.verified) for r in A.score_verifiability(d).orderBy("id").collect()]
    assert got == [(None, 0), (0, 0)]


def test_other_facts_stand_in_for_deadline_and_dossier(spark):
    pairs = spark.createDataFrame([(c, "R") for c in ("a", "b", "c")], "case_id string, rule_id string")
    cons = spark.createDataFrame([("R", 1, "deadline", "d1", None, None, None, None), ("R", 2, "dossier", "s1", None, None, None, None)],
                                 "rule_id string, seq int, kind string, session_key string, metric string, op string, target double, unit string")
    facts = spark.createDataFrame([("a", "ngay_nhan", True, None), ("a", "x_deadline", False, None), ("b", "d1", False, None), ("b", "ngay", None, 3.0), ("b", "dossier_full", None, 2.0), ("c", "dossier", None, 0.0)],
                                  "case_id string, fact_key string, value_bool boolean, value_num double")
    got = {(r.case_id, r.seq): (r.status, r.detail) for r in L.constraint_eval(pairs, cons, facts).collect()}
    assert got == {("a", 1): ("satisfied", "ngay_nhan"), ("a", 2): ("missing_input", "need_dossier_status"), ("b", 1): ("failed", ""), ("b", 2): ("satisfied", "dossier_full"),
                   ("c", 1): ("missing_input", "need_date_or_milestone"), ("c", 2): ("missing_input", "need_dossier_status")}
