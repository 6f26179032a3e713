from lexloom.operators import candidates as K
from lexloom.operators import segment as S

LAW = """Lời nói đầu dài hơn hai mươi ký tự
Chương I. Chung
Điều 1. Phạm vi
Luật này quy định về doanh nghiệp.
1. Doanh nghiệp phải nộp hồ sơ đúng hạn.
a) Hồ sơ gồm giấy đề nghị và điều lệ.
tiếp theo của điểm a nằm ở đây
2. Công ty không được chuyển nhượng.
Mục 2
Dòng này bị bỏ vì chưa có điều nào mở
Điều 2. Hiệu lực
a) Dòng này là nội dung, không phải điểm.
"""


def test_segment(spark):
    d = spark.createDataFrame([(1, LAW)], "doc_id long, text string")
    rows = [(r.chapter, r.section, r.article, r.clause, r.point, r.text, r.first_line, r.last_line) for r in S.segment_units(d).orderBy("first_line").collect()]
    assert rows == [
        ("I", None, "1", None, None, "Luật này quy định về doanh nghiệp.", 3, 4),
        ("I", None, "1", "1", None, "Doanh nghiệp phải nộp hồ sơ đúng hạn.", 5, 5),
        ("I", None, "1", "1", "a", "Hồ sơ gồm giấy đề nghị và điều lệ.\ntiếp theo của điểm a nằm ở đây", 6, 7),
        ("I", None, "1", "2", None, "Công ty không được chuyển nhượng.", 8, 8),
        ("I", "2", "2", None, None, "a) Dòng này là nội dung, không phải điểm.", 11, 13),
    ]


def test_segment_empty(spark):
    d = spark.createDataFrame([(1, "không có điều nào"), (2, "")], "doc_id long, text string")
    assert S.segment_units(d).count() == 0


def _generated(spark, **texts):
    u = spark.createDataFrame(list(texts.items()), "unit_id string, text string")
    got = {}
    for r in K.generate_candidates(u).orderBy("unit_id", "idx").collect():
        got.setdefault(r.unit_id, []).append((r.cand_text, r.how))
    return got


def test_candidates_by_points_and_windows(spark):
    got = _generated(spark, p="Hồ sơ:\na) giấy đề nghị đăng ký\nb) điều lệ công ty", w="Doanh nghiệp phải nộp thuế. Công ty không được trốn thuế.", n="không gì cả",
                     e="Thuế được miễn, trừ trường hợp thứ nhất; phạt tiền ngoại trừ khi có lý do. Hết.")
    assert [c for c, _ in got["p"]] == ["a) giấy đề nghị đăng ký", "b) điều lệ công ty"]
    assert {h for _, h in got["w"]} == {"split=trigger_window"} and any(c.endswith("phải nộp thuế") for c, _ in got["w"])
    assert "n" not in got
    assert got["e"] == [("trừ trường hợp thứ nhất", "split=focused_exception"), ("ngoại trừ khi có lý do", "split=focused_exception")]


def test_candidates_lose_nothing(spark):
    start = "giấy tờ " * 40
    got = _generated(spark, items="\n".join(f"{c}) {start}{c}" for c in "abcde"), many=" ".join(f"Người số {i} phải nộp khoản {i}." for i in range(40)), long="Doanh nghiệp phải " + "làm việc " * 200 + "xong.",
                     overlap="Cơ quan có trách nhiệm xem xét hồ sơ này")
    assert len(got["items"]) == 5 and len({c for c, _ in got["items"]}) == 5
    # A window ends at its first sentence end, so it may show the sentence of an earlier trigger; none is cut off by number.
    assert len(got["many"]) >= 36
    assert any(len(c) > 1700 for c, _ in got["long"])
    assert any(c.endswith("xem xét hồ sơ này") for c, _ in got["overlap"])


def test_overlaps_keep_best(spark):
    c = spark.createDataFrame([("u", 0, "phải nộp", 1.0), ("u", 1, "doanh nghiệp phải nộp thuế", 3.0), ("u", 2, "khác hẳn", 0.5)], "unit_id string, idx int, cand_text string, quality double")
    assert [(r.idx, r.quality) for r in K.dedupe_overlaps(c).orderBy("idx").collect()] == [(1, 3.0), (2, 0.5)]
