from pyspark.sql import functions as F

from lexloom.functions import slots, text


def one(spark, value, col, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("x")).first()["x"]


def test_slug_and_tokens(spark):
    assert one(spark, "Đăng ký Doanh nghiệp", text.slug("v")) == "dang_ky_doanh_nghiep"
    assert one(spark, "", text.slug("v")) == "unknown"
    assert one(spark, None, text.slug("v")) == "unknown"
    assert one(spark, "A bc B2 đ x_y", text.tokens("v")) == ["bc", "b2", "x_y"]


def test_clean_text_keeps_lines(spark):
    assert one(spark, "  a  b \r\n\r\n c\t d ", text.clean_text("v")) == "a b\n\nc d"


def test_families(spark):
    want = {"must": "obligation", "eligibility": "applicability", "sanction": "legal_effect", "xyz": "", "": ""}
    for k, v in want.items():
        assert one(spark, k, slots.normalize_family("v")) == v


def test_answers(spark):
    assert one(spark, "co", slots.to_bool("v")) is True
    assert one(spark, "1,5", slots.to_number("v")) == 1.5
    assert one(spark, "abc", slots.to_number("v")) is None
    assert one(spark, "03/02/2024", slots.to_date_text("v")) == "2024-02-03"
    assert one(spark, "31/02/2024", slots.to_date_text("v")) is None
    assert one(spark, "p30d", slots.to_duration("v")) == "p30d"


def test_deadline_forms(spark):
    got = one(spark, "nộp trong thời hạn 30 ngày làm việc kể từ ngày nhận đủ hồ sơ", slots.deadline_slots("v"))
    assert tuple(got) == ("30", "working_day", "from_receipt_of_dossier")
    assert tuple(one(spark, "chậm nhất 3 tháng", slots.deadline_slots("v"))) == ("3", "month", "no_later_than")
    assert tuple(one(spark, "không có hạn", slots.deadline_slots("v"))) == (None, None, None)


def test_modality_order(spark):
    assert one(spark, "phải và không được", slots.modality("v")) == "prohibition"
    assert one(spark, "doanh nghiệp được phải", slots.modality("v")) == "obligation"
    assert one(spark, "đượcx", slots.modality("v")) is None


def test_answer_features(spark):
    got = one(spark, "Theo khoản 2 Điều 5 và Điều 7, khoản 2 Điều 5; cần làm rõ", slots.answer_features("v"))
    assert got["citations"] == ["khoản 2 Điều 5", "Điều 7"] and got["mode"] == "A+B"
