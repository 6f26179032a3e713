"""Slot columns read out of a text column: modality, deadlines, quantities, references, answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.common import as_col, case_when, first_nonblank, has_phrase, head_of, lookup, none_if_blank, tags
from lexloom.functions import patterns as P
from lexloom.functions.text import squeeze


def _group(c: Column, regex: str, i: int) -> Column:
    """Capture group or NULL when there is no (non-empty) match."""
    return F.nullif(F.regexp_extract(c, regex, i), F.lit(""))


def modality(c: Column | str, triggers: Mapping[str, Sequence[str]] = P.MODALITY) -> Column:
    """First modality, in table order, whose trigger occurs."""
    return case_when([(has_phrase(c, ph), name) for name, ph in triggers.items()])


def categories(c: Column | str, triggers: Mapping[str, Sequence[str]] = P.MODALITY,
               cues: Mapping[str, Sequence[str]] = P.CATEGORY_CUES) -> Column:
    """Sorted set of the normative categories present in a text."""
    m = modality(c, triggers)
    duty = F.when(m == "obligation", F.lit("duty")).otherwise(m)
    found = tags(*[(has_phrase(c, ph), name) for name, ph in cues.items()])
    return F.array_sort(F.array_union(F.array_compact(F.array(duty)), found))


# Document code, date and body formats.
_VN_DATE = r"ngày\s+\d{1,2}\s+tháng\s+\d{1,2}\s+năm\s+\d{4}"
_EFFECT = r"có\s+hiệu\s+lực\s+từ\s+"
_CODE_CONSOLIDATED = r"(?iu)(?<![\p{L}\p{N}_])(\d{1,4})\s*/\s*VBHN-?VPQH(?![\p{L}\p{N}_])"
_CODE_DECREE = r"(?iu)(?<![\p{L}\p{N}_])(\d{1,4})\s*/\s*(\d{4})\s*/\s*N[ĐD]-CP(?![\p{L}\p{N}_])"
_BODIES = {"văn phòng quốc hội": "Văn phòng Quốc hội", "chính phủ": "Chính phủ"}


def doc_metadata(c: Column | str, head_chars: int | None = None) -> Column:
    """struct(doc_code, first_date, effective_date, issuing_body).

    Code and body are looked for in the whole text, or in its first `head_chars` characters.
    """
    text = as_col(c)
    head = head_of(text, head_chars)
    code = F.coalesce(
        F.concat(_group(head, _CODE_CONSOLIDATED, 1), F.lit("/VBHN-VPQH")),
        F.concat(_group(head, _CODE_DECREE, 1), F.lit("/"), _group(head, _CODE_DECREE, 2), F.lit("/NĐ-CP")),
    )
    body = case_when([(F.contains(F.lower(head), F.lit(k)), v) for k, v in _BODIES.items()])
    return F.struct(code.alias("doc_code"), _group(text, "(?iu)" + _VN_DATE, 0).alias("first_date"),
                    _group(text, "(?iu)" + _EFFECT + _VN_DATE, 0).alias("effective_date"),
                    body.alias("issuing_body"))


def parse_source_ref(c: Column | str) -> Column:
    """`k=v|k=v` reference -> struct of its fields, blank values as NULL."""
    m = F.str_to_map(as_col(c), F.lit(r"\|"), F.lit("="))
    part = {k: none_if_blank(F.element_at(m, F.lit(k)))
            for k in ("unit", "doc_id", "chapter", "section", "article", "clause", "point", "lines")}
    return F.struct(*[v.alias(k) for k, v in part.items()])


def free_text_ref(c: Column | str) -> Column:
    """Article, clause and point ordinals from free text or from `article=3`-like text."""
    t = as_col(c)
    word = r"([\p{L}\p{N}_]+)"
    return F.struct(
        _group(t, r"(?iu)(?:article|dieu|điều)[= ]?(\d+)", 1).alias("article"),
        _group(t, r"(?iu)(?:clause|khoan|khoản)[= ]?" + word, 1).alias("clause"),
        _group(t, r"(?iu)(?:point|diem|điểm)[= ]?" + word, 1).alias("point"),
    )


# Deadline phrase formats; group 1 value, 2 unit, 3 working-day mark, 4 what follows.
_UNITS = r"(ngày|tháng|năm)"
_WORKING = r"(\s+làm\s+việc)?"
_DEADLINE_FORMS = [
    r"(?iu)(?:trong\s+(?:thời\s+hạn|vòng)|chậm\s+nhất)\s*(\d{1,3})\s*" + _UNITS + _WORKING + "(.{0,140})",
    r"(?iu)(\d{1,3})\s*" + _UNITS + _WORKING + r"\s*kể\s+từ\s+ngày\s+([^.;]{0,90})",
    r"(?iu)(?<![\p{L}\p{N}_])(\d{1,3})\s*" + _UNITS + r"(?![\p{L}\p{N}_])" + _WORKING,
]
_UNIT_NAMES = {"ngày": "day", "tháng": "month", "năm": "year"}


# What a deadline counts from. Each row: groups of words, of every group one has to occur, and the label.
DEADLINE_ANCHORS = [
    ([["nhận"], ["hồ sơ", "ho so"]], "from_receipt_of_dossier"),
    ([["thay đổi", "có thay đổi"]], "from_change_event"),
    ([["chính thức", "lập"]], "from_establishment_date"),
]


def says_all(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """True where the text holds a word of every group."""
    holds = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
    return F.lit(True) if not groups else reduce(lambda x, y: x & y, [holds(g) for g in groups])


def deadline_anchor(text: Column) -> list[tuple[Column, str]]:
    return [(says_all(text, groups), label) for groups, label in DEADLINE_ANCHORS]


def deadline_slots(c: Column | str, triggers: Sequence[str] = P.DEADLINE) -> Column:
    """struct(value, unit, anchor); first of three phrase forms that matches decides."""
    t = squeeze(c)
    hits = [t.rlike(rx) for rx in _DEADLINE_FORMS]
    pick = lambda i: case_when([(h, F.regexp_extract(t, rx, i)) for h, rx in zip(hits, _DEADLINE_FORMS)])
    on = has_phrase(t, triggers)
    word, working = F.lower(pick(2)), pick(3) != ""
    unit = F.when((word == "ngày") & working, F.lit("working_day")).otherwise(lookup(word, _UNIT_NAMES))
    after = F.lower(F.regexp_extract(t, _DEADLINE_FORMS[0], 4))
    phrase = F.lower(F.regexp_extract(t, _DEADLINE_FORMS[1], 4))
    lead = F.lower(F.regexp_extract(t, _DEADLINE_FORMS[0], 0))
    first = case_when(deadline_anchor(after) + [(F.contains(after, F.lit("kể từ ngày")), "from_anchor"),
                                        (F.startswith(lead, F.lit("chậm")), "no_later_than")])
    anchor = case_when([(hits[0], first), (hits[1], case_when(deadline_anchor(phrase), "from_anchor"))])
    return F.struct(F.when(on, pick(1)).alias("value"), F.when(on, unit).alias("unit"),
                    F.when(on, anchor).alias("anchor"))


# Quantity phrase formats.
_RANGE = r"(?iu)(?<![\p{L}\p{N}_])từ\s+(\d+[^ ]*)\s+đến\s+(\d+[^,.; ]*)"
_RATIO = r"(?iu)(?<![\p{L}\p{N}_])(?:\d+(?:,\d+)?\s*%|tỷ\s+lệ\s+[^,.;]{0,80})"
_COUNT = r"(?iu)(?<![\p{L}\p{N}_])(?:không\s+quá|ít\s+nhất|trở\s+lên|từ)\s+\d+[^,.;]{0,60}"


def quantity_slots(c: Column | str) -> Column:
    """struct(count_limit, ratio_limit, range, condition): range wins, then ratio, then count."""
    t = squeeze(c)
    rng, ratio, count = (_group(t, rx, 0) for rx in (_RANGE, _RATIO, _COUNT))
    return F.struct(count.alias("count_limit"), ratio.alias("ratio_limit"), rng.alias("range"),
                    F.coalesce(rng, ratio, count).alias("condition"))


THRESHOLD_FIELDS = ["metric", "op", "value", "unit", "low", "high", "range_kind"]


@dataclass(frozen=True)
class QuantityForm:
    """One way to state a quantity.

    numbers: field -> group of the pattern. names: (groups of words as in `says_all`, metric), the first that holds;
    units: (prefix of the unit group, unit, metric or None). only: words of which one has to occur. after: the form
    fills fields only while this one is open. `fixed` are fields with one value.
    """

    pattern: str
    numbers: dict[str, int]
    fixed: dict[str, str]
    names: tuple[tuple[tuple[tuple[str, ...], ...], str], ...] = ()
    unit_group: int = 0
    units: tuple[tuple[str, str, str | None], ...] = ()
    only: tuple[str, ...] = ()
    after: str | None = None


# The forms in order, and the two kinds of people they count.
PEOPLE = (("thành", "thanh_vien", "so_thanh_vien"), ("", "co_dong", "so_co_dong"))
QUANTITY_FORMS = [
    QuantityForm(r"ít nhất\s+(\d+)\s*%\s*(?:tổng\s+số\s+)?(?:cổ\s+phần\s+phổ\s+thông|cổ\s+phần)", {"value": 1}, {"op": ">=", "unit": "phan_tram"}, (((), "ty_le_so_huu_co_phan_pho_thong"),)),
    QuantityForm(r"ít\s+nhất\s+(\d+)\s*%", {"value": 1}, {"op": ">=", "unit": "phan_tram"}, (((("phiếu",), ("biểu quyết",)), "ty_le_phieu_bieu_quyet"), ((), "ty_le")), after="value"),
    QuantityForm(r"(?:trên|lớn hơn)\s+(\d+)\s*%", {"value": 1}, {"op": ">", "unit": "phan_tram"}, (((("vốn điều lệ", "von dieu le"),), "ty_le_von_dieu_le"), ((), "ty_le")), after="value"),
    QuantityForm(r"(?:dưới|nhỏ hơn|không quá)\s+(\d+)\s*%", {"value": 1}, {"op": "<=", "unit": "phan_tram"}, (((("thành viên",),), "ty_le_thanh_vien_so_huu"), ((), "ty_le")), after="op"),
    QuantityForm(r"không\s+quá\s+(\d+)\s+(thành\s+viên|cổ\s+đông)", {"value": 1}, {"op": "<="}, unit_group=2, units=PEOPLE),
    QuantityForm(r"ít\s+nhất\s+(\d+)\s+(cổ\s+đông|thành\s+viên)", {"value": 1}, {"op": ">="}, unit_group=2, units=PEOPLE),
    QuantityForm(r"từ\s+0*(\d+)\s+đến\s+0*(\d+)\s+(thành\s+viên|cổ\s+đông)", {"low": 1, "high": 2}, {"range_kind": "dong"}, unit_group=3, units=PEOPLE),
    QuantityForm(r"thời\s+hạn\s+(\d+)\s+(ngày|tháng)(?![\p{L}\p{N}_])", {"value": 1}, {"op": "eq", "metric": "thoi_han_thanh_toan"}, unit_group=2, units=(("ngày", "ngay", None), ("", "thang", None)),
                 only=("thanh toán", "góp vốn", "than toan", "gop von"), after="metric"),
    QuantityForm(r"trong\s+thời\s+hạn\s+(\d+)\s+ngày(\s+làm\s+việc)?", {"value": 1}, {"op": "eq"},
                 (((("đăng ký chuyển đổi", "dang ky chuyen doi"),), "thoi_han_dang_ky_chuyen_doi"), ((("nhận hồ sơ", "nhan ho so"),), "thoi_han_xu_ly_ho_so"), ((), "thoi_han_xu_ly")),
                 unit_group=2, units=((" ", "ngay_lam_viec", None), ("", "ngay", None)), after="value"),
    QuantityForm(r"(\d+)\s+ngày\s+làm\s+việc", {"value": 1}, {"op": "eq", "metric": "thoi_han_thuc_hien", "unit": "ngay_lam_viec"}, only=("gửi", "thông báo"), after="value"),
]


def _offers(form: QuantityForm, raw: Column, low: Column) -> dict[str, Column]:
    """What a form would put into each field."""
    group = lambda i: F.regexp_extract(raw, "(?iu)" + form.pattern, i)
    out = {k: F.lit(v) for k, v in form.fixed.items()} | {k: group(i) for k, i in form.numbers.items()}
    if form.names:
        out["metric"] = case_when([(says_all(low, groups), name) for groups, name in form.names])
    if form.units:
        starts = [F.startswith(F.lower(group(form.unit_group)), F.lit(prefix)) for prefix, _, _ in form.units]
        out["unit"] = case_when([(c, unit) for c, (_, unit, _) in zip(starts, form.units)])
        if form.units[0][2]:
            out["metric"] = case_when([(c, metric) for c, (_, _, metric) in zip(starts, form.units)])
    return out


def threshold_fields(c: Column | str, forms: Sequence[QuantityForm] = QUANTITY_FORMS) -> Column:
    """struct of THRESHOLD_FIELDS: every field has the offer of the first form that applies and makes one."""
    raw = squeeze(c)
    low = F.lower(raw)

    def fold(got: dict[str, Column], form: QuantityForm) -> dict[str, Column]:
        applies = raw.rlike("(?iu)" + form.pattern)
        if form.only:
            applies = applies & says_all(low, [form.only])
        if form.after:
            applies = applies & got[form.after].isNull()
        offers = _offers(form, raw, low)
        return {k: F.coalesce(v, F.when(applies, F.nullif(offers[k], F.lit("")))) if k in offers else v for k, v in got.items()}

    got = reduce(fold, forms, {k: F.lit(None).cast("string") for k in THRESHOLD_FIELDS})
    return F.struct(*[got[k].alias(k) for k in THRESHOLD_FIELDS])


def to_bool(c: Column | str) -> Column:
    v = F.lower(F.trim(as_col(c)))
    return F.when(v.isin(P.YES_WORDS), F.lit(True)).when(v.isin(P.NO_WORDS), F.lit(False))


def to_number(c: Column | str) -> Column:
    """Decimal point or comma; anything else is NULL."""
    v = F.replace(F.trim(as_col(c)), F.lit(" "), F.lit(""))
    return F.when(v.rlike(r"^[-+]?\d+([.,]\d+)?$"), F.replace(v, F.lit(","), F.lit(".")).try_cast("double"))


def to_choice(c: Column | str, options: Sequence[str]) -> Column:
    """Option whose lower-cased text equals the answer; last of equal options wins."""
    v = none_if_blank(c)
    table = {o.strip().lower(): o.strip() for o in options if o.strip()}
    return lookup(F.lower(v), table) if table else v


def to_date_text(c: Column | str) -> Column:
    """ISO, day/month/year and year/month/day layouts to an ISO date."""
    v = none_if_blank(c)
    swap = F.regexp_replace(v, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", "$3-$2-$1")
    iso = F.regexp_replace(swap, r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})$", "$1-$2-$3")
    return F.when(iso.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.date_format(F.try_to_date(iso, "y-M-d"), "yyyy-MM-dd"))


def to_duration(c: Column | str) -> Column:
    v = none_if_blank(c)
    return F.when(v.rlike(P.DURATION), v)


def coerce_answer(c: Column | str, kind: Column | str, options: Sequence[str] = ()) -> Column:
    """Answer text by kind (`bool`, `number`, `choice`, `date`, `duration`) as canonical text."""
    k = as_col(kind)
    return case_when([
        (k == "bool", to_bool(c).cast("string")), (k == "number", to_number(c).cast("string")),
        (k == "choice", to_choice(c, options)), (k == "date", to_date_text(c)),
        (k == "duration", to_duration(c)),
    ], none_if_blank(c))


def answer_features(c: Column | str, citation: str = P.CITATION,
                    missing_phrases: Sequence[str] = P.MISSING_FACT_PHRASES) -> Column:
    """struct(citations, asks_for_facts, mode) of a free-text answer."""
    t = F.coalesce(as_col(c), F.lit(""))
    cites = F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(citation), 0), lambda x: F.trim(x)))
    low = F.lower(t)
    asks = F.lit(False)
    for ph in missing_phrases:
        asks = asks | F.contains(low, F.lit(ph))
    mode = case_when([((t != "") & asks, "A+B"), (asks, "B")], "A")
    return F.struct(cites.alias("citations"), asks.alias("asks_for_facts"), mode.alias("mode"))


def normalize_family(c: Column | str) -> Column:
    """Alias of a semantic family -> canonical family, blank when unknown."""
    token = F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(as_col(c), F.lit("")))), "[^a-z0-9]+", "_"), F.lit("_"))
    table = P.FAMILY_ALIASES
    return lookup(token, table, F.lit(""))
