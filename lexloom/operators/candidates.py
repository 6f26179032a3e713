"""Normative candidates of a unit: generation, filtering, overlap removal, expansion, slots, rubric."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.common import as_col, case_when, first_nonblank, first_row, has_phrase, is_blank, none_if_blank, phrase_regex, tags, text_or_empty
from lexloom.functions import patterns as P
from lexloom.functions.scan import Scanner, compiled, contained
from lexloom.functions.text import squeeze, stable_hash

# Cue phrases of candidate generation.
EXCEPTION = [r"trừ\s+trường\s+hợp", r"ngoại\s+trừ", r"trừ\s+khi", r"nếu\s+không", r"trừ", r"không\s+áp\s+dụng\s+cho", r"ngoại\s+lệ"]
THRESHOLD = [r"không\s+quá", r"ít\s+nhất", r"trở\s+lên", r"từ\s+\d{1,4}", r"\d{1,3}\s*%", r"tỷ\s+lệ", r"phần\s+trăm", r"từ\s+[^.;]{0,10}\s+đến\s+[^.;]{0,10}"]
EFFECT = [r"được\s+cấp", r"bị\s+thu\s+hồi", r"thu\s+hồi\s+Giấy", r"được\s+công\s+bố", r"có\s+hiệu\s+lực", r"hết\s+hiệu\s+lực", r"bị\s+tạm\s+ng(?:ừ|ư)ng", r"khôi\s+phục", r"chấp\s+thuận", r"bị\s+giải\s+thể"]
PROCEDURE = [r"đăng\s*ký", r"thông\s*báo", r"gửi\s+đến", r"gửi", r"nộp", r"công\s*bố", r"lưu\s+giữ", r"trình\s+tự", r"thủ\s+tục"]
# Each trigger is looked for by itself, so matches may overlap; the four lists below count as one trigger each.
TRIGGERS = [*[[x] for x in (*P.OBLIGATION, *P.PROHIBITION, *P.PERMISSION, *P.DEADLINE, *P.DOCUMENT, *P.AUTHORITY, *P.CONDITION)], EXCEPTION, THRESHOLD, EFFECT, PROCEDURE]
POINT_ITEM = r"(?imu)^\s*[a-zđ]\)\s+"
STOP = r"(?s)(?:[.;]\s|\n{2}).*$"
PRE_CHARS, COMMA_CHARS, NESTED_CHARS = 120, 180, 20


class _Generator:
    """Candidates of one text; see `generate_candidates`."""

    def __init__(self, triggers: Sequence[Sequence[str]], exceptions: Sequence[str], effects: Sequence[str], pre_chars: int, max_chars: int | None, max_matches: int | None, per_unit: int | None):
        self.triggers, self.focused = Scanner(triggers), Scanner([exceptions, effects])
        self.point, self.stop = compiled(POINT_ITEM.removeprefix("(?imu)").replace("^", "(?m:^)")), compiled(STOP.removeprefix("(?s)").removesuffix(".*$"))
        self.blank, self.run, self.gap = regex.compile("[ \t\n\x0b\f\r\xa0]+"), regex.compile(r"[\p{L}\p{N}]*[ \t]*"), regex.compile(r"[ \t]*")
        self.letter = regex.compile(r"[\p{L}\p{N}]")
        self.pre, self.most, self.matches, self.rows = pre_chars, max_chars, max_matches, per_unit

    def squeezed(self, text: str) -> str:
        return self.blank.sub(" ", text).strip(" ")

    def cut(self, text: str, a: int, b: int) -> str:
        """From a to the first sentence end, to b at most."""
        m = self.stop.search(text, a, b)
        return text[a:m.start() if m else b]

    def window(self, t: str, p: int, after: int) -> str:
        a = max(0, p - self.pre)
        if a:
            a = (self.run if self.letter.match(t[a - 1]) else self.gap).match(t, a).end()
        b = after if self.most is None else min(after, a + self.most)
        while a < b and t[a] == " ":
            a += 1
        while a < b and t[b - 1] == " ":  # a mark that only a blank follows here ends nothing
            b -= 1
        return self.squeezed(self.cut(t, a, b)) if a < b else ""

    def slice(self, flat: str, p: int) -> str:
        text = self.cut(flat, p, len(flat) if self.most is None else min(len(flat), p + self.most))
        return self.squeezed(text.split(",", 1)[0] if len(text) > COMMA_CHARS else text)

    def of(self, text: str, flat: str) -> list[tuple[str, str]]:
        t = text.replace("\r\n", "\n").replace("\r", "\n")
        points = [m.start() for m in self.point.finditer(t)]
        if len(points) >= 2:
            return self.first([(t[a:b].strip(" \t\n\x0b\f\r"), "split=points") for a, b in zip(points, [*points[1:], len(t)])])
        at: tuple[list[int], list[int]] = ([], [])
        for k, a, _ in self.focused.spans(flat):
            at[k].append(a)
        exceptions = [(self.slice(flat, p), "split=focused_exception") for p in sorted(at[0])]
        if len(exceptions) >= 2:
            return self.first(exceptions)
        starts = sorted(a for _, a, _ in self.triggers.spans(t))[:self.matches]
        every = [(self.window(t, p, b), "split=trigger_window") for p, b in zip(starts, [*starts[1:], len(t)])] + exceptions
        every += [(self.slice(flat, p), "split=focused_legal_effect") for p in sorted(at[1])]
        one = dict(reversed([x for x in every if x[0]]))  # of equal texts the first
        kept = {c: one[c] for c in dict.fromkeys(c for c, _ in every) if c}
        low = {c: c.lower() for c in kept}
        short: dict[str, list[str]] = {}
        for c, x in low.items():
            short.setdefault(x, []).append(c)
        gone = {c for y, inside in zip(kept, contained(short, low.values())) for x in inside for c in short[x] if len(c) + NESTED_CHARS < len(y)}
        return self.first([(c, how) for c, how in kept.items() if c not in gone])

    def first(self, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
        return [r for r in rows if r[0]][:self.rows]


def generate_candidates(units: DataFrame, triggers: Sequence[Sequence[str]] = TRIGGERS, exceptions: Sequence[str] = EXCEPTION, effects: Sequence[str] = EFFECT,
                        pre_chars: int = PRE_CHARS, max_chars: int | None = None, max_matches: int | None = None, per_unit: int | None = None) -> DataFrame:
    """(unit_id, idx, cand_text, how) candidates of each unit, inside the row: no shuffle, one walk over each text.

    Two or more `a)` items split the unit, each item as it is; else two or more exception phrases give one slice each;
    else there is a window per trigger match, from `pre_chars` before it (at a word's start) to the next match or the
    first sentence end, then a slice per exception and per effect phrase. Equal texts count once, and a text inside
    another that is longer by more than `NESTED_CHARS` goes. The three maxima cut only where they are given.
    """
    kind = units.schema["unit_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _Generator(triggers, exceptions, effects, pre_chars, max_chars, max_matches, per_unit)
        for b in batches:
            row, idx, text, how = [], [], [], []
            for i, (t, flat) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                for n, (c, h) in enumerate(make.of(t, flat)):
                    row.append(i)
                    idx.append(n)
                    text.append(c)
                    how.append(h)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(idx, pa.int32()), pa.array(text, pa.string()), pa.array(how, pa.string())], names=["unit_id", "idx", "cand_text", "how"])

    return units.select("unit_id", text_or_empty("text").alias("t"), squeeze(text_or_empty("text")).alias("flat")).mapInArrow(run, f"unit_id {kind}, idx int, cand_text string, how string")


# A candidate that defines; its head, then phrases. Not the list for whole units.
DEFINITION_HEAD = r"(?iu)^\s*\p{L}[^.;]{0,120}\s+là\s+"
DEFINITION_LIKE = [r"được\s+hiểu\s+là", r"là\s+dãy\s+số", r"là\s+đơn\s+vị\s+phụ\s+thuộc", r"là\s+tình\s+trạng", r"là\s+việc", r"là\s+tổ\s+chức", r"là\s+cá\s+nhân", r"là\s+người",
                   r"là\s+quyền", r"là\s+doanh\s+nghiệp"]


def definition_like(text: Column | str) -> Column:
    return as_col(text).rlike(DEFINITION_HEAD) | has_phrase(text, DEFINITION_LIKE)


def rule_type(text: Column | str) -> Column:
    """Type of a candidate by its cues, in the reference's order."""
    h = lambda ph: has_phrase(text, ph)
    ob, pro, per = h(P.OBLIGATION), h(P.PROHIBITION), h(P.PERMISSION)
    dl, doc, au = h(P.DEADLINE), h(P.DOCUMENT), h(P.AUTHORITY)
    cond = h(P.CONDITION) | h(EXCEPTION)
    subject = h([r"cơ\s+quan", r"ủy\s+ban", r"sở\s+kế\s+hoạch"])
    return case_when([(doc & ~au & ~dl, "document_requirement"), (au & subject, "authority_action"), (au & ~(ob | pro | doc | dl), "other"), (dl, "deadline"),
                      (ob & h([r"đăng\s*ký"]), "registration_obligation"), (ob & h([r"thông\s*báo"]), "notification"), (ob, "duty"), (pro, "prohibition"),
                      (per & definition_like(text), "other"), (per, "permission"), (h(EFFECT), "legal_effect"), (h(THRESHOLD), "threshold"), (cond, "condition"), (h(PROCEDURE), "procedure")], "other")


SUBJECTS = [r"doanh\s+nghiệp", r"công\s+ty", r"cơ\s+quan(?:\s+\p{L}+)?", r"người\s+nộp\s+thuế", r"thành\s+viên", r"cổ\s+đông", r"tổ\s+chức"]  # fixed values
ACTIONS = [r"phải", r"được", r"không\s+được", r"có\s+quyền", r"có\s+trách\s+nhiệm", r"có\s+thể", r"nộp", r"nghiêm\s+cấm"]  # fixed values


def filter_candidates(candidates: DataFrame, min_chars: int = 0, max_chars: int | None = None) -> DataFrame:
    """Candidates with a type, a subject or action, and a confidence."""
    t = squeeze("cand_text")
    c = candidates.withColumn("cand_text", t).filter(F.length("cand_text") >= min_chars)
    c = c if max_chars is None else c.filter(F.length("cand_text") <= max_chars)
    subj = F.nullif(F.regexp_extract("cand_text", "(?iu)(" + "|".join(SUBJECTS) + ")", 1), F.lit(""))
    act = F.nullif(F.regexp_extract("cand_text", "(?iu)((?:" + "|".join(ACTIONS) + r")[^.;,]{0,80})", 1), F.lit(""))
    mod = case_when([(has_phrase("cand_text", ph), n) for n, ph in P.MODALITY.items()])
    c = c.select("*", rule_type("cand_text").alias("candidate_type"), subj.alias("subject_span"), act.alias("action_span"), mod.alias("modality"))
    c = c.filter((F.col("candidate_type") != "other") & (F.col("subject_span").isNotNull() | F.col("action_span").isNotNull()))
    strong = F.coalesce(F.col("modality").isin("obligation", "prohibition"), F.lit(False))
    c = c.filter(~(definition_like("cand_text") & ~strong))
    score = (F.when(strong, 2).otherwise(0) + F.when(F.col("candidate_type").isin("deadline", "document_requirement", "authority_action"), 1).otherwise(0)
             + F.when(F.length("cand_text") <= 170, 1).otherwise(0) - F.when(definition_like("cand_text"), 2).otherwise(0))
    return c.withColumn("confidence", F.when(score >= 3, "high").when(score >= 1, "medium").otherwise("low"))


def quality_score(text: str = "cand_text") -> Column:
    strong = has_phrase(text, [*P.OBLIGATION, *P.PROHIBITION])
    kinds = ["deadline", "document_requirement", "authority_action", "duty", "prohibition", "condition", "procedure"]
    w = lambda cond, v: F.when(F.coalesce(cond, F.lit(False)), F.lit(v)).otherwise(0.0)
    return (w(strong, 2.0) + w(F.col("candidate_type").isin(kinds), 1.2) + w(F.col("candidate_type") == "permission", 0.6) + w(F.col("subject_span").isNotNull(), 0.6)
            + w(F.length("action_span") >= 12, 0.8) - w(definition_like(text), 2.0) - w(F.length(text) > 220, 0.6))


def dedupe_overlaps(candidates: DataFrame, per_unit: int | None = None) -> DataFrame:
    """Per unit, best quality first, drop a candidate that contains or is contained in a kept one; text order again.

    The candidates of one unit are gathered, never those of several. Which text stands in which is found by one walk over
    each, then a single sweep in order of quality decides.
    """
    kind = candidates.schema["unit_id"].dataType.simpleString()
    row = F.struct((-F.col("quality")).alias("o"), F.col("idx").alias("idx"), F.col("cand_text").alias("cand_text"), F.lower(squeeze("cand_text")).alias("low"))
    g = candidates.groupBy("unit_id").agg(F.array_sort(F.collect_list(row)).alias("c"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, own in enumerate(b.column(1).to_pylist()):
                kept = [own[k] for k in _apart([x["low"] for x in own])]
                rows += [(i, x["idx"], x["cand_text"], -x["o"]) for x in sorted(kept, key=lambda x: x["idx"])[:per_unit]]
            unit, idx, text, quality = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(unit, pa.int64())), pa.array(idx, pa.int32()), pa.array(text, pa.string()), pa.array(quality, pa.float64())], names=["unit_id", "idx", "cand_text", "quality"])

    return g.mapInArrow(run, f"unit_id {kind}, idx int, cand_text string, quality double")


def _apart(texts: Sequence[str | None]) -> list[int]:
    """Places of the texts that neither contain nor are contained in one kept before. An empty text stands in all."""
    place: dict[str, int] = {}
    for i, t in enumerate(texts):
        if t is not None:
            place.setdefault(t, i)
    near: dict[str, set[str]] = {t: set() for t in place}
    for t, inside in zip(place, contained(place, place)):
        for x in inside - {t}:
            near[t].add(x)
            near[x].add(t)
    kept: set[str] = set()
    for t in place:
        if (near[t].isdisjoint(kept) if t else not kept) and "" not in kept:
            kept.add(t)
    return [i for i, t in enumerate(texts) if t is None or t in kept and place[t] == i]


# Phrases of the candidate spans, in order.
SPANS = {
    "condition_span": [r"((?:trường\s+hợp|nếu|khi|đối\s+với)(?:(?![.;]).){4,200})"],
    "deadline_span": [r"(trong\s+(?:thời\s+hạn|vòng)\s*\d{1,3}\s*(?:ngày|tháng|năm)(?:\s+làm\s+việc)?[^.;]{0,90})", r"(chậm\s+nhất[^.;]{0,120})", r"(kể\s+từ\s+ngày[^.;]{0,140})"],
    "document_span": [r"(hồ\s+sơ\s+bao\s+gồm[^.;]{0,260}|kèm\s+theo[^.;]{0,260}|thông\s+báo[^.;]{0,60}phải\s+bao\s+gồm[^.;]{0,220})"],
    "exception_span": [r"((?:trừ\s+trường\s+hợp|ngoại\s+trừ)[^.;]{0,200})"],
    "threshold_span": [r"((?:không\s+quá|ít\s+nhất|trên|từ)\s+\d+[^.;,]{0,80})"],
    "effect_span": [r"((?:bị\s+thu\s+hồi|hết\s+hiệu\s+lực|chấm\s+dứt)[^.;]{0,120})"],
    "authority_span": [r"(cơ\s+quan(?:\s+[\p{L}]+){1,4})"],
    "object_span": [r"(?:nộp|chuyển\s+nhượng|sở\s+hữu)\s+([^.;,]{3,80})"],
}


def fill_slots(candidates: DataFrame, spans: Mapping[str, Sequence[str]] = SPANS) -> DataFrame:
    """Fill blank spans from the candidate text; score (number of filled spans) and extract decision."""
    t = squeeze("cand_text")
    old = lambda n: none_if_blank(n) if n in candidates.columns else F.lit(None).cast("string")
    got = {n: F.coalesce(old(n), *[F.nullif(F.trim(F.regexp_extract(t, "(?iu)" + rx, 1)), F.lit("")) for rx in rxs]) for n, rxs in spans.items()}
    c = candidates.drop(*[n for n in spans if n in candidates.columns]).select("*", *[v.alias(n) for n, v in got.items()])
    n = sum((F.when(F.col(x).isNotNull(), 1).otherwise(0) for x in spans), F.lit(0))
    return c.withColumn("slot_score", n).withColumn("decision", F.when(F.col("slot_score") >= 2, "extract").when(F.col("slot_score") == 1, "review").otherwise("skip"))


def expand_candidates(candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """Each candidate plus its derived rows (exception, threshold, effect, document, deadline, condition; the first `limit` if given), once per unit, type and text."""
    want = [("exception_span", "condition", 14, "derived_ngoai_le"), ("threshold_span", "threshold", 10, "derived_nguong"), ("effect_span", "legal_effect", 12, "derived_ket_qua"),
            ("document_span", "document_requirement", 14, "derived_ho_so"), ("deadline_span", "deadline", 12, "derived_thoi_han"), ("condition_span", "condition", 10, "derived_dieu_kien")]
    own = F.struct(F.col("cand_text").alias("cand_text"), F.col("candidate_type").alias("candidate_type"), F.lit("").alias("note"))
    derived = F.array_compact(F.array(*[F.when(F.length(c) >= n, F.struct(F.col(c).alias("cand_text"), F.lit(k).alias("candidate_type"), F.lit(note).alias("note"))) for c, k, n, note in want]))
    e = candidates.select("unit_id", "idx", F.posexplode(F.concat(F.array(own), derived if limit is None else F.slice(derived, 1, limit))).alias("sub", "r")).select("unit_id", "idx", "sub", "r.*")
    return first_row(e, ["unit_id", "candidate_type", "cand_text"], [F.asc("idx"), F.asc("sub")])


def mark_units(units: DataFrame, candidates: DataFrame) -> DataFrame:
    """Left join of the last candidate of each unit: sets topic and rule signal."""
    last = candidates.groupBy("unit_id").agg(F.max(F.struct("seq", "candidate_type", "signal")).alias("l"), F.count("*").alias("n_candidates"))
    j = units.join(last, "unit_id", "left")
    return j.select(*[f"{c}" for c in units.columns], F.col("l.candidate_type").alias("topic"), F.col("l.signal").alias("rule_signal"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def score_candidates(candidates: DataFrame) -> DataFrame:
    """0/1/2 rubric with error type and keep / split / drop. Reads cand_text, marker, subject, action, deadline_span, topic."""
    t = text_or_empty("cand_text")
    cue = has_phrase("cand_text", P.DEADLINE)
    mixed = has_phrase(text_or_empty("subject"), P.DEADLINE)
    modals = F.regexp_count(t, F.lit(phrase_regex([*P.OBLIGATION, *P.PROHIBITION])))
    items = F.regexp_count(t, F.lit(POINT_ITEM))
    long, bad_split = F.length(t) > 650, (modals >= 2) | (items > 2)
    tests = [~is_blank("marker"), ~is_blank("subject") & ~mixed, ~is_blank("action"), ~cue | (~is_blank("deadline_span") & (F.length(text_or_empty("deadline_span")) <= 120)), ~(long | bad_split)]
    n = sum((F.when(F.coalesce(x, F.lit(False)), 1).otherwise(0) for x in tests), F.lit(0))
    only_case = has_phrase("cand_text", [r"trường\s+hợp"]) & is_blank("action")
    err = case_when([(definition_like("cand_text"), "definition"), (long, "too_long"), (bad_split, "bad_split"), (only_case, "case_without_main_clause"), (is_blank("action"), "missing_action"),
                     (is_blank("subject"), "missing_subject"), (mixed, "mixed_subject")], "")
    c = candidates.select("*", n.cast("int").alias("tests_passed"), err.alias("error_type"))
    e, k = F.col("error_type"), F.col("tests_passed")
    hard = e.isin("definition", "too_long", "bad_split")
    score = F.when(hard, 0).when(e != "", F.when(k >= 3, 1).otherwise(0)).otherwise(F.when(k >= 4, 2).when(k == 3, 1).otherwise(0))
    return c.withColumn("rubric", score).withColumn("action_taken", F.when(score == 2, "keep").when(score == 1, "split").otherwise("drop"))


def backfill_gaps(units: DataFrame, candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """Flagged units without a candidate, most markers first. `limit` is the reference's optional cap."""
    flags = [c for c in units.columns if c.startswith("has_")]
    n = sum((F.col(c).cast("int") for c in flags), F.lit(0))
    g = units.withColumn("n_markers", n).filter("n_markers > 0").join(candidates.select("unit_id"), "unit_id", "left_anti").select("unit_id", "n_markers")
    return g if limit is None else g.orderBy(F.desc("n_markers"), "unit_id").limit(limit)


# Candidate type that each marker calls for.
GAP_TYPES = {"has_exception": "condition", "has_threshold": "threshold", "has_deadline": "deadline", "has_document": "document_requirement"}


def backfill_types(units: DataFrame, candidates: DataFrame, kinds: Mapping[str, str] = GAP_TYPES) -> DataFrame:
    """(unit_id, candidate_type) pairs that a marker calls for and no candidate covers."""
    want = units.select("unit_id", F.explode(tags(*[(F.col(c), k) for c, k in kinds.items()])).alias("candidate_type"))
    return want.join(candidates.select("unit_id", "candidate_type"), ["unit_id", "candidate_type"], "left_anti")


def merge_stage(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Append; columns missing on one side are NULL."""
    return existing.unionByName(new, allowMissingColumns=True)
