"""Documents -> structural units, and the marker columns of a unit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.common import as_col, case_when, has_phrase, none_if_blank, tags, text_or_empty
from lexloom.functions import patterns as P
from lexloom.functions.text import squeeze

LEVELS = ["chapter", "section", "article", "clause", "point"]


def segment_units(documents: DataFrame, headings: Mapping[str, str] = P.HEADINGS, min_chars: int = 20) -> DataFrame:
    """Units (doc_id, unit_no, chapter, section, article, heading, clause, point, text, first_line, last_line).

    Runs inside each row: no explode of lines and no shuffle. Heading candidates are found by regex; a fold over them
    keeps the open levels (a heading resets the lower ones; a clause needs an open article, a point an open clause), and
    every kept heading owns the lines up to the next kept one. Text before the first article of a section is dropped, as
    are units shorter than `min_chars`.
    """
    s = lambda: F.lit(None).cast("string")
    kind = lambda l: case_when([(l.rlike(headings[k]), k) for k in LEVELS])
    pick = lambda l, i: case_when([(l.rlike(headings[k]), F.regexp_extract(l, headings[k], i)) for k in LEVELS])
    d = documents.select("doc_id", F.transform(F.split("text", "\n"), lambda l: F.trim(l, F.lit(" \t\r"))).alias("lines"))
    marks = F.filter(F.transform("lines", lambda l, i: F.struct(i.alias("at"), kind(l).alias("kind"), l.alias("line"))), lambda m: m["kind"].isNotNull())
    marks = F.transform(marks, lambda m: F.struct(m["at"].alias("at"), m["kind"].alias("kind"), pick(m["line"], 1).alias("key"), F.trim(pick(m["line"], 2)).alias("rest")))
    d = d.withColumn("marks", marks)
    row_t = "struct<at:int,kind:string,chapter:string,section:string,article:string,heading:string,clause:string,point:string,rest:string>"
    start = F.struct(*[s().alias(n) for n in ("chapter", "section", "article", "heading", "clause", "point")], F.array().cast(f"array<{row_t}>").alias("out"))

    def step(a: Column, m: Column) -> Column:
        k = m["kind"]
        keep = k.isin("chapter", "section", "article") | ((k == "clause") & a["article"].isNotNull()) | ((k == "point") & a["clause"].isNotNull())
        top = k.isin("chapter", "section")
        level = {
            "chapter": F.when(k == "chapter", m["key"]).otherwise(a["chapter"]), "section": F.when(k == "chapter", s()).when(k == "section", m["key"]).otherwise(a["section"]),
            "article": F.when(top, s()).when(k == "article", m["key"]).otherwise(a["article"]), "heading": F.when(top, s()).when(k == "article", m["rest"]).otherwise(a["heading"]),
            "clause": F.when(top | (k == "article"), s()).when(k == "clause", m["key"]).otherwise(a["clause"]),
            "point": F.when(k == "point", F.lower(m["key"])).otherwise(s()),
        }
        row = F.struct(m["at"].alias("at"), k.alias("kind"), *[v.alias(n) for n, v in level.items()], F.when(k.isin("clause", "point"), m["rest"]).otherwise("").alias("rest"))
        grown = F.struct(*[v.alias(n) for n, v in level.items()], F.concat(a["out"], F.array(row)).alias("out"))
        return F.when(keep, grown).otherwise(a)

    d = d.withColumn("kept", F.aggregate("marks", start, step, lambda a: a["out"]))
    nxt = lambda i: F.coalesce(F.try_element_at(F.col("kept"), i + 2)["at"], F.size("lines"))

    def unit(h: Column, i: Column) -> Column:
        body = F.filter(F.slice("lines", h["at"] + 2, nxt(i) - h["at"] - 1), lambda l: l != "")
        text = F.array_join(F.concat(F.filter(F.array(h["rest"]), lambda r: r != ""), body), "\n")
        return F.struct(i.alias("unit_no"), *[h[n].alias(n) for n in ("chapter", "section", "article", "heading", "clause", "point")], F.trim(text).alias("text"),
                        (h["at"] + 1).alias("first_line"), nxt(i).alias("last_line"))

    units = F.filter(F.transform("kept", unit), lambda u: u["article"].isNotNull() & (F.length(u["text"]) >= min_chars))
    return d.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.*")


def unit_ids(units: DataFrame) -> DataFrame:
    """Adds unit_id, heading_text, parent_context and source_ref. Reads doc_id, doc_code, levels, first_line, last_line."""
    code = F.trim(F.regexp_replace(F.lower(text_or_empty("doc_code")), "[^0-9a-z]+", "_"), F.lit("_"))
    token = F.when(code == "", F.lit("DOC")).otherwise(F.substring(F.upper(code), 1, 20))
    part = lambda p, c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(F.lit(p), F.col(c)))
    uid = F.concat_ws("_", F.concat(F.lit("UNIT_"), token), part("D", "article"), part("K", "clause"), F.upper("point"), F.concat(F.lit("S"), F.col("unit_no").cast("string")), F.lit("SS0"))
    head = F.when(F.col("article").isNull(), F.trim(text_or_empty("heading"))).otherwise(F.concat_ws(". ", F.concat(F.lit("Điều "), "article"), none_if_blank("heading")))
    ctx = F.concat_ws(" | ", part("Chương ", "chapter"), part("Mục ", "section"), part("Điều ", "article"))
    e = text_or_empty
    ref = F.concat(F.lit("unit="), uid, F.lit("|doc_id="), F.col("doc_id").cast("string"), F.lit("|chapter="), e("chapter"), F.lit("|section="), e("section"), F.lit("|article="), e("article"),
                   F.lit("|clause="), e("clause"), F.lit("|point="), e("point"), F.lit("|lines="), F.col("first_line").cast("string"), F.lit("-"), F.col("last_line").cast("string"))
    return units.select("*", uid.alias("unit_id"), head.alias("heading_text"), ctx.alias("parent_context"), ref.alias("source_ref"))


# Cue phrases of the unit markers.
MARKER_CUES = {
    "has_condition": [r"nếu", r"khi", r"trường\s+hợp", r"đối\s+với"], "has_deadline": [r"trong\s+thời\s+hạn", r"trong\s+vòng", r"kể\s+từ\s+ngày", r"chậm\s+nhất"],
    "has_exception": [r"trừ\s+trường\s+hợp", r"ngoại\s+trừ", r"nếu\s+không"], "has_authority": [r"cơ\s+quan", r"ủy\s+ban", r"sở\s+kế\s+hoạch"],
    "has_document": [r"hồ\s+sơ", r"giấy\s+tờ", r"tài\s+liệu", r"kèm\s+theo"], "has_threshold": [r"không\s+quá", r"ít\s+nhất", r"trở\s+lên", r"\d+\s*%?(?=\s*(?:tổng|thành|cổ|vốn))"],
    "has_cross_reference": [r"theo\s+quy\s+định\s+tại", r"điều\s+\d+", r"khoản\s+\d+"],
}
# A unit that defines; its head, then phrases.
DEFINITION_HEAD = r"(?iu)^\s*[^.;:\n]{1,120}\s+là\s+"
DEFINITION_LIKE = [r"được\s+hiểu\s+là", r"giải\s+thích\s+từ\s+ngữ", r"(?:bao\s+gồm|gồm\s+các)(?=\s)", r"là\s+(?:một\s+)?(?:tổ\s+chức|doanh\s+nghiệp|việc)"]


def definition_like(text: Column | str) -> Column:
    return as_col(text).rlike(DEFINITION_HEAD) | has_phrase(text, DEFINITION_LIKE)


def _is_glossary(heading: str) -> Column:
    return F.contains(F.lower(text_or_empty(heading)), F.lit(P.GLOSSARY_HEADING))


def unit_markers(units: DataFrame, cues: Mapping[str, Sequence[str]] = MARKER_CUES) -> DataFrame:
    """Boolean marker columns. Definitions and glossary units without a deontic word keep only their references."""
    t = squeeze("text")
    deontic = has_phrase(t, [P.RULE_MARKERS[m] for m in P.DEONTIC_MARKERS])
    quiet = (definition_like(t) | _is_glossary("heading")) & ~deontic
    return units.select("*", *[(has_phrase(t, ph) & (F.lit(n == "has_cross_reference") | ~quiet)).alias(n) for n, ph in cues.items()])


def unit_rule_signal(units: DataFrame, markers: Mapping[str, str] = P.RULE_MARKERS) -> DataFrame:
    """Adds is_candidate, signal (first three markers) and note (definition_like / weak_signal_only)."""
    t = squeeze("text")
    u = units.withColumn("__m", tags(*[(has_phrase(t, [rx]), n) for n, rx in markers.items()]))
    some = F.size("__m") > 0
    arr = lambda ws: F.array(*[F.lit(w) for w in ws])
    deontic = F.arrays_overlap("__m", arr(P.DEONTIC_MARKERS))
    weak_only = F.size(F.array_except("__m", arr(P.WEAK_MARKERS))) == 0
    defn = some & ~deontic & (_is_glossary("heading") | definition_like(t))
    weak = some & ~defn & weak_only & ~deontic & ~has_phrase(t, P.PROCEDURAL_CONTEXT)
    ok = some & ~defn & ~weak
    return u.select(*units.columns, ok.alias("is_candidate"), F.when(ok, F.array_join(F.slice("__m", 1, 3), ";")).alias("signal"),
                    F.when(defn, "definition_like").when(weak, "weak_signal_only").otherwise("").alias("note"))


def clean_unit_hints(units: DataFrame, verbs: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(units, per-step counts): fill an empty deontic signal, expand action hints, recover or clear object fragments.

    Reads text, deontic_signal, action_hint, object_hint.
    """
    t = F.lower(squeeze("text"))
    found = F.regexp_extract(t, r"(?iu)(" + "|".join(x for m in ("prohibition", "obligation", "permission") for x in P.MODALITY[m]) + ")", 1)
    fill = (F.trim(text_or_empty("deontic_signal")) == "") & (found != "")
    verb = "|".join(verbs)
    act = F.regexp_extract(t, rf"(?iu)((?:{verb})\s+[\p{{L}}]+(?:\s+[\p{{L}}]+){{0,3}})", 1)
    longer = (act != "") & (F.length(act) > F.length(text_or_empty("action_hint")))
    frag = (F.length(F.trim(text_or_empty("object_hint"))) < 3) & F.col("object_hint").isNotNull()
    obj = F.regexp_extract(t, rf"(?iu)(?:{verb})\s+([\p{{L}}]+(?:\s+[\p{{L}}]+){{0,2}})", 1)
    u = units.select("*", fill.alias("__f"), longer.alias("__l"), frag.alias("__g"), (obj != "").alias("__o"), found.alias("__fv"), act.alias("__av"), obj.alias("__ov"))
    counts = u.agg(F.count_if("__f").alias("filled_signal"), F.count_if("__l").alias("expanded_action"), F.count_if(F.col("__g") & F.col("__o")).alias("recovered_object"),
                   F.count_if(F.col("__g") & ~F.col("__o")).alias("cleared_object"))
    out = (u.withColumn("deontic_signal", F.when(F.col("__f"), F.col("__fv")).otherwise(F.col("deontic_signal"))).withColumn("action_hint", F.when(F.col("__l"), F.col("__av")).otherwise(F.col("action_hint")))
           .withColumn("object_hint", F.when(F.col("__g"), F.nullif("__ov", F.lit(""))).otherwise(F.col("object_hint"))))
    return out.drop("__f", "__l", "__g", "__o", "__fv", "__av", "__ov"), counts
