"""Queries for the text and slot columns."""

from pyspark.sql import functions as F

from lexloom.functions import slots, text
from lexloom.plans.registry import query


@query("clean_text", """
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
         html, '\\r\\n?', chr(10), 'g'), '[\\t\\r\\f\\v \\x{00a0}]+', ' ', 'g'), ' {2,}', ' ', 'g'),
         ' ?\\n ?', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g') AS cleaned
FROM pages""".replace("\\\\", "\\"))
def clean_text(t):
    return t.pages.select("page_id", text.clean_text("html").alias("cleaned"))


@query("fold_text", """
SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[\\s\\x{00a0}]+', ' ', 'g')) AS folded FROM documents""")
def fold_text(t):
    return t.documents.select("doc_id", text.fold_text("text").alias("folded"))


@query("slug", """
SELECT p_partkey, coalesce(nullif(trim(regexp_replace(strip_accents(lower(p_name || ' / ' || p_brand)), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS slug
FROM part""")
def slug(t):
    return t.part.select("p_partkey", text.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


@query("mojibake_flags", """
WITH c AS (SELECT page_id, html AS s, len(regexp_extract_all(html, '\\?'))::INT AS q, len(regexp_extract_all(html, '[A-Za-z]')) AS a FROM pages),
r AS (SELECT page_id, q,
  list_filter([CASE WHEN regexp_matches(s, 'Ã|Â|Ä|Å|áº|á»|ðŸ|�') THEN 'mojibake_marker_sequence_detected' END,
   CASE WHEN regexp_matches(s, '[A-Za-z]\\?[A-Za-z]') THEN 'replacement_question_mark_in_word' END,
   CASE WHEN q >= 3 AND a > 0 AND q / a > 0.05 THEN 'suspicious_question_mark_density' END], lambda x: x IS NOT NULL) AS reasons FROM c)
SELECT page_id, len(reasons) > 0 AS is_mojibake, array_to_string(reasons, ';') AS reasons, q AS question_mark_count FROM r""")
def mojibake_flags(t):
    f = t.pages.select("page_id", text.mojibake_flags("html").alias("m"))
    return f.select("page_id", "m.is_mojibake", F.array_join("m.reasons", ";").alias("reasons"), "m.question_mark_count")


@query("stable_hash", "SELECT doc_id, substr(sha256(text), 1, 12) AS h FROM documents")
def stable_hash(t):
    return t.documents.select("doc_id", text.stable_hash("text", 12).alias("h"))


@query("tokens", """
SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]{2,}'), ' ') AS toks,
       len(regexp_extract_all(lower(text), '[a-z0-9_]{2,}'))::INT AS n FROM documents""")
def tokens(t):
    tk = text.tokens("text")
    return t.documents.select("doc_id", F.array_join(tk, " ").alias("toks"), F.size(tk).alias("n"))


@query("token_overlap", """
WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(strip_accents(lower(replace(text, '_', ' '))), '[\\s\\x{00a0}]+', ' ', 'g')), ' +'), lambda x: x <> '')) AS ws FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.ws) = 0 OR len(b.ws) = 0 THEN 0.0
   ELSE len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) END, 6) AS overlap
FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def token_overlap(t):
    c = t.conversations
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return c.join(nxt, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(text.token_overlap("text", "reply"), 6).alias("overlap"))


_B, _E = r"(^|[^\p{L}\p{N}_])(?:", r")($|[^\p{L}\p{N}_])"


def _rx(*phrases):
    return "'(?i)" + _B + "|".join(phrases) + _E + "'"


@query("modality", f"""
SELECT unit_id, CASE WHEN regexp_matches(text, {_rx('không được', 'nghiêm cấm')}) THEN 'prohibition'
  WHEN regexp_matches(text, {_rx('phải', 'có nghĩa vụ', 'chịu trách nhiệm', 'có trách nhiệm')}) THEN 'obligation'
  WHEN regexp_matches(text, {_rx('được', 'có quyền', 'có thể')}) THEN 'permission' END AS modality FROM clauses""", uses=["clauses"])
def modality(t):
    return t.clauses.select("unit_id", slots.modality("text").alias("modality"))


# Trigger words that occur in the invented prose of `documents`.
PROSE_MODALITY = {"prohibition": ["nicht", "pas"], "obligation": ["with", "avec", "mit"], "permission": ["from", "pour", "für"]}
PROSE_CUES = {"condition": ["that", "que", "dass"], "deadline": ["by", "par", "von"], "document": ["this", "sur", "auf"],
              "authority": ["is", "est", "ist"], "status": ["was"]}

_PROSE_SQL = f"""
WITH m AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, {_rx('nicht', 'pas')}) THEN 'prohibition'
  WHEN regexp_matches(text, {_rx('with', 'avec', 'mit')}) THEN 'obligation'
  WHEN regexp_matches(text, {_rx('from', 'pour', 'für')}) THEN 'permission' END AS m FROM documents)
SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN m = 'obligation' THEN 'duty' ELSE m END,
  CASE WHEN regexp_matches(text, {_rx('that', 'que', 'dass')}) THEN 'condition' END,
  CASE WHEN regexp_matches(text, {_rx('by', 'par', 'von')}) THEN 'deadline' END,
  CASE WHEN regexp_matches(text, {_rx('this', 'sur', 'auf')}) THEN 'document' END,
  CASE WHEN regexp_matches(text, {_rx('is', 'est', 'ist')}) THEN 'authority' END,
  CASE WHEN regexp_matches(text, {_rx('was')}) THEN 'status' END], lambda x: x IS NOT NULL)), ',') AS categories FROM m"""


@query("categories", _PROSE_SQL)
def categories(t):
    return t.documents.select("doc_id", F.array_join(slots.categories("text", PROSE_MODALITY, PROSE_CUES), ",").alias("categories"))


@query("doc_metadata", r"""
WITH d AS (SELECT o_orderkey, concat('Văn bản số ', cast(o_orderkey % 9999 AS string), CASE WHEN o_orderkey % 3 = 0 THEN '/VBHN-VPQH của Văn phòng Quốc hội'
   WHEN o_orderkey % 3 = 1 THEN concat('/', cast(year(o_orderdate) AS string), '/NĐ-CP của Chính phủ') ELSE ' không rõ' END,
   ', ngày ', cast(day(o_orderdate) AS string), ' tháng ', cast(month(o_orderdate) AS string), ' năm ', cast(year(o_orderdate) AS string),
   CASE WHEN o_orderkey % 2 = 0 THEN concat(', có hiệu lực từ ngày 1 tháng ', cast(month(o_orderdate) AS string), ' năm ', cast(year(o_orderdate) + 1 AS string)) ELSE '' END) AS s FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN concat(cast(o_orderkey % 9999 AS string), '/VBHN-VPQH')
    WHEN o_orderkey % 3 = 1 THEN regexp_extract(s, '\d{1,4}/\d{4}/NĐ-CP') END AS doc_code,
  nullif(regexp_extract(s, 'ngày \d{1,2} tháng \d{1,2} năm \d{4}'), '') AS first_date,
  nullif(regexp_extract(s, 'có hiệu lực từ ngày \d{1,2} tháng \d{1,2} năm \d{4}'), '') AS effective_date,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Văn phòng Quốc hội' WHEN o_orderkey % 3 = 1 THEN 'Chính phủ' END AS issuing_body FROM d""")
def doc_metadata(t):
    d = t.orders.selectExpr("o_orderkey", """concat('Văn bản số ', cast(o_orderkey % 9999 AS string), CASE WHEN o_orderkey % 3 = 0 THEN '/VBHN-VPQH của Văn phòng Quốc hội'
   WHEN o_orderkey % 3 = 1 THEN concat('/', cast(year(o_orderdate) AS string), '/NĐ-CP của Chính phủ') ELSE ' không rõ' END,
   ', ngày ', cast(day(o_orderdate) AS string), ' tháng ', cast(month(o_orderdate) AS string), ' năm ', cast(year(o_orderdate) AS string),
   CASE WHEN o_orderkey % 2 = 0 THEN concat(', có hiệu lực từ ngày 1 tháng ', cast(month(o_orderdate) AS string), ' năm ', cast(year(o_orderdate) + 1 AS string)) ELSE '' END) AS s""")
    return d.select("o_orderkey", slots.doc_metadata("s").alias("m")).select("o_orderkey", "m.*")


@query("parse_source_ref", """
SELECT unit_id, doc_id, chapter, article, clause, point FROM clauses""", uses=["clauses"])
def parse_source_ref(t):
    ref = F.concat(F.lit("unit="), "unit_id", F.lit("|doc_id="), "doc_id", F.lit("|chapter="), "chapter", F.lit("|section=|article="),
                   "article", F.lit("|clause="), F.coalesce("clause", F.lit("")), F.lit("|point="), F.coalesce("point", F.lit("")))
    r = t.clauses.select(slots.parse_source_ref(ref).alias("r"))
    return r.select(F.col("r.unit").alias("unit_id"), "r.doc_id", "r.chapter", "r.article", "r.clause", "r.point")


@query("free_text_ref", """
SELECT unit_id, article, clause, point FROM clauses""", uses=["clauses"])
def free_text_ref(t):
    s = F.concat_ws(" ", F.concat(F.lit("điểm "), "point"), F.concat(F.lit("khoản "), "clause"), F.concat(F.lit("Điều "), "article"))
    return t.clauses.select("unit_id", slots.free_text_ref(s).alias("r")).select("unit_id", "r.*")


@query("deadline_slots", f"""
WITH a AS (SELECT unit_id, text AS s, regexp_extract(text, '(?i)(trong\\s+(?:thời\\s+hạn|vòng)|chậm\\s+nhất)\\s*(\\d{{1,3}})\\s*(ngày|tháng|năm)(\\s+làm\\s+việc)?', ['w','v','u','k']) AS m FROM clauses)
SELECT unit_id, nullif(m.v, '') AS value,
  CASE WHEN m.v = '' THEN NULL WHEN m.u = 'ngày' AND m.k <> '' THEN 'working_day' WHEN m.u = 'ngày' THEN 'day' WHEN m.u = 'tháng' THEN 'month' ELSE 'year' END AS unit,
  CASE WHEN m.v = '' THEN NULL WHEN m.w = 'chậm nhất' THEN 'no_later_than'
       WHEN regexp_matches(s, 'thời hạn [0-9]+ ngày làm việc kể từ ngày nhận') THEN 'from_anchor' END AS anchor FROM a""", uses=["clauses"])
def deadline_slots(t):
    return t.clauses.select("unit_id", slots.deadline_slots("text").alias("d")).select("unit_id", "d.*")


@query("quantity_slots", r"""
WITH a AS (SELECT unit_id, nullif(regexp_extract(text, 'từ\s+(\d+[^ ]*)\s+đến\s+(\d+[^,.; ]*)'), '') AS r,
  nullif(regexp_extract(text, '\d+(,\d+)?\s*%'), '') AS p,
  nullif(regexp_extract(text, '(không\s+quá|ít\s+nhất|trở\s+lên|từ)\s+\d+[^,.;]{0,60}'), '') AS c FROM clauses)
SELECT unit_id, c AS count_limit, p AS ratio_limit, r AS "range", coalesce(r, p, c) AS condition FROM a""", uses=["clauses"])
def quantity_slots(t):
    return t.clauses.select("unit_id", slots.quantity_slots("text").alias("q")).select("unit_id", "q.*")


@query("threshold_fields", r"""
WITH a AS (SELECT unit_id, text AS s, cast(event_id % 12 AS INT) AS k FROM clauses)
SELECT unit_id,
  CASE k WHEN 0 THEN 'thoi_han_xu_ly' WHEN 2 THEN 'ty_le_so_huu_co_phan_pho_thong' WHEN 5 THEN 'so_thanh_vien' WHEN 6 THEN 'so_co_dong' WHEN 10 THEN 'ty_le_von_dieu_le' WHEN 11 THEN 'thoi_han_thanh_toan' END AS metric,
  CASE k WHEN 0 THEN 'eq' WHEN 2 THEN '>=' WHEN 5 THEN '<=' WHEN 10 THEN '>' WHEN 11 THEN 'eq' END AS op,
  CASE WHEN k IN (0, 2, 5, 10, 11) THEN regexp_extract(s, '\d+') END AS value,
  CASE k WHEN 0 THEN 'ngay_lam_viec' WHEN 2 THEN 'phan_tram' WHEN 5 THEN 'thanh_vien' WHEN 6 THEN 'co_dong' WHEN 10 THEN 'phan_tram' WHEN 11 THEN 'ngay' END AS unit,
  CASE WHEN k = 6 THEN regexp_extract(s, 'từ (\d+)', 1) END AS low, CASE WHEN k = 6 THEN regexp_extract(s, 'đến (\d+)', 1) END AS high,
  CASE WHEN k = 6 THEN 'dong' END AS range_kind FROM a""", uses=["clauses"])
def threshold_fields(t):
    return t.clauses.select("unit_id", slots.threshold_fields("text").alias("q")).select("unit_id", "q.*")


@query("coerce_answer", r"""
SELECT event_id, kind, CASE kind
  WHEN 'bool' THEN CASE WHEN lower(trim(answer)) IN ('1','true','yes','y','co','có','dung','đúng') THEN 'true' WHEN lower(trim(answer)) IN ('0','false','no','n','khong','không','sai') THEN 'false' END
  WHEN 'number' THEN CASE WHEN regexp_full_match(trim(answer), '[-+]?\d+([.,]\d+)?') THEN cast(cast(replace(trim(answer), ',', '.') AS DOUBLE) AS VARCHAR) END
  WHEN 'choice' THEN CASE WHEN lower(trim(answer)) IN ('click','view') THEN lower(trim(answer)) END
  WHEN 'date' THEN strftime(coalesce(try_strptime(answer, '%d/%m/%Y'), try_strptime(answer, '%Y-%m-%d')), '%Y-%m-%d')
  ELSE CASE WHEN regexp_full_match(answer, '\d+ (ngày|days)') THEN answer END END AS coerced FROM answers""", uses=["answers"])
def coerce_answer(t):
    return t.answers.select("event_id", "kind", slots.coerce_answer("answer", "kind", ["click", "view"]).alias("coerced"))


@query("answer_features", r"""
WITH a AS (SELECT conv_id, turn, text AS s, list_distinct(regexp_extract_all(text, '[TE]h?[a-z]+ (?:of|que|der) [a-z]+')) AS d,
   regexp_extract_all(text, '[TE]h?[a-z]+ (?:of|que|der) [a-z]+') AS c,
   contains(lower(text), 'what') OR contains(lower(text), 'pas ') AS asks FROM conversations)
SELECT conv_id, turn, array_to_string(list_sort(d), '|') AS citations, asks AS asks_for_facts,
   CASE WHEN s <> '' AND asks THEN 'A+B' WHEN asks THEN 'B' ELSE 'A' END AS mode FROM a""")
def answer_features(t):
    f = t.conversations.select("conv_id", "turn", slots.answer_features(
        "text", "[TE]h?[a-z]+ (?:of|que|der) [a-z]+", ["what", "pas "]).alias("a"))
    return f.select("conv_id", "turn", F.array_join(F.array_sort("a.citations"), "|").alias("citations"), "a.asks_for_facts", "a.mode")


@query("normalize_family", """
SELECT o_orderkey, CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'obligation' WHEN 1 THEN 'applicability' WHEN 2 THEN 'legal_effect'
   WHEN 3 THEN '' WHEN 4 THEN 'procedure' ELSE '' END AS family FROM orders""")
def normalize_family(t):
    raw = F.expr("CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'Must' WHEN 1 THEN ' eligibility' WHEN 2 THEN 'sanction' "
                 "WHEN 3 THEN o_orderpriority WHEN 4 THEN 'procedure step' END")
    return t.orders.select("o_orderkey", slots.normalize_family(raw).alias("family"))
