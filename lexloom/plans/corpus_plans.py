"""Queries for segmentation, candidates, frames and seeds."""

from pyspark.sql import functions as F

from lexloom.operators import candidates as K
from lexloom.operators import frames as FR
from lexloom.operators import segment as S
from lexloom.plans.policy_plans import _own, _sql
from lexloom.plans.registry import query
from lexloom.plans.text_plans import _rx

# Heading patterns that occur in the invented prose of `documents`.
PROSE_HEADINGS = {"chapter": r"^(On[a-z]*)[ .,](.*)$", "section": r"^(An[a-z]*)[ .,](.*)$", "article": r"^([E-I][a-z]+)[ .,](.*)$",
                  "clause": r"^([L-R][a-z]+)[ .,](.*)$", "point": r"^(T[a-z]+)[ .,](.*)$"}
_K = "CASE " + " ".join(f"WHEN regexp_matches(l, '{rx}') THEN '{k}'" for k, rx in PROSE_HEADINGS.items()) + " END"
_G = lambda i: "CASE " + " ".join(f"WHEN regexp_matches(l, '{rx}') THEN regexp_extract(l, '{rx}', {i})" for rx in PROSE_HEADINGS.values()) + " END"
UNITS = f"""ln AS (SELECT doc_id, i, trim(ls[i], ' ' || chr(9) || chr(13)) AS l FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
hd AS (SELECT doc_id, i, {_K} AS k, {_G(1)} AS key, trim({_G(2)}) AS rest FROM ln WHERE {_K} IS NOT NULL),
m1 AS (SELECT *, coalesce(max(CASE WHEN k = 'chapter' THEN i END) OVER w, 0) AS ch, coalesce(max(CASE WHEN k = 'section' THEN i END) OVER w, 0) AS se, coalesce(max(CASE WHEN k = 'article' THEN i END) OVER w, 0) AS ar FROM hd WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
m2 AS (SELECT *, coalesce(max(CASE WHEN k = 'clause' AND ar > greatest(ch, se) THEN i END) OVER (PARTITION BY doc_id ORDER BY i), 0) AS cl FROM m1),
m3 AS (SELECT * FROM m2 WHERE k IN ('chapter', 'section', 'article') OR (k = 'clause' AND cl = i) OR (k = 'point' AND cl > greatest(ch, se, ar))),
m4 AS (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS unit_no FROM m3),
nl AS (SELECT doc_id, max(i) AS n FROM ln GROUP BY 1),
m5 AS (SELECT m4.*, coalesce(nx - 1, n) AS last_line FROM m4 JOIN nl USING (doc_id) WHERE k IN ('article', 'clause', 'point')),
bd AS (SELECT m.doc_id, m.i, string_agg(l, chr(10) ORDER BY ln.i) AS body FROM m5 m JOIN ln ON ln.doc_id = m.doc_id AND ln.i > m.i AND ln.i <= m.last_line AND l <> '' GROUP BY ALL),
un AS (SELECT m.doc_id, unit_no::INT AS unit_no, c.key AS chapter, CASE WHEN m.se > m.ch THEN s.key END AS section, a.key AS article, a.rest AS heading, CASE WHEN m.k <> 'article' THEN q.key END AS clause, CASE WHEN m.k = 'point' THEN lower(m.key) END AS point,
  trim(concat_ws(chr(10), CASE WHEN m.k <> 'article' THEN nullif(m.rest, '') END, body)) AS text, m.i::INT AS first_line, last_line::INT AS last_line
  FROM m5 m LEFT JOIN hd c ON c.doc_id = m.doc_id AND c.i = m.ch LEFT JOIN hd s ON s.doc_id = m.doc_id AND s.i = m.se LEFT JOIN hd a ON a.doc_id = m.doc_id AND a.i = m.ar LEFT JOIN hd q ON q.doc_id = m.doc_id AND q.i = m.cl LEFT JOIN bd ON bd.doc_id = m.doc_id AND bd.i = m.i)"""


def _units(t):
    return S.segment_units(t.documents, PROSE_HEADINGS)


@query("segment_units", f"WITH {UNITS} SELECT * FROM un WHERE length(text) >= 20")
def segment_units(t):
    return _units(t)


@query("unit_ids", f"""WITH {UNITS}, u AS (SELECT *, 'UNIT_' || concat_ws('_', 'SRC_' || (doc_id % 7), 'D' || article, 'K' || clause, upper(point), 'S' || unit_no, 'SS0') AS unit_id FROM un WHERE length(text) >= 20)
SELECT doc_id, unit_no, unit_id, concat_ws('. ', 'Điều ' || article, nullif(heading, '')) AS heading_text, concat_ws(' | ', 'Chương ' || chapter, 'Mục ' || section, 'Điều ' || article) AS parent_context,
 'unit=' || unit_id || '|doc_id=' || doc_id || '|chapter=' || coalesce(chapter, '') || '|section=' || coalesce(section, '') || '|article=' || article || '|clause=' || coalesce(clause, '') || '|point=' || coalesce(point, '') || '|lines=' || first_line || '-' || last_line AS source_ref FROM u""")
def unit_ids(t):
    u = _units(t).withColumn("doc_code", F.concat(F.lit("src/"), (F.col("doc_id") % 7).cast("string")))
    return S.unit_ids(u).select("doc_id", "unit_no", "unit_id", "heading_text", "parent_context", "source_ref")


DEFN = r"'(?i)(?:^\s*[^.;:\n]{1,120}\s+là\s+|(?:^|[^\p{L}\p{N}_])(?:được\s+hiểu\s+là|giải\s+thích\s+từ\s+ngữ|(?:bao\s+gồm|gồm\s+các)\s|là\s+(?:một\s+)?(?:tổ\s+chức|doanh\s+nghiệp|việc)(?:$|[^\p{L}\p{N}_])))'"
DEON = _rx("phải", r"có\s+nghĩa\s+vụ", r"có\s+trách\s+nhiệm", r"chịu\s+trách\s+nhiệm", r"không\s+được", r"nghiêm\s+cấm")


@query("unit_markers", f"""WITH u AS (SELECT unit_id, text, (regexp_matches(text, {DEFN}) OR heading = 'Giải thích từ ngữ') AND NOT regexp_matches(text, {DEON}) AS quiet FROM clauses)
SELECT unit_id, NOT quiet AND regexp_matches(text, {_rx('nếu', 'khi', 'trường hợp')}) AS has_condition, NOT quiet AND regexp_matches(text, {_rx('trong thời hạn', 'trong vòng', 'kể từ ngày', 'chậm nhất')}) AS has_deadline,
 NOT quiet AND regexp_matches(text, {_rx('trừ trường hợp', 'nếu không')}) AS has_exception, NOT quiet AND regexp_matches(text, {_rx('cơ quan')}) AS has_authority, NOT quiet AND regexp_matches(text, {_rx('hồ sơ', 'kèm theo')}) AS has_document FROM u""", uses=["clauses"])
def unit_markers(t):
    return S.unit_markers(t.clauses).select("unit_id", "has_condition", "has_deadline", "has_exception", "has_authority", "has_document")


@query("unit_rule_signal", f"""WITH m AS (SELECT unit_id, text, heading, list_filter([CASE WHEN regexp_matches(text, {_rx('phải')}) THEN 'phai' END, CASE WHEN regexp_matches(text, {_rx('có trách nhiệm')}) THEN 'co_trach_nhiem' END, CASE WHEN regexp_matches(text, {_rx('không được')}) THEN 'khong_duoc' END,
  CASE WHEN regexp_matches(text, {_rx('nghiêm cấm')}) THEN 'nghiem_cam' END, CASE WHEN regexp_matches(text, {_rx('trong thời hạn')}) THEN 'trong_thoi_han' END, CASE WHEN regexp_matches(text, {_rx('trong vòng')}) THEN 'trong_vong' END, CASE WHEN regexp_matches(text, {_rx('kể từ ngày')}) THEN 'ke_tu_ngay' END,
  CASE WHEN regexp_matches(text, {_rx('hồ sơ bao gồm')}) THEN 'ho_so_bao_gom' END, CASE WHEN regexp_matches(text, {_rx('kèm theo hồ sơ')}) THEN 'kem_theo_ho_so' END, CASE WHEN regexp_matches(text, {_rx('thông báo')}) THEN 'thong_bao' END, CASE WHEN regexp_matches(text, {_rx('đăng ký')}) THEN 'dang_ky' END,
  CASE WHEN regexp_matches(text, {_rx('cấp')}) THEN 'cap' END, CASE WHEN regexp_matches(text, {_rx('thu hồi')}) THEN 'thu_hoi' END, CASE WHEN regexp_matches(text, {_rx('khi', 'nếu', 'trường hợp')}) THEN 'dieu_kien' END, CASE WHEN regexp_matches(text, {_rx('trừ trường hợp')}) THEN 'ngoai_le' END,
  CASE WHEN regexp_matches(text, {_rx('từ [0-9]+', 'không quá', 'ít nhất')}) THEN 'nguong_so_luong' END], lambda x: x IS NOT NULL) AS mk FROM clauses),
s AS (SELECT *, len(list_intersect(mk, ['phai','co_trach_nhiem','khong_duoc','nghiem_cam'])) > 0 AS deon, len(list_filter(mk, lambda x: x NOT IN ('dang_ky','thong_bao','cap'))) = 0 AS wk FROM m),
n AS (SELECT *, CASE WHEN len(mk) = 0 THEN '' WHEN NOT deon AND (heading = 'Giải thích từ ngữ' OR regexp_matches(text, {DEFN})) THEN 'definition_like' WHEN wk AND NOT regexp_matches(text, {_rx('hồ sơ', 'thời hạn', 'cơ quan', 'từ chối')}) THEN 'weak_signal_only' ELSE '' END AS note FROM s)
SELECT unit_id, len(mk) > 0 AND note = '' AS is_candidate, CASE WHEN len(mk) > 0 AND note = '' THEN array_to_string(mk[1:3], ';') END AS signal, note FROM n""", uses=["clauses"])
def unit_rule_signal(t):
    return S.unit_rule_signal(t.clauses).select("unit_id", "is_candidate", "signal", "note")


def _hints(t):
    return t.clauses.select("unit_id", "text", F.when(F.col("event_id") % 3 == 0, "phải").otherwise("").alias("deontic_signal"), F.lit("").alias("action_hint"), F.when(F.col("event_id") % 2 == 0, "x").alias("object_hint"))


@query("clean_unit_hints", """SELECT unit_id, CASE WHEN event_id % 3 = 0 THEN 'phải' ELSE coalesce(nullif(regexp_extract(lower(text), '(không được|nghiêm cấm|phải|có nghĩa vụ|chịu trách nhiệm|có trách nhiệm|được|có quyền|có thể)', 1), ''), '') END AS deontic_signal,
 regexp_extract(lower(text), '((?:nộp|sở hữu)\\s+[\\p{L}]+(?:\\s+[\\p{L}]+){0,3})', 1) AS action_hint FROM clauses""", uses=["clauses"])
def clean_unit_hints(t):
    return S.clean_unit_hints(_hints(t), ["nộp", "sở hữu"])[0].select("unit_id", "deontic_signal", "action_hint")


def _candidates_sql():
    """Matches with positions (lengths of the gaps and matches before), kept where no word goes on around them; then windows and slices."""
    word, squeeze = r"[\p{L}\p{N}_]", lambda x: rf"trim(regexp_replace({x}, '[\s\x{{00a0}}]+', ' ', 'g'))"
    stop = lambda x: rf"regexp_replace({x}, '(?s)(?:[.;]\s|\n\n).*$', '')"
    # A look-ahead for a character that no word holds, then any 40: that character, then any 39.
    rx = lambda ps: "|".join(ps).replace(r"(?=[^\p{L}\p{N}_]).{0,40}", r"[^\p{L}\p{N}_].{0,39}")
    kinds = [("t", "t", rx(p)) for p in K.TRIGGERS] + [("x", "flat", rx(K.EXCEPTION)), ("e", "flat", rx(K.EFFECT))]
    found = " UNION ALL ".join(f"SELECT unit_id, '{k}' AS kind, {c} AS x, regexp_extract_all({c}, '(?i)(?:{p})') AS hits, regexp_split_to_array({c}, '(?i)(?:{p})') AS gaps FROM u" for k, c, p in kinds)
    points = r"SELECT unit_id, 'p', t, regexp_extract_all(t, '(?im)^\s*[a-zđ]\)\s+'), regexp_split_to_array(t, '(?im)^\s*[a-zđ]\)\s+') FROM u"
    focus = squeeze(f"CASE WHEN length({stop('substr(x, p + 1)')}) > {K.COMMA_CHARS} THEN split_part({stop('substr(x, p + 1)')}, ',', 1) ELSE {stop('substr(x, p + 1)')} END")
    begin = rf"""CASE WHEN a = 0 THEN 0 WHEN regexp_matches(substr(x, a, 1), '[\p{{L}}\p{{N}}]') THEN a + length(regexp_extract(substr(x, a + 1), '^[\p{{L}}\p{{N}}]*[ \t]*')) ELSE a + length(regexp_extract(substr(x, a + 1), '^[ \t]*')) END"""
    return f"""WITH u AS (SELECT unit_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t, {squeeze('text')} AS flat FROM clauses),
h AS ({found} UNION ALL {points}), n AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM h),
m AS (SELECT unit_id, kind, x, length(hits[i]) AS len, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0))::BIGINT AS p FROM n),
k AS (SELECT *, greatest(0, p - {K.PRE_CHARS}) AS a, coalesce(lead(p) OVER (PARTITION BY unit_id, kind ORDER BY p), length(x)) AS b FROM m
  WHERE kind = 'p' OR NOT regexp_matches(CASE WHEN p = 0 THEN '' ELSE substr(x, p, 1) END, '{word}') AND NOT regexp_matches(substr(x, p + len + 1, 1), '{word}')),
g AS (SELECT *, {begin} AS start FROM k),
c AS (SELECT unit_id, kind, p, b, CASE kind WHEN 'p' THEN regexp_replace(substr(x, p + 1, b - p), '^\\s+|\\s+$', '', 'g') WHEN 't' THEN {squeeze(stop("trim(substr(x, start + 1, greatest(0, b - start)), ' ')"))} ELSE {focus} END AS c FROM g),
z AS (SELECT *, count(*) FILTER (kind = 'p') OVER w AS np, count(*) FILTER (kind = 'x') OVER w AS nx FROM c WINDOW w AS (PARTITION BY unit_id)),
e AS (SELECT unit_id, c, kind, row_number() OVER (PARTITION BY unit_id ORDER BY position(kind IN 'ptxe'), p, b) AS o, np >= 2 OR nx >= 2 AS plain FROM z
  WHERE c <> '' AND CASE WHEN np >= 2 THEN kind = 'p' WHEN nx >= 2 THEN kind = 'x' ELSE kind <> 'p' END),
f AS (SELECT * FROM e QUALIFY plain OR row_number() OVER (PARTITION BY unit_id, c ORDER BY o) = 1),
r AS (SELECT * FROM f WHERE plain OR NOT EXISTS (SELECT 1 FROM f y WHERE y.unit_id = f.unit_id AND contains(lower(y.c), lower(f.c)) AND length(f.c) + {K.NESTED_CHARS} < length(y.c)))
SELECT unit_id, (row_number() OVER (PARTITION BY unit_id ORDER BY o) - 1)::INT AS idx, c AS cand_text,
  CASE kind WHEN 'p' THEN 'split=points' WHEN 't' THEN 'split=trigger_window' WHEN 'x' THEN 'split=focused_exception' ELSE 'split=focused_legal_effect' END AS how FROM r"""


@query("generate_candidates", _candidates_sql(), uses=["clauses"])
def generate_candidates(t):
    return K.generate_candidates(t.clauses)


def _cands(t):
    """One candidate per unit, so that the stages after it can be stated in SQL."""
    c = t.clauses.select("unit_id", F.col("unit_id").alias("ns_id"), F.lit(0).alias("idx"), F.col("text").alias("cand_text"))
    return K.filter_candidates(c)


@query("filter_candidates", f"""WITH c AS (SELECT unit_id, cast(event_id % 12 AS INT) AS k, text, cast(user_id % 4 AS INT) AS s FROM clauses),
x AS (SELECT *, CASE WHEN k IN (0) THEN 'deadline' WHEN k = 1 THEN 'deadline' WHEN k = 2 THEN 'prohibition' WHEN k = 3 THEN 'document_requirement' WHEN k = 4 THEN 'legal_effect' WHEN k = 5 THEN 'threshold' WHEN k = 6 THEN 'permission' WHEN k = 7 THEN 'deadline' WHEN k = 9 THEN 'document_requirement' WHEN k = 10 THEN 'permission' ELSE NULL END AS t0 FROM c)
SELECT unit_id, CASE WHEN k = 1 AND s = 2 THEN 'authority_action' WHEN k = 0 AND s = 2 THEN 'authority_action' WHEN k = 11 THEN CASE WHEN s = 2 THEN 'authority_action' ELSE 'deadline' END ELSE t0 END AS candidate_type,
 CASE WHEN k IN (0, 1) THEN 'obligation' WHEN k IN (2, 9) THEN 'prohibition' WHEN k IN (6, 7, 10, 11) THEN 'permission' END AS modality FROM x WHERE k <> 8""", uses=["clauses"])
def filter_candidates(t):
    return _cands(t).select("unit_id", "candidate_type", "modality")


LOW = r"trim(regexp_replace(lower({0}), '[\s\x{{00a0}}]+', ' ', 'g'))"


@query("dedupe_overlaps", rf"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.\n]'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS c, unnest(range(0, len(l))) AS i FROM s), u AS (SELECT doc_id, 2 * i AS idx, c FROM e UNION ALL SELECT doc_id, 2 * i + 1, trim(substr(c, 1, length(c) // 2)) FROM e WHERE length(c) > 1),
o AS (SELECT doc_id, idx, c, (length(c) * 7 + idx) % 11 / 2 AS quality, {LOW.format('c')} AS low, row_number() OVER (PARTITION BY doc_id ORDER BY (length(c) * 7 + idx) % 11 DESC, idx) AS n FROM u),
r AS (SELECT doc_id, 0::BIGINT AS n, []::VARCHAR[] AS kept, NULL::BIGINT AS idx, NULL::VARCHAR AS c, NULL::DOUBLE AS quality FROM s
  UNION ALL SELECT r.doc_id, o.n, CASE WHEN x.clash THEN kept ELSE list_append(kept, low) END, CASE WHEN NOT x.clash THEN o.idx END, o.c, o.quality
  FROM r JOIN o ON o.doc_id = r.doc_id AND o.n = r.n + 1, LATERAL (SELECT len(list_filter(r.kept, lambda k: contains(k, o.low) OR contains(o.low, k))) > 0 AS clash) x)
SELECT doc_id AS unit_id, idx::INT AS idx, c AS cand_text, quality FROM r WHERE idx IS NOT NULL""")
def dedupe_overlaps(t):
    """Sentences of the documents and their first halves as candidates."""
    parts = F.filter(F.transform(F.split("text", r"[.\n]"), lambda x: F.trim(x)), lambda x: x != "")
    e = t.documents.select("doc_id", F.posexplode(parts).alias("i", "c"))
    half = e.where(F.length("c") > 1).select("doc_id", (2 * F.col("i") + 1).alias("idx"), F.trim(F.substring(F.col("c"), F.lit(1), F.expr("cast(length(c) div 2 as int)"))).alias("c"))
    u = e.select("doc_id", (2 * F.col("i")).alias("idx"), "c").union(half)
    return K.dedupe_overlaps(u.select(F.col("doc_id").alias("unit_id"), "idx", F.col("c").alias("cand_text"), (((F.length("c") * 7 + F.col("idx")) % 11) / 2).alias("quality")))


@query("fill_slots", r"""SELECT unit_id, nullif(trim(regexp_extract(text, '((?:trừ\s+trường\s+hợp|ngoại\s+trừ)[^.;]{0,200})', 1)), '') AS exception_span, nullif(trim(regexp_extract(text, '((?:bị\s+thu\s+hồi|hết\s+hiệu\s+lực|chấm\s+dứt)[^.;]{0,120})', 1)), '') AS effect_span,
  nullif(trim(regexp_extract(text, '((?:không\s+quá|ít\s+nhất|trên|từ)\s+\d+[^.;,]{0,80})', 1)), '') AS threshold_span FROM clauses WHERE event_id % 12 <> 8""", uses=["clauses"])
def fill_slots(t):
    return K.fill_slots(_cands(t)).select("unit_id", "exception_span", "effect_span", "threshold_span")


EXP = """SELECT l_orderkey, l_linenumber, concat('U', cast(l_orderkey AS string)) AS unit_id, cast(l_linenumber AS int) AS idx, concat('text ', p_name, ' ', p_brand) AS cand_text, CASE WHEN l_returnflag = 'A' THEN 'duty' ELSE 'condition' END AS candidate_type,
  CASE WHEN l_partkey % 3 = 0 THEN concat('ngoai le ', p_name) END AS exception_span, CASE WHEN l_partkey % 4 = 0 THEN concat('qua ', p_type) END AS threshold_span, CASE WHEN l_partkey % 5 = 0 THEN concat('bi ', p_name) END AS effect_span,
  CASE WHEN l_partkey % 6 = 0 THEN concat('ho so ', p_brand) END AS document_span, CASE WHEN l_partkey % 7 = 0 THEN concat('han ', p_name) END AS deadline_span, CASE WHEN l_partkey % 8 = 0 THEN p_name END AS condition_span FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""


@query("expand_candidates", f"""WITH e AS ({_own(EXP)}), d AS (SELECT unit_id, cand_text, candidate_type FROM e UNION ALL SELECT unit_id, exception_span, 'condition' FROM e WHERE length(exception_span) >= 14 UNION ALL SELECT unit_id, threshold_span, 'threshold' FROM e WHERE length(threshold_span) >= 10
 UNION ALL SELECT unit_id, effect_span, 'legal_effect' FROM e WHERE length(effect_span) >= 12 UNION ALL SELECT unit_id, document_span, 'document_requirement' FROM e WHERE length(document_span) >= 14 UNION ALL SELECT unit_id, deadline_span, 'deadline' FROM e WHERE length(deadline_span) >= 12 UNION ALL SELECT unit_id, condition_span, 'condition' FROM e WHERE length(condition_span) >= 10)
SELECT DISTINCT unit_id, cand_text, candidate_type FROM d""")
def expand_candidates(t):
    return K.expand_candidates(_sql(t, EXP)).select("unit_id", "cand_text", "candidate_type")


@query("mark_units", """WITH c AS (SELECT l_partkey, max((rule_id, l_returnflag)) AS m, count(*) AS n FROM (SELECT l_partkey, l_returnflag, l_orderkey || '_' || l_linenumber || '_' || l_suppkey AS rule_id FROM lineitem) GROUP BY 1)
SELECT p_partkey AS unit_id, m[2] AS topic, m[1] AS rule_signal, coalesce(n, 0) AS n_candidates FROM part LEFT JOIN c ON p_partkey = l_partkey""")
def mark_units(t):
    c = t.lineitem.select(F.col("l_partkey").alias("unit_id"), F.concat_ws("_", "l_orderkey", "l_linenumber", "l_suppkey").alias("seq"), F.col("l_returnflag").alias("candidate_type"))
    return K.mark_units(t.part.select(F.col("p_partkey").alias("unit_id")), c.withColumn("signal", F.col("seq")))


SCC = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE cast(l_partkey % 4 AS int) WHEN 0 THEN 'Doanh nghiệp phải nộp hồ sơ' WHEN 1 THEN 'phải nộp và phải khai' WHEN 2 THEN 'trường hợp khác trong vòng 3 ngày' ELSE 'công ty là tổ chức' END AS cand_text, CASE WHEN l_suppkey % 2 = 0 THEN 'm' ELSE '' END AS marker,
  CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'Doanh nghiệp' END AS subject, CASE WHEN l_suppkey % 5 < 2 THEN NULL ELSE 'nộp' END AS action, CASE WHEN l_linenumber = 1 THEN 'trong vòng 3 ngày' ELSE '' END AS deadline_span FROM {lineitem}"""


@query("score_candidates", f"""WITH c AS ({_own(SCC)}), d AS (SELECT *, l_partkey % 4 AS k, action IS NULL AS na, subject = '' AS ns FROM c),
e AS (SELECT *, (marker <> '')::INT + (NOT ns)::INT + (NOT na)::INT + (k <> 2 OR deadline_span <> '')::INT + (k <> 1)::INT AS n, CASE WHEN k = 3 THEN 'definition' WHEN k = 1 THEN 'bad_split' WHEN k = 2 AND na THEN 'case_without_main_clause' WHEN na THEN 'missing_action' WHEN ns THEN 'missing_subject' ELSE '' END AS error_type FROM d),
f AS (SELECT *, CASE WHEN error_type IN ('definition', 'bad_split') THEN 0 WHEN error_type <> '' THEN CASE WHEN n >= 3 THEN 1 ELSE 0 END WHEN n >= 4 THEN 2 WHEN n = 3 THEN 1 ELSE 0 END AS rubric FROM e)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n::INT AS tests_passed, error_type, rubric::INT AS rubric, ['drop', 'split', 'keep'][rubric + 1] AS action_taken FROM f""")
def score_candidates(t):
    return K.score_candidates(_sql(t, SCC)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "tests_passed", "error_type", "rubric", "action_taken")


BFU = "SELECT concat('U', cast(doc_id AS string)) AS unit_id, lang = 'fr' AS has_exception, n_chars % 3 = 0 AS has_threshold, n_chars % 4 = 0 AS has_deadline, source = 'src1' AS has_document FROM {documents}"
BFC = "SELECT concat('U', cast(doc_id AS string)) AS unit_id, CASE WHEN quality = 0 THEN 'condition' WHEN toxic = 1 THEN 'threshold' WHEN doc_id % 2 = 0 THEN 'deadline' ELSE 'duty' END AS candidate_type FROM {labels}"


@query("backfill_gaps", f"WITH u AS ({_own(BFU)}), c AS ({_own(BFC)}) SELECT unit_id, (has_exception::INT + has_threshold::INT + has_deadline::INT + has_document::INT)::INT AS n_markers FROM u WHERE n_markers > 0 AND unit_id NOT IN (SELECT unit_id FROM c)")
def backfill_gaps(t):
    return K.backfill_gaps(_sql(t, BFU), _sql(t, BFC))


@query("backfill_types", f"WITH u AS ({_own(BFU)}), c AS ({_own(BFC)}), w AS (SELECT unit_id, 'condition' AS candidate_type FROM u WHERE has_exception UNION ALL SELECT unit_id, 'threshold' FROM u WHERE has_threshold UNION ALL SELECT unit_id, 'deadline' FROM u WHERE has_deadline UNION ALL SELECT unit_id, 'document_requirement' FROM u WHERE has_document) SELECT * FROM w WHERE (unit_id, candidate_type) NOT IN (SELECT (unit_id, candidate_type) FROM c)")
def backfill_types(t):
    return K.backfill_types(_sql(t, BFU), _sql(t, BFC))


@query("merge_stage", "SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal, NULL::VARCHAR AS seg FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer")
def merge_stage(t):
    a = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return K.merge_stage(a, t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg")))


@query("extract_frames", r"""SELECT 'F_' || unit_id AS frame_id, CASE WHEN k = 3 OR k = 9 THEN 'document_rule' WHEN s = 2 AND k IN (0, 1, 11) THEN 'authority_rule' WHEN k IN (0, 1, 7, 11) THEN 'deadline_rule' WHEN k = 2 THEN 'prohibition_rule' WHEN k = 4 THEN 'effect_rule' WHEN k = 5 THEN 'threshold_rule' ELSE 'permission_rule' END AS frame_type,
 CASE WHEN k IN (0, 1, 7, 11) THEN regexp_extract(text, '(\d+) (ngày|tháng)', 1) END AS deadline_value FROM (SELECT unit_id, text, cast(event_id % 12 AS INT) AS k, cast(user_id % 4 AS INT) AS s FROM clauses WHERE event_id % 12 <> 8)""", uses=["clauses"])
def extract_frames(t):
    return FR.extract_frames(K.fill_slots(_cands(t))).select("frame_id", "frame_type", "deadline_value")


FRM = """SELECT concat('F', cast(l_orderkey AS string), '_', cast(l_linenumber AS string), '_', cast(l_partkey AS string), '_', cast(l_suppkey AS string)) AS frame_id, concat('U', cast(l_partkey AS string)) AS unit_id, concat('F', cast(l_orderkey AS string)) AS ns_id,
  CASE cast(l_linenumber AS int) WHEN 1 THEN 'obligation_rule' WHEN 2 THEN 'deadline_rule' WHEN 3 THEN 'document_rule' WHEN 4 THEN 'authority_rule' WHEN 5 THEN 'threshold_rule' ELSE 'condition_rule' END AS frame_type,
  CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE 'Doanh nghiệp' END AS subject, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE concat(CASE WHEN l_partkey % 3 = 0 THEN 'nộp ' ELSE 'sửa ' END, p_name) END AS action, CASE WHEN l_partkey % 6 = 0 THEN 'việc' WHEN l_partkey % 6 = 1 THEN p_name END AS object,
  CASE WHEN l_partkey % 4 = 0 THEN concat('nếu ', p_name, ' hoặc ', lower(p_type)) WHEN l_partkey % 4 = 1 THEN lower(p_type) END AS condition, CASE WHEN l_linenumber = 2 THEN cast(1 + l_suppkey % 30 AS string) END AS deadline_value, 'day' AS deadline_unit,
  CASE WHEN l_linenumber = 3 THEN concat('giấy ', p_name, '; bản ', lower(p_brand)) END AS documents, CASE WHEN l_linenumber = 4 AND l_suppkey % 2 = 0 THEN 'cơ quan thuế' END AS authority, CASE WHEN l_partkey % 7 = 0 THEN concat('trừ ', p_name, ' ', lower(p_type)) END AS exception,
  CASE WHEN l_partkey % 9 = 0 THEN 'bị thu hồi' END AS effect, CASE WHEN l_linenumber = 5 THEN concat('từ ', cast(l_suppkey AS string)) END AS count_limit, cast(NULL AS string) AS ratio_limit, concat('câu ', p_name) AS source_text, '' AS notes
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""
FRO = _own(FRM)


@query("exception_frames", f"WITH f AS ({FRO}) SELECT frame_id, frame_type FROM f UNION ALL SELECT frame_id || '_EX', 'exception_rule' FROM f WHERE length(trim(exception)) >= 14")
def exception_frames(t):
    return FR.exception_frames(_sql(t, FRM)).select("frame_id", "frame_type")


@query("frame_completeness", f"""WITH f AS ({FRO}), n AS (SELECT frame_id, 1 + (subject <> '')::INT + (action IS NOT NULL)::INT + (object IS NOT NULL)::INT AS a, (condition IS NOT NULL)::INT + (deadline_value IS NOT NULL)::INT + (documents IS NOT NULL)::INT + (authority IS NOT NULL)::INT + (exception IS NOT NULL)::INT + (effect IS NOT NULL)::INT AS b FROM f)
SELECT frame_id, a::INT AS n_core, b::INT AS n_bonus, CASE WHEN a = 4 AND b >= 2 THEN 'rat_day_du' WHEN a = 4 OR (a = 3 AND b >= 2) THEN 'day_du' WHEN a = 3 OR (a = 2 AND b >= 2) THEN 'trung_binh' WHEN a = 2 THEN 'so_sai' ELSE 'thieu' END AS level FROM n""")
def frame_completeness(t):
    return FR.frame_completeness(_sql(t, FRM)).select("frame_id", "n_core", "n_bonus", "level")


@query("split_flags", f"WITH f AS ({FRO}) SELECT frame_id, concat_ws(';', CASE WHEN documents IS NOT NULL THEN 'nhieu_ho_so' END, CASE WHEN contains(condition, ' hoặc ') THEN 'nhieu_dieu_kien' END, CASE WHEN exception IS NOT NULL AND action IS NOT NULL THEN 'co_ngoai_le' END) AS split_reasons, CASE WHEN documents IS NOT NULL OR contains(condition, ' hoặc ') THEN 2 ELSE 1 END::INT AS n_parts FROM f")
def split_flags(t):
    return FR.split_flags(_sql(t, FRM)).select("frame_id", F.array_join("split_reasons", ";").alias("split_reasons"), "n_parts")


SFC = "SELECT concat('F', cast(o_orderkey AS string)) AS ns_id, CASE WHEN o_custkey % 2 = 0 THEN 'nếu có' ELSE 'câu' END AS cand_text, CASE cast(o_custkey % 4 AS int) WHEN 0 THEN 'deadline' WHEN 1 THEN 'document_requirement' WHEN 2 THEN 'authority_action' ELSE 'duty' END AS candidate_type FROM {orders}"


@query("score_frames", f"""WITH f AS ({FRO}), c AS ({_own(SFC)}), j AS (SELECT f.*, cand_text, candidate_type FROM f LEFT JOIN c USING (ns_id)),
e AS (SELECT frame_id, concat_ws(';', CASE WHEN cand_text IS NULL THEN 'type' END, CASE WHEN subject = '' THEN 'subject' END, CASE WHEN action IS NULL THEN 'action' END, CASE WHEN cand_text = 'nếu có' AND condition IS NULL THEN 'condition' END) AS h,
 concat_ws(';', CASE WHEN candidate_type = 'deadline' AND deadline_value IS NULL THEN 'deadline' END, CASE WHEN candidate_type = 'document_requirement' AND documents IS NULL THEN 'documents' END, CASE WHEN candidate_type = 'authority_action' AND authority IS NULL THEN 'authority' END) AS s FROM j)
SELECT frame_id, h AS hard_errors, s AS soft_errors, CASE WHEN h <> '' THEN 'redo' WHEN s <> '' THEN 'fix' ELSE 'keep' END AS verdict FROM e""")
def score_frames(t):
    s = FR.score_frames(_sql(t, FRM), _sql(t, SFC))
    return s.select("frame_id", F.array_join("hard_errors", ";").alias("hard_errors"), F.array_join("soft_errors", ";").alias("soft_errors"), "verdict")


VF = """SELECT frame_id, CASE frame_type WHEN 'obligation_rule' THEN 'obligation' WHEN 'deadline_rule' THEN 'deadline' WHEN 'document_rule' THEN 'document_requirement' WHEN 'authority_rule' THEN 'authority_action' WHEN 'threshold_rule' THEN 'threshold' ELSE 'other' END AS frame_type,
  CASE WHEN subject = '' THEN 'ab' ELSE subject END AS subject, substr(action, 1, 4 + length(action) % 3 - 2) AS predicate, CASE WHEN deadline_value = '3' THEN NULL ELSE deadline_value END AS deadline, CASE WHEN effect IS NULL THEN documents END AS document, substr(authority, 1, 3 + length(source_text) % 2) AS authority, CASE WHEN exception IS NULL THEN count_limit END AS threshold FROM ("""


@query("validate_frames", f"""WITH f AS ({VF}{FRO})), e AS (SELECT frame_id, concat_ws(';', CASE WHEN frame_type IN ('obligation','authority_action') AND predicate IS NULL THEN 'missing_required_slot:predicate' END, CASE WHEN frame_type = 'deadline' AND deadline IS NULL THEN 'missing_required_slot:deadline' END,
 CASE WHEN frame_type = 'document_requirement' AND document IS NULL THEN 'missing_required_slot:document' END, CASE WHEN frame_type = 'authority_action' AND authority IS NULL THEN 'missing_required_slot:authority' END, CASE WHEN frame_type = 'threshold' AND threshold IS NULL THEN 'missing_required_slot:threshold' END,
 CASE WHEN frame_type IN ('deadline','threshold') AND deadline IS NULL AND threshold IS NULL THEN 'missing_temporal_threshold_value' END, CASE WHEN frame_type = 'authority_action' AND length(trim(authority)) < 4 THEN 'authority_too_short' END, CASE WHEN length(subject) < 3 THEN 'subject_too_short' END, CASE WHEN length(trim(predicate)) < 4 THEN 'predicate_too_short' END,
 CASE WHEN frame_type = 'document_requirement' AND document IS NULL THEN 'document_requirement_missing_document' END) AS errors FROM f) SELECT frame_id, errors, errors = '' AS ok FROM e""")
def validate_frames(t):
    f = t.spark.sql(VF + FRM + ")", lineitem=t.lineitem, part=t.part)
    return FR.validate_frames(f).select("frame_id", F.array_join("errors", ";").alias("errors"), "ok")


@query("enrich_frames", f"""WITH f AS ({FRO}), u AS (SELECT 'U' || p_partkey AS unit_id, 'Mục ' || p_brand AS heading, CASE p_partkey % 3 WHEN 0 THEN 'nộp tiền thuế.' WHEN 1 THEN 'bị thu hồi giấy.' ELSE 'hồ sơ bao gồm đơn.' END AS text FROM part),
g AS (SELECT f.*, concat_ws(' ', source_text, heading, text) AS gr FROM f LEFT JOIN u USING (unit_id)), h AS (SELECT *, nullif(regexp_extract(gr, '(hồ sơ bao gồm[^.]*)', 1), '') AS nd, nullif(regexp_extract(gr, 'nộp ([^.;,]{{3,60}})', 1), '') AS no, nullif(regexp_extract(gr, '(bị thu hồi[^.;]*)', 1), '') AS ne FROM g)
SELECT frame_id, coalesce(documents, nd) AS documents, coalesce(CASE WHEN object <> 'việc' THEN object END, no) AS object, coalesce(effect, ne) AS effect, concat_ws(';', CASE WHEN documents IS NULL AND nd IS NOT NULL THEN 'bo_sung_ho_so' END, CASE WHEN (object IS NULL OR object = 'việc') AND no IS NOT NULL THEN 'bo_sung_doi_tuong' END, CASE WHEN effect IS NULL AND ne IS NOT NULL THEN 'bo_sung_ket_qua' END) AS notes_added FROM h""")
def enrich_frames(t):
    u = t.part.select(F.concat(F.lit("U"), F.col("p_partkey").cast("string")).alias("unit_id"), F.concat(F.lit("Mục "), "p_brand").alias("heading"),
                                                    F.expr("CASE p_partkey % 3 WHEN 0 THEN 'nộp tiền thuế.' WHEN 1 THEN 'bị thu hồi giấy.' ELSE 'hồ sơ bao gồm đơn.' END").alias("text"))
    return FR.enrich_frames(_sql(t, FRM), u).select("frame_id", "documents", "object", "effect", F.array_join("notes_added", ";").alias("notes_added"))


@query("apply_overrides", f"WITH f AS ({FRO}), p AS (SELECT 'F' || o_orderkey AS ns_id, CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Sửa' END AS s FROM orders) SELECT frame_id, CASE WHEN s IS NULL THEN subject WHEN s = '' THEN NULL ELSE s END AS subject, CASE WHEN p.ns_id IS NOT NULL THEN 'da_sua' ELSE '' END AS notes FROM f LEFT JOIN p USING (ns_id)")
def apply_overrides(t):
    p = t.orders.select(F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("ns_id"), F.expr("CASE o_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Sửa' END").alias("subject"))
    return FR.apply_overrides(_sql(t, FRM), p, "ns_id", ["subject"], "da_sua").select("frame_id", "subject", "notes")


_SL = "coalesce(nullif(trim(regexp_replace(strip_accents(replace(lower({0}), 'đ', 'd')), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown')"
LEX = f"""f AS ({FRO}), r0 AS (SELECT frame_id, 0 AS i, 'action' AS role, trim(action) AS surface FROM f WHERE action IS NOT NULL UNION ALL SELECT frame_id, 1, 'condition', trim(condition) FROM f WHERE condition IS NOT NULL
 UNION ALL SELECT frame_id, 2, 'document', trim(split_part(documents, ';', 1)) FROM f WHERE documents IS NOT NULL UNION ALL SELECT frame_id, 3, 'document', trim(split_part(documents, ';', 2)) FROM f WHERE documents IS NOT NULL),
lx AS (SELECT *, {_SL.format('surface')} AS s FROM r0), ly AS (SELECT *, CASE WHEN s LIKE 'nop%' THEN 'nop' ELSE s END AS normalized, CASE WHEN s LIKE 'nop%' THEN 'ho_so' ELSE 'khac' END AS grp FROM lx)"""


@query("build_lexicon", f"WITH {LEX} SELECT normalized, grp, role, surface FROM ly QUALIFY row_number() OVER (PARTITION BY normalized, grp, role ORDER BY frame_id, i) = 1")
def build_lexicon(t):
    return FR.build_lexicon(_sql(t, FRM))[0].select("normalized", "grp", "role", "surface")


@query("surface_map", f"WITH {LEX} SELECT DISTINCT surface, normalized FROM ly")
def surface_map(t):
    return FR.build_lexicon(_sql(t, FRM))[1]


@query("build_rule_seeds", f"""WITH {LEX}, sm AS (SELECT DISTINCT surface, normalized FROM ly), s AS (SELECT frame_id, action, CASE frame_type WHEN 'obligation_rule' THEN 'quy_tac_nghia_vu' WHEN 'deadline_rule' THEN 'quy_tac_thoi_han' WHEN 'document_rule' THEN 'quy_tac_ho_so' WHEN 'authority_rule' THEN 'quy_tac_hanh_dong_co_quan' WHEN 'threshold_rule' THEN 'quy_tac_nguong_dinh_luong' ELSE 'quy_tac_dieu_kien' END AS rule_type, '' AS item FROM f
 UNION ALL SELECT frame_id, action, 'quy_tac_thoi_han', deadline_value || ' day' FROM f WHERE deadline_value IS NOT NULL UNION ALL SELECT frame_id, action, 'quy_tac_ho_so', trim(unnest(string_split(documents, ';'))) FROM f WHERE documents IS NOT NULL
 UNION ALL SELECT frame_id, action, 'quy_tac_ngoai_le', exception FROM f WHERE exception IS NOT NULL UNION ALL SELECT frame_id, action, 'quy_tac_nguong_dinh_luong', count_limit FROM f WHERE count_limit IS NOT NULL
 UNION ALL SELECT frame_id, action, 'quy_tac_dieu_kien', trim(unnest(string_split(condition, ' hoặc '))) FROM f WHERE condition IS NOT NULL UNION ALL SELECT frame_id, action, 'quy_tac_ket_qua_phap_ly', effect FROM f WHERE effect IS NOT NULL)
SELECT frame_id, rule_type, item, normalized AS canonical_predicate, 'G_' || sha256(frame_id) AS group_id FROM s LEFT JOIN sm ON sm.surface = trim(action)""")
def build_rule_seeds(t):
    f = _sql(t, FRM)
    return FR.build_rule_seeds(f, FR.build_lexicon(f)[1]).select("frame_id", "rule_type", "item", "canonical_predicate", "group_id")


@query("refine_seeds", """WITH c AS (SELECT unit_id, cast(event_id % 12 AS INT) AS k, text, CASE cast(user_id % 3 AS INT) WHEN 0 THEN 'quy_tac_nguong_dinh_luong' WHEN 1 THEN 'quy_tac_nghia_vu' ELSE 'khac' END AS rt, event_id % 5 = 0 AS has FROM clauses)
SELECT unit_id, CASE WHEN rt = 'quy_tac_nguong_dinh_luong' THEN CASE k WHEN 0 THEN 'thoi_han_xu_ly' WHEN 2 THEN 'ty_le_so_huu_co_phan_pho_thong' WHEN 5 THEN 'so_thanh_vien' WHEN 6 THEN 'so_co_dong' WHEN 10 THEN 'ty_le_von_dieu_le' WHEN 11 THEN 'thoi_han_thanh_toan' END END AS metric,
 CASE WHEN has THEN 'co' WHEN rt = 'quy_tac_nghia_vu' THEN 'phát sinh nghĩa vụ' END AS effect, concat_ws(';', 'cu', CASE WHEN rt = 'quy_tac_nguong_dinh_luong' AND k IN (0, 2, 5, 6, 10, 11) THEN 'bo_sung_nguong' END, CASE WHEN NOT has AND rt = 'quy_tac_nghia_vu' THEN 'bo_sung_he_qua' END) AS notes FROM c""", uses=["clauses"])
def refine_seeds(t):
    s = t.clauses.select("unit_id", "text", F.expr("CASE cast(user_id % 3 AS INT) WHEN 0 THEN 'quy_tac_nguong_dinh_luong' WHEN 1 THEN 'quy_tac_nghia_vu' ELSE 'khac' END").alias("rule_type"), F.when(F.col("event_id") % 5 == 0, "co").alias("effect"), F.lit("cu").alias("notes"))
    return FR.refine_seeds(s).select("unit_id", "metric", "effect", "notes")
