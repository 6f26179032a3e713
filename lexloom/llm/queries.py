"""Registered queries of the operators in this package, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
import public_tokenizers

from lexloom.llm import decontaminate, hard_negatives, html, langid, merkle, minhash, ngram_join, packing, pii, quality, secrets, topk, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans", "longest")


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.label_languages(table(spark, sf_dir, "documents"))


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


@query
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


@query
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


ORACLES["op8_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 10
"""


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("template", "purity")


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = merkle.manifest(table(spark, sf_dir, "documents"), merkle.without_newlines())
    return merkle.verified(entries).select(entries.id.alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _leaf_sql(text: str) -> str:
    one = lambda c: f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')"
    return f"sha256({' || '.join(map(one, ['doc_id::VARCHAR', 'source', 'lang', 'n_chars::VARCHAR', text]))})"


def _levels_sql(name: str, leaves: str) -> str:
    """Levels of a tree as a recursive table (grp, lvl, r, h, n), and the children of its nodes."""
    return f"""{name} AS (
  SELECT grp, 0 AS lvl, r, h, n FROM {leaves}
  UNION ALL SELECT grp, lvl + 1, r // 3, sha256(string_agg(h, '' ORDER BY r)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY grp, lvl, r // 3, n
), {name}_kids AS (SELECT grp, lvl + 1 AS lvl, r // 3 AS r, list(h ORDER BY r) AS kids FROM {name} WHERE n > 1 GROUP BY ALL)"""


def _walk_sql(name: str, start: str, tree: str) -> str:
    left, right = "array_to_string(kids[1:w.r % 3], '')", "array_to_string(kids[w.r % 3 + 2:], '')"
    return f"""{name} AS (
  SELECT *, 0 AS lvl FROM ({start})
  UNION ALL SELECT w.doc_id, w.source, w.grp, w.r // 3, sha256({left} || acc || {right}), proof || {left} || {right}, w.lvl + 1
  FROM {name} w JOIN {tree}_kids p ON p.grp IS NOT DISTINCT FROM w.grp AND p.lvl = w.lvl + 1 AND p.r = w.r // 3
), {name}_end AS (SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1)"""


CRC_SQL = """(xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, b: xor(xor(a, b) >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END))))"""

ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_leaf_sql('text')} AS leaf, CASE WHEN {CRC_SQL} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql('text')} END AS shown FROM documents
), l0 AS (SELECT source AS grp, doc_id, leaf AS h, shown, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM d),
{_levels_sql('tree', 'l0')},
s0 AS (SELECT 0 AS grp, grp AS source, h, row_number() OVER (ORDER BY encode(grp) NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM tree WHERE n = 1),
{_levels_sql('top', 's0')},
{_walk_sql('low', "SELECT doc_id, grp AS source, grp, r, shown AS acc, '' AS proof FROM l0", 'tree')},
{_walk_sql('high', "SELECT e.doc_id, e.source, 0 AS grp, s0.r, e.acc, e.proof FROM low_end e JOIN s0 ON s0.source IS NOT DISTINCT FROM e.source", 'top')}
SELECT doc_id, leaf, s0.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = t.h AS verified
FROM high_end e JOIN d USING (doc_id) JOIN s0 ON s0.source IS NOT DISTINCT FROM e.source CROSS JOIN (SELECT h FROM top WHERE n = 1) t
"""


@query
def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_components(table(spark, sf_dir, "documents"), n=3, threshold=(85, 100))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives.mine_negatives(vectors, "id % 50 = 0")


ORACLES["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT anchor_id, positive_id, s.vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
