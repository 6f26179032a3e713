"""Readers for text corpora, rule and passage files, review tables and artifact folders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.common import case_when, first_nonblank, is_blank, none_if_blank, text_or_empty
from lexloom.functions.slots import doc_metadata, to_bool
from lexloom.functions.text import clean_text

S = T.StringType()
TERM = T.StructType([T.StructField("predicate", S), T.StructField("args", T.ArrayType(S))])
RULE_SCHEMA = T.StructType([
    T.StructField("rule_id", S), T.StructField("logic_form", S), T.StructField("head", TERM), T.StructField("body", T.ArrayType(TERM)),
    T.StructField("auxiliary_clauses", T.ArrayType(TERM)), T.StructField("metadata", T.MapType(S, S)), T.StructField("source_ref", S), T.StructField("source_ref_full", S),
])
CHUNK_SCHEMA = T.StructType([
    T.StructField("chunk_id", S), T.StructField("text", S), T.StructField("source_doc", S), T.StructField("article_clause", S), T.StructField("article", S), T.StructField("clause", S),
    T.StructField("point", S), T.StructField("source_ref", S), T.StructField("rule_ids", T.ArrayType(S)), T.StructField("domain", S), T.StructField("rulebase_id", S), T.StructField("origin", S),
])
CORRUPT = "_corrupt"


def read_corpus(spark: SparkSession, path: str, domain: str, overrides: DataFrame | None = None) -> DataFrame:
    """One row per text file: id, type by name, code / dates / body by text, cleaned text.

    overrides(file_name, doc_code, doc_type) wins over what is read from the text.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("raw_text"))
    name = F.lower("file_name")
    # Document type by file name.
    kind = case_when([(name.rlike("nghi.?dinh|nd-cp|nđ-cp"), "decree"), (name.rlike("thong.?tu|tt-"), "circular"), (name.rlike("luat|vbhn|law"), "law")], "other")
    d = raw.select(F.regexp_replace("file_name", r"\.[^.]+$", "").alias("doc_id"), "file_name", F.lit(domain).alias("domain"), kind.alias("doc_type"), "raw_text", clean_text("raw_text").alias("text"))
    d = d.withColumn("m", doc_metadata("text")).select("*", "m.*").drop("m")
    if overrides is not None:
        o = overrides.select("file_name", F.col("doc_code").alias("o_code"), F.col("doc_type").alias("o_type"))
        d = d.join(o, "file_name", "left").withColumn("doc_code", first_nonblank("o_code", "doc_code")).withColumn("doc_type", first_nonblank("o_type", "doc_type")).drop("o_code", "o_type")
    return d


def _rows(spark: SparkSession, path: str, schema: T.StructType, roots: Sequence[str], lines: bool) -> DataFrame:
    """Rows of JSON lines, or of an object / list per file, with the unreadable text in `_corrupt`."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, S)])
    opt = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    if lines:
        text = spark.read.text(path).filter("trim(value) <> ''")
        return text.select(F.from_json("value", full, opt).alias("r")).select("r.*")
    text = spark.read.text(path, wholetext=True)
    is_list = F.startswith(F.ltrim("value", F.lit(" \n\r\t")), F.lit("["))
    holder = T.StructType([*[T.StructField(n, T.ArrayType(schema)) for n in roots], T.StructField(CORRUPT, S)])
    obj = text.filter(~is_list).select("value", F.from_json("value", holder, opt).alias("r"))
    arr = F.coalesce(*[F.col(f"r.{n}") for n in roots])
    lst = text.filter(is_list).select("value", F.from_json("value", T.ArrayType(schema), {"mode": "PERMISSIVE"}).alias("a"))
    items = obj.select("value", arr.alias("a")).union(lst)
    good = items.select(F.explode("a").alias("x")).select("x.*").withColumn(CORRUPT, F.lit(None).cast("string"))
    bad = items.filter("a IS NULL").select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], F.col("value").alias(CORRUPT))
    return good.unionByName(bad)


def read_rules(spark: SparkSession, path: str, lines: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rules, rejected): JSON lines, or files holding `rules_reasoning_core` / `rules` / a list."""
    r = _rows(spark, path, RULE_SCHEMA, ["rules_reasoning_core", "rules"], lines)
    bad = F.col(CORRUPT).isNotNull() | is_blank("rule_id")
    pred = first_nonblank("head.predicate", F.lit("unknown"))
    head = F.struct(pred.alias("predicate"), F.coalesce("head.args", F.array().cast("array<string>")).alias("args"))
    good = r.filter(~bad).withColumn("logic_form", first_nonblank("logic_form", F.lit("unknown"))).withColumn("head", head).drop(CORRUPT)
    return good, r.filter(bad).select("rule_id", F.col(CORRUPT).alias("raw"))


def read_chunks(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Passages from JSON lines, a list, or an object with `chunks` / `evidence_chunks`; unreadable lines are skipped."""
    c = _rows(spark, path, CHUNK_SCHEMA, ["chunks", "evidence_chunks"], lines)
    return c.filter(F.col(CORRUPT).isNull() & ~is_blank("text")).drop(CORRUPT)


def read_review_table(spark: SparkSession, path: str, required: Sequence[str], flags: Sequence[str] = (), ints: Sequence[str] = (), defaults: Mapping[str, str] | None = None) -> DataFrame:
    """Reload a reviewed stage: fails when a required column is missing, coerces flags and integers, fills blanks."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for c in flags:
        df = df.withColumn(c, F.coalesce(to_bool(c), F.lit(False)))
    for c in ints:
        df = df.withColumn(c, F.expr(f"try_cast(trim(`{c}`) AS int)"))
    for c, v in (defaults or {}).items():
        df = df.withColumn(c, F.coalesce(none_if_blank(c), F.lit(v)))
    return df


def artifact_inventory(spark: SparkSession, root: str, kinds: Sequence[str] = ("rules", "canonical", "traceability", "packs")) -> DataFrame:
    """Per domain: lines of each artifact kind under `root/<domain>/<kind>*.jsonl` and complete / missing."""
    f = spark.read.option("recursiveFileLookup", True).text(root).select(F.col("_metadata.file_path").alias("p"))
    part = F.split("p", "/")
    f = f.select(F.element_at(part, -2).alias("domain"), F.element_at(part, -1).alias("file"))
    kind = case_when([(F.startswith(F.col("file"), F.lit(k)), k) for k in kinds])
    g = f.withColumn("kind", kind).filter("kind IS NOT NULL").groupBy("domain").pivot("kind", list(kinds)).agg(F.count("kind")).na.fill(0, list(kinds))
    absent = F.array_compact(F.array(*[F.when(F.col(k) == 0, F.lit(k)) for k in kinds]))
    return g.withColumn("missing", F.array_join(absent, ",")).withColumn("complete", F.size(absent) == 0)
