"""Writers for JSON lines, statute packs, flat CSV and review tables, and runs of a pipeline prefix."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.common import first_nonblank, is_blank, lookup, text_or_empty


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line with NULL fields kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def pack_key(c: str = "doc_code") -> Column:
    return F.regexp_replace(first_nonblank(c, F.lit("unknown_doc")), r"[/\s]+", "_")


def pack_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy(pack_key().alias("doc_key")).agg(F.count("*").alias("rule_count"))


def write_statute_packs(rules: DataFrame, path: str) -> DataFrame:
    """One folder of JSON lines per document code; returns the counts per pack."""
    rules.withColumn("doc_key", pack_key()).write.mode("overwrite").partitionBy("doc_key").option("ignoreNullFields", "false").json(path)
    return pack_counts(rules)


def flat_columns(log: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fixed column order; arrays, maps and structs as JSON text, absent columns as NULL."""
    types = dict(log.dtypes)
    nested = lambda c: types[c].startswith(("array", "struct", "map"))
    return log.select(*[F.lit(None).cast("string").alias(c) if c not in types else (F.to_json(c, {"ignoreNullFields": "false"}) if nested(c) else F.col(c)).alias(c) for c in columns])


def write_flat_csv(log: DataFrame, path: str, columns: Sequence[str]) -> None:
    flat_columns(log, columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def review_table(df: DataFrame, columns: Sequence[str], codes: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    """Fixed projection of a stage for review: control characters removed, booleans as co / khong, coded values spelled out."""
    types, out = dict(df.dtypes), []
    for c in columns:
        v = F.col(c)
        if types[c] == "boolean":
            v = F.when(v, F.lit("co")).otherwise(F.lit("khong"))
        else:
            v = F.regexp_replace(v.cast("string"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
        if codes and c in codes:
            v = lookup(v, codes[c], v)
        out.append(v.alias(c))
    return df.select(*out)


def write_review_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def run_stages(spark: SparkSession, inputs: Mapping[str, DataFrame], stages: Sequence[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]], root: str, until: str | None = None) -> dict[str, DataFrame]:
    """Run a prefix of the pipeline; each stage is written as Parquet and read back, so the next one starts from a table."""
    have = dict(inputs)
    for name, fn in stages:
        fn(have).write.mode("overwrite").parquet(f"{root}/{name}")
        have[name] = spark.read.parquet(f"{root}/{name}")
        if name == until:
            break
    return have
