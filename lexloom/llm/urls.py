"""URL filter: rules first, then a tree of path templates per host.

The labels are the verdicts of the rules. Per host, the distinct paths grow a tree, level by level: segments that look
variable (numbers, hexadecimal, dates, long mixed tokens) become `*`, and so do rare ones below a node with many
children; then branches whose share of blocked URLs does not differ significantly from that of their siblings together
are merged into `*`. A template's purity is its share of blocked URLs, smoothed towards that of the same template
over all hosts, which is smoothed towards the overall share. A URL without a rule is blocked if the purity of its
template is at least `reject`.

Paths are told apart to `depth` segments; deeper ones share what stands above them. All steps are joins and sums over
(host, path) pairs that are added up first; nothing is gathered per host.

A null URL and one without `://` have an empty host and path. Repeated rows give a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.util import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VARIABLE = r"^(?:[0-9]+|[0-9a-fA-F]{8,}|[0-9]{1,4}[-_.][0-9]{1,2}(?:[-_.][0-9]{1,4})?|(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_-]{10,}|.*[0-9]{4,}.*)$"
Z = 1.96


def url_parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict. rules: (verdict, host/path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, below = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + below)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def templates(paths: DataFrame, depth: int, fan: int) -> DataFrame:
    """paths (host, path, n, block, allow) with the template of each path in its host's tree, and its plain form."""
    seg = F.filter(F.split("path", "/"), lambda s: s != "")
    out = paths.withColumn("segs", F.transform(seg, lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))).withColumn(
        "plain", F.concat_ws("/", F.slice("segs", 1, depth))).withColumn("template", F.lit(""))
    for d in range(1, depth + 1):
        out = out.withColumn("seg", F.get("segs", F.lit(d - 1)))
        kids = out.where(F.col("seg").isNotNull()).groupBy("host", "template", "seg").agg(*[F.sum(c).alias(c) for c in ("n", "block", "allow")])
        whole = kids.groupBy("host", "template").agg(F.count(F.lit(1)).alias("kids"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "block", "allow")])
        known, share = F.col("block") + F.col("allow"), F.try_divide("all_block", F.col("all_block") + F.col("all_allow"))
        rare = (F.col("kids") >= fan) & (F.col("n") * fan < F.col("all_n"))
        alike = F.abs(F.try_divide("block", known) - share) <= Z * F.sqrt(F.try_divide(share * (1 - share), known))  # null: nothing known
        nodes = kids.join(whole, ["host", "template"]).select("host", "template", "seg", F.when(rare | F.coalesce(alike, F.lit(False)), F.lit("*")).otherwise(F.col("seg")).alias("node"))
        out = out.join(nodes, ["host", "template", "seg"], "left").withColumn("template", F.when(F.col("node").isNull(), F.col("template")).otherwise(F.concat_ws("/", "template", "node"))).drop("seg", "node")
    return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", depth: int = 3, fan: int = 20,
               weight: float = 5.0, reject: float = 0.5) -> DataFrame:
    """Per page: page_id, host, path, rule (null without), verdict, and the template and purity where no rule fits."""
    host, path = url_parts(F.col(url_col).cast("string"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("verdict", verdict)
    said = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0))
    paths = own.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), said("block").alias("block"), said("allow").alias("allow"))
    tree = stage(templates(paths, depth, fan), "url_templates")
    total = tree.agg(F.sum("block").alias("b"), F.sum("allow").alias("a")).first()
    overall = (total.b + 1) / (total.b + total.a + 2) if total.b is not None else 0.5
    smooth = lambda b, a, prior: (b + weight * prior) / (b + a + weight)
    everywhere = tree.groupBy("plain").agg(F.sum("block").alias("b"), F.sum("allow").alias("a")).select("plain", smooth(F.col("b"), F.col("a"), F.lit(overall)).alias("prior"))
    here = tree.groupBy("host", "template").agg(F.sum("block").alias("b"), F.sum("allow").alias("a"))
    asked = tree.where("block + allow = 0").select("host", "path", "template", "plain")
    judged = asked.join(here, ["host", "template"]).join(everywhere, "plain").select("host", "path", "template", smooth(F.col("b"), F.col("a"), F.col("prior")).alias("purity"))
    ruled = own.where("rule is not null").select("*", F.lit(None).cast("string").alias("template"), F.lit(None).cast("double").alias("purity"))
    free = own.where("rule is null").drop("verdict").join(judged, ["host", "path"]).select(
        "page_id", "host", "path", "rule", F.when(F.col("purity") >= reject, "block").otherwise("allow").alias("verdict"), "template", "purity")
    return ruled.unionByName(free)
