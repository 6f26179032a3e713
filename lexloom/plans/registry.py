"""Registry of runnable queries, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.plans.inputs import DERIVED, TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the base tables and to inputs that Spark derives from them.

    `lexloom.input.tasks` (unset: as the files are cut) deals every base table over so many tasks.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._seen = spark, root, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._seen:
            if name in TABLES:
                df = self.spark.read.parquet(f"{self.root}/{name}.parquet")
                if tasks := self.spark.conf.get("lexloom.input.tasks", None):  # for tables of one file with one row group
                    df = df.repartition(int(tasks))
            else:
                needs, sql = DERIVED[name]
                df = self.spark.sql(sql, **{n: getattr(self, n) for n in needs})
            self._seen[name] = df
        return self._seen[name]


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        if n in TABLES:
            continue
        for x in _closure(DERIVED[n][0]) + [n]:
            if x not in out:
                out.append(x)
    return out


def _oracle(sql: str, uses: list[str]) -> str:
    ctes = []
    for n in _closure(uses):
        needs, text = DERIVED[n]
        ctes.append(f"{n} AS ({text.format(**{x: x for x in needs})})")
    body = sql.strip().rstrip(";")
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        rest = body[5:].lstrip()
        if rest[:10].upper() == "RECURSIVE ":
            return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + rest[10:]
        return "WITH " + ",\n".join(ctes) + ",\n" + rest
    return "WITH " + ",\n".join(ctes) + "\n" + body


def query(name: str, oracle: str | None = None, uses: list[str] | None = None):
    """Register `fn(tables) -> DataFrame` under `name`."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, root: fn(Tables(spark, root))
        if oracle is not None:
            ORACLES[name] = _oracle(oracle, uses or [])
        return fn

    return wrap
