"""Registry of runnable queries and the views they read.

A query is a function of ``Tables``; its SQL twin is plain text for an independent engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# view name -> SQL over tables and earlier views
VIEWS: dict[str, str] = {}
# views that Spark builds with this package's own operators instead of the SQL text
BUILT: dict[str, Callable[["Tables"], DataFrame]] = {}
QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def view(name: str, sql: str, built: Callable[["Tables"], DataFrame] | None = None) -> None:
    VIEWS[name] = sql
    if built is not None:
        BUILT[name] = built


def query(name: str, sql: str | None = None):
    def register(fn: Callable[["Tables"], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return register


def _used(sql: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
    return [v for v in VIEWS if v in words]


def with_views(sql: str) -> str:
    """Prefixes the SQL with the views it needs, in order of definition."""
    needed: set[str] = set()
    todo = _used(sql)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += _used(VIEWS[name])
    if not needed:
        return sql
    heads = [f"{v} AS (\n{VIEWS[v].strip()}\n)" for v in VIEWS if v in needed]
    body = sql.strip()
    if body[:4].upper() == "WITH":
        return "WITH " + ",\n".join(heads) + ",\n" + body[4:].lstrip()
    return "WITH " + ",\n".join(heads) + "\n" + body


class Tables:
    """The driver's tables and the views over them, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name in VIEWS:
            if name not in self._frames:
                self._frames[name] = BUILT[name](self) if name in BUILT else self.derive(VIEWS[name])
            return self._frames[name]
        raise AttributeError(name)

    def derive(self, sql: str, **frames: DataFrame) -> DataFrame:
        """Runs the SQL with the tables and views after FROM and JOIN bound to DataFrames."""
        known = {n for n in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql) if n in TABLES or n in VIEWS}
        bound = {n: frames[n] if n in frames else getattr(self, n) for n in known}
        text = re.sub(r"\b(FROM|JOIN)\s+(\w+)",
                      lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in bound else m[0], sql)
        return self.spark.sql(text, **bound)


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return QUERIES[name](Tables(spark, folder))
