"""Stored tick tiers: Parquet by tier, date and realm group, written forward from a high-water mark.

``advance`` rolls up what has closed since the mark, with the tier's look-back for late rows, so a run
reads and rewrites the days it touches and no others. New days are staged and named in the manifest
before they replace stored ones; a run that dies in between is finished by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark import schemas
from tidemark.functions.times import TIER_FLOORS
from tidemark.operators.history import LOOK_BACK, TICK_COLUMNS, realm_part, rollup
from tidemark.session import materialize, remove_path
from tidemark.sources.versioned import Manifest

TIERS = ("5m", "1h", "1d")


class TierStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.manifest = spark, path, Manifest(spark, path)
        self.schema = StructType([*schemas.TICKS.fields, StructField("part", IntegerType())])

    def tier(self, name: str) -> DataFrame:
        """A tier as stored, empty before its first run; date and part are partition columns."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(name))
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder(name))

    def tiers(self) -> dict[str, DataFrame]:
        return {name: self.tier(name) for name in TIERS}

    def _folder(self, name: str) -> str:
        return f"{self.path}/tier={name}"

    def marks(self) -> dict[str, str]:
        """Per tier the moment up to which its buckets are stored, as UTC text."""
        return self.manifest.newest()[1].get("marks", {})

    def advance(self, ticks: DataFrame, upto: str) -> None:
        """Stores all buckets that end by ``upto`` (timestamp text), tier by tier; running it again changes
        nothing. ``ticks`` are the stored ticks, with a date column to prune by if they have one."""
        self._finish()
        source = ticks
        for name in TIERS:
            self._advance(name, source, upto)
            source = self.tier(name)

    def _advance(self, name: str, source: DataFrame, upto: str) -> None:
        version, state = self.manifest.newest()
        marks = state.get("marks", {})
        cut = TIER_FLOORS[name](F.lit(upto).cast("timestamp"))
        fresh = source.filter(F.col("recorded_at") < cut)
        kept = self.tier(name).limit(0)
        if name in marks:
            start = TIER_FLOORS[name](F.lit(marks[name]).cast("timestamp") - F.expr(f"INTERVAL {LOOK_BACK[name]}"))
            if "date" in source.columns:
                fresh = fresh.filter(F.col("date") >= F.to_date(start))
            fresh = fresh.filter(F.col("recorded_at") >= start)
            kept = self.tier(name).filter((F.col("date") >= F.to_date(start)) & (F.col("recorded_at") < start))
        rows = rollup(fresh, name).withColumns({"date": F.to_date("recorded_at"), "part": realm_part(F.col("server_id"))})
        staged = materialize(kept.select(*rows.columns).unionByName(rows), "tier")
        mark = self.spark.range(1).select(F.date_format(cut, "yyyy-MM-dd HH:mm:ss")).first()[0]
        self.manifest.commit(version, {"marks": marks, "pending": {"tier": name, "staged": staged.staged_at, "mark": mark}})
        self._finish()

    def _finish(self) -> None:
        """Replaces the days of a staged run, and moves the mark."""
        version, state = self.manifest.newest()
        pending = state.get("pending")
        if not pending:
            return
        rows = self.spark.read.schema(self.schema).parquet(pending["staged"])
        (rows.select(*TICK_COLUMNS, "date", "part").hint("rebalance", "date", "part").sortWithinPartitions("date", "part", "server_id", "faction", "recorded_at")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "part").parquet(self._folder(pending["tier"])))
        self.manifest.commit(version, {"marks": {**state["marks"], pending["tier"]: pending["mark"]}})
        remove_path(self.spark, pending["staged"])
