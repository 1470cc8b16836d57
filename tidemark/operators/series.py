"""Chart series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import prices
from tidemark.operators.scale import with_neighbours


def smoothed(series: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Centred mean of three points, of two at the ends."""
    around = with_neighbours(series, keys, time, value)
    parts = [F.col(value), F.col("prev_value"), F.col("next_value")]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    count = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return around.withColumn("smooth", total / count).drop("prev_value", "next_value")


def carried_forward(series: DataFrame, keys: list[str], time: str, value: str, as_of: Column
                    ) -> DataFrame:
    """Adds (as_of, last value) to every series that ends earlier."""
    last = series.groupBy(*keys).agg(F.max(time).alias("_t"), F.max_by(value, time).alias(value))
    tail = last.filter(F.col("_t") < as_of).select(*keys, as_of.alias(time), value)
    return series.select(*keys, time, value).unionByName(tail)


def with_live_point(history: DataFrame, live: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Adds the live row of a series when it is newer than the last history point."""
    last = history.groupBy(*keys).agg(F.max(time).alias("_last"))
    newer = (live.join(last, keys, "left")
             .filter(F.col("_last").isNull() | (F.col(time) > F.col("_last"))).drop("_last"))
    return history.unionByName(newer, allowMissingColumns=True)


def live_prices(entries: DataFrame) -> DataFrame:
    """Per realm, Alliance and Horde side by side; the index of Alliance, else of Horde."""
    side = lambda f, c: F.max(F.when(F.col("faction") == f, c))
    return (entries.groupBy(F.lower("server_name").alias("realm"), F.upper("region").alias("region"),
                            F.lower("version").alias("version"))
            .agg(F.coalesce(side("Alliance", F.col("index_price_per_1k")),
                            side("Horde", F.col("index_price_per_1k"))).alias("index_price_per_1k"),
                 (side("Alliance", F.col("min_price")) * 1000).alias("best_ask_alliance_per_1k"),
                 (side("Horde", F.col("min_price")) * 1000).alias("best_ask_horde_per_1k"))
            .filter("index_price_per_1k IS NOT NULL"))


def aligned(points: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Alliance and Horde asks on one time line, index line from the longer of the two series."""
    side = lambda f, c: F.max(F.when(F.col("faction") == f, F.col(c)))
    ask = lambda f: F.max(F.when((F.col("faction") == f) & (F.col("best_ask") > 0), F.col("best_ask")))
    wide = points.filter(F.col("faction").isin("Alliance", "Horde")).groupBy(*keys, time).agg(
        side("Alliance", "index_price_per_1k").alias("_a"),
        side("Horde", "index_price_per_1k").alias("_h"),
        ask("Alliance").alias("ask_alliance"), ask("Horde").alias("ask_horde"))
    longer = wide.groupBy(*keys).agg(
        (F.count("_a") >= F.count("_h")).alias("_alliance"))
    return (wide.join(longer, keys)
            .withColumn("index_line", F.when(F.col("_alliance"), F.col("_a")).otherwise(F.col("_h")))
            .drop("_a", "_h", "_alliance"))


def chart_sources(points: DataFrame) -> DataFrame:
    """Union of the sources over all points."""
    return points.select(F.explode("sources").alias("source")).distinct()


def chart_values(points: DataFrame, value: str, unit: str) -> DataFrame:
    return points.withColumn(value, prices.chart_price(F.col(value), unit))
