"""Tick tiers, bars and history reads."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed, prices, text
from tidemark.functions.times import TIER_FLOORS, bucket_minutes, floor_minutes
from tidemark.operators.filters import since
from tidemark.operators.ranking import newest
from tidemark.operators.scale import lookup

TICK_KEYS = ["server_id", "faction", "recorded_at"]
TICK_COLUMNS = [*TICK_KEYS, "index_price", "best_ask", "sample_size"]
LOOK_BACK = {"5m": "10 MINUTES", "1h": "2 HOURS", "1d": "2 DAYS"}


def rollup(ticks: DataFrame, tier: str, as_of: Column | None = None) -> DataFrame:
    """Mean price, lowest ask and largest sample per key and bucket of the tier.

    With ``as_of`` only the look-back of the tier is read, cut at the start of a bucket so
    that no bucket is made from a part of its rows.
    """
    floor = TIER_FLOORS[tier]
    if as_of is not None:
        start = as_of - F.expr(f"INTERVAL {LOOK_BACK[tier]}")
        cut = floor_minutes(start, 5) if tier == "5m" else floor(start)
        if "date" in ticks.columns:
            ticks = ticks.filter(F.col("date") >= F.to_date(cut))
        ticks = ticks.filter(F.col("recorded_at") >= cut)
    return (ticks.groupBy("server_id", "faction", floor(F.col("recorded_at")).alias("bucket"))
            .agg(F.avg("index_price").alias("index_price"), F.min("best_ask").alias("best_ask"),
                 F.max("sample_size").alias("sample_size"))
            .withColumnRenamed("bucket", "recorded_at").select(*TICK_COLUMNS))


def merged(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``first`` and those of ``second`` whose key is new."""
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"))


def back_fill(short: DataFrame, long: DataFrame) -> dict[str, DataFrame]:
    """Tiers from the full history; the hourly tier also takes keys only the long table has."""
    return {"5m": rollup(short, "5m"),
            "1h": merged(rollup(short, "1h"), rollup(long, "1h"), TICK_KEYS)}


def back_fill_audit(source: DataFrame, targets: Mapping[str, DataFrame]) -> DataFrame:
    """One row per target: row counts and whether a filled source left the target empty."""
    rows = source.agg(F.count(F.lit(1)).alias("source_rows"))
    out = None
    for name, target in targets.items():
        one = (target.agg(F.count(F.lit(1)).alias("target_rows"))
               .select(F.lit(name).alias("target"), "target_rows").crossJoin(F.broadcast(rows)))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("ok", (F.col("source_rows") == 0) | (F.col("target_rows") > 0))


def tier_for(hours: int) -> str:
    """Finest tier kept long enough for the range; the minute buffer is never read."""
    if hours <= fixed.TIER_5M_HOURS:
        return "5m"
    return "1h" if hours <= fixed.TIER_1H_HOURS else "1d"


def history_points(ticks: DataFrame) -> DataFrame:
    return ticks.select(*TICK_KEYS, "index_price",
                        prices.index_per_1k(F.col("index_price")).alias("index_price_per_1k"),
                        prices.best_ask_per_1k(F.col("best_ask"), F.col("index_price")).alias("best_ask"),
                        "sample_size")


# realm groups of a day in the stored tiers
REALM_PARTS = 16


def realm_part(server_id: Column) -> Column:
    """The group of a realm; with a literal, the scan of a stored tier is left with one folder a day."""
    return F.pmod(F.hash(server_id.cast("int")), F.lit(REALM_PARTS))


def history(tiers: Mapping[str, DataFrame], server_id: int, faction: str, hours: int, as_of,
            max_points: int = 500) -> DataFrame:
    """Newest points of one series, oldest first, from the tier that covers the range."""
    stored = text.stored_faction(F.lit(faction))
    ticks = tiers[tier_for(hours)].filter((F.col("server_id") == server_id)
                                          & (F.col("faction") == stored))
    if "part" in ticks.columns:
        ticks = ticks.filter(F.col("part") == realm_part(F.lit(server_id)))
    return newest(history_points(since(ticks, "recorded_at", as_of, hours)), "recorded_at", max_points)


def history_by_name(tiers: Mapping[str, DataFrame], servers: DataFrame, name: str, region: str,
                    version: str, faction: str, hours: int, as_of, max_points: int = 500) -> DataFrame:
    """As ``history`` for a realm given by name, region and version; unknown -> no rows."""
    found = (servers.filter((F.lower("name") == name.lower()) & (F.col("region") == region.upper())
                            & (F.lower("version") == version.lower()))
             .agg(F.min("id").alias("server_id")))
    ticks = tiers[tier_for(hours)].filter(F.col("faction") == text.stored_faction(F.lit(faction)))
    on = ["server_id"]
    if "part" in ticks.columns:  # the realm found at run time prunes the folders
        on, found = ["server_id", "part"], found.withColumn("part", realm_part(F.col("server_id")))
    ticks = since(ticks, "recorded_at", as_of, hours).join(F.broadcast(found), on)  # one row
    return newest(history_points(ticks), "recorded_at", max_points)


def named_history(ticks: DataFrame, servers: DataFrame) -> DataFrame:
    """Tick rows with the realm's name, region and version."""
    names = servers.select(F.col("id").alias("server_id"), "name", "region", "version")
    return lookup(history_points(ticks), names, "server_id", "inner")


def bars(group_index: DataFrame, bucket: Column) -> DataFrame:
    """Bars per (label, faction, bucket): open, high, low, close, means, lowest ask, sources.

    Rows with the same source list are summed first, so the list of lists per bucket stays
    as short as the number of different source sets.
    """
    sources = F.sort_array(text_array(F.col("sources")))
    point = F.struct("ts", "index_price")
    part = (group_index.withColumns({"bucket": bucket, "_src": sources})
            .groupBy("server", "faction", "bucket", "_src")
            .agg(F.min(point).alias("first"), F.max(point).alias("last"),
                 F.max("index_price").alias("high"), F.min("index_price").alias("low"),
                 F.sum("index_price").alias("s"), F.count("index_price").alias("n"),
                 F.sum("vwap").alias("vs"), F.count("vwap").alias("vn"),
                 F.min("best_ask").alias("ask"), F.sum("offer_count").alias("offers")))
    return part.groupBy("server", "faction", "bucket").agg(
        F.min("first")["index_price"].alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max("last")["index_price"].alias("close"),
        F.try_divide(F.sum("s"), F.sum("n")).alias("avg_price"),
        F.try_divide(F.sum("vs"), F.sum("vn")).alias("vwap"),
        F.coalesce(F.min("ask"), F.lit(0.0)).alias("best_ask"),
        F.sum("offers").cast("long").alias("offer_count"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("_src")))).alias("sources"))


def text_array(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def ohlc(group_index: DataFrame, label: str, faction: str, hours: int, as_of,
         max_points: int = 500) -> DataFrame:
    """Bars of one label and faction over the last hours, oldest first."""
    chosen = since(group_index.filter((F.col("server") == label)
                                      & (F.col("faction") == text.stored_faction(F.lit(faction)))),
                   "ts", as_of, hours)
    return bars(chosen, floor_minutes(F.col("ts"), bucket_minutes(hours, max_points))).orderBy("bucket")


def price_index(current: DataFrame, servers: DataFrame, faction: str = fixed.ALL) -> DataFrame:
    """Current index of active servers with their names; 'All' means every faction."""
    names = servers.filter("is_active").select(
        F.col("id").alias("server_id"), F.col("name").alias("server_name"), "region", "version")
    if faction.lower() != "all":
        current = current.filter(F.col("faction") == text.stored_faction(F.lit(faction)))
    return lookup(current, names, "server_id", "inner").select(
        "server_name", "region", "version", "faction", "computed_at", "index_price",
        prices.index_per_1k(F.col("index_price")).alias("index_price_per_1k"),
        F.coalesce("sample_size", F.lit(0)).alias("sample_size"),
        F.coalesce("min_price", F.lit(0.0)).alias("min_price"),
        F.coalesce("max_price", F.lit(0.0)).alias("max_price"))


def price_index_order(entries: DataFrame) -> DataFrame:
    return entries.orderBy("region", "version", "server_name", "faction")


# rows older than this are dropped; the daily tier is kept for good
RETENTION = {"1m": "5 MINUTES", "5m": "7 DAYS", "1h": "2 YEARS", "raw": "1 DAY", "group": "30 DAYS"}


def expired(time: Column, table: str, as_of: Column) -> Column:
    return time < as_of - F.expr(f"INTERVAL {RETENTION[table]}")


def retention_report(df: DataFrame, time: str, table: str, as_of: Column) -> DataFrame:
    """Rows kept and deleted by a retention run."""
    gone = expired(F.col(time), table, as_of)
    return df.agg(F.count_if(~gone).alias("kept"), F.count_if(gone).alias("deleted"))
