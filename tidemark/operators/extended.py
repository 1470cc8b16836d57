"""Further market measures: volume-weighted prices, outliers, ranges, re-routing, KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fixed
from tidemark.operators.indexes import price_quantiles
from tidemark.operators.scale import cumulative, first_per_key, lookup, median, same_key
from tidemark.session import materialize


def _priced(offers: DataFrame) -> DataFrame:
    return offers.filter("price_per_1k > 0")


def volume_median(offers: DataFrame, keys: list[str]) -> DataFrame:
    """Price at which the cumulative amount reaches half of the total."""
    half = F.col("total") / 2
    cum = cumulative(_priced(offers), keys, "price_per_1k", F.col("amount_gold"),
                     (F.col("bin_upto") >= half) & (F.col("bin_before") < half))
    return cum.filter(F.col("upto") >= half).groupBy(*keys).agg(F.min("v").alias("volume_median"))


def capped_vwap(offers: DataFrame, keys: list[str], cap: float = fixed.VWAP_VOLUME_CAP) -> DataFrame:
    """Mean price weighted by amount over the cheapest ``cap`` units; the last lot is clipped."""
    cum = cumulative(_priced(offers), keys, "price_per_1k", F.col("amount_gold"), F.col("bin_before") < cap)
    taken = F.least(F.col("w"), F.lit(cap) - F.col("before"))
    return (cum.filter(F.col("before") < cap).groupBy(*keys)
            .agg((F.sum(F.col("v") * taken) / F.sum(taken)).alias("vwap"),
                 F.sum(taken).cast("long").alias("volume")))


def liquid_ask(offers: DataFrame, keys: list[str], volume: float = fixed.LIQUID_VOLUME) -> DataFrame:
    """Price at which ``volume`` units can be bought; groups that never reach it are absent."""
    cum = cumulative(_priced(offers), keys, "price_per_1k", F.col("amount_gold"),
                     (F.col("bin_upto") >= volume) & (F.col("bin_before") < volume))
    return cum.filter(F.col("upto") >= volume).groupBy(*keys).agg(F.min("v").alias("liquid_ask"))


def without_outliers(offers: DataFrame, keys: list[str], multiple: float = fixed.OUTLIER_MULTIPLE
                     ) -> DataFrame:
    """Offers at no more than ``multiple`` times the median of their group."""
    mid = median(_priced(offers), keys, "price_per_1k").drop("n")
    return (same_key(_priced(offers), materialize(mid, "side"), keys)
            .filter(F.col("price_per_1k") <= F.col("median") * multiple).drop("median"))


def top_n_mean(offers: DataFrame, keys: list[str], n: int = fixed.INDEX_TOP_N) -> DataFrame:
    """Mean of the ``n`` cheapest offers."""
    cheap = first_per_key(offers.filter("price_per_1k > 0"), keys,
                          [F.col("price_per_1k"), F.col("id")], n)
    return cheap.groupBy(*keys).agg(F.avg("price_per_1k").alias("top_mean"),
                                    F.count(F.lit(1)).alias("sample_size"))


def price_range_reason(offers: DataFrame) -> DataFrame:
    """Adds ``reason`` for prices outside [p10 / 10, p90 * 10] of their profile."""
    q = materialize(price_quantiles(offers, {"p10": 0.10, "p90": 0.90}), "bounds")
    bounds = F.struct((F.col("p10") * 0.1).alias("low"), (F.col("p90") * 10.0).alias("high"))
    own = q.select("server_id", "faction", bounds.alias("_own"))
    whole = q.filter(F.col("faction") == fixed.ALL).select("server_id", bounds.alias("_whole"))
    joined = lookup(lookup(offers, own, ["server_id", "faction"]), whole, "server_id")
    limit = F.coalesce("_own", "_whole")
    outside = ~F.col("price_per_1k").between(limit["low"], limit["high"])
    return joined.withColumn("reason", F.when(outside, "price_out_of_range")).drop("_own", "_whole")


def rerouted(offers: DataFrame, servers: DataFrame, profiles: DataFrame, min_gap: float = 0.20,
             max_distance: float = 0.30) -> DataFrame:
    """Sets ``routed_id`` for offers with only a realm name and region.

    Applies to realms with 2 or 3 active candidates whose medians are all more than
    ``min_gap`` apart; the nearest median must lie within ``max_distance`` of itself.
    """
    mids = profiles.filter(F.col("faction") == fixed.ALL).select("server_id", "median")
    names = servers.filter("is_active").select(F.lower("name").alias("realm"), "region",
                                               F.col("id").alias("server_id"))
    several = names.groupBy("realm", "region").agg(F.count(F.lit(1)).alias("n")).filter("n BETWEEN 2 AND 3")
    sets = (names.join(several.drop("n"), ["realm", "region"]).join(mids, "server_id")
            .groupBy("realm", "region")
            .agg(F.sort_array(F.collect_list(F.struct("median", "server_id"))).alias("c"))
            .filter(F.size("c") >= 2))
    gaps = F.transform(F.slice("c", 2, 2), lambda x, i: x["median"] > F.col("c")[i]["median"] * (1 + min_gap))
    sets = sets.filter(F.forall(gaps, lambda g: g))
    joined = lookup(offers, sets, ["realm", "region"], store=True)
    distance = F.transform("c", lambda x: F.struct(
        F.abs(F.col("price_per_1k") - x["median"]).alias("d"), x["server_id"].alias("server_id"),
        x["median"].alias("median")))
    best = F.array_min(distance)
    return joined.withColumn("routed_id", F.when(
        best["d"] <= best["median"] * max_distance, best["server_id"])).drop("c")


def kpis(tagged: DataFrame) -> DataFrame:
    """Quarantine rate, alias coverage, liquid entities, overlap of two sources."""
    rows = tagged.agg((F.count_if(F.col("reason").isNotNull()) / F.count(F.lit(1))).alias("quarantine_rate"),
                      (F.count("server_id") / F.count(F.lit(1))).alias("alias_coverage"))
    ok = tagged.filter("reason IS NULL AND server_id IS NOT NULL")
    per_entity = ok.groupBy("server_id").agg(F.count(F.lit(1)).alias("offers"))
    liquid = per_entity.agg(F.count_if(F.col("offers") > 2).alias("liquid_entities"),
                            F.count(F.lit(1)).alias("entities"))
    of = lambda s: ok.filter(F.col("source") == s).select("server_id")
    both = of("g2g").intersect(of("funpay")).agg(F.count(F.lit(1)).alias("overlap"))
    # one row each
    return (rows.crossJoin(F.broadcast(liquid)).crossJoin(F.broadcast(both))
            .withColumn("cross_source_overlap", F.try_divide("overlap", "entities")).drop("overlap"))


def spikes(ticks: DataFrame, multiple: float = fixed.OUTLIER_MULTIPLE) -> DataFrame:
    """Flags prices above ``multiple`` times the median of the last earlier day with ticks."""
    keys = ["server_id", "faction"]
    days = ticks.withColumn("day", F.to_date("recorded_at"))
    mids = median(days, [*keys, "day"], "index_price").drop("n")
    recent = mids.withColumn("recent_median", F.lag("median").over(
        Window.partitionBy(*keys).orderBy("day"))).drop("median")
    return (lookup(days, recent, [*keys, "day"], store=True)
            .withColumn("is_spike", F.coalesce(
                F.col("index_price") > F.col("recent_median") * multiple, F.lit(False))))

