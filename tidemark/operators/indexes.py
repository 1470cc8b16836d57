"""Price indexes, profiles, sidebar groups and market statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fixed, prices, text
from tidemark.operators.filters import offers_matching
from tidemark.operators.scale import lookup, median, order_statistics
from tidemark.session import materialize


def faction_fan_out(df: DataFrame) -> DataFrame:
    """Every row under its own faction and under 'All'."""
    return df.withColumn("group_faction", F.explode(F.array("faction", F.lit(fixed.ALL))))


def _cheapest(offers: DataFrame, keys: list[str]) -> DataFrame:
    return offers.filter("price_per_1k > 0").groupBy(*keys, "source", "faction").agg(
        F.min("price_per_1k").alias("price"))


def server_index(offers: DataFrame) -> DataFrame:
    """Index per (server_id, faction or All), prices per unit.

    Cheapest offer per (source, faction); sources whose mean is above twice the lowest mean
    are left out; mean, min, max and count of the rest. Offers belong to a faction whatever the
    case, picks are per exact name. The minimum is taken before the
    'All' fan-out, so the shuffle carries one row per (server, source, faction) and task.
    """
    picks = _cheapest(offers.filter("server_id IS NOT NULL"), ["server_id"]).withColumn(
        "group_faction", F.explode(F.array(text.stored_faction(F.col("faction")), F.lit(fixed.ALL))))
    per_source = picks.groupBy("server_id", "group_faction", "source").agg(
        F.sum("price").alias("total"), F.count("price").alias("n"),
        F.min("price").alias("low"), F.max("price").alias("high"))
    mean = F.col("total") / F.col("n")
    lowest = F.min(mean).over(Window.partitionBy("server_id", "group_faction"))
    kept = (per_source.withColumn("lowest", lowest)
            .filter(mean <= F.col("lowest") * fixed.PLATFORM_EXCLUSION))
    unit = lambda c: F.round(c / 1000.0, 8)
    return (kept.groupBy("server_id", F.col("group_faction").alias("faction"))
            .agg(unit(F.sum("total") / F.sum("n")).alias("index_price"),
                 unit(F.min("low")).alias("best_ask"),
                 F.sum("n").alias("sample_size"),
                 unit(F.min("low")).alias("min_price"),
                 unit(F.max("high")).alias("max_price")))


def group_index(offers: DataFrame, keys: tuple[str, ...] = ("display_server",)) -> DataFrame:
    """Index per (label, faction or All), prices per 1000.

    One cheapest offer per (source, faction) whatever the case; none for groups with fewer
    than two offers or two picks. Offers without a price count as offers only.
    """
    keys = list(keys)
    low = offers.withColumns({"_src": F.lower("source"), "_fac": F.lower("faction")})
    priced = F.col("price_per_1k") > 0
    best = F.min(F.when(priced, F.struct(F.col("price_per_1k").alias("price"),
                                         (-F.col("amount_gold")).alias("neg_amount"),
                                         F.col("source").alias("source"))))
    picks = (low.groupBy(*keys, "faction", "_src", "_fac")
             .agg(best.alias("best"), F.count(F.lit(1)).alias("offers")))
    fanned = (picks.withColumn("group_faction", F.explode(F.array("faction", F.lit(fixed.ALL))))
              .groupBy(*keys, "group_faction", "_src", "_fac")
              .agg(F.min("best").alias("best"), F.sum("offers").alias("offers")))
    price = F.col("best.price")
    r6 = lambda c: F.round(c, 6)
    out = fanned.groupBy(*keys, F.col("group_faction").alias("faction")).agg(
        r6(F.avg(price)).alias("index_price"), r6(F.avg(price)).alias("vwap"),
        r6(F.min(price)).alias("best_ask"), r6(F.min(price)).alias("price_min"),
        r6(F.max(price)).alias("price_max"), F.count(price).alias("offer_count"),
        F.sum(-F.col("best.neg_amount")).cast("long").alias("total_volume"),
        F.sort_array(F.collect_set("best.source")).alias("sources"),
        F.sum("offers").alias("_offers"))
    return out.filter("_offers >= 2 AND offer_count >= 2").drop("_offers")


def market_point(offers: DataFrame, as_of: Column, label: str | None = None,
                 faction: str | None = None) -> DataFrame:
    """One index point over the filtered offers; empty when the market is too thin."""
    chosen = offers_matching(offers, label, None, faction).withColumn("_all", F.lit(1))
    return (group_index(chosen, ("_all",)).filter(F.col("faction") == fixed.ALL)
            .select(as_of.alias("timestamp"), F.col("index_price").alias("price"),
                    F.col("price_min").alias("min"), F.col("price_max").alias("max"),
                    F.col("offer_count").alias("count")))


# --- profiles ---------------------------------------------------------------------------

def position_of(q: float) -> Column:
    """0-based position of quantile ``q``: floor(n * q), kept inside the list."""
    total = F.col("total")
    return F.greatest(F.lit(0), F.least(total - 1, F.floor(total * q)))


def price_quantiles(offers: DataFrame, quantiles: dict[str, float],
                    min_sample: int = fixed.PROFILE_MIN_SAMPLE) -> DataFrame:
    """Exact quantiles per (server_id, faction or All) with at least ``min_sample`` offers."""
    usable = offers.filter("server_id IS NOT NULL AND price_per_1k > 0")
    # equal prices are summed ahead of the one shuffle that follows, under 'All' too
    fanned = faction_fan_out(usable.select("server_id", "faction", "price_per_1k"))
    stats = order_statistics(fanned, ["server_id", "group_faction"], "price_per_1k",
                             {name: position_of(q) for name, q in quantiles.items()})
    return stats.filter(F.col("n") >= min_sample).withColumnRenamed("group_faction", "faction")


def price_profiles(offers: DataFrame) -> DataFrame:
    return (price_quantiles(offers, {"p25": 0.25, "median": 0.50, "p75": 0.75})
            .withColumnRenamed("n", "sample_size"))


def profile_stats(profiles: DataFrame, refreshed_at: Column, as_of: Column) -> DataFrame:
    age = F.round(F.unix_micros(as_of) / 1e6 - F.unix_micros(refreshed_at) / 1e6, 1)
    return profiles.agg(F.count_distinct("server_id").alias("server_count"),
                        F.count(F.lit(1)).alias("total_profiles"),
                        F.max(age).alias("refreshed_ago_s")) \
        .withColumn("is_stale", F.col("refreshed_ago_s") > fixed.PROFILE_STALE_SECONDS)


def with_profile(offers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profile of (server, faction), else of (server, All)."""
    cols = ["p25", "median", "p75", "sample_size"]
    profiles = materialize(profiles, "profiles")
    own = profiles.select("server_id", F.col("faction"), F.struct(*cols).alias("_own"))
    whole = (profiles.filter(F.col("faction") == fixed.ALL)
             .select("server_id", F.struct(*cols).alias("_whole")))
    joined = lookup(lookup(offers, own, ["server_id", "faction"]), whole, ["server_id"])
    return joined.withColumn("profile", F.coalesce("_own", "_whole")).drop("_own", "_whole")


# --- groups and statistics --------------------------------------------------------------

def min_price_override(groups: DataFrame, index: DataFrame) -> DataFrame:
    """Minimum price := best ask of All, else Alliance, else Horde, else the minimum itself."""
    asks = (index.groupBy("display_server")
            .pivot("faction", [fixed.ALL, "Alliance", "Horde"]).agg(F.first("best_ask")))
    return (groups.join(asks, "display_server", "left")
            .withColumn("min_price", F.coalesce("All", "Alliance", "Horde", "min_price"))
            .drop("All", "Alliance", "Horde"))


def sidebar_groups(offers: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Per label: realms, realm -> sources, minimum price, game version, rank."""
    usable = offers.filter(text.is_group_label(F.col("display_server")) & (F.col("price_per_1k") > 0))
    per_source = (usable.groupBy("display_server", "server_name", "source")
                  .agg(F.min("price_per_1k").alias("min_price")))
    per_realm = per_source.groupBy("display_server", "server_name").agg(
        F.sort_array(F.collect_set("source")).alias("sources"), F.min("min_price").alias("min_price"))
    named = F.coalesce(F.col("server_name"), F.lit("")) != ""
    entry = F.when(named, F.struct(F.col("server_name").alias("key"), F.col("sources").alias("value")))
    groups = per_realm.groupBy("display_server").agg(
        F.sort_array(F.collect_list(entry)).alias("_entries"), F.min("min_price").alias("min_price"))
    if index is not None:
        groups = min_price_override(groups, index)
    return groups.select(
        "display_server",
        F.transform("_entries", lambda e: e["key"]).alias("realms"),
        F.map_from_entries("_entries").alias("realm_sources"),
        F.round("min_price", 4).alias("min_price"),
        text.game_version_of(F.col("display_server")).alias("game_version"),
        text.version_rank(F.col("display_server")).alias("version_rank"))


def sidebar_order(groups: DataFrame) -> DataFrame:
    return groups.orderBy("version_rank", "min_price", "display_server")


def version_groups(groups: DataFrame) -> DataFrame:
    """Sidebar groups per game version, with the fixed position of the version."""
    v = F.coalesce(text.blank_to_null(F.col("game_version")), F.lit(fixed.DEFAULT_GAME_VERSION))
    place = F.array_position(F.array(*[F.lit(x) for x in fixed.GAME_VERSION_ORDER]), v)
    return (groups.groupBy(v.alias("game_version"), place.alias("position"))
            .agg(F.count(F.lit(1)).alias("groups"), F.min("min_price").alias("min_price"))
            .filter("position > 0"))


def multi_source_realms(groups: DataFrame) -> DataFrame:
    return (groups.select("display_server", F.explode("realm_sources").alias("realm", "sources"))
            .withColumn("is_multi_source", F.size("sources") > 1))


def source_summary(offers: DataFrame) -> DataFrame:
    return (offers.filter("coalesce(source, '') <> ''").groupBy("source")
            .agg(F.count(F.lit(1)).alias("offers"), F.min("price_per_1k").alias("min_price")))


def market_stats(offers: DataFrame) -> DataFrame:
    """One row: counts and best price of two sources, their spread, median, total amount."""
    valid = offers.filter("price_per_1k > 0")
    of = lambda s: F.col("source") == s
    best = lambda s: F.min(F.when(of(s), F.col("price_per_1k")))
    sums = valid.agg(F.count_if(of("funpay")).alias("funpay_count"),
                     F.count_if(of("g2g")).alias("g2g_count"),
                     best("funpay").alias("best_funpay"), best("g2g").alias("best_g2g"),
                     F.sum("amount_gold").cast("long").alias("total_gold"))
    a, b = F.col("best_g2g"), F.col("best_funpay")
    mid = median(valid.withColumn("_all", F.lit(1)), ["_all"], "price_per_1k").drop("_all", "n")
    return (sums.join(F.broadcast(mid), how="left")  # one row each
            .withColumn("spread", prices.spread(a, b))
            .withColumn("winner", F.when(a < b, "G2G").when(a.isNotNull() & b.isNotNull(), "FunPay"))
            .withColumn("spread_pct", F.when(F.col("spread").isNotNull(), prices.spread_percent(a, b))))


def cheapest_per_realm(offers: DataFrame, keys: tuple[str, ...] = ("region", "server_name", "faction")
                       ) -> DataFrame:
    """Cheapest row per key, the lowest id on ties."""
    rest = [c for c in offers.columns if c not in keys]
    pick = F.min(F.struct(F.col("unit_price"), F.col("offer_id"),
                          *[F.col(c) for c in rest if c not in ("unit_price", "offer_id")]))
    return offers.groupBy(*keys).agg(pick.alias("_pick")).select(*keys, "_pick.*")


def data_version(updates: DataFrame) -> DataFrame:
    return updates.agg(F.max("last_update").alias("last_update"))


def source_status(cycles: DataFrame) -> DataFrame:
    """Per source, from a log (source, cycle, finished_at, offers, error).

    Offers and last update come from the newest successful cycle, the error from the newest.
    """
    good = F.col("offers") > 0
    return cycles.groupBy("source").agg(
        F.coalesce(F.max(F.when(good, F.struct("cycle", "offers")))["offers"], F.lit(0)).alias("offers"),
        F.max(F.when(good, F.col("finished_at"))).alias("last_update"),
        F.count_if(good).alias("version"),
        F.max(F.struct("cycle", "error"))["error"].alias("last_error"))


def index_for_realms(offers: DataFrame, per_server: DataFrame, per_group: DataFrame,
                     servers: DataFrame) -> DataFrame:
    """Index of every (realm, region, version, faction): the server's own, else its group's.

    The group index is spread over the realms that have offers in the group.
    """
    label = text.split_label(F.col("display_server"))
    realms = faction_fan_out(offers.filter("coalesce(server_name, '') <> ''")
                             .select("display_server", "server_name", "faction").distinct())
    realms = (realms.select("display_server", "server_name", F.col("group_faction").alias("faction"),
                            label.alias("_l")).distinct().filter("_l.region IS NOT NULL"))
    spread = (realms.join(per_group, ["display_server", "faction"])
              .select("server_name", "_l.region", "_l.version", "faction",
                      F.col("index_price").alias("group_index"),
                      F.col("best_ask").alias("group_ask")))
    named = servers.select(
        F.col("id").alias("server_id"), F.col("name").alias("server_name"), "region",
        F.concat("version", F.when(F.col("realm_type") == "Hardcore", fixed.HARDCORE_SUFFIX)
                 .otherwise("")).alias("version"))
    own = (lookup(per_server, named, "server_id", "inner")
           .groupBy("server_name", "region", "version", "faction")
           .agg(F.min("index_price").alias("own_index"), F.min("best_ask").alias("own_ask")))
    keys = ["server_name", "region", "version", "faction"]
    spread = spread.groupBy(*keys).agg(F.min("group_index").alias("group_index"),
                                       F.min("group_ask").alias("group_ask"))
    return spread.join(own, keys, "full").select(
        *keys,
        F.round(F.coalesce(F.col("own_index") * 1000, "group_index"), 6).alias("index_price"),
        F.round(F.coalesce(F.col("own_ask") * 1000, "group_ask"), 6).alias("best_ask"),
        F.col("own_index").isNotNull().alias("per_server"))
