"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed, text


def offers_matching(offers: DataFrame, label: str | None = None, realm: str | None = None,
                    faction: str | None = None) -> DataFrame:
    """Optional label, realm (both compared cleaned) and faction (any case)."""
    if label:
        offers = offers.filter(text.clean(F.col("display_server")) == text.clean(F.lit(label)))
    if realm:
        offers = offers.filter(text.clean(F.col("server_name")) == text.clean(F.lit(realm)))
    if faction:
        offers = offers.filter(F.lower("faction") == faction.lower())
    return offers


def invalid_reason() -> Column:
    """Why a raw row is not a valid offer, or null."""
    return (F.when(~F.coalesce(F.col("source").isin(*fixed.SOURCES), F.lit(False)), "unknown_source")
            .when(F.coalesce(F.col("price_per_1k"), F.lit(0.0)) <= 0, "price_not_positive")
            .when(F.coalesce(F.col("amount_gold"), F.lit(0)) <= 0, "amount_not_positive")
            .when(F.col("updated_at").isNull() | F.col("fetched_at").isNull(), "time_missing"))


def valid_rows(offers: DataFrame) -> DataFrame:
    return offers.filter(invalid_reason().isNull())


def invalid_rows(offers: DataFrame) -> DataFrame:
    return offers.withColumn("reason", invalid_reason()).filter("reason IS NOT NULL")


def online(flag: Column) -> Column:
    return F.lower(text.strip(flag)).isin(*fixed.ONLINE_FLAGS)


def is_real_realm(name: Column, game_version: Column) -> Column:
    """False for catch-all names: 'any', and for Retail also '*' and ''."""
    n = F.lower(text.strip(name))
    return ~((n == "any") | ((game_version == "Retail") & n.isin("*", "")))


def plausible_price(lot_price: Column) -> Column:
    return F.coalesce((lot_price > fixed.MIN_LOT_PRICE)
                      & (F.round(lot_price * 1000.0, 6) >= fixed.MIN_PER_1K), F.lit(False))


def in_stock(price: Column, quantity: Column, skip_quantity: bool = False) -> Column:
    ok = price > 0
    return F.coalesce(ok if skip_quantity else ok & (quantity > 0), F.lit(False))


def well_formed(realm: Column, faction: Column, unit_price: Column) -> Column:
    return F.coalesce((realm != "") & faction.isin(*fixed.FACTIONS) & (unit_price > 0), F.lit(False))


def from_sources(offers: DataFrame, enabled: Sequence[str] | None) -> DataFrame:
    return offers if enabled is None else offers.filter(F.col("source").isin(*enabled))


def since(df: DataFrame, time: str, as_of, hours: int) -> DataFrame:
    """Rows strictly newer than ``as_of`` minus ``hours``; a table by ``date`` is read from that day on."""
    cut = (as_of if isinstance(as_of, Column) else F.lit(as_of)) - F.expr(f"INTERVAL {int(hours)} HOURS")
    if "date" in df.columns:
        df = df.filter(F.col("date") >= F.to_date(cut))
    return df.filter(F.col(time) > cut)


def active(servers: DataFrame) -> DataFrame:
    return servers.filter("is_active")


def search_groups(groups: DataFrame, query: str) -> DataFrame:
    """Groups whose label (region left out) or realms contain the query.

    Realm hits narrow the realm list; a hit on the label alone keeps all realms.
    """
    q = query.strip().lower()
    if not q:
        return groups.withColumn("highlight", F.lit(False))
    hits = F.filter("realms", lambda r: F.lower(r).contains(q))
    on_label = F.lower(text.without_region(F.col("display_server"))).contains(q)
    return (groups.withColumn("_hits", hits).filter((F.size("_hits") > 0) | on_label)
            .withColumn("highlight", F.size("_hits") > 0)
            .withColumn("realms", F.when(F.size("_hits") > 0, F.col("_hits")).otherwise(F.col("realms")))
            .drop("_hits"))


def positive_asks(points: DataFrame, column: str = "best_ask") -> DataFrame:
    return points.filter(F.col(column) > 0)
