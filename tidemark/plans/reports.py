"""Read API: one function per question a client asks. Tables in, result table out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed, prices, times
from tidemark.operators import filters, history, indexes, quality, ranking, resolve

OFFER_COLUMNS = ("id", "source", "server_name", "server_id", "faction", "price_per_1k", "price_display",
                 "amount_gold", "seller", "game_version", "is_suspicious", "offer_url", "updated_at",
                 "fetched_at")


def offer_rows(offers: DataFrame, price_unit: str = "per_1k") -> DataFrame:
    """Offers in output form: fixed columns, rounded prices, UTC text times."""
    return offers.withColumns({
        "price_display": prices.display_price(F.col("price_per_1k"), price_unit),
        "price_per_1k": F.round("price_per_1k", 4),
        "updated_at": times.utc_text(F.col("updated_at")),
        "fetched_at": times.utc_text(F.col("fetched_at"))}).select(*OFFER_COLUMNS)


def offers(all_offers: DataFrame, label: str | None = None, faction: str | None = None,
           sort_by: str = "price", realm: str | None = None, price_unit: str = "per_1k") -> DataFrame:
    found = filters.offers_matching(all_offers, label, realm, faction)
    return offer_rows(ranking.by_price(found) if sort_by == "price" else ranking.by_amount(found), price_unit)


def servers(all_offers: DataFrame) -> DataFrame:
    """Sidebar groups in display order, minimum price from the group index where there is one."""
    return indexes.sidebar_order(indexes.sidebar_groups(all_offers, indexes.group_index(all_offers)))


def price_index(current: DataFrame, registry: DataFrame, faction: str = fixed.ALL) -> DataFrame:
    return history.price_index_order(history.price_index(current, registry, faction))


def index_of(all_indexes: DataFrame, server: str, faction: str = fixed.ALL, region: str | None = None,
             version: str | None = None) -> DataFrame:
    """The index row of a realm (with region and version) from ``indexes.index_for_realms``."""
    found = all_indexes.filter((F.col("server_name") == server) & (F.col("faction") == faction))
    if region and version:
        found = found.filter((F.col("region") == region.upper()) & (F.col("version") == version))
    return found


def price_history(tiers: Mapping[str, DataFrame], registry: DataFrame, realm: str, region: str,
                  version: str, faction: str, hours: int, as_of, last: int = 500) -> DataFrame:
    return history.history_by_name(tiers, registry, realm, region, version, faction, hours, as_of, last)


def current_point(all_offers: DataFrame, as_of: Column, label: str | None = None,
                  faction: str | None = None) -> DataFrame:
    return indexes.market_point(all_offers, as_of, label, faction)


def ohlc(group_index: DataFrame, label: str, faction: str, hours: int, as_of, max_points: int = 500
         ) -> DataFrame:
    return history.ohlc(group_index, label, faction, hours, as_of, max_points)


def meta(updates: DataFrame) -> DataFrame:
    return indexes.data_version(updates)


def quarantine(rejected: DataFrame) -> DataFrame:
    return quality.quarantine_tail(rejected)


def unresolved(tagged: DataFrame) -> DataFrame:
    return quality.unresolved_titles(tagged).orderBy(F.col("count").desc(), "raw_title")


def alias_coverage(all_offers: DataFrame, aliases: DataFrame, source: str = "funpay") -> DataFrame:
    return resolve.alias_coverage(all_offers.filter(F.col("source") == source), aliases).orderBy("alias_text")
