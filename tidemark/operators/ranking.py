"""Deduplication, pinning, top lists and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scale import first_per_key, lookup, number_rows


def total_order(df: DataFrame, *first: Column) -> list[Column]:
    """Cheapest first, then larger amount, then id, then every other sortable column."""
    lead = list(first) or [F.col("price_per_1k"), F.col("amount_gold").desc(), F.col("id")]
    return lead + [F.col(c) for c in sorted(df.columns)]


def dedup(df: DataFrame, *first: Column) -> DataFrame:
    """One row per (source, id): the first in the given order."""
    return first_per_key(df, ["source", "id"], total_order(df, *first))


def latest_per_offer(prices: DataFrame) -> DataFrame:
    """Newest row per (source, offer_id)."""
    order = [F.col("fetched_at").desc(), *[F.col(c) for c in sorted(prices.columns)]]
    return first_per_key(prices, ["source", "offer_id"], order)


def union_first_wins(parts: list[DataFrame], key: str = "id") -> DataFrame:
    """Concatenate; of rows with the same id the one from the earliest part stays."""
    merged = None
    for i, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(i))
        merged = part if merged is None else merged.unionByName(part)
    order = [F.col("_part"), *[F.col(c) for c in sorted(parts[0].columns)]]
    return first_per_key(merged, [key], order).drop("_part")


def dedup_in_group_order(items: DataFrame, page: str, group: str, position: str,
                         key: str) -> DataFrame:
    """Per page, one row per id: the first when groups are listed by first appearance.

    All windows stay inside one page, which arrived as one record, and share one shuffle.
    """
    group_at = F.min(position).over(Window.partitionBy(page, group))
    placed = items.repartition(page).withColumn("_group_at", group_at)
    return first_per_key(placed, [page, key], [F.col("_group_at"), F.col(position)]).drop("_group_at")


def with_top_picks(offers: DataFrame, listing: str = "server_id") -> DataFrame:
    """``is_top``: the cheapest offer of its (source, faction) in the listing.

    ``id`` must be unique in the listing. The picks are a small aggregate, joined back.
    """
    src, fac = F.lower("source"), F.lower("faction")
    ranking = F.struct(F.col("price_per_1k"), (-F.col("amount_gold")).alias("neg_amount"), F.col("id"))
    picks = (offers.groupBy(listing, src.alias("_s"), fac.alias("_f"))
             .agg(F.min(ranking)["id"].alias("_pick")))
    tagged = offers.withColumns({"_s": src, "_f": fac})
    return (lookup(tagged, picks, [listing, "_s", "_f"], store=True)
            .withColumn("is_top", F.col("id") == F.col("_pick")).drop("_s", "_f", "_pick"))


def display_list(offers: DataFrame, listing: str = "server_id") -> DataFrame:
    """Top picks first by price, then all others by price, numbered from 1."""
    order = [(~F.col("is_top")).alias("_rest"), F.col("price_per_1k"),
             F.col("amount_gold").desc(), F.col("id")]
    return number_rows(with_top_picks(offers, listing), [listing], order, "rank")


def top_five(offers: DataFrame, listing: str = "server_id") -> DataFrame:
    """The 2 cheapest per source, filled up by price to 5 rows; more when there are many sources."""
    order = [F.col("price_per_1k"), F.col("amount_gold").desc(), F.col("id")]
    sure = first_per_key(offers, [listing, "source"], order, 2).withColumn("_fill", F.lit(0))
    # rows that fill up are always among the 5 cheapest of the listing
    cheap = first_per_key(offers, [listing], order, 5).withColumn("_fill", F.lit(1))
    both = first_per_key(sure.unionByName(cheap), [listing, "id"], [F.col("_fill")])
    place = F.row_number().over(Window.partitionBy(listing).orderBy("_fill", *order))
    return (both.withColumn("_place", place)
            .filter((F.col("_fill") == 0) | (F.col("_place") <= 5)).drop("_fill", "_place"))


def assign_ids(registry: DataFrame, by: str, order: list[str], base: Column) -> DataFrame:
    """Consecutive ids per ``by`` in name order, starting at ``base``."""
    return (number_rows(registry, [by], order, "_n")
            .withColumn("assigned_id", base + F.col("_n") - 1).drop("_n"))


# --- listing orders ---------------------------------------------------------------------

def by_price(offers: DataFrame) -> DataFrame:
    return offers.orderBy("price_per_1k", F.col("amount_gold").desc(), "id")


def by_amount(offers: DataFrame) -> DataFrame:
    return offers.orderBy(F.col("amount_gold").desc(), "price_per_1k", "id")


def newest(df: DataFrame, time: str, n: int, *tie: str) -> DataFrame:
    """The newest ``n`` rows, oldest first."""
    return df.orderBy(F.col(time).desc(), *tie).limit(n).orderBy(time, *tie)
