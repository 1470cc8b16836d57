"""Price and display columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed


def price_per_1k(raw_price: Column, unit: Column, lot_size: Column) -> Column:
    """Comparable price for 1000 units, from the raw price and its unit."""
    per_lot = raw_price / F.greatest(lot_size, F.lit(1)) * 1000.0
    return F.round(
        F.when(unit == "per_lot", per_lot).when(unit == "per_1k", raw_price)
        .otherwise(raw_price * 1000.0), 6)


def with_prices(offers: DataFrame) -> DataFrame:
    """Derive ``price_per_1k``; back-fill the raw price of rows that only carry the derived one."""
    raw, derived = F.col("raw_price"), F.coalesce(F.col("price_per_1k"), F.lit(0.0))
    has_raw = F.coalesce(raw, F.lit(0.0)) > 0
    back_fill = ~has_raw & (derived > 0)
    return offers.withColumns({
        "price_per_1k": F.when(has_raw, price_per_1k(raw, F.col("raw_price_unit"), F.col("lot_size")))
                         .otherwise(derived),
        "raw_price": F.when(back_fill, F.round(derived / 1000.0, 8)).otherwise(raw),
        "raw_price_unit": F.when(back_fill, F.lit("per_unit")).otherwise(F.col("raw_price_unit")),
        "lot_size": F.when(back_fill, F.lit(1)).otherwise(F.col("lot_size")),
    })


def display_price(per_1k: Column, unit: str = "per_1k") -> Column:
    """Price in the unit asked for: 8 decimals for one unit, 4 for a thousand."""
    return F.round(per_1k / 1000.0, 8) if unit == "per_1" else F.round(per_1k, 4)


def chart_price(per_1k: Column, unit: Column | str) -> Column:
    """Chart value for ``per_unit``, ``per_1k`` or ``per_1m``."""
    unit = F.lit(unit) if isinstance(unit, str) else unit
    return (F.when(unit == "per_unit", per_1k / 1000.0)
            .when(unit == "per_1m", per_1k * 1000.0).otherwise(per_1k))


def with_denomination(offers: DataFrame) -> DataFrame:
    """Versions quoted per thousand: the raw price already is the price per 1000."""
    per_1k = F.col("game_version").isin(*fixed.PER_1K_VERSIONS)
    return offers.withColumns({
        "raw_price_unit": F.when(per_1k, F.lit("per_1k")).otherwise(F.col("raw_price_unit")),
        "price_per_1k": F.when(per_1k, F.round("raw_price", 6)).otherwise(F.col("price_per_1k")),
    })


def is_suspicious(per_1k: Column) -> Column:
    return per_1k > fixed.SUSPICIOUS_PER_1K


def position_value(per_1k: Column, amount: Column) -> Column:
    return per_1k * (amount / 1000.0)


def is_unbounded_position(per_1k: Column, amount: Column) -> Column:
    return position_value(per_1k, amount) > fixed.POSITION_VALUE_CAP


def source_id(source: Column, raw_id: Column, href: Column, row: Column) -> Column:
    """Offer id with the prefix of its source.

    The listing source takes its id from the link. A row without any id gets a digest of
    its own content, so a re-run gives the same id.
    """
    digest = F.substring(F.sha2(row, 256), 1, 12)
    from_href = F.coalesce(F.nullif(F.regexp_extract(href, fixed.LISTING_ID, 1), F.lit("")), digest)
    own = F.coalesce(F.nullif(raw_id, F.lit("")), digest)
    return (F.when(source == "g2g", F.concat(F.lit("g2g_"), own))
            .when(source == "playerauctions", F.concat(F.lit("pa_"), own))
            .otherwise(F.concat(F.lit("fp_"), from_href)))


def offer_key(offer_id: Column, source: Column, seller: Column, price: Column, updated: Column) -> Column:
    """The id, or a composite of four fields when there is none."""
    return F.coalesce(F.nullif(offer_id, F.lit("")), F.concat_ws("::", source, seller, price, updated))


def offer_url(base: str, group: Column, region_id: Column, sort: Column) -> Column:
    """Link to the buy page of an offer group; blank input gives a blank link."""
    path = F.regexp_replace(group, "^/+", "")
    prefix = F.regexp_replace(path, r"_\d+$", "")
    # url_encode writes a space as '+'; the link needs %20
    encoded = F.replace(F.url_encode(F.concat(prefix, F.lit(":"), path)), F.lit("+"), F.lit("%20"))
    link = F.concat(F.lit(base + "?fa="), encoded, F.lit("&region_id="), region_id,
                    F.lit("&sort="), sort, F.lit("&include_offline=0"))
    blank = (F.coalesce(group, F.lit("")) == "") | (F.coalesce(region_id, F.lit("")) == "")
    return F.when(blank, F.lit("")).otherwise(link)


def best_ask_per_1k(best_ask: Column, index_price: Column) -> Column:
    return F.round(F.coalesce(best_ask, index_price) * 1000, 4)


def index_per_1k(index_price: Column) -> Column:
    return F.round(F.coalesce(index_price, F.lit(0.0)) * 1000, 4)


def spread(first: Column, second: Column) -> Column:
    return F.abs(first - second)


def spread_percent(first: Column, second: Column) -> Column:
    """Spread in percent of the dearer price, one decimal; 0 when there is no price."""
    top = F.greatest(first, second)
    return F.coalesce(F.round(F.try_divide(spread(first, second), F.when(top > 0, top)) * 100, 1),
                      F.lit(0.0))


def absolute_url(href: Column, base: str) -> Column:
    return (F.when(href.startswith("http"), href)
            .when(href.startswith("/"), F.concat(F.lit(base), href)))


def safe_url(url: Column) -> Column:
    """The link when its protocol is http or https, else null."""
    return F.when(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), url)
