"""Landed pages and API bodies to rows, with native string and JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fixed, prices, text
from tidemark.operators import filters
from tidemark.operators.ranking import dedup_in_group_order
from tidemark.operators.scale import as_of, first_per_key, once
from tidemark.sources.markup import FIELDS as ITEM_FIELDS
from tidemark.sources.markup import class_pattern, page_items


def segments(html: Column, class_name: str) -> Column:
    """The page cut in front of every element of a class; what precedes the first is dropped."""
    parts = F.split(html, rf"(?i)(?=<\w+\b[^>]*{class_pattern(class_name)})")
    return F.filter(parts, lambda p: p.rlike(rf"(?i)^<\w+\b[^>]*{class_pattern(class_name)}"))


def plain(markup: Column) -> Column:
    """Text of a markup fragment: tags removed, common entities decoded, trimmed."""
    out = F.regexp_replace(markup, r"<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return text.strip(out)


def element_text(html: Column, class_name: str) -> Column:
    """Text of the first element of a class, '' without one."""
    pattern = rf"(?is)<(\w+)\b[^>]*{class_pattern(class_name)}[^>]*>(.*?)</\1\s*>"
    # the name alone is found faster, and most often it is absent; (?i) folds A-Z only, as lower() does for ASCII
    named = F.lower(html).contains(class_name)
    return F.when(named, plain(F.regexp_extract(html, pattern, 2))).otherwise("")


def attribute(html: Column, name: str) -> Column:
    """Value of an attribute of the first tag, '' without it."""
    head = F.regexp_extract(html, r"(?s)^<[^>]*>", 0)
    return plain(F.regexp_extract(head, rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1))


def listing_items(pages: DataFrame, base_url: str) -> DataFrame:
    """pages(page_id, html, game_version, ...) -> one valid row per online listing item.

    Bad prices, offline items and catch-all realms are dropped. Of items with the same id
    the first stays, with items listed by realm.
    """
    rest = [c for c in pages.columns if c != "html"]
    items = (once(pages, _items=page_items(F.col("html").cast("binary")))
             .select(*rest, F.posexplode("_items").alias("item_no", "item")))
    items = items.select(*rest, "item_no", *[F.col(f"item.{c}").cast("string").alias(f"_{c}") for c in ITEM_FIELDS])
    items = items.filter(filters.online(F.col("_online")))
    href = F.col("_href")
    rows = once(items, _raw_price=text.parse_number(F.col("_price"))).select(
        *rest, "item_no", F.coalesce(text.blank_to_null(F.col("_server")), F.lit("Unknown")).alias("display_server"),
        text.faction_or_default(F.col("_side")).alias("faction"),
        text.parse_amount(F.col("_amount")).alias("amount_gold"),
        F.col("_raw_price").alias("raw_price"),
        text.seller_name(F.col("_user"), F.col("_seller"), F.col("_data_seller"), F.col("_data_user"),
                         F.col("_data_username")).alias("seller"),
        F.when(href != "", F.coalesce(prices.absolute_url(href, base_url), href)).alias("offer_url"),
        prices.source_id(F.lit("funpay"), F.lit(""), href, F.col("_markup")).alias("id"))
    rows = rows.filter(filters.plausible_price(F.col("raw_price"))).withColumn(
        "is_suspicious", prices.is_suspicious(F.round(F.col("raw_price") * 1000.0, 6)))
    unique = dedup_in_group_order(rows, "page_id", "display_server", "item_no", "id")
    return unique.filter(filters.is_real_realm(F.col("display_server"), F.col("game_version")))


def page_currency(pages: DataFrame) -> DataFrame:
    """Unit symbol of the first price of the page, '$' without one."""
    price = F.regexp_extract("html", rf"(?is)<\w+\b[^>]*{class_pattern('tc-price')}[^>]*>.*?"
                                     rf"<(\w+)\b[^>]*{class_pattern('unit')}[^>]*>(.*?)</\1\s*>", 2)
    return pages.withColumn("currency", F.coalesce(text.blank_to_null(plain(price)), F.lit("$")))


MODEL_SCHEMA = "array<struct<id:string,unitPriceListItem:string,currencyPerUnit:string>>"


def script_offers(pages: DataFrame) -> DataFrame:
    """Rows of the page's ``offersModel`` script array; no marker or bad JSON -> no rows."""
    start, end = "var offersModel = [", "var metaServer"
    html = F.col("html")
    tail = F.when(html.contains(start), F.concat(F.lit("["), F.substr(
        html, F.instr(html, start) + F.lit(len(start)))))
    body = F.when(tail.contains(end), F.substring_index(tail, end, 1))
    array = F.regexp_extract(body, r"(?s)^(.*\])", 1)
    model = F.from_json(array, MODEL_SCHEMA, {"allowUnquotedFieldNames": "true"})
    rest = [c for c in pages.columns if c != "html"]
    return (pages.select(*rest, F.explode(model).alias("m"))
            .select(*rest, F.col("m.id").alias("offer_id"),
                    F.col("m.unitPriceListItem").try_cast("double").alias("unit_price")))


def price_unit(html: Column) -> Column:
    """'per_1k' when the page's price tail mentions K, else 'per_unit'."""
    pattern = r"var pricePerUnitTail\s*=\s*'([^']*)'"
    tail = F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1)).otherwise("/ Gold")
    return F.when(tail.contains("K"), "per_1k").otherwise("per_unit")


def title_rows(pages: DataFrame, base_url: str) -> DataFrame:
    """Visible rows of a page: offer id, the two title lines, link."""
    parts = pages.select("page_id", F.posexplode(segments(F.col("html"), "offer-title-colum"))
                         .alias("row_no", "part"))
    link = F.regexp_extract("part", r"""(?is)<\w+\b[^>]*\bid\s*=\s*["']odpUrl-[^"']+["'][^>]*>""", 0)
    rows = parts.select("page_id", "row_no",
                        F.regexp_extract(link, r"""id\s*=\s*["']odpUrl-([^"']+)["']""", 1).alias("offer_id"),
                        element_text(F.col("part"), "offer-title-lv1").alias("lv1"),
                        element_text(F.col("part"), "offer-title-lv2").alias("lv2"),
                        prices.absolute_url(attribute(link, "href"), base_url).alias("offer_url"))
    return first_per_key(rows.filter("offer_id <> ''"), ["page_id", "offer_id"], [F.col("row_no")]) \
        .drop("row_no")


def script_listing(pages: DataFrame, base_url: str) -> DataFrame:
    """Script rows joined with the visible rows of the same page; malformed rows dropped.

    pages(page_id, html, version, region): the region is read from the title when null.
    """
    model = script_offers(pages.select("page_id", "html"))
    about = pages.select("page_id", "version", F.col("region").alias("page_region"),
                         price_unit(F.col("html")).alias("raw_price_unit"))
    rows = model.join(title_rows(pages, base_url), ["page_id", "offer_id"]).join(about, "page_id")
    split = text.realm_faction(F.col("lv2"))
    rows = rows.withColumns({
        "server_name": split["server"], "faction": split["faction"],
        "region": F.coalesce("page_region", text.first_token_region(F.col("lv1")))})
    return (rows.filter(filters.well_formed(F.col("server_name"), F.col("faction"), F.col("unit_price")))
            .select("page_id", "offer_id", "unit_price", "raw_price_unit", "region", "server_name",
                    "faction", "version", "offer_url"))


PAYLOAD_SCHEMA = """payload struct<results: array<struct<
    offer_id: string, title: string, username: string, unit_price_in_usd: string, min_qty: string,
    available_qty: string, offer_group: string, region_id: string, relation_id: string>>>"""


def payload_rows(bodies: DataFrame) -> DataFrame:
    """API bodies (column ``body``) -> typed offer rows; rows with unreadable numbers are dropped."""
    rest = [c for c in bodies.columns if c != "body"]
    parsed = bodies.withColumn("_j", F.from_json("body", PAYLOAD_SCHEMA))
    rows = parsed.select(*rest, F.explode("_j.payload.results").alias("r"))

    def number(name: str, default: float) -> Column:
        c = F.col(f"r.{name}")
        given = F.coalesce(c, F.lit("")) != ""
        value = c.try_cast("double")
        return F.when(given & (value != 0), value).when(given, value + default).otherwise(default)

    rows = rows.select(
        *rest, F.col("r.offer_id").alias("offer_id"), F.coalesce("r.title", F.lit("")).alias("title"),
        text.strip(F.col("r.username")).alias("seller"),
        number("unit_price_in_usd", 0.0).alias("price_usd"), number("min_qty", 1.0).alias("_min"),
        number("available_qty", 0.0).alias("_available"),
        text.strip(F.col("r.offer_group")).alias("offer_group"),
        text.strip(F.col("r.region_id")).alias("region_id"))
    rows = rows.filter("price_usd IS NOT NULL AND _min IS NOT NULL AND _available IS NOT NULL")
    return (rows.withColumn("price_usd", F.greatest("price_usd", F.lit(0.0)))
            .withColumn("min_qty", F.col("_min").cast("long"))
            .withColumn("available_qty", F.col("_available").cast("long")).drop("_min", "_available"))


def discovered_pairs(rows: DataFrame) -> DataFrame:
    """Distinct (offer_group, region_id) without blanks."""
    return (rows.select(text.strip(F.col("offer_group")).alias("offer_group"),
                        text.strip(F.col("region_id")).alias("region_id"))
            .filter("offer_group <> '' AND region_id <> ''").dropDuplicates())


def titled_offers(rows: DataFrame, skip_quantity: bool = False) -> DataFrame:
    """API rows (with game_version, sort, fetched_at) -> raw offers with parsed titles."""
    rows = rows.filter(filters.in_stock(F.col("price_usd"), F.col("available_qty"), skip_quantity))
    title = text.latin_title(text.inject_version(F.col("title"), F.col("game_version")),
                             F.col("game_version"))
    parsed = text.bracket_title(title)
    return rows.select(
        F.concat(F.lit("g2g_"), "offer_id").alias("id"), F.lit("g2g").alias("source"),
        parsed["server"].alias("server_name"), F.lit("").alias("display_server"),
        title.alias("raw_title"), "game_version", parsed["faction"].alias("faction"),
        F.col("price_usd").alias("raw_price"),
        F.when(F.col("game_version").isin(*fixed.PER_1K_VERSIONS), "per_1k").otherwise("per_unit")
        .alias("raw_price_unit"),
        F.lit(1).alias("lot_size"), F.greatest("available_qty", F.lit(1)).alias("amount_gold"),
        F.when(F.col("sort") == "lowest_price", "Lowest Price").otherwise("Recommended").alias("seller"),
        "fetched_at")


# --- currencies -------------------------------------------------------------------------

def daily_rates(rates: DataFrame) -> DataFrame:
    """rates(code, valid_from, rate) -> one row per code and calendar day.

    ``carry`` is the last rate before the day, ``steps`` the rates that start on the day.
    """
    per_day = (rates.groupBy("code", F.to_date("valid_from").alias("day"))
               .agg(F.array_sort(F.collect_set(F.struct("valid_from", "rate"))).alias("steps")))
    along = Window.partitionBy("code").orderBy("day")
    spans = (per_day.withColumn("_next", F.lead("day").over(along))
             .withColumn("_carry", F.lag(F.element_at("steps", -1)).over(along)))
    own = spans.select("code", "day", F.col("_carry").alias("carry"), "steps")
    gaps = (spans.filter(F.col("_next") > F.date_add("day", 1))
            .select("code", F.explode(F.sequence(F.date_add("day", 1), F.date_sub("_next", 1))).alias("day"),
                    F.element_at("steps", -1).alias("carry")))
    gaps = gaps.withColumn("steps", F.lit(None).cast(own.schema["steps"].dataType))
    return own.unionByName(gaps)


def in_usd(offers: DataFrame, rates: DataFrame) -> DataFrame:
    """Raw prices in USD at the last rate at or before ``fetched_at``; 1.0 without one.

    Offers and rates are merged in order of (code, time). Offers in USD or without a currency need no
    rate and pass by.
    """
    tagged = offers.withColumn("code", text.currency_code(F.col("currency")))
    foreign = F.coalesce(F.col("code") != "USD", F.lit(False))
    found = as_of(tagged.filter(foreign), rates.select("code", "valid_from", "rate"), "code", "fetched_at", "valid_from", "_rate")
    age = F.unix_timestamp("fetched_at") - F.unix_timestamp("_rate.valid_from")
    found = found.withColumns({
        "rate": F.coalesce("_rate.rate", F.lit(1.0)),
        "stale_rate": F.coalesce(age >= fixed.RATE_FRESH_SECONDS, F.lit(False))}).drop("_rate")
    own = tagged.filter(~foreign).withColumns({"rate": F.lit(1.0), "stale_rate": F.lit(False)})
    price = F.when(F.col("rate") != 1.0, F.round(F.col("raw_price") * F.col("rate"), 8)).otherwise(F.col("raw_price"))
    return (found.unionByName(own).withColumn("raw_price", price)
            .withColumn("price_per_1k", F.round(F.col("raw_price") * 1000.0, 6)))


# --- generic pages ----------------------------------------------------------------------

def page_links(pages: DataFrame) -> DataFrame:
    """Every link of a page with its text; links without an http(s) or site address get no url."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), F.lit(0))
    links = pages.select("page_id", "url", F.posexplode(found).alias("link_no", "link"))
    host = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    href = attribute(F.col("link"), "href")
    return links.select("page_id", "link_no", href.alias("href"), plain(F.col("link")).alias("label"),
                        F.when(href.startswith("/"), F.concat(host, href))
                        .when(href.startswith("http"), href).alias("target"))


def script_variable(html: Column, name: str, default: str) -> Column:
    """Text value of ``var name = '..'`` or "..", else the default."""
    pattern = rf"""var {name}\s*=\s*(["'])(.*?)\1"""
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 2)).otherwise(default)
