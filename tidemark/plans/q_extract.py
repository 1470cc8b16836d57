"""Queries for landed pages, API bodies and currency conversion."""

from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.plans.catalog import VIEWS, query, view
from tidemark.sources import extract

SHOP = "https://m.example.com"

# one listing page per order: an item per line, some offline, without a price or of no realm
view("listing_lines", """
SELECT order_no, line_no, part_no, server_id, faction, amount_gold, seller, raw_price, id,
       CASE WHEN part_no % 11 = 0 THEN 'Any' ELSE concat('Realm ', server_id, ' &amp; Co') END AS realm_markup,
       CASE WHEN part_no % 11 = 0 THEN 'Any' ELSE concat('Realm ', server_id, ' & Co') END AS realm,
       CASE part_no % 5 WHEN 0 THEN '0' WHEN 1 THEN 'true' ELSE '1' END AS online,
       CASE WHEN part_no % 13 = 0 THEN 'ask' WHEN part_no % 13 = 1 THEN '0.001'
            ELSE concat(line_no, ',', lpad(CAST(part_no % 1000 AS STRING), 3, '0')) END AS price_text,
       CASE order_no % 3 WHEN 0 THEN '$' WHEN 1 THEN '€' ELSE '£' END AS unit,
       CASE WHEN part_no % 3 = 0 THEN '-' ELSE seller END AS shown_seller,
       concat(order_no, '-', line_no, lpad(CAST(part_no AS STRING), 9, '0'), lpad(CAST(server_id AS STRING), 9, '0'),
              faction, amount_gold, raw_price) AS place
FROM raw_offers
""")


def by_order(t, view_name: str):
    """The view's lines with an order's lines in one partition: lines of lineitem are shuffled, not markup.

    The partitions are not joined by their size, which says little of the work on the pages made of them.
    """
    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    offers = t.derive(VIEWS["raw_offers"], lineitem=t.lineitem.repartition(parts, "l_orderkey"))
    return t.derive(VIEWS[view_name], raw_offers=offers)


def listing_pages(t):
    item = F.concat(
        F.lit('<a href="/en/lots/offer?id='), "order_no", F.lit("-"), (F.col("part_no") % 4).cast("string"),
        F.lit('" class="tc-item lazy" data-online="'), "online", F.lit('" data-user="'), "seller",
        F.lit('"><div class="tc-server hidden">'), "realm_markup", F.lit('</div><div class="tc-side">'), "faction",
        F.lit('</div><div class="tc-user"><div class="media-user-name"><span> '), "shown_seller",
        F.lit(' </span></div></div><div class="tc-amount">'), "amount_gold",
        F.lit('</div><div class="tc-price"><div>'), "price_text", F.lit(' <span class="unit">'), "unit",
        F.lit("</span></div></div></a>"))
    lines = by_order(t, "listing_lines").groupBy("order_no").agg(
        F.sort_array(F.collect_list(F.struct("place", item.alias("item")))).alias("l"))
    head, tail = F.lit("<html><body><div class='tc-header'>list</div>"), F.lit("</body></html>")
    return lines.select(F.col("order_no").alias("page_id"), F.lit("Classic Era").alias("game_version"),
                        F.concat(head, F.array_join(F.transform("l", lambda x: x["item"]), "\n"), tail).alias("html"))


view("sql_items", """
SELECT page_id, item_id, display_server, faction, amount_gold, raw_price, seller FROM (
  SELECT page_id, item_id, display_server, faction, amount_gold, raw_price, seller,
         row_number() OVER (PARTITION BY page_id, item_id ORDER BY group_at, n) AS rn
  FROM (SELECT *, min(n) OVER (PARTITION BY page_id, display_server) AS group_at FROM (
    SELECT order_no AS page_id, concat('fp_', order_no, '-', part_no % 4) AS item_id, realm AS display_server,
           faction, amount_gold, line_no + (part_no % 1000) / 1000.0 AS raw_price,
           CASE WHEN part_no % 3 = 0 THEN seller ELSE shown_seller END AS seller, online, part_no, n
    FROM (SELECT *, row_number() OVER (PARTITION BY order_no ORDER BY place) AS n FROM listing_lines))
    WHERE online <> '0' AND part_no % 13 > 1)) WHERE rn = 1 AND display_server <> 'Any'
""", lambda t: extract.listing_items(listing_pages(t), SHOP))


@query("s7_listing_items", """
SELECT page_id, item_id AS id, display_server, faction, amount_gold, round(raw_price, 6) AS raw_price, seller
FROM sql_items""")
def _(t):
    return t.sql_items.select("page_id", "id", "display_server", "faction", "amount_gold",
                              F.round("raw_price", 6).alias("raw_price"), "seller")


@query("s7_page_links", """
SELECT page_id, CAST(n - 1 AS INT) AS link_no, href, label FROM (
  SELECT page_id, generate_subscripts(m, 1) AS n, unnest(m) AS tag,
         regexp_extract(unnest(m), 'href="([^"]*)"', 1) AS href,
         trim(regexp_replace(unnest(m), '<[^>]*>', '', 'g')) AS label
  FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a\\s*>') AS m FROM pages))""")
def _(t):
    return extract.page_links(t.pages).select("page_id", "link_no", "href", "label")


@query("s9_page_script_value", """
SELECT page_id, CASE WHEN regexp_matches(html, 'var t\\s*="([^"]*)"') THEN regexp_extract(html, 'var t\\s*="([^"]*)"', 1)
  ELSE 'none' END AS value FROM pages""")
def _(t):
    return t.pages.select("page_id", extract.script_variable(F.col("html"), "t", "none").alias("value"))


@query("s11_page_currency", """
SELECT order_no AS page_id, min(unit) AS currency FROM listing_lines GROUP BY 1""")
def _(t):
    return extract.page_currency(listing_pages(t)).select("page_id", "currency")


# script pages: one per order; visible rows for all lines but every fifth part
view("script_lines", """
SELECT order_no, line_no, part_no, server_id, faction, raw_price, order_no % 3 AS kind,
       concat(line_no, '0', part_no, '0', server_id) AS offer_no,
       concat(line_no, lpad(CAST(part_no AS STRING), 9, '0'), lpad(CAST(server_id AS STRING), 9, '0'), faction,
              raw_price) AS place,
       CASE part_no % 7 WHEN 0 THEN 'null' WHEN 1 THEN concat('-', line_no, '.5')
         ELSE concat(line_no, '.', lpad(CAST(part_no % 1000 AS STRING), 3, '0'), '1') END AS price_text,
       CASE part_no % 7 WHEN 0 THEN NULL WHEN 1 THEN -line_no - 0.5
         ELSE line_no + (part_no % 1000) / 1000.0 + 0.0001 END AS unit_price
FROM raw_offers
""")


def script_pages(t):
    entry = F.concat(F.lit("{currencyPerUnit:100.000,unitPriceListItem:"), "price_text", F.lit(",id:"), "offer_no",
                     F.lit("}"))
    row = F.when(F.col("part_no") % 5 != 0, F.concat(
        F.lit('<div class="offer-title-colum"><a id="odpUrl-'), "offer_no", F.lit('" href="/offer/'), "offer_no",
        F.lit('">x</a><div class="offer-title-lv1">EU Classic Era</div><div class="offer-title-lv2">Realm '),
        "server_id", F.when(F.col("line_no") % 2 == 0, "- ").otherwise(" - "), "faction", F.lit("</div></div>")))
    lines = by_order(t, "script_lines").groupBy("order_no", "kind").agg(
        F.sort_array(F.collect_list(F.struct("place", entry.alias("e"), row.alias("r")))).alias("l"))
    script = F.concat(F.lit("<script>var pricePerUnitTail = '"), F.when(F.col("kind") == 0, "/K Gold").otherwise("/ Gold"),
                      F.lit("';\nvar offersModel = ["), F.array_join(F.transform("l", lambda x: x["e"]), ",\n"),
                      F.when(F.col("kind") == 2, "").otherwise("]; // Game MetaNameEN\nvar metaServer = 1;"),
                      F.lit("</script>"))
    rows = F.array_join(F.transform("l", lambda x: x["r"]), "")
    return lines.select(F.col("order_no").alias("page_id"), F.lit("Classic Era").alias("version"),
                        F.when(F.col("kind") == 1, "US").alias("region"),
                        F.concat(F.lit("<html>"), script, rows, F.lit("</html>")).alias("html"))


@query("s8_script_offers", """
SELECT order_no AS page_id, offer_no AS offer_id, round(unit_price, 6) AS unit_price FROM script_lines WHERE kind <> 2
""")
def _(t):
    return extract.script_offers(script_pages(t).select("page_id", "html")).withColumn(
        "unit_price", F.round("unit_price", 6))


@query("s9_price_unit", """
SELECT DISTINCT order_no AS page_id, CASE kind WHEN 0 THEN 'per_1k' ELSE 'per_unit' END AS raw_price_unit
FROM script_lines""")
def _(t):
    return script_pages(t).select("page_id", extract.price_unit(F.col("html")).alias("raw_price_unit"))


@query("j18_script_listing", """
SELECT order_no AS page_id, offer_no AS offer_id, round(unit_price, 6) AS unit_price,
       CASE kind WHEN 0 THEN 'per_1k' ELSE 'per_unit' END AS raw_price_unit,
       CASE kind WHEN 1 THEN 'US' ELSE 'EU' END AS region, concat('Realm ', server_id) AS server_name,
       first_faction AS faction, 'Classic Era' AS version,
       concat('https://m.example.com/offer/', offer_no) AS offer_url
FROM (SELECT *, first_value(faction) OVER (PARTITION BY order_no, offer_no ORDER BY place) AS first_faction
      FROM script_lines) WHERE kind <> 2 AND unit_price > 0 AND part_no % 5 <> 0""")
def _(t):
    return extract.script_listing(script_pages(t), SHOP).withColumn("unit_price", F.round("unit_price", 6))


def payload_bodies(t, listings=None):
    """API bodies, one per order, and per version and sort where given listings have them, made of the order's lines."""
    per = [] if listings is None else ["game_version", "sort"]
    result = F.struct(
        F.col("id").alias("offer_id"), F.col("raw_title").alias("title"), F.concat(F.lit(" "), "seller").alias("username"),
        F.when(F.col("lot_size") % 9 == 0, "n/a").when(F.col("lot_size") % 9 == 1, "")
        .otherwise(F.col("raw_price").cast("string")).alias("unit_price_in_usd"),
        F.lit(1).alias("min_qty"), F.col("amount_gold").alias("available_qty"),
        F.concat(F.lit("/g"), "lot_size").alias("offer_group"), F.lit("r1 ").alias("region_id"))
    return ((t.listings if listings is None else listings).filter("source = 'g2g'")
            .groupBy(F.split_part("id", F.lit("-"), F.lit(1)).alias("body_id"), *per)
            .agg(F.to_json(F.struct(F.struct(F.collect_list(result).alias("results")).alias("payload"))).alias("body")))


@query("s10_payload_rows", """
SELECT split_part(id, '-', 1) AS body_id, id AS offer_id, raw_title AS title, seller,
       CASE WHEN lot_size % 9 = 1 THEN 0 ELSE raw_price END AS price_usd, CAST(1 AS BIGINT) AS min_qty,
       amount_gold AS available_qty, concat('/g', lot_size) AS offer_group, 'r1' AS region_id
FROM listings WHERE source = 'g2g' AND lot_size % 9 <> 0""")
def _(t):
    return extract.payload_rows(payload_bodies(t))


def titled_listings(t):
    """Listings as the API gives them: a version and a sort per answer, some titles without version, some bilingual."""
    realm = F.regexp_extract("raw_title", r"^(.+?)\s*\[", 1)
    side = F.when(F.col("raw_title").endswith("- Alliance"), "alliance").otherwise("horde")
    form, titled = F.col("lot_size") % 9, F.col("raw_title") != ""
    return t.listings.withColumns({
        "game_version": F.when(form == 8, "Retail").otherwise(F.col("game_version")),
        "sort": F.when(F.col("amount_gold") % 2 == 0, "lowest_price").otherwise("recommended"),
        "raw_title": F.when(titled & (form == 8), F.concat(F.lit("Мир ("), realm, F.lit(") - "), side))
        .when(titled & (form == 7), F.concat(realm, F.lit(" [US] - "), F.initcap(side))).otherwise(F.col("raw_title"))})


@query("s10_titled_offers", r"""
SELECT concat('g2g_', id) AS id, realm AS server_name, side AS faction, v AS game_version,
       CASE WHEN raw_title = '' THEN '' WHEN form = 8 THEN concat(realm, ' [RU - Retail] - ', side)
            WHEN form = 7 AND v = 'Classic Era' THEN concat(realm, ' [US] - ', side)
            WHEN form = 7 THEN concat(realm, ' [US - ', v, '] - ', side)
            WHEN v = 'Classic Era' THEN raw_title
            ELSE regexp_replace(raw_title, '\[([A-Z]{2,})\]', concat('[\1 - ', v, ']')) END AS raw_title,
       raw_price, CASE v WHEN 'Classic Era' THEN 'per_unit' ELSE 'per_1k' END AS raw_price_unit, amount_gold,
       CASE WHEN amount_gold % 2 = 0 THEN 'Lowest Price' ELSE 'Recommended' END AS seller
FROM (SELECT *, lot_size % 9 AS form, CASE WHEN lot_size % 9 = 8 THEN 'Retail' ELSE game_version END AS v,
             CASE WHEN raw_title = '' THEN '' ELSE regexp_extract(raw_title, '^(.+?)\s*\[', 1) END AS realm,
             CASE WHEN raw_title LIKE '%- Alliance' THEN 'Alliance' ELSE 'Horde' END AS side
      FROM listings) WHERE source = 'g2g' AND form > 1 AND raw_price > 0""")
def _(t):
    rows = extract.payload_rows(payload_bodies(t, titled_listings(t))).withColumn("fetched_at", F.lit("2024-01-01"))
    return extract.titled_offers(rows).select("id", "server_name", "faction", "game_version", "raw_title", "raw_price",
                                              "raw_price_unit", "amount_gold", "seller")


@query("j17_fx_conversion", """
SELECT id, CASE WHEN c = 'USD' THEN raw_price ELSE round(raw_price * coalesce(rate, 1), 8) END AS raw_price,
       c <> 'USD' AND rate IS NOT NULL AND epoch(fetched_at) - epoch(valid_from) >= 3600 AS stale_rate
FROM (SELECT id, raw_price, fetched_at, CASE symbol WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' ELSE 'USD' END AS c FROM
        (SELECT id, raw_price, fetched_at, CASE part_no % 3 WHEN 0 THEN '$' WHEN 1 THEN '€' ELSE '£' END AS symbol
         FROM raw_offers)) o
ASOF LEFT JOIN rates r ON o.c = r.code AND o.fetched_at >= r.valid_from""")
def _(t):
    symbol = F.when(F.col("part_no") % 3 == 0, "$").when(F.col("part_no") % 3 == 1, "€").otherwise("£")
    out = extract.in_usd(t.raw_offers.withColumn("currency", symbol), t.rates)
    return out.select("id", "raw_price", "stale_rate")


@query("j17_daily_rates", """
SELECT code, strftime(valid_from, '%Y-%m-%dT%H:%M:%SZ') AS valid_from, round(rate, 4) AS rate FROM rates""")
def _(t):
    daily = extract.daily_rates(t.rates)
    return daily.select("code", F.explode("steps").alias("s")).select(
        "code", times.utc_text(F.col("s.valid_from")).alias("valid_from"), F.round("s.rate", 4).alias("rate"))
