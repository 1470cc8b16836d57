"""Queries for derived columns, text functions and filters."""

from pyspark.sql import functions as F

from tidemark.functions import fixed, prices, text, times
from tidemark.operators import filters
from tidemark.plans.catalog import query, view

view("legacy_offers", """
SELECT id, order_no, line_no,
       CASE WHEN order_no % 10 = 4 THEN CAST(0 AS DOUBLE) ELSE raw_price END AS raw_price,
       raw_price_unit, lot_size,
       CASE WHEN order_no % 10 = 4 THEN floor(raw_price * 7700) / 100 ELSE CAST(0 AS DOUBLE) END AS price_per_1k
FROM raw_offers
""")

# texts in the shapes listing pages use for numbers, sellers, links and units
view("texts", """
SELECT order_no, line_no,
       CASE part_no % 6
         WHEN 0 THEN concat('$ ', part_no, '.', lpad(CAST(line_no AS STRING), 2, '0'))
         WHEN 1 THEN concat(line_no, ',', lpad(CAST(part_no % 1000 AS STRING), 3, '0'), '.5')
         WHEN 2 THEN concat(line_no, '.', lpad(CAST(part_no % 1000 AS STRING), 3, '0'), ',25 €')
         WHEN 3 THEN concat(line_no, ',', part_no % 1000, ',', line_no)
         WHEN 4 THEN concat(line_no, '.', part_no % 1000, '.', line_no)
         ELSE CASE WHEN line_no = 1 THEN 'free' ELSE concat(part_no, ' pcs') END END AS number_text,
       CASE part_no % 4 WHEN 0 THEN concat(lot_size, ' k') WHEN 1 THEN concat(line_no, ' 000')
         WHEN 2 THEN '0' ELSE 'many' END AS amount_text,
       CASE order_no % 5 WHEN 0 THEN '-' WHEN 1 THEN ' N/A' WHEN 2 THEN '' ELSE concat('  ', seller, ' ') END
         AS seller_a,
       CASE part_no % 3 WHEN 0 THEN seller WHEN 1 THEN '-' ELSE ' ' END AS seller_b,
       CASE part_no % 4 WHEN 0 THEN '$' WHEN 1 THEN '€' WHEN 2 THEN '£' ELSE '₽' END AS symbol,
       CASE part_no % 5 WHEN 0 THEN concat('/lots/offer?id=', order_no, '-', line_no)
         WHEN 1 THEN concat('https://m.example.com/o?id=', order_no) WHEN 2 THEN 'javascript:run()'
         WHEN 3 THEN concat('HTTP://m.example.com/', order_no) ELSE '' END AS href,
       concat('/lgc_', source, ' group_', order_no) AS offer_group,
       CASE WHEN part_no % 7 = 0 THEN '' ELSE concat('reg-', server_id) END AS region_id,
       CASE part_no % 5 WHEN 0 THEN '1' WHEN 1 THEN ' TRUE' WHEN 2 THEN 'Yes' WHEN 3 THEN '0' ELSE '' END AS flag,
       CASE part_no % 6 WHEN 0 THEN 'Any' WHEN 1 THEN '*' WHEN 2 THEN ' ' ELSE concat('Realm ', server_id) END
         AS realm_text,
       CASE part_no % 4 WHEN 0 THEN 'Horde' WHEN 1 THEN 'the alliance' WHEN 2 THEN 'Alliance' ELSE 'x' END
         AS side_text,
       CASE WHEN order_no % 3 = 0 THEN '' ELSE id END AS maybe_id,
       id, source, seller, raw_price, lot_size, fetched_at, server_id, faction, part_no
FROM raw_offers
""")

KEYS = ("order_no", "line_no")


# --- prices -----------------------------------------------------------------------------

@query("p1_price_per_1k", "SELECT id, raw_price, raw_price_unit, price_per_1k FROM offers")
def _(t):
    return t.offers.select("id", "raw_price", "raw_price_unit", "price_per_1k")


@query("p2_raw_back_fill", """
SELECT id,
       CASE WHEN raw_price > 0 THEN round(CASE raw_price_unit WHEN 'per_lot' THEN raw_price / lot_size * 1000
            WHEN 'per_1k' THEN raw_price ELSE raw_price * 1000 END, 6) ELSE price_per_1k END AS price_per_1k,
       CASE WHEN raw_price > 0 THEN raw_price ELSE round(price_per_1k / 1000, 8) END AS raw_price,
       CASE WHEN raw_price > 0 THEN raw_price_unit ELSE 'per_unit' END AS raw_price_unit,
       CASE WHEN raw_price > 0 THEN lot_size ELSE 1 END AS lot_size
FROM legacy_offers""")
def _(t):
    return prices.with_prices(t.legacy_offers).drop(*KEYS)


@query("p3_display_price", """
SELECT id, round(price_per_1k / 1000, 8) AS per_1, round(price_per_1k, 4) AS per_1k FROM offers""")
def _(t):
    p = F.col("price_per_1k")
    return t.offers.select("id", prices.display_price(p, "per_1").alias("per_1"),
                           prices.display_price(p).alias("per_1k"))


@query("p4_chart_price", """
SELECT id, CASE line_no % 4 WHEN 0 THEN price_per_1k / 1000 WHEN 1 THEN price_per_1k * 1000
       ELSE price_per_1k END AS chart_price FROM offers""")
def _(t):
    unit = (F.when(F.col("line_no") % 4 == 0, "per_unit").when(F.col("line_no") % 4 == 1, "per_1m")
            .otherwise("per_1k"))
    return t.offers.select("id", prices.chart_price(F.col("price_per_1k"), unit).alias("chart_price"))


@query("p5_denomination", """
SELECT id, game_version, CASE WHEN game_version <> 'Classic Era' THEN 'per_1k' ELSE raw_price_unit END
         AS raw_price_unit,
       CASE WHEN game_version <> 'Classic Era' THEN round(raw_price, 6) ELSE price_per_1k END AS price_per_1k
FROM (SELECT id, raw_price, raw_price_unit, price_per_1k,
             CASE WHEN sv_version IN ('Retail', 'MoP Classic') THEN sv_version ELSE 'Classic Era' END
               AS game_version
      FROM offers JOIN server_names ON server_id = sv_id)""")
def _(t):
    version = F.when(F.col("sv_version").isin("Retail", "MoP Classic"), F.col("sv_version")) \
        .otherwise("Classic Era")
    rows = (t.offers.join(t.server_names, F.col("server_id") == F.col("sv_id"))
            .withColumn("game_version", version))
    return prices.with_denomination(rows).select("id", "game_version", "raw_price_unit", "price_per_1k")


@query("p6_suspicious", "SELECT id, price_per_1k > 500 AS is_suspicious FROM offers")
def _(t):
    return t.offers.select("id", prices.is_suspicious(F.col("price_per_1k")).alias("is_suspicious"))


@query("p7_expensive", """
SELECT id, source = 'g2g' AND price_per_1k >= 3 * low AS is_expensive FROM offers
JOIN (SELECT server_id AS sid, min(price_per_1k) AS low FROM offers GROUP BY 1) ON server_id = sid""")
def _(t):
    from tidemark.operators.scale import lookup
    low = t.offers.groupBy("server_id").agg(F.min("price_per_1k").alias("low"))
    flag = (F.col("source") == "g2g") & (F.col("price_per_1k") >= F.col("low") * fixed.EXPENSIVE_MULTIPLE)
    return lookup(t.offers, low, "server_id").select("id", flag.alias("is_expensive"))


@query("p8_position_value", """
SELECT id, round(price_per_1k * amount_gold / 1000, 6) AS position_value,
       price_per_1k * (amount_gold / 1000.0) > 9999 AS unbounded FROM offers""")
def _(t):
    p, a = F.col("price_per_1k"), F.col("amount_gold")
    return t.offers.select("id", F.round(prices.position_value(p, a), 6).alias("position_value"),
                           prices.is_unbounded_position(p, a).alias("unbounded"))


@query("p9_source_id", """
SELECT order_no, line_no,
       CASE source WHEN 'g2g' THEN concat('g2g_', CASE WHEN maybe_id = '' THEN digest ELSE maybe_id END)
         WHEN 'playerauctions' THEN concat('pa_', CASE WHEN maybe_id = '' THEN digest ELSE maybe_id END)
         ELSE concat('fp_', CASE WHEN regexp_extract(href, 'id=([0-9-]+)', 1) = '' THEN digest
                            ELSE regexp_extract(href, 'id=([0-9-]+)', 1) END) END AS offer_id
FROM (SELECT order_no, line_no, source, maybe_id, href,
             substr(sha256(concat(order_no, '/', line_no)), 1, 12) AS digest FROM texts)""")
def _(t):
    row = F.concat(F.col("order_no"), F.lit("/"), F.col("line_no"))
    return t.texts.select(*KEYS, prices.source_id(F.col("source"), F.col("maybe_id"), F.col("href"), row)
                          .alias("offer_id"))


@query("p10_offer_key", """
SELECT order_no, line_no, CASE WHEN maybe_id <> '' THEN maybe_id
         ELSE concat(source, '::', seller, '::', part_no, '::', strftime(fetched_at, '%Y-%m-%dT%H:%M:%SZ'))
         END AS offer_key FROM texts""")
def _(t):
    return t.texts.select(*KEYS, prices.offer_key(
        F.col("maybe_id"), F.col("source"), F.col("seller"), F.col("part_no").cast("string"),
        times.utc_text(F.col("fetched_at"))).alias("offer_key"))


@query("p11_offer_url", """
SELECT order_no, line_no, CASE WHEN region_id = '' THEN '' ELSE
         concat('https://shop.example.com/group?fa=lgc_', source, '%20group%3Algc_', source, '%20group_',
                order_no, '&region_id=', region_id, '&sort=lowest_price&include_offline=0') END AS offer_url
FROM texts""")
def _(t):
    return t.texts.select(*KEYS, prices.offer_url(
        "https://shop.example.com/group", F.col("offer_group"), F.col("region_id"),
        F.lit("lowest_price")).alias("offer_url"))


@query("p12_best_ask", """
SELECT server_id, faction, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ') AS recorded_at,
       round(coalesce(best_ask, index_price) * 1000, 4) AS best_ask FROM ticks""")
def _(t):
    return t.ticks.select("server_id", "faction", times.utc_text(F.col("recorded_at")).alias("recorded_at"),
                          prices.best_ask_per_1k(F.col("best_ask"), F.col("index_price")).alias("best_ask"))


@query("p13_index_per_1k", """
SELECT event_id, round(coalesce(best_ask, 0) * 1000, 4) AS index_price_per_1k FROM raw_ticks""")
def _(t):
    return t.raw_ticks.select("event_id", prices.index_per_1k(F.col("best_ask")).alias("index_price_per_1k"))


@query("p14_spread", """
SELECT id, round(abs(a - b), 6) AS spread,
       CASE WHEN greatest(a, b) > 0 THEN round(abs(a - b) / greatest(a, b) * 100, 1) ELSE 0 END AS spread_pct,
       CASE WHEN b < a THEN 'second' ELSE 'first' END AS cheaper
FROM (SELECT id, price_per_1k * (line_no % 3) AS a, price_per_1k * (line_no % 3) * (order_no % 7) / 4 AS b
      FROM offers)
""")
def _(t):
    a = F.col("price_per_1k") * (F.col("line_no") % 3)
    rows = t.offers.select("id", a.alias("a"), (a * (F.col("order_no") % 7) / 4).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("id", F.round(prices.spread(a, b), 6).alias("spread"),
                       prices.spread_percent(a, b).alias("spread_pct"),
                       F.when(b < a, "second").otherwise("first").alias("cheaper"))


@query("p15_absolute_url", """
SELECT order_no, line_no, CASE WHEN href LIKE 'http%' THEN href
         WHEN href LIKE '/%' THEN concat('https://m.example.com', href) END AS url FROM texts""")
def _(t):
    return t.texts.select(*KEYS, prices.absolute_url(F.col("href"), "https://m.example.com").alias("url"))


@query("p16_safe_url", """
SELECT order_no, line_no, CASE WHEN lower(href) LIKE 'http://%' OR lower(href) LIKE 'https://%' THEN href END
  AS url FROM texts""")
def _(t):
    return t.texts.select(*KEYS, prices.safe_url(F.col("href")).alias("url"))


OFFER_ROW = ("id", "source", "server_name", "server_id", "faction", "price_per_1k", "price_display",
             "amount_gold", "seller", "game_version", "is_suspicious", "offer_url", "updated_at", "fetched_at")


@query("p17_offer_row", """
SELECT id, source, server_name, server_id, faction, round(price_per_1k, 4) AS price_per_1k,
       round(price_per_1k / 1000, 8) AS price_display, amount_gold, seller,
       CASE WHEN version IN ('MoP Classic', 'Retail') THEN version ELSE 'Classic Era' END AS game_version,
       price_per_1k > 500 AS is_suspicious, concat('https://m.example.com/o?id=', id) AS offer_url,
       strftime(fetched_at, '%Y-%m-%dT%H:%M:%SZ') AS updated_at,
       strftime(fetched_at, '%Y-%m-%dT%H:%M:%SZ') AS fetched_at FROM labelled""")
def _(t):
    from tidemark.plans.reports import offer_rows
    rows = t.labelled.withColumns({
        "game_version": F.when(F.col("version").isin("MoP Classic", "Retail"), F.col("version"))
        .otherwise("Classic Era"),
        "is_suspicious": prices.is_suspicious(F.col("price_per_1k")),
        "offer_url": F.concat(F.lit("https://m.example.com/o?id="), "id"),
        "updated_at": F.col("fetched_at")})
    return offer_rows(rows, "per_1")


# --- text -------------------------------------------------------------------------------

@query("n1_clean", """
SELECT order_no, line_no, lower(regexp_replace(trim(title), '\\s+', ' ', 'g')) AS cleaned FROM titles""")
def _(t):
    return t.titles.select(*KEYS, text.clean(F.col("title")).alias("cleaned"))


@query("n2_bracket_title", """
SELECT order_no, line_no,
  CASE shape WHEN 4 THEN concat('(', lower(region), ') ', version, ' - ', replace(realm, chr(39), '’'))
    WHEN 5 THEN concat('(', region, ') ', version)
    WHEN 6 THEN concat(realm, '  NA  classic era')
    WHEN 7 THEN concat('Реалм (', realm, ')') ELSE realm END AS server,
  CASE WHEN shape IN (2, 7) THEN '' WHEN shape = 6 THEN 'NA' ELSE region END AS region,
  CASE shape WHEN 0 THEN version WHEN 3 THEN 'seasonal' WHEN 2 THEN '' WHEN 7 THEN ''
    WHEN 1 THEN 'Classic' WHEN 6 THEN 'Classic'
    ELSE CASE version WHEN 'Classic Era' THEN 'Classic' WHEN 'Season of Discovery' THEN 'Seasonal'
           WHEN 'Anniversary' THEN 'Anniversary' ELSE 'Classic' END END AS version,
  CASE WHEN shape IN (3, 4) THEN 'Horde' ELSE faction END AS faction
FROM (SELECT order_no, line_no, realm, region, version, faction, (order_no + line_no) % 8 AS shape FROM titles)
""")
def _(t):
    return t.titles.select(*KEYS, text.bracket_title(F.col("title")).alias("p")).select(*KEYS, "p.*")


@query("n3_listing_label", """
SELECT order_no, line_no,
  CASE shape WHEN 4 THEN concat('(', region, ') ', known) WHEN 5 THEN concat('(', region, ') ', known)
    ELSE '' END AS label,
  CASE shape WHEN 4 THEN replace(realm, chr(39), '’') WHEN 5 THEN faction ELSE 'given' END AS server
FROM (SELECT order_no, line_no, realm, region, faction, (order_no + line_no) % 8 AS shape,
             CASE WHEN version = 'Retail' THEN 'Classic' ELSE version END AS known FROM titles)""")
def _(t):
    return (t.titles.select(*KEYS, text.listing_label(F.col("title"), F.lit("given")).alias("p"))
            .select(*KEYS, "p.*"))


@query("n4_title_label", """
SELECT order_no, line_no, CASE (order_no + line_no) % 8 WHEN 4 THEN concat('(', region, ') ', version)
    WHEN 5 THEN concat('(', region, ') ', version) ELSE 'given' END AS label FROM titles""")
def _(t):
    return t.titles.select(*KEYS, text.title_label(F.col("title"), F.lit("given")).alias("label"))


@query("n5_group_label", """
SELECT order_no, line_no, CASE line_no % 3
    WHEN 0 THEN concat('(', region, ') ', CASE WHEN order_no % 2 = 0 THEN 'Season of Discovery' ELSE version END)
    WHEN 1 THEN '' ELSE concat(realm, ' x') END AS label FROM titles""")
def _(t):
    shape = F.col("line_no") % 3
    display = (F.when(shape == 0, F.concat(
        F.lit("("), F.lower("region"), F.lit(")  "),
        F.when(F.col("order_no") % 2 == 0, "SOD").otherwise(F.col("version"))))
        .when(shape == 1, F.lower("realm")).otherwise(F.concat("realm", F.lit(" x"))))
    return t.titles.select(*KEYS, text.group_label(display, F.col("realm")).alias("label"))


@query("n6_detect_version", """
SELECT order_no, line_no, CASE
    WHEN low LIKE '%season of discovery%' OR regexp_matches(low, '\\b(sod|seasonal)\\b')
      THEN 'Season of Discovery'
    WHEN low LIKE '%anniversary%' THEN 'Anniversary' WHEN low LIKE '%mop classic%' THEN 'MoP Classic'
    WHEN low LIKE '%classic era%' THEN 'Classic Era' WHEN low LIKE '%hardcore%' THEN 'Hardcore'
    ELSE 'Classic' END AS version
FROM (SELECT order_no, line_no, lower(title) AS low FROM titles)""")
def _(t):
    return t.titles.select(*KEYS, text.detect_version(F.col("title")).alias("version"))


_ALIASES_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in fixed.VERSION_ALIASES.items()) + ")"


@query("n7_version_alias", f"""
SELECT order_no, line_no, coalesce(canonical, given) AS version FROM (
  SELECT order_no, line_no, concat(' ', upper(word), ' ') AS given, word
  FROM (SELECT order_no, line_no, CASE line_no WHEN 1 THEN 'sod' WHEN 2 THEN 'era' WHEN 3 THEN 'tww'
          WHEN 4 THEN 'mists of pandaria' WHEN 5 THEN 'unknown one' ELSE lower(version) END AS word FROM titles))
LEFT JOIN (SELECT a, canonical FROM {_ALIASES_SQL} AS m(a, canonical)) ON a = word""")
def _(t):
    n = F.col("line_no")
    word = (F.when(n == 1, "sod").when(n == 2, "era").when(n == 3, "tww").when(n == 4, "mists of pandaria")
            .when(n == 5, "unknown one").otherwise(F.lower("version")))
    given = F.concat(F.lit(" "), F.upper(word), F.lit(" "))
    return t.titles.select(*KEYS, text.canonical_version(given).alias("version"))


@query("n8_registry_version", """
SELECT order_no, line_no, CASE
    WHEN regexp_matches(title, '(?i)season\\s+of\\s+discovery|\\bseasonal\\b|\\bsod\\b')
      THEN 'Season of Discovery'
    WHEN lower(title) LIKE '%anniversary%' THEN 'Anniversary'
    WHEN regexp_matches(title, '(?i)classic\\s+era') THEN 'Classic Era'
    WHEN regexp_matches(title, '(?i)\\bclassic\\b') THEN 'Classic' ELSE trim(title) END AS version FROM titles""")
def _(t):
    return t.titles.select(*KEYS, text.registry_version(F.col("title")).alias("version"))


@query("n9_registry_region", """
SELECT order_no, line_no, CASE WHEN region = 'US' THEN 'US' ELSE region END AS region FROM titles""")
def _(t):
    raw = F.concat(F.lit(" "), F.lower(F.when(F.col("region") == "US", "na").otherwise(F.col("region"))))
    return t.titles.select(*KEYS, text.registry_region(raw).alias("region"))


@query("n10_apostrophes", """
SELECT order_no, line_no, replace(replace(title, '’', chr(39)), '‘', chr(39)) AS title FROM titles""")
def _(t):
    return t.titles.select(*KEYS, text.fold_apostrophes(F.col("title")).alias("title"))


@query("n11_inject_version", """
SELECT order_no, line_no, CASE WHEN game_version <> 'Classic Era' AND (order_no + line_no) % 8 = 1
    THEN concat(realm, ' [', region, ' - ', game_version, '] - ', faction) ELSE title END AS title FROM titles""")
def _(t):
    return t.titles.select(*KEYS, text.inject_version(F.col("title"), F.col("game_version")).alias("title"))


@query("n12_latin_title", """
SELECT order_no, line_no, CASE WHEN game_version = 'Retail' AND (order_no + line_no) % 8 = 7
    THEN concat(realm, ' [RU - Retail] - ', faction) ELSE title END AS title FROM titles""")
def _(t):
    return t.titles.select(*KEYS, text.latin_title(F.col("title"), F.col("game_version")).alias("title"))


@query("n13_realm_faction", """
SELECT order_no, line_no, concat(realm, '-x') AS server,
       CASE WHEN line_no % 3 = 2 THEN '' ELSE faction END AS faction FROM titles""")
def _(t):
    sep = F.when(F.col("line_no") % 3 == 0, " - ").when(F.col("line_no") % 3 == 1, "- ").otherwise(" ")
    pair = F.concat("realm", F.lit("-x"), sep, F.when(F.col("line_no") % 3 == 2, "").otherwise(F.col("faction")))
    return t.titles.select(*KEYS, text.realm_faction(pair).alias("p")).select(*KEYS, "p.*")


@query("n14_first_token_region", """
SELECT order_no, line_no, CASE region WHEN 'OCE' THEN 'OC' ELSE region END AS region FROM titles""")
def _(t):
    lv1 = F.concat(F.lit(" "), F.when(F.col("region") == "OCE", "Oceania").otherwise(F.col("region")),
                   F.lit("  "), "version")
    return t.titles.select(*KEYS, text.first_token_region(lv1).alias("region"))


@query("n15_parse_number", """
SELECT order_no, line_no, CASE part_no % 6
    WHEN 0 THEN CAST(concat(part_no, '.', lpad(CAST(line_no AS STRING), 2, '0')) AS DOUBLE)
    WHEN 1 THEN line_no * 1000 + part_no % 1000 + 0.5
    WHEN 2 THEN line_no * 1000 + part_no % 1000 + 0.25
    WHEN 3 THEN CAST(concat(line_no, part_no % 1000, '.', line_no) AS DOUBLE)
    WHEN 4 THEN CAST(concat(line_no, part_no % 1000, '.', line_no) AS DOUBLE)
    ELSE CASE WHEN line_no = 1 THEN NULL ELSE CAST(part_no AS DOUBLE) END END AS number FROM texts""")
def _(t):
    return t.texts.select(*KEYS, text.parse_number(F.col("number_text")).alias("number"))


@query("n16_parse_amount", """
SELECT order_no, line_no, CASE part_no % 4 WHEN 0 THEN CAST(lot_size AS BIGINT)
    WHEN 1 THEN CAST(line_no * 1000 AS BIGINT) ELSE 1 END AS amount FROM texts""")
def _(t):
    return t.texts.select(*KEYS, text.parse_amount(F.col("amount_text")).alias("amount"))


@query("n17_seller", """
SELECT order_no, line_no, CASE WHEN order_no % 5 > 2 OR part_no % 3 = 0 THEN seller ELSE 'unknown' END AS seller
FROM texts""")
def _(t):
    return t.texts.select(*KEYS, text.seller_name(F.col("seller_a"), F.col("seller_b")).alias("seller"))


@query("n18_faction", """
SELECT order_no, line_no, CASE WHEN part_no % 4 IN (1, 2) THEN 'Alliance' ELSE 'Horde' END AS faction FROM texts
""")
def _(t):
    return t.texts.select(*KEYS, text.faction_or_default(F.col("side_text")).alias("faction"))


@query("n19_stored_faction", """
SELECT order_no, line_no, CASE WHEN line_no % 3 = 0 THEN 'All' ELSE faction END AS faction FROM texts""")
def _(t):
    given = F.when(F.col("line_no") % 3 == 0, "aLL").when(F.col("line_no") % 3 == 1, F.upper("faction")) \
        .otherwise(F.lower("faction"))
    return t.texts.select(*KEYS, text.stored_faction(given).alias("faction"))


@query("n20_alias_key", """
SELECT id, faction, CASE
    WHEN source = 'g2g' THEN CASE WHEN raw_title <> '' THEN raw_title END
    WHEN source IN ('funpay', 'playerauctions') AND display_server LIKE '(%) %'
      THEN concat(replace(display_server, '’', chr(39)), ' - x')
    END AS alias_key FROM listings""")
def _(t):
    key = text.alias_key(F.col("source"), F.col("raw_title"), F.col("display_server"), F.lit("x"),
                         F.col("faction"))
    return t.listings.select("id", "faction", key.alias("alias_key"))


@query("n21_server_slug", """
SELECT order_no, line_no, lower(name) AS slug,
       CASE WHEN shape IN (4, 5) THEN concat(name, ' (', CASE shape WHEN 4 THEN lower(region) ELSE region END, ')')
         ELSE name END AS display
FROM (SELECT order_no, line_no, region, (order_no + line_no) % 8 AS shape, CASE (order_no + line_no) % 8
        WHEN 0 THEN faction WHEN 1 THEN faction WHEN 2 THEN faction
        WHEN 3 THEN concat(realm, '[', lower(region), ' -  seasonal ]')
        WHEN 4 THEN replace(realm, chr(39), '’') WHEN 5 THEN faction WHEN 6 THEN upper(faction)
        ELSE lower(faction) END AS raw_name,
        regexp_replace(CASE (order_no + line_no) % 8
        WHEN 0 THEN faction WHEN 1 THEN faction WHEN 2 THEN faction
        WHEN 3 THEN 'seasonal ]'
        WHEN 4 THEN replace(realm, chr(39), '’') WHEN 5 THEN faction WHEN 6 THEN upper(faction)
        ELSE lower(faction) END, '#\\S+\\s*', '', 'g') AS name FROM titles)""")
def _(t):
    return t.titles.select(*KEYS, text.server_slug(F.col("title")).alias("p")).select(*KEYS, "p.*")


@query("n22_canonical_label", """
SELECT id, concat('(', region, ') ', version, CASE WHEN realm_type = 'Hardcore' THEN ' · Hardcore' ELSE '' END)
  AS label FROM servers""")
def _(t):
    return t.servers.select("id", text.canonical_label(F.col("region"), F.col("version"), F.col("realm_type"))
                            .alias("label"))


@query("n23_group_label_guard", """
SELECT order_no, line_no, title FROM titles WHERE regexp_matches(title, '^\\([A-Z]{2,}\\)\\s+\\S')""")
def _(t):
    return t.titles.filter(text.is_group_label(F.col("title"))).select(*KEYS, "title")


@query("n24_game_version", """
SELECT id, CASE WHEN version IN ('MoP Classic', 'Retail') THEN version ELSE 'Classic Era' END AS game_version
FROM labelled""")
def _(t):
    return t.labelled.select("id", text.game_version_of(F.col("display_server")).alias("game_version"))


@query("n25_version_rank", """
SELECT id, CASE WHEN display_server LIKE '%Season of Discovery · Hardcore%' THEN 110
    WHEN display_server LIKE '%Anniversary · Hardcore%' THEN 100
    WHEN display_server LIKE '%Season of Discovery%' THEN 20
    WHEN display_server LIKE '%Classic · Hardcore%' THEN 130
    WHEN display_server LIKE '%Anniversary%' THEN 10 WHEN display_server LIKE '%MoP Classic%' THEN 0
    WHEN display_server LIKE '%Classic%' THEN 40 WHEN display_server LIKE '%Retail%' THEN 5
    ELSE 99 END AS version_rank FROM labelled""")
def _(t):
    return t.labelled.select("id", text.version_rank(F.col("display_server")).alias("version_rank"))


@query("n26_split_label", """
SELECT order_no, line_no, CASE WHEN shape IN (4, 5) THEN region END AS region,
       CASE shape WHEN 4 THEN concat(version, ' - ', replace(realm, chr(39), '’'))
         WHEN 5 THEN concat(version, ' - ', realm, ' - ', faction) END AS version
FROM (SELECT order_no, line_no, region, version, realm, faction, (order_no + line_no) % 8 AS shape FROM titles)
""")
def _(t):
    return t.titles.select(*KEYS, text.split_label(F.col("title")).alias("p")).select(*KEYS, "p.*")


@query("n27_rebuilt_label", """
SELECT order_no, line_no, CASE (order_no + line_no) % 8 WHEN 0 THEN concat('(', region, ') ', version)
    WHEN 3 THEN concat('(', region, ') Season of Discovery') END AS label,
  CASE WHEN (order_no + line_no) % 8 IN (0, 3) THEN realm END AS server FROM titles""")
def _(t):
    return t.titles.select(*KEYS, text.rebuilt_label(F.col("title")).alias("p")).select(*KEYS, "p.*")


@query("n28_prefixed_label", """
SELECT order_no, line_no, CASE WHEN line_no % 4 = 3 THEN bare
    WHEN trim(bare) = '' THEN concat('(', 'EU', ') ', game_version)
    ELSE concat('(', CASE WHEN bare = 'Gordunni' AND line_no % 4 = 1 AND game_version = 'Retail' THEN 'RU'
                     ELSE 'EU' END, ') ', game_version, ' - ', trim(bare)) END AS label
FROM (SELECT order_no, line_no, game_version, CASE WHEN order_no % 5 = 0 THEN 'Gordunni'
             WHEN order_no % 5 = 1 THEN ' ' ELSE concat(' ', realm) END AS bare FROM titles)""")
def _(t):
    bare = F.when(F.col("order_no") % 5 == 0, "Gordunni").when(F.col("order_no") % 5 == 1, " ") \
        .otherwise(F.concat(F.lit(" "), "realm"))
    kind = F.col("line_no") % 4
    return t.titles.select(*KEYS, text.prefixed_label(
        bare, F.when(kind == 3, "EU+US+RU").otherwise("EU"), F.col("game_version"),
        F.when(kind == 1, 2).otherwise(146)).alias("label"))


@query("n29_currency", """
SELECT order_no, line_no, CASE symbol WHEN '€' THEN 'EUR' WHEN '£' THEN 'GBP' ELSE 'USD' END AS code FROM texts
""")
def _(t):
    return t.texts.select(*KEYS, text.currency_code(F.col("symbol")).alias("code"))


@query("n30_utc_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts_text FROM events")
def _(t):
    return t.events.select("event_id", times.utc_text(F.col("ts").cast("timestamp")).alias("ts_text"))


@query("n31_floor_5_minutes", """
SELECT event_id, strftime(date_trunc('hour', ts) + INTERVAL '1' MINUTE * (minute(ts) // 5 * 5),
       '%Y-%m-%dT%H:%M:%SZ') AS bucket FROM events""")
def _(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", times.floor_5_minutes(ts).alias("w")).select(
        "event_id", times.utc_text(F.col("w")).alias("bucket"))


@query("n32_adaptive_floor", """
SELECT event_id, strftime(date_trunc('minute', ts) - INTERVAL '1' MINUTE * (minute(ts) % 25),
         '%Y-%m-%dT%H:%M:%SZ') AS bucket_25,
       strftime(date_trunc('minute', ts) - INTERVAL '1' MINUTE * (minute(ts) % 86),
         '%Y-%m-%dT%H:%M:%SZ') AS bucket_86 FROM events""")
def _(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", times.utc_text(times.floor_minutes(ts, 25)).alias("bucket_25"),
                           times.utc_text(times.floor_minutes(ts, times.bucket_minutes(720, 500)))
                           .alias("bucket_86"))


@query("n33_hour_day_floor", """
SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') AS hour,
       strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ') AS day FROM events""")
def _(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", times.utc_text(times.TIER_FLOORS["1h"](ts)).alias("hour"),
                           times.utc_text(times.TIER_FLOORS["1d"](ts)).alias("day"))


@query("n34_flat_list", """
SELECT event_id, coalesce(source_text, '') AS sources,
       CAST(CASE WHEN source_text IS NULL THEN 0 WHEN source_text LIKE '%,%' THEN 2 ELSE 1 END AS INT) AS n
FROM group_index""")
def _(t):
    nested = F.transform(F.split("source_text", ","), lambda s: F.array(s))
    flat = text.flat_list(nested)
    return t.group_index.select("event_id", F.array_join(flat, ",").alias("sources"), F.size(flat).alias("n"))


@query("n35_realm_sources_map", """
SELECT display_server, string_agg(concat(server_name, '=', sources), ';' ORDER BY server_name) AS realm_sources
FROM (SELECT display_server, server_name, string_agg(DISTINCT source, '+' ORDER BY source) AS sources
      FROM labelled GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    from tidemark.operators.indexes import sidebar_groups
    entries = F.array_sort(F.map_entries("realm_sources"))
    shown = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+")))
    return sidebar_groups(t.labelled).select("display_server", F.array_join(shown, ";").alias("realm_sources"))


# --- filters ----------------------------------------------------------------------------

@query("f1_offer_filter", """
SELECT id, server_name, display_server, faction FROM labelled
WHERE display_server = '(EU) Anniversary' AND faction = 'Horde'""")
def _(t):
    return filters.offers_matching(t.labelled, " (eu)   ANNIVERSARY", None, "horde").select(
        "id", "server_name", "display_server", "faction")


@query("f2_row_validity", """
SELECT id, CASE WHEN order_no % 10 = 0 THEN 'unknown_source' WHEN order_no % 10 = 1 THEN 'price_not_positive'
    WHEN order_no % 10 = 2 THEN 'amount_not_positive' WHEN order_no % 10 = 3 THEN 'time_missing'
    ELSE 'valid' END AS reason FROM offers""")
def _(t):
    k = F.col("order_no") % 10
    rows = t.offers.withColumns({
        "source": F.when(k == 0, "other").otherwise(F.col("source")),
        "price_per_1k": F.when(k == 1, 0.0).otherwise(F.col("price_per_1k")),
        "amount_gold": F.when(k == 2, 0).otherwise(F.col("amount_gold")),
        "updated_at": F.when(k != 3, F.col("fetched_at"))})
    good = filters.valid_rows(rows).select("id", F.lit("valid").alias("reason"))
    return good.unionByName(filters.invalid_rows(rows).select("id", "reason"))


@query("f3_online", "SELECT order_no, line_no FROM texts WHERE part_no % 5 < 3")
def _(t):
    return t.texts.filter(filters.online(F.col("flag"))).select(*KEYS)


@query("f4_real_realm", """
SELECT order_no, line_no FROM texts WHERE part_no % 6 > 2 OR (part_no % 6 > 0 AND line_no % 2 = 0)""")
def _(t):
    version = F.when(F.col("line_no") % 2 == 1, "Retail").otherwise("Classic Era")
    return t.texts.filter(filters.is_real_realm(F.col("realm_text"), version)).select(*KEYS)


@query("f5_price_floor", """
SELECT order_no, line_no FROM texts WHERE raw_price / 50 > 0.001 AND round(raw_price / 50 * 1000, 6) >= 0.01
  AND line_no <> 7""")
def _(t):
    price = F.when(F.col("line_no") != 7, F.col("raw_price") / 50)
    return t.texts.filter(filters.plausible_price(price)).select(*KEYS)


@query("f6_in_stock", "SELECT order_no, line_no FROM texts WHERE raw_price > 0.2 AND lot_size > 5")
def _(t):
    return t.texts.filter(filters.in_stock(F.col("raw_price") - 0.2, F.col("lot_size") - 5)).select(*KEYS)


@query("f7_well_formed", """
SELECT order_no, line_no FROM texts WHERE part_no % 4 IN (0, 2) AND part_no % 6 <> 2 AND raw_price > 0.3""")
def _(t):
    return t.texts.filter(filters.well_formed(F.trim("realm_text"), F.col("side_text"),
                                              F.col("raw_price") - 0.3)).select(*KEYS)


@query("f8_source_subset", "SELECT id, source FROM offers WHERE source IN ('g2g', 'funpay')")
def _(t):
    return filters.from_sources(t.offers, ["g2g", "funpay"]).select("id", "source")


@query("f9_time_range", """
SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-25 12:00:00' - INTERVAL '1' HOUR * 168""")
def _(t):
    as_of = F.lit("2024-01-25 12:00:00").cast("timestamp")
    rows = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return filters.since(rows, "ts", as_of, 168).select("event_id")


@query("f10_active", "SELECT id, name FROM servers WHERE is_active")
def _(t):
    return filters.active(t.servers).select("id", "name")


@query("f11_search", """
SELECT display_server, string_agg(server_name, ',' ORDER BY server_name) AS realms, on_realm AS highlight FROM (
  SELECT display_server, server_name, server_name LIKE '%4%' AS hit,
         max(CASE WHEN server_name LIKE '%4%' THEN 1 ELSE 0 END) OVER (PARTITION BY display_server) = 1 AS on_realm
  FROM (SELECT DISTINCT display_server, server_name FROM labelled))
WHERE hit OR NOT on_realm AND regexp_replace(display_server, '^\\([^)]*\\)\\s*', '') LIKE '%4%'
GROUP BY display_server, on_realm""")
def _(t):
    from tidemark.operators.indexes import sidebar_groups
    found = filters.search_groups(sidebar_groups(t.labelled), " 4 ")
    return found.select("display_server", F.array_join("realms", ",").alias("realms"), "highlight")


@query("f12_positive_asks", "SELECT event_id, best_ask FROM raw_ticks WHERE best_ask > 0")
def _(t):
    return filters.positive_asks(t.raw_ticks).select("event_id", "best_ask")

