"""Queries for indexes, profiles, groups, listing orders and ranks."""

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import times
from tidemark.operators import indexes, ranking
from tidemark.operators.indexes import faction_fan_out
from tidemark.plans.catalog import query, view
from tidemark.session import new_path
from tidemark.sources import tables

# cheapest offer per (server, source, faction), under its faction and under All
view("sql_picks", """
SELECT server_id, source, faction, CASE WHEN whole = 1 THEN 'All' ELSE faction END AS gf, price
FROM (SELECT server_id, source, faction, min(price_per_1k) AS price FROM offers
      WHERE price_per_1k > 0 GROUP BY 1, 2, 3), (VALUES (0), (1)) AS v(whole)
""")

view("sql_server_index", """
SELECT server_id, gf AS faction, round(sum(total) / sum(n) / 1000, 8) AS index_price,
       round(min(low) / 1000, 8) AS best_ask, CAST(sum(n) AS BIGINT) AS sample_size,
       round(min(low) / 1000, 8) AS min_price, round(max(high) / 1000, 8) AS max_price
FROM (SELECT server_id, gf, total, n, low, high, avg_price, min(avg_price) OVER (PARTITION BY server_id, gf) AS lowest
      FROM (SELECT server_id, gf, source, sum(price) AS total, count(*) AS n, avg(price) AS avg_price,
                   min(price) AS low, max(price) AS high
            FROM sql_picks GROUP BY server_id, gf, source))
WHERE avg_price <= 2 * lowest GROUP BY server_id, gf
""", lambda t: indexes.server_index(t.offers))

view("sql_group_index", """
SELECT display_server, faction, round(avg(price), 6) AS index_price, round(avg(price), 6) AS vwap,
       round(min(price), 6) AS best_ask, round(min(price), 6) AS price_min, round(max(price), 6) AS price_max,
       count(*) AS offer_count, CAST(sum(amount) AS BIGINT) AS total_volume,
       string_agg(DISTINCT source, ',' ORDER BY source) AS sources
FROM (SELECT display_server, CASE WHEN whole = 1 THEN 'All' ELSE faction END AS faction, source, price, amount
      FROM (SELECT display_server, faction, source, price_per_1k AS price, amount_gold AS amount,
                   row_number() OVER (PARTITION BY display_server, faction, source
                                      ORDER BY price_per_1k, amount_gold DESC) AS rn
            FROM labelled), (VALUES (0), (1)) AS v(whole) WHERE rn = 1)
GROUP BY 1, 2 HAVING count(*) >= 2
""", lambda t: indexes.group_index(t.labelled))

view("sql_profiles", """
SELECT server_id, gf AS faction, max(CASE WHEN rn = floor(n * 0.25) + 1 THEN price_per_1k END) AS p25,
       max(CASE WHEN rn = floor(n * 0.5) + 1 THEN price_per_1k END) AS median,
       max(CASE WHEN rn = floor(n * 0.75) + 1 THEN price_per_1k END) AS p75, max(n) AS sample_size
FROM (SELECT server_id, gf, price_per_1k, row_number() OVER (PARTITION BY server_id, gf ORDER BY price_per_1k)
               AS rn, count(*) OVER (PARTITION BY server_id, gf) AS n
      FROM (SELECT server_id, price_per_1k, CASE WHEN whole = 1 THEN 'All' ELSE faction END AS gf
            FROM offers, (VALUES (0), (1)) AS v(whole)))
GROUP BY 1, 2 HAVING max(n) >= 3
""", lambda t: indexes.price_profiles(t.offers))


@query("a1_faction_fan_out", """
SELECT server_id, gf AS group_faction, count(*) AS offers, min(price_per_1k) AS low, max(price_per_1k) AS high
FROM (SELECT server_id, price_per_1k, CASE WHEN whole = 1 THEN 'All' ELSE faction END AS gf
      FROM offers, (VALUES (0), (1)) AS v(whole)) GROUP BY 1, 2""")
def _(t):
    per_faction = t.offers.groupBy("server_id", "faction").agg(
        F.count(F.lit(1)).alias("offers"), F.min("price_per_1k").alias("low"), F.max("price_per_1k").alias("high"))
    return faction_fan_out(per_faction).groupBy("server_id", "group_faction").agg(
        F.sum("offers").alias("offers"), F.min("low").alias("low"), F.max("high").alias("high"))


@query("a2_group_index", "SELECT * FROM sql_group_index")
def _(t):
    return t.sql_group_index.withColumn("sources", F.array_join("sources", ","))


@query("a3_server_index", "SELECT * FROM sql_server_index")
def _(t):
    return t.sql_server_index


@query("a4_price_profile", "SELECT * FROM sql_profiles")
def _(t):
    return t.sql_profiles


@query("a5_profile_stats", """
SELECT count(DISTINCT server_id) AS server_count, count(*) AS total_profiles, CAST(900.0 AS DOUBLE) AS refreshed_ago_s,
       TRUE AS is_stale FROM sql_profiles""")
def _(t):
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return indexes.profile_stats(t.sql_profiles, at, at + F.expr("INTERVAL 15 MINUTES"))


_GROUPS = """
SELECT display_server, string_agg(DISTINCT server_name, ',' ORDER BY server_name) AS realms,
       round(min(price_per_1k), 4) AS min_price FROM labelled GROUP BY 1"""


@query("a6_sidebar_groups", f"""
SELECT display_server, realms, coalesce(ask, min_price) AS min_price,
       CASE WHEN display_server LIKE '%MoP Classic%' THEN 'MoP Classic'
            WHEN display_server LIKE '%Retail%' THEN 'Retail' ELSE 'Classic Era' END AS game_version
FROM ({_GROUPS}) LEFT JOIN (SELECT display_server AS ds, best_ask AS ask FROM sql_group_index
                            WHERE faction = 'All') ON ds = display_server""")
def _(t):
    return indexes.sidebar_groups(t.labelled, t.sql_group_index).select(
        "display_server", F.array_join("realms", ",").alias("realms"), "min_price", "game_version")


@query("a13_source_summary", """
SELECT source, count(*) AS offers, min(price_per_1k) AS min_price FROM offers GROUP BY 1""")
def _(t):
    return indexes.source_summary(t.offers)


@query("a14_market_stats", """
SELECT count(*) FILTER (source = 'funpay') AS funpay_count, count(*) FILTER (source = 'g2g') AS g2g_count,
       min(price_per_1k) FILTER (source = 'funpay') AS best_funpay,
       min(price_per_1k) FILTER (source = 'g2g') AS best_g2g,
       CAST(sum(amount_gold) AS BIGINT) AS total_gold, median(price_per_1k) AS median,
       abs(min(price_per_1k) FILTER (source = 'g2g') - min(price_per_1k) FILTER (source = 'funpay')) AS spread,
       CASE WHEN min(price_per_1k) FILTER (source = 'g2g') < min(price_per_1k) FILTER (source = 'funpay')
            THEN 'G2G' ELSE 'FunPay' END AS winner,
       round(abs(min(price_per_1k) FILTER (source = 'g2g') - min(price_per_1k) FILTER (source = 'funpay'))
         / greatest(min(price_per_1k) FILTER (source = 'g2g'), min(price_per_1k) FILTER (source = 'funpay'))
         * 100, 1) AS spread_pct FROM offers""")
def _(t):
    return indexes.market_stats(t.offers)


@query("a15_cheapest_per_realm", """
SELECT region, server_name, faction, arg_min(id, (price_per_1k, id)) AS offer_id, min(price_per_1k) AS unit_price
FROM labelled GROUP BY 1, 2, 3""")
def _(t):
    rows = t.labelled.select("region", "server_name", "faction", F.col("id").alias("offer_id"),
                             F.col("price_per_1k").alias("unit_price"))
    return indexes.cheapest_per_realm(rows)


# one poll of a source per (source, day): some polls come back empty
view("cycles", """
SELECT source, day AS cycle, finished_at, CASE WHEN day % 3 = 0 THEN 0 ELSE n END AS offers,
       CASE WHEN day % 3 = 0 THEN 'empty_result' ELSE '' END AS error
FROM (SELECT source, order_no % 50 AS day, max(fetched_at) AS finished_at, count(*) AS n
      FROM raw_offers GROUP BY source, order_no % 50)
""")


@query("a16_data_version", """
SELECT strftime(max(finished_at), '%Y-%m-%dT%H:%M:%SZ') AS last_update FROM cycles WHERE offers > 0""")
def _(t):
    updates = t.cycles.filter("offers > 0").groupBy("source").agg(F.max("finished_at").alias("last_update"))
    return indexes.data_version(updates).select(times.utc_text(F.col("last_update")).alias("last_update"))


@query("a17_source_status", """
SELECT source, coalesce(arg_max(offers, cycle) FILTER (offers > 0), 0) AS offers,
       strftime(max(finished_at) FILTER (offers > 0), '%Y-%m-%dT%H:%M:%SZ') AS last_update,
       count(*) FILTER (offers > 0) AS version, arg_max(error, cycle) AS last_error FROM cycles GROUP BY 1""")
def _(t):
    return indexes.source_status(t.cycles).withColumn("last_update", times.utc_text(F.col("last_update")))


@query("a22_market_point", """
SELECT '2024-01-01T00:00:00Z' AS timestamp, index_price AS price, price_min AS min, price_max AS max,
       offer_count AS count FROM sql_group_index WHERE display_server = '(EU) Anniversary' AND faction = 'All'""")
def _(t):
    at = times.utc_text(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return indexes.market_point(t.labelled, at, "(EU) Anniversary")


@query("a23_version_groups", """
SELECT game_version, CAST(CASE game_version WHEN 'Retail' THEN 1 WHEN 'MoP Classic' THEN 2 ELSE 3 END AS BIGINT)
         AS position, count(*) AS groups, min(min_price) AS min_price
FROM (SELECT CASE WHEN display_server LIKE '%MoP Classic%' THEN 'MoP Classic'
                  WHEN display_server LIKE '%Retail%' THEN 'Retail' ELSE 'Classic Era' END AS game_version,
             min(price_per_1k) AS min_price FROM labelled GROUP BY display_server) GROUP BY 1""")
def _(t):
    return indexes.version_groups(indexes.sidebar_groups(t.labelled)).withColumn(
        "position", F.col("position").cast("long"))


@query("a24_multi_source", """
SELECT display_server, server_name AS realm, count(DISTINCT source) > 1 AS is_multi_source
FROM labelled GROUP BY 1, 2""")
def _(t):
    return indexes.multi_source_realms(indexes.sidebar_groups(t.labelled)).drop("sources")


@query("a25_chart_sources", """
SELECT DISTINCT unnest(string_split(source_text, ',')) AS source FROM group_index""")
def _(t):
    from tidemark.operators.series import chart_sources
    return chart_sources(t.group_index.withColumn("sources", F.split("source_text", ",")))


# --- lookups ----------------------------------------------------------------------------

@query("j20_best_ask_override", f"""
SELECT display_server, min_price AS plain_min, coalesce(a, l, h, min_price) AS min_price FROM ({_GROUPS})
LEFT JOIN (SELECT display_server AS ds, max(best_ask) FILTER (faction = 'All') AS a,
                  max(best_ask) FILTER (faction = 'Alliance') AS l, max(best_ask) FILTER (faction = 'Horde') AS h
           FROM sql_group_index GROUP BY 1) ON ds = display_server""")
def _(t):
    groups = t.labelled.groupBy("display_server").agg(F.min("price_per_1k").alias("min_price")) \
        .withColumn("plain_min", F.col("min_price"))
    return indexes.min_price_override(groups, t.sql_group_index)


@query("j21_index_for_realms", """
SELECT server_name, region, version, faction, round(coalesce(own * 1000, grp), 6) AS index_price,
       round(coalesce(own_ask * 1000, grp_ask), 6) AS best_ask, own IS NOT NULL AS per_server
FROM (SELECT DISTINCT server_name, region, concat(version, CASE WHEN display_server LIKE '%Hardcore'
               THEN ' · Hardcore' ELSE '' END) AS version, faction, grp, grp_ask
      FROM (SELECT DISTINCT server_name, region, version, display_server,
                   CASE WHEN whole = 1 THEN 'All' ELSE faction END AS fac
            FROM labelled, (VALUES (0), (1)) AS v(whole))
      JOIN (SELECT display_server AS ds, faction, index_price AS grp, best_ask AS grp_ask FROM sql_group_index)
        ON ds = display_server AND fac = faction)
FULL JOIN (SELECT sv_name AS server_name, sv_region AS region,
                  concat(sv_version, CASE WHEN sv_type = 'Hardcore' THEN ' · Hardcore' ELSE '' END) AS version,
                  faction, min(index_price) AS own, min(best_ask) AS own_ask
           FROM sql_server_index JOIN server_names ON server_id = sv_id GROUP BY 1, 2, 3, 4)
  USING (server_name, region, version, faction)""")
def _(t):
    return indexes.index_for_realms(t.labelled, t.sql_server_index, t.sql_group_index, t.servers)


@query("j22_profile_fallback", """
SELECT id, coalesce(o.median, w.median) AS median FROM
  (SELECT id, server_id, CASE WHEN line_no % 3 = 0 THEN 'Other' ELSE faction END AS f FROM offers)
LEFT JOIN (SELECT server_id AS os, faction AS ofa, median FROM sql_profiles) o ON os = server_id AND ofa = f
LEFT JOIN (SELECT server_id AS ws, median FROM sql_profiles WHERE faction = 'All') w ON ws = server_id""")
def _(t):
    rows = t.offers.withColumn("faction", F.when(F.col("line_no") % 3 == 0, "Other").otherwise(F.col("faction")))
    return indexes.with_profile(rows, t.sql_profiles).select("id", F.col("profile.median").alias("median"))


# --- ranks ------------------------------------------------------------------------------

@query("w1_dedup", "SELECT * REPLACE (strftime(fetched_at, '%Y-%m-%dT%H:%M:%SZ') AS fetched_at) FROM unique_offers")
def _(t):
    rows = t.offers.select("id", "source", "server_id", "faction", "price_per_1k", "amount_gold", "seller",
                           "fetched_at")
    return ranking.dedup(rows).withColumn("fetched_at", times.utc_text(F.col("fetched_at")))


_PINNED = """
SELECT server_id, id, is_top, row_number() OVER (PARTITION BY server_id
         ORDER BY is_top DESC, price_per_1k, amount_gold DESC, id) AS rank
FROM (SELECT server_id, id, price_per_1k, amount_gold, row_number() OVER (
        PARTITION BY server_id, source, faction ORDER BY price_per_1k, amount_gold DESC, id) = 1 AS is_top
      FROM unique_offers)"""


@query("w3_pinned_list", _PINNED)
def _(t):
    return ranking.display_list(t.unique_offers).select("server_id", "id", "is_top", "rank")


@query("w4_top_five", """
SELECT server_id, id FROM (
  SELECT server_id, id, sure, row_number() OVER (PARTITION BY server_id
           ORDER BY sure DESC, price_per_1k, amount_gold DESC, id) AS place
  FROM (SELECT server_id, id, price_per_1k, amount_gold, row_number() OVER (
          PARTITION BY server_id, source ORDER BY price_per_1k, amount_gold DESC, id) <= 2 AS sure
        FROM unique_offers)) WHERE sure OR place <= 5""")
def _(t):
    return ranking.top_five(t.unique_offers).select("server_id", "id")


@query("w10_latest_per_offer", """
SELECT source, offer_id, strftime(fetched_at, '%Y-%m-%dT%H:%M:%SZ') AS fetched_at, raw_price FROM (
  SELECT source, id AS offer_id, fetched_at, raw_price, row_number() OVER (PARTITION BY source, id
           ORDER BY fetched_at DESC, raw_price) AS rn FROM raw_offers) WHERE rn = 1""")
def _(t):
    rows = t.raw_offers.select("source", F.col("id").alias("offer_id"), "fetched_at", "raw_price")
    return ranking.latest_per_offer(rows).withColumn("fetched_at", times.utc_text(F.col("fetched_at")))


@query("w11_assign_ids", """
SELECT id, region, CASE region WHEN 'EU' THEN 293 WHEN 'US' THEN 541 WHEN 'OCE' THEN 775 WHEN 'RU' THEN 787
    ELSE 900 END - 1 + row_number() OVER (PARTITION BY region ORDER BY name, id) AS assigned_id FROM servers""")
def _(t):
    base = (F.when(F.col("region") == "EU", 293).when(F.col("region") == "US", 541)
            .when(F.col("region") == "OCE", 775).when(F.col("region") == "RU", 787).otherwise(900))
    return ranking.assign_ids(t.servers, "region", ["name", "id"], base).select("id", "region", "assigned_id")


# --- orders -----------------------------------------------------------------------------

@query("l1_offers_by_price", "SELECT id, price_per_1k, amount_gold FROM offers ORDER BY 2, 3 DESC, 1")
def _(t):
    return ranking.by_price(t.offers.select("id", "price_per_1k", "amount_gold"))


@query("l2_offers_by_amount", "SELECT id, price_per_1k, amount_gold FROM offers ORDER BY 3 DESC, 2, 1")
def _(t):
    return ranking.by_amount(t.offers.select("id", "price_per_1k", "amount_gold"))


@query("l5_sidebar_order", f"SELECT display_server, min_price FROM ({_GROUPS})")
def _(t):
    return indexes.sidebar_order(indexes.sidebar_groups(t.labelled)).select("display_server", "min_price")


# --- sets -------------------------------------------------------------------------------

@query("u1_union_all", """
SELECT id, source, CAST(CASE source WHEN 'funpay' THEN 0 WHEN 'g2g' THEN 1 ELSE 3 END AS INT) AS source_no
FROM offers""")
def _(t):
    parts = {s: t.offers.filter(F.col("source") == s).select("id", "source")
             for s in ("playerauctions", "g2g", "funpay")}
    return tables.read_sources(parts)


@query("u2_union_first_wins", """
SELECT id, price_per_1k, part FROM (
  SELECT id, price_per_1k, part, row_number() OVER (PARTITION BY id ORDER BY part, price_per_1k) AS rn
  FROM (SELECT id, price_per_1k, CASE WHEN line_no % 2 = 0 THEN 'low' ELSE 'recommended' END AS part
        FROM (SELECT concat(source, order_no) AS id, price_per_1k, line_no FROM offers))) WHERE rn = 1""")
def _(t):
    rows = t.offers.select(F.concat("source", "order_no").alias("id"), "price_per_1k", "line_no")
    part = lambda even, name: rows.filter((F.col("line_no") % 2 == 0) == even).select(
        "id", "price_per_1k", F.lit(name).alias("part"))
    return ranking.union_first_wins([part(True, "low"), part(False, "recommended")])


@query("u3_distinct_pairs", """
SELECT DISTINCT trim(offer_group) AS offer_group, trim(region_id) AS region_id FROM texts WHERE region_id <> ''""")
def _(t):
    from tidemark.sources.extract import discovered_pairs
    return discovered_pairs(t.texts)


@query("u5_grouped_dedup", """
SELECT page_id, line_no, side, id FROM (
  SELECT page_id, line_no, side, id, row_number() OVER (PARTITION BY page_id, id ORDER BY group_at, line_no, pos)
    AS rn FROM (SELECT page_id, line_no, side, id, pos, min(pos) OVER (PARTITION BY page_id, side) AS group_at
                FROM (SELECT order_no % 500 AS page_id, line_no, faction AS side, concat('x', part_no % 40) AS id,
                             concat(lpad(CAST(line_no AS STRING), 2, '0'), '/', id, '/', price_per_1k, '/',
                                    server_id, '/', part_no, '/', amount_gold) AS pos FROM offers)))
WHERE rn = 1""")
def _(t):
    items = t.offers.select(
        (F.col("order_no") % 500).alias("page_id"), "line_no", F.col("faction").alias("side"),
        F.concat(F.lit("x"), F.col("part_no") % 40).alias("id"),
        F.concat_ws("/", F.lpad(F.col("line_no").cast("string"), 2, "0"), "id", "price_per_1k", "server_id",
                    "part_no", "amount_gold").alias("pos"))
    return ranking.dedup_in_group_order(items, "page_id", "side", "pos", "id").drop("pos")


@query("s1_offer_scan", """
SELECT id, lower(server) AS server, CASE WHEN display_server = '' THEN lower(server) ELSE display_server END
  AS display_server FROM listings""")
def _(t):
    path = new_path(t.spark, "offers")
    # columns that listings lack are null in the stored table
    have = set(t.listings.columns)
    t.listings.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                        for f in schemas.OFFERS)).write.parquet(path)
    return tables.scan_offers(t.spark, path).select("id", "server", "display_server")


@query("s2_multi_source_read", """
SELECT source, CAST(CASE source WHEN 'funpay' THEN 0 WHEN 'g2g' THEN 1 ELSE 3 END AS INT) AS source_no,
       count(*) AS offers, CAST(sum(amount_gold) AS BIGINT) AS amount FROM offers GROUP BY 1, 2""")
def _(t):
    parts = {s: t.offers.filter(F.col("source") == s) for s in ("g2g", "playerauctions", "funpay")}
    return tables.read_sources(parts).groupBy("source", "source_no").agg(
        F.count(F.lit(1)).alias("offers"), F.sum("amount_gold").alias("amount"))

