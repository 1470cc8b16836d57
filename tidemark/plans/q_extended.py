"""Queries for the further market measures."""

from pyspark.sql import functions as F

from tidemark.operators import extended
from tidemark.plans.catalog import query
from tidemark.plans.q_history import shown

KEYS = ["server_id", "faction"]

_CUM = """
SELECT server_id, faction, v, w, sum(w) OVER (PARTITION BY server_id, faction ORDER BY v) AS upto,
       sum(w) OVER (PARTITION BY server_id, faction) AS total
FROM (SELECT server_id, faction, price_per_1k AS v, sum(amount_gold) AS w FROM offers GROUP BY 1, 2, 3)"""


@query("d1_volume_median", f"""
SELECT server_id, faction, min(v) AS volume_median FROM ({_CUM}) WHERE upto >= total / 2 GROUP BY 1, 2""")
def _(t):
    return extended.volume_median(t.offers, KEYS)


@query("d2_capped_vwap", f"""
SELECT server_id, faction, round(sum(v * taken) / sum(taken), 6) AS vwap, CAST(sum(taken) AS BIGINT) AS volume FROM (
  SELECT server_id, faction, v, least(w, 2000 - (upto - w)) AS taken FROM ({_CUM}) WHERE upto - w < 2000)
GROUP BY 1, 2""")
def _(t):
    return extended.capped_vwap(t.offers, KEYS, 2000).withColumn("vwap", F.round("vwap", 6))


@query("d2_capped_vwap_default", f"""
SELECT server_id, faction, round(sum(v * taken) / sum(taken), 6) AS vwap, CAST(sum(taken) AS BIGINT) AS volume FROM (
  SELECT server_id, faction, v, least(w, 1000000 - (upto - w)) AS taken FROM ({_CUM}) WHERE upto - w < 1000000)
GROUP BY 1, 2""")
def _(t):
    return extended.capped_vwap(t.offers, KEYS).withColumn("vwap", F.round("vwap", 6))


@query("d3_liquid_ask", f"""
SELECT server_id, faction, min(v) AS liquid_ask FROM ({_CUM}) WHERE upto >= 3000 GROUP BY 1, 2""")
def _(t):
    return extended.liquid_ask(t.offers, KEYS, 3000)


@query("d4_outlier_filter", """
SELECT id, server_id, faction, price_per_1k FROM offers JOIN (
  SELECT server_id AS s, faction AS f, median(price_per_1k) AS m FROM offers GROUP BY 1, 2)
  ON s = server_id AND f = faction WHERE price_per_1k <= m * 1.5""")
def _(t):
    return extended.without_outliers(t.offers, KEYS, 1.5).select("id", *KEYS, "price_per_1k")


@query("d5_top_n_mean", """
SELECT server_id, faction, round(avg(price_per_1k), 6) AS top_mean, count(*) AS sample_size FROM (
  SELECT server_id, faction, price_per_1k, row_number() OVER (PARTITION BY server_id, faction
           ORDER BY price_per_1k, id) AS rn FROM offers) WHERE rn <= 10 GROUP BY 1, 2""")
def _(t):
    return extended.top_n_mean(t.offers, KEYS).withColumn("top_mean", F.round("top_mean", 6))


@query("d6_price_range", """
SELECT id, CASE WHEN p < low * 0.1 OR p > high * 10 THEN 'price_out_of_range' END AS reason
FROM (SELECT id, server_id, faction, CASE line_no WHEN 1 THEN price_per_1k * 100 WHEN 2 THEN price_per_1k / 100
        ELSE price_per_1k END AS p FROM offers)
LEFT JOIN (SELECT server_id AS s, gf, max(CASE WHEN rn = floor(n * 0.1) + 1 THEN price_per_1k END) AS low,
             max(CASE WHEN rn = floor(n * 0.9) + 1 THEN price_per_1k END) AS high
           FROM (SELECT server_id, gf, p AS price_per_1k, row_number() OVER (PARTITION BY server_id, gf ORDER BY p)
                   AS rn, count(*) OVER (PARTITION BY server_id, gf) AS n
                 FROM (SELECT server_id, faction AS gf, CASE line_no WHEN 1 THEN price_per_1k * 100
                         WHEN 2 THEN price_per_1k / 100 ELSE price_per_1k END AS p FROM offers))
           GROUP BY 1, 2 HAVING max(n) >= 3) ON s = server_id AND gf = faction""")
def _(t):
    n, p = F.col("line_no"), F.col("price_per_1k")
    rows = t.offers.withColumn("price_per_1k", F.when(n == 1, p * 100).when(n == 2, p / 100).otherwise(p))
    return extended.price_range_reason(rows).select("id", "reason")


@query("d7_reroute", """
SELECT id, CASE WHEN gap_ok THEN CASE WHEN abs(p - low_m) <= abs(p - high_m)
         THEN CASE WHEN abs(p - low_m) <= low_m * 0.3 THEN low_id END
         ELSE CASE WHEN abs(p - high_m) <= high_m * 0.3 THEN high_id END END END AS routed_id
FROM (SELECT id, realm, region, p, low_m, high_m, low_id, high_id, high_m > low_m * 1.2 AS gap_ok
      FROM (SELECT id, lower(server_name) AS realm, region, price_per_1k / 100 + 1 AS p FROM labelled)
      LEFT JOIN (SELECT r, g, min(m) AS low_m, max(m) AS high_m, arg_min(sid, (m, sid)) AS low_id,
                        arg_max(sid, (m, sid)) AS high_id
                 FROM (SELECT lower(name) AS r, region AS g, id AS sid, 1 + id % 7 AS m FROM servers
                       WHERE is_active) GROUP BY 1, 2 HAVING count(*) = 2) ON r = realm AND g = region)""")
def _(t):
    rows = t.labelled.select("id", F.lower("server_name").alias("realm"), "region",
                             (F.col("price_per_1k") / 100 + 1).alias("price_per_1k"))
    profiles = t.servers.select(F.col("id").alias("server_id"), F.lit("All").alias("faction"),
                                (1 + F.col("id") % 7).cast("double").alias("median"))
    return extended.rerouted(rows, t.servers, profiles).select("id", "routed_id")


@query("d9_spikes", """
SELECT server_id, faction, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ') AS recorded_at,
       round(recent, 6) AS recent_median, coalesce(index_price > recent * 3, FALSE) AS is_spike
FROM ticks JOIN (SELECT server_id AS s, faction AS f, day, lag(m) OVER (PARTITION BY server_id, faction ORDER BY day)
                   AS recent FROM (SELECT server_id, faction, CAST(recorded_at AS DATE) AS day,
                                          median(index_price) AS m FROM ticks GROUP BY 1, 2, 3))
  ON s = server_id AND f = faction AND day = CAST(recorded_at AS DATE)""")
def _(t):
    return shown(extended.spikes(t.ticks).select(*KEYS, "recorded_at", "recent_median", "is_spike"), digits=6)
