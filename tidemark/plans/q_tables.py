"""Queries that write tables and return what is stored afterwards."""

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.plans.catalog import query
from tidemark.plans.q_history import AS_OF, shown
from tidemark.session import new_path
from tidemark.sources import tables

TICK = ("server_id", "faction", "recorded_at", "index_price", "best_ask", "sample_size")
_FIRST = "ORDER BY index_price, best_ask NULLS FIRST, sample_size"


@query("s3_raw_price_append", """
SELECT id AS offer_id, source, server_id, faction, CAST(CAST(raw_price AS DECIMAL(18, 8)) AS DOUBLE) AS raw_price,
       raw_price_unit, lot_size, 'USD' AS currency, concat('2024-01-', lpad(CAST(order_no % 20 + 1 AS VARCHAR), 2, '0'))
         AS day FROM offers""")
def _(t):
    path = new_path(t.spark, "raw_prices")
    rows = t.offers.withColumns({
        "offer_url": F.lit(None).cast("string"),
        "fetched_at": F.make_timestamp(F.lit(2024), F.lit(1), F.col("order_no") % 20 + 1, F.lit(1), F.lit(2),
                                       F.lit(3))})
    for part in (0, 1):
        tables.append_raw_prices(rows.filter(F.col("line_no") % 2 == part), path)
    stored = tables.read(t.spark, path, schemas.RAW_PRICES)
    return stored.select("offer_id", "source", "server_id", "faction", F.col("raw_price").cast("double"),
                         "raw_price_unit", "lot_size", "currency",
                         F.date_format("date", "yyyy-MM-dd").alias("day"))


@query("s4_group_index_append", """
SELECT display_server AS server, faction, round(index_price, 6) AS index_price, total_volume, sources,
       CAST(len(string_split(sources, ',')) AS INT) AS source_count FROM sql_group_index""")
def _(t):
    path = new_path(t.spark, "group_index")
    tables.append_group_index(t.sql_group_index, F.lit(AS_OF).cast("timestamp"), path)
    return tables.read(t.spark, path, schemas.GROUP_INDEX).select(
        "server", "faction", F.col("index_price").cast("double"), "total_volume",
        F.array_join("sources", ",").alias("sources"), "source_count")


@query("s5_upsert_index", """
SELECT server_id, faction, CASE WHEN server_id % 2 = 0 THEN 'second' ELSE 'first' END AS run,
       CASE WHEN server_id % 2 = 0 THEN index_price * 2 ELSE index_price END AS index_price FROM sql_server_index
UNION ALL SELECT server_id + 1000000, faction, 'second', index_price * 2 FROM sql_server_index
WHERE server_id % 2 = 0""")
def _(t):
    path = new_path(t.spark, "current_index")
    at = lambda text: F.lit(text).cast("timestamp")
    tables.upsert_index(t.sql_server_index.withColumn("computed_at", at("2024-01-01")), path)
    again = t.sql_server_index.filter("server_id % 2 = 0").withColumns({
        "computed_at": at("2024-01-02"), "index_price": F.col("index_price") * 2})
    tables.upsert_index(again.unionByName(again.withColumn("server_id", F.col("server_id") + 1000000)), path)
    run = F.when(F.col("computed_at") == at("2024-01-02"), "second").otherwise("first")
    return tables.read(t.spark, path, schemas.CURRENT_INDEX).select("server_id", "faction", run.alias("run"),
                                                                    "index_price")


@query("s6_insert_if_absent", f"""
SELECT server_id, faction, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ') AS recorded_at, index_price, best_ask,
       sample_size FROM (
  SELECT *, row_number() OVER (PARTITION BY server_id, faction, recorded_at
              ORDER BY event_id % 2, index_price, best_ask NULLS FIRST, sample_size) AS rn FROM raw_ticks)
WHERE rn = 1""")
def _(t):
    path = new_path(t.spark, "ticks")
    tables.insert_ticks(t.raw_ticks.filter("event_id % 2 = 0"), path)
    tables.insert_ticks(t.raw_ticks, path)
    tables.insert_ticks(t.raw_ticks, path)
    return shown(tables.read(t.spark, path, schemas.TICKS).select(*TICK))


@query("st9_apply_retention", f"""
SELECT server_id, faction, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ') AS recorded_at,
       (SELECT count(*) FROM ticks WHERE recorded_at < TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY) AS deleted
FROM ticks WHERE recorded_at >= TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY""")
def _(t):
    path = new_path(t.spark, "ticks")
    tables.insert_ticks(t.ticks, path)
    deleted = tables.apply_retention(t.spark, path, schemas.TICKS, "recorded_at", "2024-01-21 12:07:00")
    return shown(tables.read(t.spark, path, schemas.TICKS).select("server_id", "faction", "recorded_at",
                                                                  F.lit(deleted).cast("long").alias("deleted")))


@query("st6_last_good_cycle", """
SELECT id, source, cycle FROM (SELECT id, source, order_no % 50 AS cycle FROM offers)
WHERE (source, cycle) IN (SELECT (source, max(cycle)) FROM cycles WHERE offers > 0 GROUP BY source)""")
def _(t):
    from tidemark.streaming.jobs import last_good
    rows = t.offers.select("id", "source", (F.col("order_no") % 50).alias("cycle"))
    return last_good(rows, t.cycles).select("id", "source", "cycle")


