"""Streaming queries. The tables are replayed as file streams until all input is read."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.plans.catalog import VIEWS, query
from tidemark.plans.q_history import THROTTLED, shown
from tidemark.session import new_path
from tidemark.sources import tables
from tidemark.sources.tables import normal_offers
from tidemark.streaming import jobs

NOW = {"availableNow": True}
REGISTRY_MOST = 500_000  # rows of a registry that is sent to all executors
TICK = ("server_id", "faction", "recorded_at", "index_price", "best_ask", "sample_size")


def stream_of(t, table: str) -> DataFrame:
    """The table's file as a stream."""
    return (t.spark.readStream.schema(t.table(table).schema)
            .option("pathGlobFilter", f"{table}.parquet").parquet(t.folder))


def tick_stream(t, events: DataFrame | None = None) -> DataFrame:
    return t.derive(VIEWS["raw_ticks"], events=stream_of(t, "events") if events is None else events)


def done(running) -> None:
    running.awaitTermination()


def files(t, path: str, schema) -> DataFrame:
    return t.spark.readStream.schema(schema).parquet(path)


def in_loads(t, rows: DataFrame, conditions: list[str], start) -> None:
    """Lands the rows load by load; after each, the job goes on from its checkpoint."""
    landed, checkpoint = new_path(t.spark, "landed"), new_path(t.spark, "cp")
    for condition in conditions:
        rows.filter(condition).write.mode("append").parquet(landed)
        done(start(files(t, landed, rows.schema), checkpoint))


_TICK_TEXT = """server_id, faction, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ') AS recorded_at,
       round(index_price, 8) AS index_price, round(best_ask, 8) AS best_ask, sample_size"""


def _rolled(source: str, bucket: str) -> str:
    return f"""SELECT server_id, faction, {bucket} AS recorded_at, avg(index_price) AS index_price,
       min(best_ask) AS best_ask, max(sample_size) AS sample_size FROM {source} GROUP BY 1, 2, 3"""


_FLOOR_5 = "date_trunc('hour', recorded_at) + INTERVAL '1' MINUTE * (minute(recorded_at) // 5 * 5)"
_FIVE = f"""SELECT * FROM ({_rolled('raw_ticks', _FLOOR_5)}) WHERE recorded_at + INTERVAL '5' MINUTE
       <= (SELECT max(recorded_at) FROM raw_ticks) - INTERVAL '10' MINUTE"""
_HOUR = f"""SELECT * FROM ({_rolled(f'({_FIVE})', "date_trunc('hour', recorded_at)")})
       WHERE recorded_at + INTERVAL '1' HOUR <= (SELECT max(recorded_at) FROM ({_FIVE})) - INTERVAL '2' HOUR"""
_DAY = f"""SELECT * FROM ({_rolled(f'({_HOUR})', "date_trunc('day', recorded_at)")})
       WHERE recorded_at + INTERVAL '1' DAY <= (SELECT max(recorded_at) FROM ({_HOUR})) - INTERVAL '2' DAY"""


@query("st1_normalizing_stream", """
SELECT id, source, server_id, display_server, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY source, id, reason IS NULL ORDER BY arrival) AS rn FROM sql_tagged)
WHERE rn = 1 AND reason IS NULL UNION ALL
SELECT raw_id, source, NULL, NULL, reason FROM sql_rejected""")
def _(t):
    raw = t.derive(VIEWS["raw_offers"], lineitem=stream_of(t, "lineitem"))
    # a stream's plan is fixed before sizes are known; a registry that fits goes to the lines, which then stay in place
    names = F.broadcast(t.server_names) if t.supplier.count() <= REGISTRY_MOST else t.server_names
    listings = normal_offers(t.derive(VIEWS["listings"], raw_offers=raw, server_names=names))
    clean, rejected = new_path(t.spark, "clean"), new_path(t.spark, "rejected")
    done(jobs.start_normalizer(listings, t.aliases, t.servers, clean, rejected, new_path(t.spark, "cp"), NOW))
    good = t.spark.read.parquet(clean).select("id", "source", "server_id", "display_server",
                                              F.lit(None).cast("string").alias("reason"))
    bad = t.spark.read.parquet(rejected).select(
        F.col("raw_id").alias("id"), "source", F.lit(None).cast("int").alias("server_id"),
        F.lit(None).cast("string").alias("display_server"), "reason")
    return good.unionByName(bad)


# the offers arrive in three loads; every load gives ticks over all offers seen by then, the newest of an id
_SEEN = """(SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY source, id ORDER BY fetched_at DESC, price_per_1k, faction,
                                     server_id) AS place FROM offers) WHERE place = 1)
      JOIN (VALUES (0), (1), (2)) AS p(load) ON order_no % 3 <= load"""


def _ticks_of(seen: str) -> str:
    return f"""
SELECT server_id, faction, strftime(moment, '%Y-%m-%dT%H:%M:%SZ') AS recorded_at, index_price, best_ask,
       CAST(sample_size AS INT) AS sample_size
FROM (SELECT *, row_number() OVER (PARTITION BY server_id, faction, moment ORDER BY load) AS rn FROM (
  SELECT load, server_id, gf AS faction, round(sum(total) / sum(n) / 1000, 8) AS index_price,
         round(min(low) / 1000, 8) AS best_ask, sum(n) AS sample_size
  FROM (SELECT *, min(mean) OVER (PARTITION BY load, server_id, gf) AS lowest FROM (
    SELECT load, server_id, gf, source, sum(price) AS total, count(*) AS n, avg(price) AS mean, min(price) AS low
    FROM (SELECT load, server_id, source, price, unnest([faction, 'All']) AS gf FROM (
      SELECT load, server_id, source, faction, min(price_per_1k) AS price FROM {seen}
      WHERE price_per_1k > 0 GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2, 3, 4))
  WHERE mean <= 2 * lowest GROUP BY 1, 2, 3)
  JOIN (SELECT load, date_trunc('minute', max(fetched_at)) AS moment FROM {seen} GROUP BY 1) USING (load))
WHERE rn = 1"""


@query("st2_tick_writer", _ticks_of(_SEEN))
def _(t):
    path, current = new_path(t.spark, "ticks"), new_path(t.spark, "market")
    in_loads(t, t.offers, [f"order_no % 3 = {load}" for load in range(3)],
             lambda offers, checkpoint: jobs.start_tick_writer(offers, current, path, checkpoint, NOW))
    return shown(tables.read(t.spark, path, schemas.TICKS).select(*TICK))


# a source's offers come in cycles; after each load, its newest cycle is what it offers
_CYCLES = """(SELECT o.*, p.load FROM (
        SELECT *, row_number() OVER (PARTITION BY source, cycle, id ORDER BY fetched_at DESC, price_per_1k, faction,
                                     server_id) AS place
        FROM (SELECT *, order_no % 50 AS cycle FROM offers)) AS o
      JOIN (SELECT load, source, max(order_no % 50) AS newest FROM offers JOIN (VALUES (0), (1), (2)) AS v(load)
              ON order_no % 50 < 17 * load + 17 GROUP BY ALL) AS p ON p.source = o.source AND p.newest = o.cycle
      WHERE place = 1)"""


@query("st2_market_cycles", _ticks_of(_CYCLES))
def _(t):
    path, current = new_path(t.spark, "ticks"), new_path(t.spark, "market")
    offers = t.offers.withColumn("cycle", F.col("order_no") % 50)
    in_loads(t, offers, [f"cycle >= {17 * load} AND cycle < {17 * load + 17}" for load in range(3)],
             lambda loads, checkpoint: jobs.start_tick_writer(loads, current, path, checkpoint, NOW))
    return shown(tables.read(t.spark, path, schemas.TICKS).select(*TICK))


@query("st3_tier_streams", f"""
SELECT '5m' AS tier, {_TICK_TEXT} FROM ({_FIVE}) UNION ALL SELECT '1h', {_TICK_TEXT} FROM ({_HOUR}) UNION ALL
SELECT '1d', {_TICK_TEXT} FROM ({_DAY})""")
def _(t):
    source, out = tick_stream(t), None
    for tier in ("5m", "1h", "1d"):
        path = new_path(t.spark, f"tier_{tier}")
        done(jobs.start_rollup(source, tier, path, new_path(t.spark, "cp"), NOW))
        stored = t.spark.read.parquet(path)
        source = files(t, path, stored.schema)
        part = stored.select(F.lit(tier).alias("tier"), *TICK)
        out = part if out is None else out.unionByName(part)
    return shown(out)


@query("st3_open_buckets", f"SELECT {_TICK_TEXT} FROM ({_rolled('raw_ticks', _FLOOR_5)})")
def _(t):
    path = new_path(t.spark, "open")
    # the cut lies inside a bucket, whose state goes from one load to the next
    cut = "TIMESTAMP '2024-01-15 12:02:00'"
    in_loads(t, t.raw_ticks, [f"recorded_at < {cut}", f"recorded_at >= {cut}"],
             lambda ticks, checkpoint: jobs.start_open_buckets(ticks, "5m", path, checkpoint, NOW))
    return shown(tables.read(t.spark, path, schemas.TICKS).select(*TICK))


# rows count as late against the watermark that held at the start of the batch before theirs
_LATE = f"""(SELECT * FROM raw_ticks WHERE event_id % 10 <> 3 OR {_FLOOR_5} + INTERVAL '5' MINUTE >
       (SELECT max(recorded_at) FROM raw_ticks WHERE event_id % 10 IN (0, 1, 2, 4, 5)) - INTERVAL '10' MINUTE)"""


@query("st4_late_data", f"""
SELECT {_TICK_TEXT} FROM ({_rolled(_LATE, _FLOOR_5)}) WHERE recorded_at + INTERVAL '5' MINUTE
  <= (SELECT max(recorded_at) FROM raw_ticks) - INTERVAL '10' MINUTE""")
def _(t):
    landed = new_path(t.spark, "landed")
    for digits in ((0, 1, 2, 4, 5), (6, 7, 8, 9), (3,)):  # the last tenth arrives after all others
        part = t.events.filter((F.col("event_id") % 10).isin(*digits))
        part.coalesce(1).write.mode("append").parquet(landed)
    events = (t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(landed))
    path = new_path(t.spark, "tier_5m")
    done(jobs.start_rollup(tick_stream(t, events), "5m", path, new_path(t.spark, "cp"), NOW))
    return shown(t.spark.read.parquet(path).select(*TICK))


@query("st5_stateful_throttle", THROTTLED)
def _(t):
    stream = tick_stream(t).select("server_id", "faction", "recorded_at", "event_id", "index_price")
    path = new_path(t.spark, "throttled")
    kept = jobs.throttled(stream, ["server_id", "faction"], "recorded_at", ["index_price"], ["event_id"])
    done(kept.writeStream.outputMode("append").format("parquet").option("path", path)
         .option("checkpointLocation", new_path(t.spark, "cp")).trigger(availableNow=True).start())
    return shown(t.spark.read.parquet(path))


@query("st7_streaming_dedup", "SELECT DISTINCT source, id FROM offers")
def _(t):
    raw = t.derive(VIEWS["raw_offers"], lineitem=stream_of(t, "lineitem"))
    path = new_path(t.spark, "unique")
    done(jobs.deduplicated(raw).select("source", "id").writeStream.outputMode("append").format("parquet")
         .option("path", path).option("checkpointLocation", new_path(t.spark, "cp"))
         .trigger(availableNow=True).start())
    return t.spark.read.schema("source string, id string").parquet(path)


@query("st10_current_index", f"""
SELECT server_id, faction, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ') AS computed_at, index_price, best_ask FROM (
  SELECT *, row_number() OVER (PARTITION BY server_id, faction ORDER BY recorded_at DESC,
                               (event_id % 3) DESC, index_price, best_ask NULLS FIRST) AS rn FROM raw_ticks) WHERE rn = 1""")
def _(t):
    index = t.raw_ticks.select(
        "event_id", "server_id", "faction", F.col("recorded_at").alias("computed_at"), "index_price", "best_ask",
        F.col("sample_size").cast("long"), F.col("index_price").alias("min_price"),
        F.col("index_price").alias("max_price"))
    path = new_path(t.spark, "current")
    in_loads(t, index, [f"event_id % 3 = {load}" for load in range(3)],
             lambda ticks, checkpoint: jobs.start_current_index(ticks, path, checkpoint, NOW))
    return shown(tables.read(t.spark, path, schemas.CURRENT_INDEX).select(
        "server_id", "faction", "computed_at", "index_price", "best_ask"), "computed_at")
