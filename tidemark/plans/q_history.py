"""Queries for tiers, bars, history reads and chart series."""

from pyspark.sql import functions as F

from tidemark.functions import fixed, times
from tidemark.operators import history, series, throttle
from tidemark.plans.catalog import query, view
from tidemark.session import materialize, new_path, release
from tidemark.sources.tiers import TierStore
from tidemark.streaming import jobs

AS_OF = "2024-01-28 12:07:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def shown(df, *columns, digits=8):
    """Output form: times as UTC text, means rounded."""
    out = df
    for c in columns or ("recorded_at",):
        out = out.withColumn(c, times.utc_text(F.col(c)))
    for f in df.schema.fields:
        if f.dataType.typeName() == "double":
            out = out.withColumn(f.name, F.round(f.name, digits))
    return out


_T = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ') AS {0}"
_TICK = (f"SELECT server_id, faction, {_T.format('recorded_at')}, round(index_price, 8) AS index_price, "
         "round(best_ask, 8) AS best_ask, sample_size FROM ")


def _rollup_sql(source: str, bucket: str) -> str:
    return f"""
SELECT server_id, faction, {bucket} AS recorded_at, avg(index_price) AS index_price,
       min(best_ask) AS best_ask, max(sample_size) AS sample_size FROM {source} GROUP BY 1, 2, 3"""


_FLOOR_5 = "date_trunc('hour', recorded_at) + INTERVAL '1' MINUTE * (minute(recorded_at) // 5 * 5)"

view("tier_5m", _rollup_sql("ticks", _FLOOR_5), lambda t: history.rollup(t.ticks, "5m"))
view("tier_1h", _rollup_sql("tier_5m", "date_trunc('hour', recorded_at)"),
     lambda t: history.rollup(t.tier_5m, "1h"))
view("tier_1d", _rollup_sql("tier_1h", "date_trunc('day', recorded_at)"),
     lambda t: history.rollup(t.tier_1h, "1d"))


@query("a8_rollup_5m", _TICK + "tier_5m")
def _(t):
    return shown(t.tier_5m)


@query("a9_rollup_1h", _TICK + "tier_1h")
def _(t):
    return shown(t.tier_1h)


@query("a10_rollup_1d", _TICK + "tier_1d")
def _(t):
    return shown(t.tier_1d)


@query("a9_rollup_look_back", _TICK + f"""(
{_rollup_sql("tier_5m WHERE recorded_at >= TIMESTAMP '2024-01-28 10:00:00'", "date_trunc('hour', recorded_at)")})""")
def _(t):
    return shown(history.rollup(t.tier_5m, "1h", as_of()))


@query("a11_back_fill", f"""
SELECT '5m' AS tier, * FROM ({_TICK} tier_5m) UNION ALL
SELECT '1h', * FROM ({_TICK} (
  SELECT * FROM ({_rollup_sql("ticks", "date_trunc('hour', recorded_at)")})
  UNION ALL
  SELECT * FROM ({_rollup_sql("(SELECT * REPLACE (server_id + 1 AS server_id) FROM raw_ticks)",
                              "date_trunc('hour', recorded_at)")})
  WHERE (server_id, faction, recorded_at) NOT IN
        (SELECT server_id, faction, date_trunc('hour', recorded_at) FROM ticks)))""")
def _(t):
    other = t.raw_ticks.withColumn("server_id", F.col("server_id") + 1)
    tiers = history.back_fill(t.ticks, other)
    return shown(tiers["5m"].select(F.lit("5m").alias("tier"), "*")
                 .unionByName(tiers["1h"].select(F.lit("1h").alias("tier"), "*")))


@query("a12_back_fill_audit", """
SELECT '5m' AS target, (SELECT count(*) FROM tier_5m) AS target_rows, (SELECT count(*) FROM ticks) AS source_rows,
       TRUE AS ok UNION ALL
SELECT 'none', 0, (SELECT count(*) FROM ticks), FALSE""")
def _(t):
    return history.back_fill_audit(t.ticks, {"5m": t.tier_5m, "none": t.tier_5m.filter("sample_size < 0")})


_BARS = """
SELECT server, faction, bucket, arg_min(index_price, (ts, index_price)) AS open, max(index_price) AS high,
       min(index_price) AS low, arg_max(index_price, (ts, index_price)) AS close,
       round(avg(index_price), 6) AS avg_price, round(avg(vwap), 6) AS vwap,
       coalesce(min(best_ask), 0) AS best_ask, CAST(sum(offer_count) AS BIGINT) AS offer_count,
       array_to_string(list_sort(list_distinct(flatten(list(
         CASE WHEN source_text IS NULL THEN CAST([] AS VARCHAR[]) ELSE string_split(source_text, ',') END)))), ',')
         AS sources
FROM (SELECT *, date_trunc('minute', ts) - INTERVAL '1' MINUTE * (minute(ts) % {0}) AS bucket FROM group_index)
WHERE {1} GROUP BY 1, 2, 3"""

def _bars(df):
    return shown(df.withColumn("sources", F.array_join("sources", ",")), "bucket", digits=6)


def _index_rows(t):
    return t.group_index.withColumn("sources", F.split("source_text", ","))


@query("a7_ohlc_bars", f"SELECT * REPLACE (strftime(bucket, '%Y-%m-%dT%H:%M:%SZ') AS bucket) FROM ("
                       f"{_BARS.format(86, 'TRUE')})")
def _(t):
    return _bars(history.bars(_index_rows(t), times.floor_minutes(F.col("ts"), 86)))


@query("l7_ohlc_of_group", f"""
SELECT * REPLACE (strftime(bucket, '%Y-%m-%dT%H:%M:%SZ') AS bucket) FROM ({_BARS.format(
    20, f"server = '(EU) Anniversary' AND faction = 'Horde' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL '168' HOUR")})
""")
def _(t):
    return _bars(history.ohlc(_index_rows(t), "(EU) Anniversary", "horde", 168, as_of(), 500))


@query("w5_open_close", """
SELECT server, faction, arg_min(index_price, (ts, index_price)) AS open,
       arg_max(index_price, (ts, index_price)) AS close, strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ')
       AS bucket FROM group_index GROUP BY 1, 2, 5""")
def _(t):
    return shown(history.bars(_index_rows(t), F.date_trunc("day", "ts")).select(
        "server", "faction", "open", "close", "bucket"), "bucket")


# --- reads ------------------------------------------------------------------------------

_POINT = """SELECT server_id, faction, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ') AS recorded_at,
       round(index_price, 8) AS index_price, round(index_price * 1000, 4) AS index_price_per_1k,
       round(coalesce(best_ask, index_price) * 1000, 4) AS best_ask, sample_size FROM """


def _tiers(t):
    """The tiers as stored by two runs, the second from the first one's mark."""
    ticks = materialize(t.ticks, "ticks")
    store = TierStore(t.spark, new_path(t.spark, "tiers"))
    for upto in ("2024-01-16 10:07:00", "2024-03-01 00:00:00"):
        store.advance(ticks, upto)
    release(ticks)
    return store.tiers()


@query("s12_history_read", _POINT + f"""(SELECT * FROM tier_5m WHERE server_id = 1 AND faction = 'Horde'
  AND recorded_at > TIMESTAMP '{AS_OF}' - INTERVAL '100' HOUR ORDER BY recorded_at DESC LIMIT 500)""")
def _(t):
    return shown(history.history(_tiers(t), 1, "horde", 100, as_of()))


@query("l3_newest_points", _POINT + f"""(SELECT * FROM tier_1h WHERE server_id = 2 AND faction = 'Alliance'
  AND recorded_at > TIMESTAMP '{AS_OF}' - INTERVAL '720' HOUR ORDER BY recorded_at DESC LIMIT 50)""")
def _(t):
    return shown(history.history(_tiers(t), 2, "Alliance", 720, as_of(), 50))


@query("s13_tier_router", """
SELECT '5m' AS tier, server_id, faction, count(*) AS points FROM tier_5m GROUP BY 2, 3 UNION ALL
SELECT '1h', server_id, faction, count(*) FROM tier_1h GROUP BY 2, 3 UNION ALL
SELECT '1d', server_id, faction, count(*) FROM tier_1d GROUP BY 2, 3""")
def _(t):
    out, tiers = None, _tiers(t)
    for hours in (168, 720, 721):
        tier = history.tier_for(hours)
        part = (tiers[tier].groupBy("server_id", "faction").agg(F.count(F.lit(1)).alias("points"))
                .withColumn("tier", F.lit(tier)))
        out = part if out is None else out.unionByName(part)
    return out


@query("j5_price_index", f"""
SELECT sv_name AS server_name, sv_region AS region, sv_version AS version, faction, '{AS_OF}' AS computed_at,
       index_price, round(index_price * 1000, 4) AS index_price_per_1k, sample_size, min_price, max_price
FROM sql_server_index JOIN server_names ON server_id = sv_id
JOIN (SELECT id FROM servers WHERE is_active) ON id = sv_id""")
def _(t):
    current = t.sql_server_index.withColumn("computed_at", F.lit(AS_OF))
    return history.price_index(current, t.servers)


@query("l4_price_index_order", """
SELECT sv_region AS region, sv_version AS version, sv_name AS server_name, faction, index_price
FROM sql_server_index JOIN server_names ON server_id = sv_id
JOIN (SELECT id FROM servers WHERE is_active) ON id = sv_id WHERE faction = 'Horde' """)
def _(t):
    from tidemark.plans.reports import price_index
    current = t.sql_server_index.withColumn("computed_at", F.lit(AS_OF))
    return price_index(current, t.servers, "horde").select("region", "version", "server_name", "faction",
                                                            "index_price")


@query("j6_named_history", """
SELECT sv_name AS name, sv_region AS region, sv_version AS version, p.* FROM (""" + _POINT + """tier_1h) p
JOIN server_names ON server_id = sv_id""")
def _(t):
    return shown(history.named_history(_tiers(t)["1h"], t.servers))


@query("j6_history_by_name", _POINT + f"""(SELECT * FROM tier_1d WHERE server_id = 0 AND faction = 'Horde'
  AND recorded_at > TIMESTAMP '{AS_OF}' - INTERVAL '1000' HOUR)""")
def _(t):
    realm = t.servers.filter("id = 0").first()  # one registry row
    return shown(history.history_by_name(_tiers(t), t.servers, realm["name"].upper(), realm["region"].lower(),
                                         realm["version"].upper(), "horde", 1000, as_of()))


# --- series -----------------------------------------------------------------------------

@query("w2_moving_average", """
SELECT server_id, faction, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ') AS recorded_at,
       round(avg(index_price) OVER (PARTITION BY server_id, faction ORDER BY recorded_at
             ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 8) AS smooth FROM ticks""")
def _(t):
    out = series.smoothed(t.ticks, ["server_id", "faction"], "recorded_at", "index_price")
    return shown(out.select("server_id", "faction", "recorded_at", "smooth"))


@query("w8_carry_forward", f"""
SELECT server_id, faction, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ') AS recorded_at, index_price FROM (
  SELECT server_id, faction, recorded_at, index_price FROM ticks UNION ALL
  SELECT server_id, faction, TIMESTAMP '2024-02-01 00:00:00', arg_max(index_price, recorded_at) FROM ticks
  GROUP BY 1, 2)""")
def _(t):
    return shown(series.carried_forward(t.ticks, ["server_id", "faction"], "recorded_at", "index_price",
                                        F.lit("2024-02-01 00:00:00").cast("timestamp")))


@query("w9_live_point", """
SELECT server_id, faction, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ') AS recorded_at,
       round(index_price, 8) AS index_price FROM (
  SELECT server_id, faction, recorded_at, index_price FROM tier_1d UNION ALL
  SELECT server_id, faction, TIMESTAMP '2024-01-30 00:00:00', index_price FROM sql_server_index
  JOIN (SELECT server_id, faction, max(recorded_at) AS m FROM tier_1d GROUP BY 1, 2)
    USING (server_id, faction) WHERE m < TIMESTAMP '2024-01-30 00:00:00' UNION ALL
  SELECT server_id, faction, TIMESTAMP '2024-01-30 00:00:00', index_price FROM sql_server_index
  WHERE (server_id, faction) NOT IN (SELECT server_id, faction FROM tier_1d))""")
def _(t):
    live = t.sql_server_index.select("server_id", "faction", F.lit("2024-01-30 00:00:00").cast("timestamp")
                                     .alias("recorded_at"), "index_price")
    past = t.tier_1d.select("server_id", "faction", "recorded_at", "index_price")
    return shown(series.with_live_point(past, live, ["server_id", "faction"], "recorded_at"))


@query("j15_live_prices", """
SELECT lower(sv_name) AS realm, sv_region AS region, lower(sv_version) AS version,
       coalesce(max(round(index_price * 1000, 4)) FILTER (faction = 'Alliance'),
                max(round(index_price * 1000, 4)) FILTER (faction = 'Horde')) AS index_price_per_1k,
       max(min_price) FILTER (faction = 'Alliance') * 1000 AS best_ask_alliance_per_1k,
       max(min_price) FILTER (faction = 'Horde') * 1000 AS best_ask_horde_per_1k
FROM sql_server_index JOIN server_names ON server_id = sv_id
JOIN (SELECT id FROM servers WHERE is_active) ON id = sv_id GROUP BY 1, 2, 3""")
def _(t):
    return series.live_prices(history.price_index(t.sql_server_index.withColumn("computed_at", F.lit(AS_OF)),
                                                  t.servers))


@query("j16_aligned_factions", """
SELECT server_id, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ') AS recorded_at, ask_alliance, ask_horde,
       CASE WHEN na >= nh THEN a ELSE h END AS index_line FROM (
  SELECT *, count(a) OVER (PARTITION BY server_id) AS na, count(h) OVER (PARTITION BY server_id) AS nh FROM (
    SELECT server_id, recorded_at, max(ask) FILTER (faction = 'Alliance' AND ask > 0) AS ask_alliance,
           max(ask) FILTER (faction = 'Horde' AND ask > 0) AS ask_horde,
           max(idx) FILTER (faction = 'Alliance') AS a, max(idx) FILTER (faction = 'Horde') AS h
    FROM (SELECT server_id, faction, recorded_at, round(index_price * 1000, 4) AS idx,
                 round(coalesce(best_ask, index_price) * 1000, 4) AS ask FROM tier_1h) GROUP BY 1, 2))""")
def _(t):
    return shown(series.aligned(history.history_points(t.tier_1h), ["server_id"], "recorded_at"))


# --- throttles --------------------------------------------------------------------------

def _walk(rows: str, order: str, values: list[str], columns: str) -> str:
    """Steps along every series and carries time and values of the last row kept."""
    kept = f"epoch(o.recorded_at) - epoch(w.at) >= {fixed.WRITE_TTL_SECONDS}"
    for v in values:
        kept += f" OR w.last_{v} IS NULL OR w.last_{v} = 0 OR abs(o.{v} - w.last_{v}) / w.last_{v} > {fixed.WRITE_THRESHOLD}"
    first = ", ".join(f"{v} AS last_{v}" for v in values)
    carried = ", ".join(f"CASE WHEN {kept} THEN o.{v} ELSE w.last_{v} END" for v in values)
    return f"""SELECT server_id, faction, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ') AS recorded_at, {columns} FROM (
  WITH RECURSIVE o AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY server_id, faction ORDER BY {order}) AS rn FROM {rows}),
  w AS (
    SELECT server_id, faction, rn, recorded_at AS at, {first}, TRUE AS kept FROM o WHERE rn = 1
    UNION ALL
    SELECT o.server_id, o.faction, o.rn, CASE WHEN {kept} THEN o.recorded_at ELSE w.at END, {carried},
           coalesce({kept}, FALSE)
    FROM w JOIN o ON o.server_id = w.server_id AND o.faction = w.faction AND o.rn = w.rn + 1)
  SELECT o.* FROM w JOIN o USING (server_id, faction, rn) WHERE kept)"""


THROTTLED = _walk("raw_ticks", "recorded_at, event_id, index_price", ["index_price"],
                  "event_id, round(index_price, 8) AS index_price")


@query("w6_change_throttle", THROTTLED)
def _(t):
    rows = t.raw_ticks.select("server_id", "faction", "recorded_at", "event_id", "index_price")
    return shown(throttle.significant_changes(rows, ["server_id", "faction"], "recorded_at", ["index_price"],
                                              ["event_id"]))


@query("w7_two_value_throttle", _walk(
    "ticks", "recorded_at, index_price, best_ask NULLS FIRST", ["index_price", "best_ask"],
    "round(index_price, 8) AS index_price, round(best_ask, 8) AS best_ask"))
def _(t):
    rows = t.ticks.select("server_id", "faction", "recorded_at", "index_price", "best_ask")
    return shown(throttle.significant_changes(rows, ["server_id", "faction"], "recorded_at",
                                              ["index_price", "best_ask"]))


# --- age --------------------------------------------------------------------------------

@query("st8_staleness", """
SELECT server_id, faction, CAST(epoch(TIMESTAMP '2024-01-30 20:00:00') - epoch(max(recorded_at)) AS BIGINT)
         AS age_seconds, epoch(TIMESTAMP '2024-01-30 20:00:00') - epoch(max(recorded_at)) > 600 AS is_stale
FROM ticks GROUP BY 1, 2""")
def _(t):
    return jobs.staleness(t.ticks, F.lit("2024-01-30 20:00:00").cast("timestamp"))


@query("st9_retention", f"""
SELECT '5m' AS tier, count(*) FILTER (recorded_at >= TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY) AS kept,
       count(*) FILTER (recorded_at < TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY) AS deleted FROM tier_5m UNION ALL
SELECT '1m', count(*) FILTER (recorded_at >= TIMESTAMP '{AS_OF}' - INTERVAL '5' MINUTE),
       count(*) FILTER (recorded_at < TIMESTAMP '{AS_OF}' - INTERVAL '5' MINUTE) FROM ticks UNION ALL
SELECT '1h', count(*), 0 FROM tier_1h""")
def _(t):
    out = None
    for name, table in (("5m", t.tier_5m), ("1m", t.ticks), ("1h", t.tier_1h)):
        part = history.retention_report(table, "recorded_at", name, as_of()).withColumn("tier", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
