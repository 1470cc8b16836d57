"""Streaming jobs. Sinks are written so that a repeated micro-batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark import schemas
from tidemark.functions import fixed
from tidemark.operators.filters import since
from tidemark.operators.indexes import server_index
from tidemark.operators.quality import normalize
from tidemark.operators.scale import first_per_key
from tidemark.session import free_shuffles, remove_path
from tidemark.sources import tables

WATERMARK = {"5m": "10 minutes", "1h": "2 hours", "1d": "2 days"}
WINDOW = {"5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str,
           trigger: dict[str, Any] | None) -> StreamingQuery:
    return (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def start_normalizer(listings: DataFrame, aliases: DataFrame, servers: DataFrame, clean_path: str,
                     rejected_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Every micro-batch through the batch pipeline; a batch owns one partition per output.

    Clean rows are stored with the columns of listings. Those of a large batch are made slice by slice, and
    shuffle files of a step go before the next one, so the disk holds those of one slice.
    """
    def stored(rows: DataFrame, path: str, number: int, mode: str) -> None:
        (rows.withColumn("batch", F.lit(number)).write.mode(mode).option("partitionOverwriteMode", "dynamic")
         .option("compression", "zstd").partitionBy("batch").parquet(path))
        free_shuffles(rows.sparkSession)

    def each(batch: DataFrame, number: int) -> None:
        out = normalize(batch, aliases, servers)
        stored(out.rejected, rejected_path, number, "overwrite")
        slices = out.sliced(batch)
        if len(slices) == 1:
            return stored(slices[0].clean_of(*batch.columns), clean_path, number, "overwrite")
        # a batch that is repeated begins anew, also if its first slice has no row
        remove_path(batch.sparkSession, f"{clean_path}/batch={number}")
        for part in slices:
            stored(part.clean_of(*batch.columns), clean_path, number, "append")
    return _start(listings, each, checkpoint, trigger)


def start_tick_writer(offers: DataFrame, current_path: str, path: str, checkpoint: str,
                      trigger: dict | None = None, hours: int | None = None) -> StreamingQuery:
    """Per micro-batch the index of every (server, faction or All) over the whole market.

    Offers with a column ``cycle`` replace their source's offers as a whole once a newer cycle has any, so
    delisted offers leave; without it they are added to the current offers by key. The index is taken
    over the market as it then stands, at the minute of its newest offer. With ``hours``, offers not seen
    for that long before the newest one no longer count.
    """
    cycles = "cycle" in offers.columns

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if cycles:
            order = [F.desc("fetched_at"), F.col("price_per_1k"), F.col("faction"), F.col("server_id")]
            kept = tables.market(spark, current_path)
            kept.write(first_per_key(batch, ["source", "cycle", "id"], order), checkpoint, number)
            market = kept.read()
        else:
            tables.upsert_offers(batch, current_path, checkpoint, number)
            market = tables.read(spark, current_path, schemas.CURRENT_OFFERS)
        newest = market.agg(F.max("fetched_at")).first()[0]
        if newest is None:
            return
        if hours is not None:
            market = since(market, "fetched_at", newest, hours)
        ticks = server_index(market).withColumn("recorded_at", F.date_trunc("minute", F.lit(newest)))
        tables.insert_ticks(ticks, path)
    return _start(offers, each, checkpoint, trigger or {"processingTime": "60 seconds"})


def rolled_up(ticks: DataFrame, tier: str) -> DataFrame:
    """Event-time rollup; a bucket is final once the watermark has passed its end."""
    return (ticks.withWatermark("recorded_at", WATERMARK[tier])
            .groupBy("server_id", "faction", F.window("recorded_at", WINDOW[tier]).alias("w"))
            .agg(F.avg("index_price").alias("index_price"), F.min("best_ask").alias("best_ask"),
                 F.max("sample_size").alias("sample_size"))
            .select("server_id", "faction", F.col("w.start").alias("recorded_at"), "index_price",
                    "best_ask", "sample_size"))


def start_rollup(ticks: DataFrame, tier: str, path: str, checkpoint: str,
                 trigger: dict | None = None) -> StreamingQuery:
    """Appends closed buckets; the next tier reads the files as they arrive."""
    return (rolled_up(ticks, tier).writeStream.outputMode("append").format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def start_open_buckets(ticks: DataFrame, tier: str, path: str, checkpoint: str,
                       trigger: dict | None = None) -> StreamingQuery:
    """Buckets as they stand, changed ones rewritten by key."""
    rolled = rolled_up(ticks, tier)

    def each(batch: DataFrame, _: int) -> None:
        tables.upsert_ticks(batch, path)
    return (rolled.writeStream.outputMode("update").foreachBatch(each)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def deduplicated(offers: DataFrame, time: str = "fetched_at", delay: str = "10 minutes") -> DataFrame:
    """One row per (source, id) as long as repeats arrive within the delay."""
    return offers.withWatermark(time, delay).dropDuplicatesWithinWatermark(["source", "id"])


def start_current_index(index: DataFrame, path: str, checkpoint: str,
                        trigger: dict | None = None) -> StreamingQuery:
    """Keeps the newest index per (server, faction)."""
    def each(batch: DataFrame, number: int) -> None:
        tables.upsert_index(batch, path, checkpoint, number)
    return _start(index, each, checkpoint, trigger)


def last_good(offers: DataFrame, cycles: DataFrame) -> DataFrame:
    """Offers of the newest non-empty cycle of every source.

    cycles(source, cycle, offers) logs every cycle, empty ones too.
    """
    newest = (cycles.filter("offers > 0").groupBy("source").agg(F.max("cycle").alias("cycle")))
    return offers.join(F.broadcast(newest), ["source", "cycle"])  # one row per source


def staleness(ticks: DataFrame, as_of: Column, limit: float = fixed.PROFILE_STALE_SECONDS) -> DataFrame:
    """Age of the newest tick per series and whether it is stale."""
    age = F.unix_timestamp(as_of) - F.unix_timestamp(F.max("recorded_at"))
    return (ticks.groupBy("server_id", "faction").agg(age.alias("age_seconds"))
            .withColumn("is_stale", F.col("age_seconds") > limit))


def throttled(stream: DataFrame, keys: list[str], time: str, values: list[str],
              order: list[str] | None = None, threshold: float = fixed.WRITE_THRESHOLD,
              ttl: int = fixed.WRITE_TTL_SECONDS, delay: str = "1 hour") -> DataFrame:
    """Keeps a row when a value moved by more than the threshold since the last row kept.

    One small state per key: time and values of the last row kept. It stops counting ``ttl``
    seconds of event time later and is removed once the watermark has passed that moment.
    """
    columns = stream.columns
    sequence = [time, *(order or []), *values]

    def moved(new: tuple, old: tuple) -> bool:
        return any(o == 0 or abs(n - o) / o > threshold for n, o in zip(new, old))

    def keep(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(parts)).sort_values(sequence, kind="stable")
        last = state.get if state.exists else None
        kept = []
        times = batch[time].astype("datetime64[us]").astype("int64") / 1e6
        for place, (at, new) in enumerate(zip(times, batch[values].itertuples(index=False, name=None))):
            if last is None or at - last[0] >= ttl or moved(new, last[1:]):
                kept.append(place)
                last = (float(at), *map(float, new))
        expires = int((last[0] + ttl) * 1000) + 1
        if expires > state.getCurrentWatermarkMs():
            state.update(last)
            state.setTimeoutTimestamp(expires)
        elif state.exists:
            state.remove()
        yield batch.iloc[kept][columns]

    fields = ", ".join(f"v{i} double" for i in range(len(values)))
    return stream.withWatermark(time, delay).groupBy(*keys).applyInPandasWithState(
        keep, stream.schema, f"at double, {fields}", "append", GroupStateTimeout.EventTimeTimeout)
