"""Streamed results against the batch operators on the same rows."""

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


def test_throttle_stream_equals_batch(spark):
    assert rows(spark, "st5_stateful_throttle") == rows(spark, "w6_change_throttle")


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ticks_cover_the_whole_market(spark):
    """Every micro-batch brings one offer of a realm; its tick counts the offers seen before too."""
    from tidemark import schemas
    from tidemark.session import new_path
    from tidemark.sources import tables
    from tidemark.streaming import jobs

    schema = "source string, id string, server_id int, faction string, price_per_1k double, fetched_at timestamp"
    landed, current, path, checkpoint = (new_path(spark, n) for n in ("landed", "market", "ticks", "cp"))
    loads = [[("g2g", "a", 7, "Horde", 1.0, "10:00:05")], [("funpay", "b", 7, "Horde", 1.5, "10:01:00")],
             [("playerauctions", "c", 7, "horde", 1.9, "10:02:00")],
             [("g2g", "a", 7, "Horde", 1.6, "10:03:00"), ("funpay", "b", 7, "Horde", 0.1, "09:00:00")]]
    for load in loads:
        rows = spark.createDataFrame([(*r[:5], f"2024-01-01 {r[5]}") for r in load], schema.replace("timestamp", "string"))
        rows.withColumn("fetched_at", rows.fetched_at.cast("timestamp")).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(schema).parquet(landed)
        jobs.start_tick_writer(stream, current, path, checkpoint, {"availableNow": True}).awaitTermination()
    ticks = tables.read(spark, path, schemas.TICKS).filter("faction = 'Horde'").orderBy("recorded_at")
    assert [(r.index_price, r.sample_size) for r in ticks.collect()] == [
        (0.001, 1), (0.00125, 2), (0.00146667, 3), (0.00166667, 3)]
