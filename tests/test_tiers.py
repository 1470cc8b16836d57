"""Stored tiers: written forward, finished after a crash, read by partition."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history
from tidemark.session import new_path
from tidemark.sources.tiers import TierStore

COLUMNS = ["server_id", "faction", "recorded_at", "index_price", "best_ask", "sample_size"]


@pytest.fixture(scope="module")
def ticks(spark):
    minutes = spark.range(0, 4 * 24 * 60, 7)
    return (minutes.select((F.col("id") % 5).cast("int").alias("server_id"), F.when(F.col("id") % 2 == 0, "Horde").otherwise("Alliance").alias("faction"),
                           (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("recorded_at"),
                           (F.col("id") % 13 + 1).cast("double").alias("index_price"), F.lit(None).cast("double").alias("best_ask"),
                           (F.col("id") % 9).cast("int").alias("sample_size"))
            .withColumn("date", F.to_date("recorded_at")))


def content(df):
    return sorted(map(str, map(tuple, df.select(*COLUMNS).collect())))


def whole(ticks):
    tiers, source = {}, ticks
    for name in ("5m", "1h", "1d"):
        tiers[name] = source = history.rollup(source, name)
    return {name: content(df) for name, df in tiers.items()}


def test_runs_from_the_mark_equal_one_rollup(spark, ticks):
    store = TierStore(spark, new_path(spark, "tiers"))
    store.advance(ticks.filter("recorded_at < '2024-01-02 10:20:00'"), "2024-01-02 10:03:00")
    assert store.marks() == {"5m": "2024-01-02 10:00:00", "1h": "2024-01-02 10:00:00", "1d": "2024-01-02 00:00:00"}
    assert store.tier("5m").agg(F.max("recorded_at")).first()[0].isoformat() < "2024-01-02T10:00:00"
    for _ in range(2):  # running it again changes nothing
        store.advance(ticks, "2024-02-01 00:00:00")
        assert {name: content(df) for name, df in store.tiers().items()} == whole(ticks)


def test_a_run_that_dies_is_finished_by_the_next(spark, ticks, monkeypatch):
    store = TierStore(spark, new_path(spark, "tiers"))
    with monkeypatch.context() as broken:
        finish, calls = TierStore._finish, []
        broken.setattr(TierStore, "_finish", lambda self: finish(self) if not calls.append(1) and len(calls) < 2 else (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.advance(ticks, "2024-02-01 00:00:00")
    assert store.marks() == {} and store.tier("5m").count() == 0
    store.advance(ticks, "2024-02-01 00:00:00")
    assert {name: content(df) for name, df in store.tiers().items()} == whole(ticks)


def test_reads_are_pruned_by_day_and_realm(spark, ticks):
    store = TierStore(spark, new_path(spark, "tiers"))
    store.advance(ticks, "2024-02-01 00:00:00")
    at = F.lit("2024-01-04 00:00:00").cast("timestamp")
    read = history.history(store.tiers(), 3, "horde", 24, at)
    plan = read._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    assert "date" in filters and "part" in filters and read.count() > 0
    servers = spark.createDataFrame([(3, "Realm", "EU", "Classic"), (4, "Other", "EU", "Classic")], "id int, name string, region string, version string")
    named = history.history_by_name(store.tiers(), servers, "realm", "eu", "classic", "horde", 24, at)
    assert "dynamicpruning" in named._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted(map(str, named.collect())) == sorted(map(str, read.collect()))
