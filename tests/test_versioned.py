"""Keyed and snapshot tables: what is rewritten, what a crash and a repeated batch leave."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.session import new_path
from tidemark.sources import tables
from tidemark.sources.versioned import KeyedTable, Manifest
from tidemark.streaming import jobs

SCHEMA = schemas._schema("k int, v int, at int, bucket int")
OFFER = "source string, id string, server_id int, faction string, price_per_1k double, fetched_at timestamp, cycle bigint"


def keyed(spark, path, **more):
    return KeyedTable(spark, path, SCHEMA, ["k"], [F.desc("at")], [F.col("v")], **more)


def rows(spark, values):
    return spark.createDataFrame([(*x, x[0] % 4) for x in values], SCHEMA)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if "/_log" not in d}


def content(table):
    return {r["k"]: (r["v"], r["at"]) for r in table.read().collect()}


def test_one_row_rewrites_no_old_file(spark):
    path = new_path(spark, "keyed")
    table = keyed(spark, path)
    table.write(rows(spark, [(k, k, 1) for k in range(40)]))
    before = files(path)
    table.write(rows(spark, [(5, 50, 2), (5, 49, 1)]))
    after = files(path)
    assert before.items() <= after.items() and len(content(table)) == 40 and content(table)[5] == (50, 2)
    table.write(rows(spark, [(5, 7, 1), (6, 60, 1)]))  # late for 5, a tie for 6
    assert content(table)[5] == (50, 2) and content(table)[6] == (60, 1)


def test_crash_between_write_and_commit_and_repeated_batches(spark, monkeypatch):
    path = new_path(spark, "keyed")
    table = keyed(spark, path)
    table.write(rows(spark, [(1, 1, 1)]), "job", 0)
    with monkeypatch.context() as broken:
        broken.setattr(Manifest, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.write(rows(spark, [(1, 2, 2)]), "job", 1)
    assert content(table) == {1: (1, 1)}
    table.write(rows(spark, [(1, 2, 2)]), "job", 1)
    table.write(rows(spark, [(1, 9, 9)]), "job", 1)  # was committed
    assert content(table) == {1: (2, 2)}
    version, state = table.manifest.newest()
    with pytest.raises(RuntimeError):
        table.manifest.commit(version - 1, state)


def test_batches_against_brute_force_and_compaction(spark):
    rnd, path = random.Random(4), new_path(spark, "keyed")
    table, want = keyed(spark, path, share=0.6, most=3), {}
    for number in range(9):
        batch = [(rnd.randrange(30), rnd.randrange(99), rnd.randrange(6)) for _ in range(rnd.choice([0, 1, 12]))]
        best = {}
        for k, v, at in batch:
            best[k] = min(best.get(k, (1, 0)), (-at, v))
        for k, (less, v) in best.items():
            if k not in want or -less >= want[k][1]:
                want[k] = (v, -less)
        table.write(rows(spark, batch), "job", number)
        assert content(table) == want
    state = table.manifest.newest()[1]
    held = [b for p in state["parts"] for b in p["rows"]]
    assert all(held.count(b) <= 3 for b in held)
    table.manifest.sweep(path)  # what the version before the last one held has gone meanwhile
    named = {p["folder"] for v in table.manifest.versions() for p in table.manifest.at(v)["parts"]}
    assert {f for f in os.listdir(path) if not f.startswith("_")} == named


def offers(spark, values):
    made = [(s, i, 7, "Horde", p, f"2024-01-01 {t}", c) for s, i, p, t, c in values]
    return spark.createDataFrame(made, OFFER.replace("timestamp", "string")).withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))


def test_delisted_offers_leave(spark):
    landed, current, path, checkpoint = (new_path(spark, n) for n in ("landed", "market", "ticks", "cp"))
    loads = [[("g2g", "a", 1.0, "10:00:00", 1), ("g2g", "b", 1.2, "10:00:00", 1), ("funpay", "c", 1.5, "10:00:01", 1)],
             [("g2g", "b", 1.4, "10:01:00", 2)],  # a is delisted; funpay's empty cycle keeps c
             [("funpay", "d", 1.1, "10:02:00", 3), ("g2g", "a", 0.1, "10:02:00", 1)],  # an old cycle comes late
             [("funpay", "e", 1.3, "10:03:00", 3)]]  # more of a cycle
    seen = []
    for load in loads:
        offers(spark, load).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(OFFER).parquet(landed)
        jobs.start_tick_writer(stream, current, path, checkpoint, {"availableNow": True}).awaitTermination()
        seen.append({r["id"] for r in tables.market(spark, current).read().collect()})
    assert seen == [{"a", "b", "c"}, {"b", "c"}, {"b", "d"}, {"b", "d", "e"}]
    ticks = tables.read(spark, path, schemas.TICKS).filter("faction = 'Horde'").orderBy("recorded_at")
    assert [(r.index_price, r.best_ask, r.sample_size) for r in ticks.collect()] == [
        (0.00125, 0.001, 2), (0.00145, 0.0014, 2), (0.00125, 0.0011, 2), (0.00125, 0.0011, 2)]


def test_a_stream_leaves_only_its_tables(spark, tmp_path):
    """The sinks' staged tables are gone after five batches."""
    path = new_path(spark, "ticks")
    parent = os.path.dirname(path)
    before = set(os.listdir(parent))
    for minute in range(5):
        tick = spark.sql(f"SELECT 1 AS server_id, 'Horde' AS faction, timestamp '2024-01-01 10:0{minute}:00' AS recorded_at, 1D AS index_price, 1D AS best_ask, 1 AS sample_size")
        tables.insert_ticks(tick, path)
        tables.upsert_ticks(tick, path)
    assert set(os.listdir(parent)) - before == {os.path.basename(path)}
