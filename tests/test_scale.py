"""The skew-safe building blocks against brute force, with one key holding most rows."""

import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from tidemark.operators import scale, series, throttle


def skewed(n=600, seed=3):
    rnd = random.Random(seed)
    return [(("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(9)}"), round(rnd.choice([1.5, rnd.uniform(0.01, 90)]), 2), i)
            for i in range(n)]


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_order_statistics_and_median(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, v double, i int")
    total = F.col("total")
    got = {r["k"]: r for r in scale.order_statistics(df, ["k"], "v", {"q1": F.floor(total * 0.25)}).collect()}
    mid = {r["k"]: r["median"] for r in scale.median(df, ["k"], "v").collect()}
    for key, group in by_key(rows).items():
        values = sorted(r[1] for r in group)
        assert got[key]["q1"] == values[int(len(values) * 0.25)] and got[key]["n"] == len(values)
        assert abs(mid[key] - statistics.median(values)) < 1e-9


def test_number_rows(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, v double, i int").repartition(7)
    got = {(r["k"], r["i"]): r["position"] for r in scale.number_rows(df, ["k"], ["v", "i"]).collect()}
    want = {(k, r[2]): n + 1 for k, g in by_key(rows).items()
            for n, r in enumerate(sorted(g, key=lambda r: (r[1], r[2])))}
    assert got == want


def test_first_per_key_limits_ahead_of_the_shuffle(spark):
    df = spark.createDataFrame(skewed(), "k string, v double, i int")
    plan = scale.first_per_key(df, ["k"], [F.col("v"), F.col("i")], 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def ticks(n=500, seed=5):
    rnd, at, out = random.Random(seed), dt.datetime(2024, 1, 1), []
    price = 100.0
    for i in range(n):
        at += dt.timedelta(seconds=rnd.choice([20, 300, 900, 4000]))
        price *= 1 + rnd.choice([0, 0.001, -0.002, 0.004, 0.02])
        out.append(("hot" if i % 5 else "cold", at, price))
    return out


def fold(rows):
    kept, last = [], {}
    for k, at, v in rows:
        old = last.get(k)
        if old is None or (at - old[0]).total_seconds() >= 3600 or abs(v - old[1]) / old[1] > 0.005:
            kept.append((k, at, v))
            last[k] = (at, v)
    return sorted(kept)


def test_throttle_is_the_same_for_any_slice_length(spark):
    rows = ticks()
    df = spark.createDataFrame(rows, "k string, at timestamp, v double")
    for length in (7, 10_000):
        out = throttle.significant_changes(df, ["k"], "at", ["v"], slice_rows=length)
        assert sorted((r["k"], r["at"], r["v"]) for r in out.collect()) == fold(rows)


def test_moving_average_across_slices(spark):
    rows = ticks(200)
    df = spark.createDataFrame(rows, "k string, at timestamp, v double")
    got = {(r["k"], r["at"]): r["smooth"] for r in series.smoothed(df, ["k"], "at", "v").collect()}
    for k, g in by_key(rows).items():
        for i, r in enumerate(g):
            around = [x[2] for x in g[max(0, i - 1):i + 2]]
            assert abs(got[k, r[1]] - sum(around) / len(around)) < 1e-9


def test_null_keys_and_values(spark):
    rows = [(None, 1.0, 0), (None, 3.0, 1), ("a", 1.0, 2), ("a", 2.0, 3), ("a", None, 4)]
    df = spark.createDataFrame(rows, "k string, v double, i int")
    assert scale.number_rows(df, ["k"], ["v", "i"]).count() == 5
    mid = {r["k"]: (r["median"], r["n"]) for r in scale.median(df, ["k"], "v").collect()}
    assert mid == {None: (2.0, 2), "a": (1.5, 2)}
    stamped = df.withColumn("t", F.timestamp_seconds(F.col("i").cast("long") * 90000 + 1))
    assert scale.with_neighbours(stamped, ["k"], "t", "v").count() == 5
    assert {r["k"] for r in throttle.significant_changes(stamped, ["k"], "t", ["v"]).collect()} == {None, "a"}


def test_as_of(spark):
    rnd = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    at = lambda: start + dt.timedelta(minutes=rnd.randrange(300))
    facts = [(i, "hot" if i % 10 < 7 else rnd.choice(["a", "b", "no rate", None]), at() if i % 50 else None, f"x{i}") for i in range(900)]
    rates = [(k, at(), round(rnd.random(), 3)) for k in ("hot", "hot", "a", "b", "unused") for _ in range(40)]
    rates += [(*rates[0][:2], 2.0), (None, start, 3.0), ("a", None, 4.0)]
    df = spark.createDataFrame(facts, "i int, key string, time timestamp, fact string").repartition(5)
    dim = spark.createDataFrame(rates, "code string, since timestamp, rate double").withColumnRenamed("code", "key")
    got = scale.as_of(df, dim, "key", "time", "since", "found").collect()
    assert len(got) == len(facts)
    for r in got:
        i, key, time, fact = facts[r["i"]]
        assert (r["key"], r["time"], r["fact"]) == (key, time, fact)
        known = [(s, v) for k, s, v in rates if k == key and None not in (k, s, time) and s <= time]
        assert (tuple(r["found"]) if r["found"] else None) == max(known, default=None)
    assert scale.as_of(df.limit(0), dim, "key", "time", "since", "found").count() == 0
    assert scale.as_of(df, dim.limit(0), "key", "time", "since", "found").filter("found is not null").count() == 0


def test_order_statistics_cut_large_inputs_into_small_tasks(spark, monkeypatch):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    monkeypatch.setattr(scale, "ROWS_PER_TASK", 10)
    seen = []
    stored = scale.materialize
    monkeypatch.setattr(scale, "materialize", lambda df, at: (seen.append(spark.conf.get(name)), stored(df, at))[1])
    rows = [(i % 3, float(i * 7 % 101)) for i in range(200)]
    mid = scale.median(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()
    assert seen == ["20"] and spark.conf.get(name) == before
    assert {r["k"]: r["median"] for r in mid} == {k: statistics.median(v for j, v in rows if j == k) for k in range(3)}
