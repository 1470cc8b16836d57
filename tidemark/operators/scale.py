"""Building blocks that keep hot keys out of single tasks.

A plain window over a key puts all rows of that key into one task. The helpers here give
the same answers from pieces of bounded size: value bins, time slices or range partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import materialize


ROWS_PER_TASK = 500_000  # rows of a shuffle partition where every row may be a group of its own
_SMALL = {"spark.sql.shuffle.partitions": None, "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
          "spark.sql.files.maxPartitionBytes": "16m"}


@contextmanager
def small_tasks(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles of queries that run inside have a partition per ``ROWS_PER_TASK`` of ``rows``, if that is more
    than the session's number, and files are read in small pieces, so a task's memory does not grow with
    the input. Results that leave the block must be stored in it."""
    parts = -(-rows // ROWS_PER_TASK)
    if parts <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        yield
        return
    before = {name: spark.conf.get(name) for name in _SMALL}
    try:
        for name, value in _SMALL.items():
            spark.conf.set(name, value or parts)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def lookup(facts: DataFrame, dim: DataFrame, on, how: str = "left", store: bool = False) -> DataFrame:
    """Join a large table with a dimension that has one row per key.

    The kind of join is left to adaptive execution, which knows sizes at run time. ``store`` is for
    sides that are the result of a large aggregation: they are written once.
    """
    if store:
        dim = materialize(dim, "side")
    return facts.join(dim, on, how)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row.

    Spark moves filters below a projection and merges projections, and then computes an expression once
    for every use; nothing moves through a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on all keys where null equals null; the keys come from the left side."""
    names = {k: f"_right_{k}" for k in keys}
    other = right.withColumnsRenamed(names)
    condition = None
    for k, name in names.items():
        equal = left[k].eqNullSafe(other[name])
        condition = equal if condition is None else condition & equal
    return left.join(other, condition, how).drop(*names.values())


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1,
                  rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of every key.

    Spark keeps only ``n`` rows per key and task ahead of the shuffle (window group limit),
    so a hot key costs no more than any other.
    """
    name = rank or "_rank"
    ranked = (df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
              .filter(F.col(name) <= n))
    return ranked if rank else ranked.drop(name)


FILTER_WORDS = 1 << 20  # of 64 bits each
_BIT = "cast(shiftrightunsigned(_h, 58) as int)"


def _word() -> Column:
    return F.col("_h").bitwiseAND(F.lit(FILTER_WORDS - 1))


def repeated(rows: DataFrame, *key: str) -> tuple[DataFrame, int]:
    """A bitmap of the keys that several rows have, for ``maybe``, and the number of rows; a null key is a key.

    Only hashes of the keys are shuffled. The bitmap has 2**26 bits at most, whatever the number of keys. It is stored.
    """
    counted = rows.select(F.xxhash64(*key).alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias("_n"))
    words = materialize(counted.groupBy(_word().alias("_word")).agg(
        F.bit_or(F.when(F.col("_n") > 1, F.expr(f"shiftleft(1L, {_BIT})"))).alias("_bits"), F.sum("_n").alias("_rows")), "repeated")
    return words.filter("_bits IS NOT NULL").drop("_rows"), words.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]


def maybe(rows: DataFrame, bits: DataFrame, *key: str) -> DataFrame:
    """``rows`` with a column _may: false only where ``key`` is surely not in the bitmap.

    Many keys fill the bitmap, and then more rows are marked in vain; who needs certainty looks at these.
    """
    seen = rows.withColumn("_h", F.xxhash64(*key)).join(F.broadcast(bits), _word() == F.col("_word"), "left")
    hit = F.expr(f"shiftrightunsigned(_bits, {_BIT}) & 1 = 1")
    return seen.withColumn("_may", F.coalesce(hit, F.lit(False))).drop("_h", "_word", "_bits")


def value_bin(c: Column) -> Column:
    """Bin that grows with the value: 64 bins for every doubling, one for all values <= 0."""
    return F.coalesce(F.when(c > 0, F.floor(F.log2(c) * 64)), F.lit(-(1 << 40))).cast("long")


def cumulative(df: DataFrame, keys: Sequence[str], value: str, weight: Column | None = None,
               needed: Column | None = None) -> DataFrame:
    """Running weight over the distinct values of every key, in value order.

    Null values count nowhere; a null key is a key. Returns keys, ``v``, ``w`` (weight at v), ``before``, ``upto`` and ``total``. Equal
    values are summed ahead of the shuffle; the running sum is taken over bins first and
    then inside each bin, so no window holds more than the distinct values of one bin.
    ``needed`` (a condition on bin_before, bin_upto, total) drops bins that cannot matter. Rows are counted
    first, the result is stored.
    """
    rows = df.filter(F.col(value).isNotNull())
    with small_tasks(df.sparkSession, rows.count()):
        return materialize(_cumulative(rows, list(keys), value, weight, needed), "cumulative")


def _cumulative(rows: DataFrame, keys: list[str], value: str, weight: Column | None, needed: Column | None) -> DataFrame:
    w = F.lit(1) if weight is None else weight
    per_value = (rows.groupBy(*keys, F.col(value).alias("v")).agg(F.sum(w).alias("w"))
                 .withColumn("bin", value_bin(F.col("v"))))
    bins = per_value.groupBy(*keys, "bin").agg(F.sum("w").alias("bin_w"))
    by_key = Window.partitionBy(*keys)
    bins = (bins.withColumn("bin_upto", F.sum("bin_w").over(by_key.orderBy("bin")))
            .withColumn("total", F.sum("bin_w").over(by_key))
            .withColumn("bin_before", F.col("bin_upto") - F.col("bin_w")))
    if needed is not None:
        bins = bins.filter(needed)
    in_bin = Window.partitionBy(*keys, "bin").orderBy("v")
    return (same_key(per_value, bins.drop("bin_w", "bin_upto"), [*keys, "bin"])
            .withColumn("upto", F.col("bin_before") + F.sum("w").over(in_bin))
            .withColumn("before", F.col("upto") - F.col("w"))
            .select(*keys, "v", "w", "before", "upto", "total"))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str,
                     positions: dict[str, Column], weight: Column | None = None) -> DataFrame:
    """Exact values at 0-based sorted positions per key.

    ``positions`` maps an output name to an expression over ``total`` (rows of the key). A
    row stands for ``weight`` equal values.
    """
    inside = None
    for position in positions.values():
        hit = (F.col("bin_before") <= position) & (position < F.col("bin_upto"))
        inside = hit if inside is None else inside | hit
    cum = cumulative(df, keys, value, weight, inside)
    picks = [F.max(F.when((F.col("before") <= p) & (p < F.col("upto")), F.col("v"))).alias(name)
             for name, p in positions.items()]
    return cum.groupBy(*keys).agg(*picks, F.max("total").alias("n"))


def median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact interpolated median per key, with the row count ``n``."""
    total = F.col("total")
    low, high = F.floor((total - 1) / 2), F.floor(total / 2)
    return (order_statistics(df, keys, value, {"_low": low, "_high": high})
            .withColumn(name, (F.col("_low") + F.col("_high")) / 2)
            .select(*keys, name, "n"))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                name: str = "position") -> DataFrame:
    """1-based position of every row inside its key.

    Rows are range-partitioned by (keys, order) and stored once; the position is the place
    inside the partition plus the rows of the same key in earlier partitions. ``order`` must
    be total, which also means that even equal prices are spread over partitions.
    """
    keys = list(keys)
    sort = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    place = F.monotonically_increasing_id()
    ranged = (df.repartitionByRange(*sort).sortWithinPartitions(*sort)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_place", place))
    stored = materialize(ranged, "ranked")
    pieces = (stored.groupBy(*keys, "_part")
              .agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows")))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (pieces.withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
              .drop("_rows"))
    return (same_key(stored, pieces, [*keys, "_part"])
            .withColumn(name, F.col("_place") - F.col("_first") + F.col("_offset") + 1)
            .drop("_part", "_place", "_first", "_offset"))


def with_neighbours(df: DataFrame, keys: Sequence[str], time: str, value: str,
                    slice_: Column | None = None) -> DataFrame:
    """Adds ``prev_value`` and ``next_value`` along time, one row per key and time.

    Windows run inside time slices (a day unless given); the rows at the edges take their
    neighbour from the nearest slice that has rows.
    """
    keys = list(keys)
    cut = F.date_trunc("day", time) if slice_ is None else slice_
    sliced = df.withColumn("_slice", cut)
    edges = (sliced.groupBy(*keys, "_slice")
             .agg(F.min_by(value, time).alias("_head"), F.max_by(value, time).alias("_tail")))
    along = Window.partitionBy(*keys).orderBy("_slice")
    edges = (edges.withColumn("_before", F.lag("_tail").over(along))
             .withColumn("_after", F.lead("_head").over(along))
             .select(*keys, "_slice", "_before", "_after"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(time)
    return (same_key(sliced, edges, [*keys, "_slice"])
            .withColumn("prev_value", F.coalesce(F.lag(value).over(inside), F.col("_before")))
            .withColumn("next_value", F.coalesce(F.lead(value).over(inside), F.col("_after")))
            .drop("_slice", "_before", "_after"))


def as_of(facts: DataFrame, dim: DataFrame, key: str, at: str, since: str, found: str) -> DataFrame:
    """Every fact with the last row of ``dim`` of its key whose ``since`` is not after its ``at``.

    ``found`` holds that row as a struct, null without one; facts without key or time have none. Both
    sides are range-partitioned together by (key, time), so a key with most of the facts is spread over
    partitions; each partition takes the last row seen inside it, or else the last one of the partitions
    before. Of several rows with one ``since`` the greatest counts.
    """
    row = F.struct(since, *(c for c in dim.columns if c not in (key, since)))
    steps = (dim.filter(F.col(key).isNotNull() & F.col(since).isNotNull())
             .groupBy(F.col(key).alias("key"), F.col(since).alias("time")).agg(F.max(row).alias("step")))
    rows = facts.select(F.col(key).alias("key"), F.col(at).alias("time"), F.struct("*").alias("fact"))
    both = steps.withColumn("fact", F.lit(None).cast(rows.schema["fact"].dataType)).unionByName(
        rows.withColumn("step", F.lit(None).cast(steps.schema["step"].dataType)))
    # equal times are parted by a hash of the fact; a step lies ahead of the facts of its time
    late, tie = F.col("fact").isNotNull(), F.xxhash64("fact")
    merged = materialize(both.withColumns({"late": late, "tie": F.when(late, tie)})
                         .repartitionByRange("key", "time", "late", "tie").withColumn("part", F.spark_partition_id()), "as-of")
    last = merged.filter("step is not null").groupBy("key", "part").agg(F.max("step").alias("last"))
    parts = merged.select("key", "part").distinct().join(last, ["key", "part"], "left")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (parts.withColumn("carried", F.last("last", True).over(before)).filter("carried is not null")
               .select(F.col("key").alias("_key"), F.col("part").alias("_part"), "carried"))
    inside = Window.partitionBy("part", "key").orderBy("time", "late").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = merged.withColumn("seen", F.last("step", True).over(inside)).filter("late")
    out = seen.join(carried, (F.col("key") == F.col("_key")) & (F.col("part") == F.col("_part")), "left")
    return out.select("fact.*", F.when(F.col("time").isNotNull(), F.coalesce("seen", "carried")).alias(found))
