"""What the operators share: tables by path, storing in the shared folder, small frame helpers."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import new_path, release

__all__ = ["buckets", "labelled", "marked", "numbered", "release", "stable_hash", "staging", "stored", "table"]

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_FILTER_WORDS = 1 << 20  # of 64 bits: what ``marked`` broadcasts is never more than these rows of two longs
TEXTS_AT_ONCE = 2000  # whole texts that a worker holds in a batch; results do not depend on it

_staged_here: ContextVar[list[DataFrame] | None] = ContextVar("_staged_here", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the folder in spark.checkpoint.dir and reads it back.

    What follows has no lineage into the work before, so a lost executor repeats nothing of it
    and never sees other rows. ``release`` deletes it again.
    """
    path = new_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    open_list = _staged_here.get()
    if open_list is not None:
        open_list.append(out)
    return out


@contextmanager
def staging() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside are deleted at the end, also after an error, but for those handed to the
    yielded function. What leaves the block may read kept tables only. Blocks nest: what an inner one
    keeps belongs to the outer one. Shuffle files of the steps inside are given free as well, and texts
    reach the workers in batches of ``TEXTS_AT_ONCE`` rows at most."""
    outer, own, kept = _staged_here.get(), [], []
    token = _staged_here.set(own)
    spark = SparkSession.active()
    batch = int(spark.conf.get(_BATCH))
    if not 0 < batch <= TEXTS_AT_ONCE:
        spark.conf.set(_BATCH, TEXTS_AT_ONCE)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.staged_at)
        return df

    try:
        yield keep
    finally:
        _staged_here.reset(token)
        spark.conf.set(_BATCH, batch)
        release(*(df for df in own if df.staged_at not in kept))
        if outer is not None:
            outer.extend(df for df in own if df.staged_at in kept)
        # Spark deletes a shuffle's files once nothing in the driver refers to it
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def numbered(rows: DataFrame, group: str, order: Sequence[str], name: str = "idx", size: str = "n") -> DataFrame:
    """``rows`` with their place from 0 inside their group (``name``) and the group's rows (``size``).

    Rows are range-partitioned by (group, order), so a hot group spreads over partitions; only one row
    per group and partition is gathered to find where each partition begins. ``order`` should be total:
    rows that tie change places with each other. ``group`` must not be null. The columns _part and
    _place are used in between.
    """
    keys = [group, *order]
    placed = (rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()))
    placed = stored(placed, "numbered")
    pieces = placed.groupBy(group, "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    at = Window.partitionBy(group)
    earlier = at.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (pieces.withColumn(size, F.sum("_rows").over(at))
              .withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first"))
              .select(group, "_part", size, "_shift"))
    out = stored(placed.join(pieces, [group, "_part"]).withColumn(name, F.col("_place") + F.col("_shift"))
                 .select(*rows.columns, name, size), "places")
    release(placed)
    return out


def marked(rows: DataFrame, key: Sequence[str | Column], keys: DataFrame) -> DataFrame:
    """``rows`` with a column _may: false only where ``key`` is surely not among ``keys``.

    ``keys`` holds the same columns in the same order and types, nulls included, and should be stored. One hash sets
    one of 2**26 bits, so the broadcast is bounded whatever the size of ``keys``; with many keys more
    rows are marked in vain, and who needs certainty joins the marked ones. Rows that are not marked need
    no shuffle. The columns _h, _at, _word and _bits are used in between.
    """
    bit = "cast(shiftrightunsigned(_h, 58) as int)"
    bits = (keys.select(F.xxhash64(*keys.columns).alias("_h"))
            .groupBy(F.col("_h").bitwiseAND(F.lit(_FILTER_WORDS - 1)).alias("_word"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("_bits")))
    # stored first, so that the broadcast itself is short
    bits = F.broadcast(stored(bits, "bits"))
    rows = (rows.withColumn("_h", F.xxhash64(*key)).withColumn("_at", F.col("_h").bitwiseAND(F.lit(_FILTER_WORDS - 1)))
            .join(bits, F.col("_at") == F.col("_word"), "left"))
    return (rows.withColumn("_may", F.coalesce(F.expr(f"shiftrightunsigned(_bits, {bit}) & 1 = 1"), F.lit(False)))
            .drop("_h", "_at", "_word", "_bits"))


def labelled(rows: DataFrame, key: str, known: DataFrame, label: str, labels: int) -> DataFrame:
    """``rows`` with the column ``label`` of ``known``, a stored table with every ``key`` of ``rows`` and its
    label, a whole number from 0 to ``labels`` - 1.

    Every label has a bitmap as in ``marked``, of 2**26 bits for four labels and smaller for more, so the
    broadcast is bounded. A key is in the bitmap of its own label; where it is in no other, the label is
    certain and the row needs no shuffle. The rows left, few until keys are as many as bits, are joined.
    The columns _h, _at and those called _label and _word are used in between.
    """
    words = max(1, _FILTER_WORDS >> max(0, (labels - 1).bit_length() - 2))
    bit = "cast(shiftrightunsigned(_h, 58) as int)"
    at = F.col("_h").bitwiseAND(F.lit(words - 1))
    bits = (known.select(F.xxhash64(key).alias("_h"), label).groupBy(at.alias("_word"))
            .agg(*(F.bit_or(F.when(F.col(label) == i, F.expr(f"shiftleft(1L, {bit})"))).alias(f"_label{i}")
                   for i in range(labels))))
    bits = F.broadcast(stored(bits, "bits"))
    found = F.array_compact(F.array(*(F.when(F.expr(f"shiftrightunsigned(_label{i}, {bit}) & 1 = 1"), F.lit(i))
                                      for i in range(labels))))
    seen = (rows.withColumn("_h", F.xxhash64(key)).withColumn("_at", at).join(bits, F.col("_at") == F.col("_word"))
            .withColumn("_label", found))
    sure = seen.filter(F.size("_label") == 1).withColumn(label, F.element_at("_label", 1).cast("long"))
    unsure = seen.filter(F.size("_label") > 1).select(*rows.columns).join(known.select(key, label), key)
    return sure.select(*rows.columns, label).unionByName(unsure.select(*rows.columns, F.col(label).cast("long").alias(label)))


def stable_hash(*columns: str) -> Column:
    """63-bit hash of the columns, for salts and buckets."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 63) - 1))


def buckets(spark: SparkSession) -> int:
    """Pieces into which a hot group is cut: as many as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
