"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

A source's target is its share of all words by weight, never more than ``cap`` times its own size;
what a capped source cannot take is shared out again by weight. Every document of a source expects
target / size copies. Along the source, in order of document size, the expected copies are summed
up, one offset drawn from (seed, source) is added, and a document is taken once for every whole
number that its stretch crosses. As sizes rise along the order, the words taken miss the target by
no more than the largest document.

A hot source is ranked in pieces: rows are range-partitioned by (source, size, doc_id) and the
places inside a partition are raised by the rows of the source before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import labelled, staging, stored, table

WEIGHTS = (5, 2, 1)
CAP = 3


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Adds the 1-based place of every row inside its key (null is a key). ``order`` starts with the
    keys and says how rows lie; it may name any columns."""
    lying = stored(df.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "lying")
    pieces = lying.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    pieces = pieces.select(*(F.col(c).alias(f"_{c}") for c in (*keys, "_part")), "_first", "_before")
    same = lying["_part"] == pieces["__part"]
    for k in keys:
        same &= lying[k].eqNullSafe(pieces[f"_{k}"])
    return (lying.join(pieces, same).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1)
            .select(*df.columns, name))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target. Weights go round over the sources in order of code points, null last."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one key for all: only the few counts per partition meet in a window
    ranked = numbered(sources.withColumn("_all", F.lit(0)), ["_all"], [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = stored(ranked.select("source", "source_size", weight.alias("weight")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = -1.0, F.lit(False)
    while total:
        held, free = sources.agg(
            F.coalesce(F.sum(F.when(capped, cap * F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        new = (total - held) / free
        if new == level:
            break
        level = new
        capped = cap * F.col("source_size") < F.col("weight") * F.lit(level)
    share = F.col("weight") * F.lit(max(level, 0.0))
    return sources.select("source", "source_size",
                          F.when(capped, (cap * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def copies(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """``sizes``: source, size and any columns among them doc_id. Adds source_size, target, copies.

    Rows that agree in source, size and doc_id share their copies in any order. A source without
    words has target 0 and no copies. An empty table gives an empty table.
    """
    ranked = numbered(sizes, ["source"], [F.col("source"), F.col("size"), F.col("doc_id"), *(
        F.col(c) for c in sizes.columns if c not in ("source", "size", "doc_id"))], "place")
    goal = targets(sizes, weights, cap).withColumnRenamed("source", "_source")
    name = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))))
    offset = (F.conv(F.substring(name, 1, 4), 16, 10).cast("double") + 0.5) / 65536
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = lambda k: F.floor(F.col("_expected") * k + F.col("_offset"))
    return (ranked.join(goal, ranked["source"].eqNullSafe(goal["_source"])).withColumn("_expected", expected)
            .withColumn("_offset", offset)
            # rounding in long running sums must not take a document more often than the cap
            .withColumn("copies", F.least(upto(F.col("place")) - upto(F.col("place") - 1), F.lit(cap)).cast("long"))
            .select(*sizes.columns, "source_size", "target", "copies"))


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its columns, whatever their names.

    A null source is a source, the last one; null and empty texts have size 0 and come as often as their
    place in the source says. An empty table gives an empty table."""
    # the row as one column, so that its names cannot clash; words are counted once, as texts are stored
    rows = stored(docs.select(F.struct("*").alias("whole"), n_words(F.col("text")).alias("size"),
                              F.monotonically_increasing_id().alias("row")), "rows")
    sizes = rows.select("whole.doc_id", "whole.source", "size", "row")
    with staging() as keep:
        counted = keep(stored(copies(sizes, weights, cap, seed).select("row", "copies"), "counted"))
    # texts stay where they are, but for rows whose copies the bitmaps leave open
    return (labelled(rows.select("whole", "row"), "row", counted, "copies", cap + 1).filter("copies > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("whole.*"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sizes = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(docs["text"]).alias("size")), "sizes")
    return (copies(sizes).withColumn("taken", F.col("copies") * F.col("size"))
            .select("doc_id", "size", "source_size", "target", "taken"))
