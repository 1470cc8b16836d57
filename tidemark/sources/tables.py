"""Parquet tables: scans, appends, keyed upserts, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark import schemas
from tidemark.functions import fixed, text
from tidemark.functions.prices import with_prices
from tidemark.operators.scale import first_per_key
from tidemark.session import materialize, release, remove_path
from tidemark.sources.versioned import KeyedTable, SnapshotTable

INDEX_BUCKETS = 64


# --- reading ----------------------------------------------------------------------------

def scan_offers(spark: SparkSession, path: str) -> DataFrame:
    """Offers with the fixed schema, slug lower-cased, an empty label filled from the slug."""
    return normal_offers(spark.read.schema(schemas.OFFERS).parquet(path))


def normal_offers(offers: DataFrame) -> DataFrame:
    server = F.lower("server")
    return with_prices(offers.withColumns({
        "server": server,
        "display_server": F.coalesce(text.blank_to_null(F.col("display_server")), server)}))


def read_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """All per-source offer sets in their fixed order, with ``source_no``."""
    out = None
    for number, name in enumerate(fixed.SOURCE_ORDER):
        if name in parts:
            part = parts[name].withColumn("source_no", F.lit(number))
            out = part if out is None else out.unionByName(part)
    return out


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table, empty when nothing was written yet."""
    if schema in (schemas.CURRENT_OFFERS, schemas.CURRENT_INDEX):
        return (current_offers if schema == schemas.CURRENT_OFFERS else current_index)(spark, path).read()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


# --- writing ----------------------------------------------------------------------------

def fitted(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns and types of the stored table."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _by_partition(df: DataFrame, partition: str) -> DataFrame:
    """Rows of a partition together, so that it gets few files; a large one is split."""
    return df.hint("rebalance", partition)


def append(df: DataFrame, path: str, schema: StructType, partition: str = "date") -> None:
    _by_partition(fitted(df, schema), partition).write.mode("append").partitionBy(partition).parquet(path)


def append_raw_prices(offers: DataFrame, path: str) -> None:
    """Raw prices only; nothing derived is stored."""
    rows = offers.withColumnRenamed("id", "offer_id").withColumns(
        {"currency": F.lit("USD"), "date": F.to_date("fetched_at")})
    append(rows, path, schemas.RAW_PRICES)


def append_group_index(index: DataFrame, ts: Column, path: str) -> None:
    rows = index.withColumnRenamed("display_server", "server").withColumns(
        {"ts": ts, "source_count": F.size("sources"), "date": F.to_date(ts)})
    append(rows, path, schemas.GROUP_INDEX)


def _overwrite(df: DataFrame, path: str, partition: str) -> None:
    """Stage, then replace just the partitions that occur in ``df``."""
    staged = materialize(df, "staged")
    (_by_partition(staged, partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))
    release(staged)


def upsert(batch: DataFrame, path: str, schema: StructType, keys: Sequence[str],
           newest: Sequence[Column], partition: str) -> None:
    """Insert or overwrite by key; ``newest`` orders rows of one key, first wins.

    Only partitions with a batch row are read and rewritten. ``partition`` must follow from
    the key.
    """
    batch = materialize(first_per_key(fitted(batch, schema), keys, newest), "batch")
    touched = batch.select(partition).distinct()
    stored = read(batch.sparkSession, path, schema).join(touched, partition, "left_semi")
    kept = stored.join(batch.select(*keys, partition), [*keys, partition], "left_anti")
    _overwrite(kept.unionByName(batch).select(*schema.fieldNames()), path, partition)
    release(batch)


def insert_if_absent(batch: DataFrame, path: str, schema: StructType, keys: Sequence[str],
                     first: Sequence[Column], partition: str) -> None:
    """Insert rows with a new key; running it again changes nothing.

    Only partitions with a batch row are read; ``partition`` must follow from the key.
    """
    batch = materialize(first_per_key(fitted(batch, schema), keys, first), "batch")
    touched = batch.select(partition).distinct()
    stored = read(batch.sparkSession, path, schema).select(*keys, partition).join(touched, partition, "left_semi")
    fresh = materialize(batch.join(stored, [*keys, partition], "left_anti")
                        .select(*schema.fieldNames()), "fresh")
    _by_partition(fresh, partition).write.mode("append").partitionBy(partition).parquet(path)
    release(batch, fresh)


def _bucket(*keys: str) -> Column:
    return F.pmod(F.hash(*keys), F.lit(INDEX_BUCKETS))


def current_index(spark: SparkSession, path: str) -> KeyedTable:
    """One row per (server_id, faction), the newest."""
    return KeyedTable(spark, path, schemas.CURRENT_INDEX, ["server_id", "faction"], [F.desc("computed_at")],
                      [F.col("index_price"), F.col("best_ask")])


def current_offers(spark: SparkSession, path: str) -> KeyedTable:
    """One row per (source, id), the newest."""
    return KeyedTable(spark, path, schemas.CURRENT_OFFERS, ["source", "id"], [F.desc("fetched_at")],
                      [F.col("price_per_1k"), F.col("faction"), F.col("server_id")])


def market(spark: SparkSession, path: str) -> SnapshotTable:
    """The offers of every source's newest cycle that had any."""
    return SnapshotTable(spark, path, schemas.MARKET)


def upsert_index(index: DataFrame, path: str, writer: str = "", number: int | None = None) -> None:
    """Adds rows to the current index; an older row that comes late is ignored."""
    rows = index.withColumn("faction", text.stored_faction(F.col("faction"))).withColumn("bucket", _bucket("server_id", "faction"))
    current_index(index.sparkSession, path).write(rows, writer, number)


def upsert_offers(offers: DataFrame, path: str, writer: str = "", number: int | None = None) -> None:
    """Adds rows to the current offers; an older row that comes late is ignored."""
    current_offers(offers.sparkSession, path).write(offers.withColumn("bucket", _bucket("source", "id")), writer, number)


def _dated(ticks: DataFrame) -> DataFrame:
    return ticks.withColumn("date", F.to_date("recorded_at"))


TICK_KEYS = ["server_id", "faction", "recorded_at"]
TICK_ORDER = ["index_price", "best_ask", "sample_size"]


def upsert_ticks(ticks: DataFrame, path: str) -> None:
    upsert(_dated(ticks), path, schemas.TICKS, TICK_KEYS, [F.col(c) for c in TICK_ORDER], "date")


def insert_ticks(ticks: DataFrame, path: str) -> None:
    insert_if_absent(_dated(ticks), path, schemas.TICKS, TICK_KEYS, [F.col(c) for c in TICK_ORDER], "date")


def apply_retention(spark: SparkSession, path: str, schema: StructType, time: str, cut: str) -> int:
    """Deletes rows older than ``cut`` (timestamp text); returns how many.

    Only the partitions up to the cut are read: whole older days become empty, the day of
    the cut keeps its newer rows.
    """
    moment = F.lit(cut).cast("timestamp")
    old = read(spark, path, schema).filter(F.col("date") <= F.to_date(moment))
    # one row per day
    counts = {r[0]: r[1] for r in old.groupBy("date").agg(F.count_if(F.col(time) < moment)).collect()}
    deleted = sum(counts.values())
    if deleted:
        # a day without kept rows is dropped, the day of the cut is rewritten
        days = list(counts)
        last = spark.sql(f"SELECT to_date('{cut}')").first()[0]
        for day in days:
            if day < last:
                remove_path(spark, f"{path}/date={day}")
        if last in days:
            _replace_day(old.filter((F.col("date") == F.lit(last)) & (F.col(time) >= moment)), path, last)
    return deleted


def _replace_day(kept: DataFrame, path: str, day) -> None:
    spark = kept.sparkSession
    if kept.isEmpty():
        remove_path(spark, f"{path}/date={day}")
    else:
        _overwrite(kept, path, "date")
