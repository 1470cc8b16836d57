"""Token ids in files: one shared zstandard dictionary, every document compressed alone.

A file set is a folder of three Parquet tables, so that any store that Spark reaches will do and a
lost executor's half-written part is never seen:

- ``dictionary``: one row, the dictionary, its hash, the bytes of an id (2 or 4);
- ``segments``: a row per up to ``SEGMENT`` documents in ascending doc_id order. ``payload`` joins
  the documents' frames; ``doc_ids``, ``n_tokens`` and ``offsets`` (n + 1 byte places) say where each
  one is, ``dictionary_hash`` which dictionary it needs;
- ``index``: part, segment, first and last doc_id, documents, ids, and the ids of all documents
  before the segment.

A document is read by its segment's row and a slice of the payload; nothing else is decompressed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import stored, table
from tidemark.llm.tokens import batches_of, default_path, encoder
from tidemark.session import new_path

END = 2  # closes every document
SEGMENT = 512
SAMPLE = 2000  # documents that the dictionary is trained on, about
SAMPLE_IDS = 8192  # ids of each of them, at most
DICTIONARY_BYTES = 64 << 10
LEVEL = 3


def _width(path: str) -> int:
    return 2 if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else 4


def _serial(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def _closed(texts: pa.Array, path: str) -> list[np.ndarray]:
    """The ids of every text, with the closing id."""
    ids, bounds = encoder(path).encode(texts)
    ids = np.insert(ids, bounds[1:], END)
    bounds = bounds + np.arange(len(bounds))
    return [ids[a:b] for a, b in pairwise(bounds.tolist())]


def train(docs: DataFrame, path: str) -> bytes:
    """A dictionary from a sample of about ``SAMPLE`` documents, chosen by hash. Empty for a table
    too small to train on."""
    total = docs.count()
    every = max(1, total // SAMPLE)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select("text").limit(2 * SAMPLE)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = []
        for batch in batches:
            width = _width(path)
            serial += [_serial(ids[:SAMPLE_IDS], width) for ids in _closed(batch.column("text"), path)]
        try:
            made = zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, serial)) // 8), serial).as_bytes()
        except (zstandard.ZstdError, ValueError):
            made = b""
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["dictionary"])

    # the limit leaves one partition of a bounded number of rows
    return next((r[0] for r in sample.coalesce(1).mapInArrow(work, "dictionary binary").collect() if r[0]), b"")


def write(docs: DataFrame, folder: str, path: str | None = None) -> None:
    """Writes the token ids of ``docs`` (doc_id, text) to a new folder.

    A null or empty text is the closing id alone. Rows that share a doc_id follow each other in the
    order in which they were read; rows without doc_id come first. An empty table gives empty tables.
    """
    path = path or default_path()
    spark = docs.sparkSession
    dictionary = train(docs, path)
    mark = xxhash.xxh64(dictionary).intdigest() >> 1
    shared = zstandard.ZstdCompressionDict(dictionary).as_bytes() if dictionary else b""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _width(path)
        ready = zstandard.ZstdCompressionDict(shared) if shared else None
        if ready:
            ready.precompute_compress(level=LEVEL)  # once per task, not once per document
        press = zstandard.ZstdCompressor(LEVEL, dict_data=ready)
        for batch in batches:
            for rows in batches_of(batch.column("text")):
                part = batch.slice(rows.start, rows.stop - rows.start)
                ids = _closed(part.column("text"), path)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([press.compress(_serial(x, width)) for x in ids], pa.binary())],
                    names=["doc_id", "row", "n", "frame"])

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        number, waiting = 0, []
        for batch in chain(batches, (None,)):
            if batch is not None:
                waiting.append(pa.Table.from_batches([batch]))
                if sum(x.num_rows for x in waiting) < SEGMENT:
                    continue
            rows = pa.concat_tables(waiting) if waiting else None
            while rows is not None and rows.num_rows >= (SEGMENT if batch is not None else 1):
                now, rows = rows.slice(0, SEGMENT), rows.slice(SEGMENT)
                frames = now["frame"].to_pylist()
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in frames])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([now["doc_id"].to_pylist()], pa.list_(pa.int64())),
                     pa.array([now["n"].to_pylist()], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())),
                     pa.array([b"".join(frames)], pa.binary()), pa.array([mark], pa.int64())],
                    names=["part", "segment", "doc_ids", "n_tokens", "offsets", "payload", "dictionary_hash"])
                number += 1
            waiting = [rows] if rows is not None and rows.num_rows else []

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    frames = stored(rows.mapInArrow(encode, "doc_id long, row long, n long, frame binary"), "frames")
    order = [F.col("doc_id"), F.col("row")]
    (frames.repartitionByRange(*order).sortWithinPartitions(*order)
     .mapInArrow(segments, "part int, segment int, doc_ids array<long>, n_tokens array<long>, offsets array<long>, "
                           "payload binary, dictionary_hash long").write.parquet(f"{folder}/segments"))
    spark.createDataFrame([(bytearray(dictionary), mark, _width(path))], "dictionary binary, hash long, width int") \
        .coalesce(1).write.parquet(f"{folder}/dictionary")
    ids = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda total, n: total + n)
    held = stored(spark.read.parquet(f"{folder}/segments").select(
        "part", "segment", F.element_at("doc_ids", 1).alias("first_doc"), F.element_at("doc_ids", -1).alias("last_doc"),
        F.size("doc_ids").alias("n_docs"), ids.alias("n_ids")), "held")
    # ids before: of the partitions before (a row per partition meets in one window), then inside one
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = held.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    parts = parts.select("part", F.coalesce(F.sum("_ids").over(ahead.orderBy("part")), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("n_ids").over(ahead.partitionBy("part").orderBy("segment")), F.lit(0))
    (held.withColumn("_inside", inside).join(parts, "part").withColumn("start", F.col("_before") + F.col("_inside"))
     .drop("_before", "_inside").write.parquet(f"{folder}/index"))


def _decoded(rows: DataFrame, folder: str, only: frozenset[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) from rows of segments with start."""
    dictionary, mark, width = rows.sparkSession.read.parquet(f"{folder}/dictionary").first()
    dictionary = bytes(dictionary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_hash"] != mark:
                    raise ValueError("these segments were written with another dictionary")
                starts = row["start"] + np.concatenate(([0], np.cumsum(row["n_tokens"])))
                payload = memoryview(row["payload"])
                wanted = [i for i, d in enumerate(row["doc_ids"]) if only is None or d in only]
                places = list(pairwise(row["offsets"]))
                bodies = [np.frombuffer(press.decompress(payload[slice(*places[i])]), f"<u{width}").astype("<u4").tobytes()
                          for i in wanted]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["doc_ids"][i] for i in wanted], pa.int64()), pa.array(starts[wanted], pa.int64()),
                     pa.array([row["n_tokens"][i] for i in wanted], pa.int64()), pa.array(bodies, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All documents of a file set."""
    index = spark.read.parquet(f"{folder}/index").select("part", "segment", "start")
    return _decoded(spark.read.parquet(f"{folder}/segments").join(index, ["part", "segment"]), folder)


def lookup(spark: SparkSession, folder: str, doc_ids: Sequence[int]) -> DataFrame:
    """Some documents: the index names their segments, and only their frames are decompressed."""
    wanted = sorted(set(doc_ids))
    inside = F.lit(False)
    for i in wanted:
        inside |= F.col("first_doc").isNotNull() & (F.coalesce("first_doc", F.lit(i)) <= i) & (F.col("last_doc") >= i) \
            | F.col("first_doc").isNull() & (F.col("last_doc") >= i)
    index = spark.read.parquet(f"{folder}/index").filter(inside).select("part", "segment", "start")
    return _decoded(spark.read.parquet(f"{folder}/segments").join(index, ["part", "segment"]), folder, frozenset(wanted))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of decoded rows."""
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "llm-token-files")
    write(table(spark, sf_dir, "documents"), folder)
    return digests(read(spark, folder))
