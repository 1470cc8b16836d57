"""Substring deduplication by hashing lines, runs of lines, and windows for what begins inside a line.

A unit is ``LEAST_WORDS`` words or more. Texts are cut into lines; every line that holds a word is
normalised (A-Z lower-cased, words joined by one space) and hashed to 128 bits, digests are grouped over all
texts, and the occurrence that ranks first stays. Consecutive lines that all occurred before are a
paragraph, lines without words between them included; a paragraph, or a single line, of ``LEAST_WORDS``
words or more goes. Ranks follow doc_id (null last), then the hash of the text, then the place. Places are
kept as offsets, in code points, into the text as it was.

Passages that begin or end inside a line are found by windows of ``LEAST_WORDS`` words, every one of
them, across lines. A window's smallest gram of ``GRAM`` words names it; equal windows have equal
names, so windows with a name of their own are left alone. Windows in a row with one name are a run:
of runs that agree word for word the later ones go whole, and where a name has several runs, the
windows of each first one are digested and grouped. The window that ranks first stays.

All spans that go are united per text. Rows that agree in doc_id and text are one document and lose the
same spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from tidemark.llm.common import marked, staging, stored, table
from tidemark.llm.words import Words, _power, chunks, mix

LEAST_WORDS = 50  # words of a line, a paragraph or a window that goes
LONG_WORD = 10  # code points of a line count as a word at least, for scripts without blanks
GRAM = 12  # words of the grams that name windows; only cost depends on it

_Q, _Q_INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
_SPANS = "doc_id long, text_hash long, start long, stop long"
_WINDOWS = _SPANS + ", d1 long, d2 long"
_UNITS = "doc_id long, text_hash long, unit int, start int, stop int, words int, d1 long, d2 long"


def _digests(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """128 bits, as two numbers, of each run of words first .. last - 1."""
    digests = []
    for salt in (0, 0x2545F4914F6CDD1D):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes ^ np.uint64(salt)) * _power(_Q, len(hashes)), out=sums[1:])
        raw = (sums[last] - sums[first]) * _power(_Q_INVERSE, len(sums))[first]
        digests.append(mix(raw + (last - first).astype(np.uint64)).view(np.int64))
    return digests


def _lines(words: Words) -> tuple[np.ndarray, ...]:
    """Of each line: bytes, words, text and number in its text."""
    cuts = np.flatnonzero(words.data == 10)
    starts = np.union1d(words.bounds[:-1], cuts + 1)
    starts = starts[starts < len(words.data)]
    ends = np.minimum(words.bounds[np.searchsorted(words.bounds, starts, "right")],
                      np.append(cuts, len(words.data))[np.searchsorted(cuts, starts)])
    first, last = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    text = np.searchsorted(words.bounds, starts, "right") - 1
    line = np.arange(len(starts)) - np.searchsorted(starts, words.bounds[text])
    return starts, ends, first, last, text, line


def units(docs: DataFrame) -> DataFrame:
    """One row per line that holds a word: its number among these, start and stop (code points, from the
    first word to the last), number of words (``LONG_WORD`` code points count as one at least), digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("text_hash")
            for row, words in chunks(batch.column("text"), fold=True):
                _, _, first, last, text, _ = _lines(words)
                filled = last > first
                first, last, text = first[filled], last[filled], text[filled]
                line = np.arange(len(text)) - np.searchsorted(text, text)
                places = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
                base, at = places[words.bounds[text]], pa.array(row + text)
                start, stop = places[words.starts[first]] - base, places[words.ends[last - 1]] - base
                size = np.maximum(last - first, (stop - start) // LONG_WORD)
                whole = [x.astype(np.int32) for x in (line, start, stop, size)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), hashes.take(at), *map(pa.array, whole), *map(pa.array, _digests(words.hashes, first, last))],
                    names=["doc_id", "text_hash", "unit", "start", "stop", "words", "d1", "d2"])

    return _keyed(docs).mapInArrow(work, _UNITS)


def paragraphs(docs: DataFrame, min_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text_hash, start, stop: runs of lines that all occur before and hold ``min_words`` words
    together, a single line among them. ``docs`` needs doc_id and text."""
    lines = stored(units(docs), "lines")
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash", "unit")
    # digests that occur once are left out before any whole row is shuffled
    several = lines.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("d1", "d2")
    lines = stored(_among(lines, stored(several, "several-lines")), "common-lines")
    firsts = lines.groupBy("d1", "d2").agg(F.min(rank).alias("first"))
    later = (lines.join(firsts, ["d1", "d2"]).filter(rank > F.col("first"))
             .select("doc_id", "text_hash", "unit", "start", "stop", "words").distinct())
    at = Window.partitionBy("doc_id", "text_hash").orderBy("unit")  # lines of one text
    return (later.withColumn("run", F.col("unit") - F.row_number().over(at)).groupBy("doc_id", "text_hash", "run")
            .agg(F.min("start").cast("long").alias("start"), F.max("stop").cast("long").alias("stop"), F.sum("words").alias("words"))
            .filter(F.col("words") >= min_words).select("doc_id", "text_hash", "start", "stop"))


def _among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose columns of ``keys`` are found there."""
    return marked(rows, keys.columns, keys).filter("_may").drop("_may").join(keys, keys.columns, "left_semi")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _runs(docs: DataFrame, n: int) -> DataFrame:
    """One row per gram that is the smallest (leftmost of equals) of some windows of ``n`` words, which
    follow each other: its hash, a hash of the words of all these windows, and in code points where
    the first window starts (start) and ends (head) and the last one ends (stop)."""
    gram = min(GRAM, n)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("text_hash")
            for row, words in chunks(batch.column("text"), fold=True):
                count = len(words.hashes)
                if count < n:
                    continue
                at = np.arange(count - gram + 1)
                grams = _digests(words.hashes, at, at + gram)[0]
                # the place of the smallest of n - gram + 1 grams in a row, by doubling
                least, width = at, 1
                while width < n - gram + 1:
                    step = min(width, n - gram + 1 - width)
                    a, b = least[:-step], least[step:]
                    least, width = np.where(grams[a] <= grams[b], a, b), width + step
                text = np.searchsorted(words.of_text, np.arange(len(least)), "right") - 1
                inside = np.flatnonzero(np.arange(len(least)) + n <= words.of_text[text + 1])
                if not len(inside):
                    continue
                new = np.flatnonzero(np.append(True, np.diff(least[inside]) != 0))
                first, last = inside[new], inside[np.append(new[1:], len(inside)) - 1]
                places = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
                base, rows = places[words.bounds[text[first]]], pa.array(row + text[first])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), hashes.take(rows), *map(pa.array, (
                        grams[least[first]], _digests(words.hashes, first, last + n)[1], places[words.starts[first]] - base,
                        places[words.ends[first + n - 1]] - base, places[words.ends[last + n - 1]] - base))],
                    names=["doc_id", "text_hash", "name", "body", "start", "head", "stop"])

    return _keyed(docs).mapInArrow(work, "doc_id long, text_hash long, name long, body long, start long, head long, stop long")


def _windows(docs: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    """The windows of ``n`` words in the given spans: start and stop (code points), digest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, runs = (batch.column(x) for x in ("doc_id", "text_hash", "runs"))
            for row, words in chunks(batch.column("text"), fold=True):
                part = runs.slice(row, len(words))
                text = np.repeat(np.arange(len(words)), part.value_lengths().to_numpy(zero_copy_only=False))
                places = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
                base = places[words.bounds[text]]
                start, stop = (part.flatten().field(x).to_numpy() + base for x in (0, 1))
                low, last = np.searchsorted(places[words.starts], start), np.searchsorted(places[words.ends], stop)
                size = last - low - n + 2
                first = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
                if not len(first):
                    continue
                base, rows = np.repeat(base, size), pa.array(row + np.repeat(text, size))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), hashes.take(rows), pa.array(places[words.starts[first]] - base),
                     pa.array(places[words.ends[first + n - 1]] - base),
                     *map(pa.array, _digests(words.hashes, first, first + n))],
                    names=["doc_id", "text_hash", "start", "stop", "d1", "d2"])

    texts = marked(_keyed(docs), ["doc_id", "text_hash"], runs.select("doc_id", "text_hash")).filter("_may")
    runs = (runs.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
            .agg(F.collect_list(F.struct("start", "stop")).alias("runs")))
    return (texts.join(runs, texts["doc_id"].eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
            .select("doc_id", "text_hash", "text", "runs").mapInArrow(work, _WINDOWS))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("spans")
        text = np.repeat(np.arange(len(spans)), spans.value_lengths().to_numpy(zero_copy_only=False))
        start, stop = (spans.flatten().field(x).to_numpy() for x in (0, 1))
        order = np.lexsort((start, text))
        text, start, stop = text[order], start[order], stop[order]
        # texts are laid end to end, so that one running maximum serves all
        shift = text * (int(stop.max(initial=0)) + 2)
        reach = np.maximum.accumulate(stop + shift)
        new = np.flatnonzero(np.append(True, (start + shift)[1:] > reach[:-1])[:len(start)])
        at = pa.array(text[new])
        stops = (reach - shift)[np.append(new[1:], len(start)) - 1] if len(new) else stop
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(start[new]), pa.array(stops)],
            names=["doc_id", "text_hash", "start", "stop"])


def _window_spans(docs: DataFrame, min_words: int) -> DataFrame:
    """Spans, not united yet, of the windows that occur before."""
    runs = stored(_runs(docs, min_words), "window-runs")
    names = stored(runs.groupBy("name").count().filter("count > 1").select("name"), "names")
    runs = stored(_among(runs, names), "named-runs")
    place = (F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash", "start")
    # a run that repeats another word for word goes whole; every window's first place is in a first run
    firsts = stored(runs.groupBy("name", "body").agg(F.min(F.struct(*place, "head", "stop")).alias("first")), "first-runs")
    copies = _later(runs, firsts, F.struct(*place, "head", "stop"), ["name", "body"], "first.head")
    several = firsts.groupBy("name").agg((F.min("body") < F.max("body")).alias("several")).filter("several").select("name")
    opened = stored(firsts.join(several, "name", "left_semi").select("first.*"), "open-runs")
    windows = stored(_windows(docs, opened, min_words), "windows")
    # most windows still occur once: one number each says so
    again = stored(windows.groupBy("d1").count().filter("count > 1").select("d1"), "again")
    windows = stored(_among(windows, again), "common-windows")
    rank = F.struct(*place, "stop")
    kept = windows.groupBy("d1", "d2").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).filter("first < last").drop("last")
    return copies.unionByName(_later(windows, kept, rank, ["d1", "d2"], "first.stop"))


def _spans(found: DataFrame) -> DataFrame:
    """Spans of a text put together."""
    return (found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
            .mapInArrow(_united, _SPANS))


def passages(docs: DataFrame, min_words: int = LEAST_WORDS) -> DataFrame:
    """The spans that go because every word of them stands in a window of ``min_words`` words that
    occurs before: doc_id, text_hash, start, stop (code points), spans of a text apart.

    ``docs`` needs doc_id and text. Lines do not matter. Where a window overlaps its own first
    occurrence, that one stays whole. Null and empty texts have no windows.
    """
    with staging() as keep:
        return keep(stored(_spans(_window_spans(docs, min_words)), "spans"))


def repeats(docs: DataFrame, min_words: int = LEAST_WORDS) -> DataFrame:
    """The spans that go, as lines, paragraphs or windows: doc_id, text_hash, start, stop (code points),
    spans of a text apart.

    ``docs`` needs doc_id and text, other columns are not read. Null and empty texts have no spans; an
    empty table gives an empty table. Of rows that tie in doc_id and text each has the same spans, and
    they appear once. Texts of any length are searched whole; one text's memory is the limit.
    """
    with staging() as keep:
        lines = stored(paragraphs(docs, min_words), "paragraphs")
        return keep(stored(_spans(lines.unionByName(_window_spans(docs, min_words))), "spans"))


def _later(rows: DataFrame, firsts: DataFrame, rank: F.Column, key: list[str], end: str) -> DataFrame:
    """Spans of the rows that are not the first of their key, from the end of the first on if in the same text."""
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return (rows.join(firsts, key).filter(rank > F.col("first"))
            .select("doc_id", "text_hash", F.when(same, F.greatest("start", end)).otherwise(F.col("start")).alias("start"), "stop"))


def without_repeats(docs: DataFrame, min_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the spans of ``repeats`` cut out of text, and n_chars, where there is one, made anew.
    Documents of which no word is left go; null and empty texts, and other columns whatever their names,
    stay as they are."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
            left, at = "", 0
            for start, stop in sorted((x["start"], x["stop"]) for x in spans or ()):
                left, at = _joined(left, text[at:start]), stop
            out.append(text and _joined(left, text[at:]))
        return pa.array(out, pa.string())

    spans = repeats(docs, min_words)
    gone = spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    # the row as one column, so that its names cannot clash
    rows = docs.select(F.struct("*").alias("row"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("text_hash"))
    # texts that lose nothing are not shuffled
    rows = marked(rows, [F.col("row.doc_id").cast("long"), F.xxhash64("row.text")], spans.select("doc_id", "text_hash"))
    touched = rows.filter("_may").join(gone, same, "left")
    new = F.when(F.col("gone").isNotNull(), cut("row.text", "gone"))
    touched = touched.select("row", new.alias("new")).filter(F.col("new").isNull() | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.filter("not _may").select("row", F.lit(None).cast("string").alias("new")).unionByName(touched)
    made = {"text": F.coalesce("new", "row.text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        made["n_chars"] = F.when(F.col("new").isNull(), F.col("row.n_chars")).otherwise(F.length("new").cast(kind))
    return rows.select(*(made.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def _joined(left: str, right: str) -> str:
    """Without doubled blanks where a span was cut out."""
    if not left or left[-1] in " \t\n":
        right = right.lstrip(" \t")
        if right[:1] == "\n" and left[-1:] in ("", "\n"):
            right = right[1:]
    return left + right


def op5_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of ``documents`` alone, whatever the lines; odd texts as in ``passages``."""
    return passages(table(spark, sf_dir, "documents")).drop("text_hash")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of ``documents`` that go, as lines, paragraphs or windows; odd texts as in ``repeats``."""
    return repeats(table(spark, sf_dir, "documents")).drop("text_hash")
