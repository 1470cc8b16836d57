"""License scans: winnowed fingerprints pick candidates, banded alignment says what matches.

Templates and texts are sequences of lower-cased words between ASCII marks. Of a template's k-gram
hashes, the smallest of every ``WINDOW`` in a row are its fingerprints; they form an inverted index
from hash to (template, place). A text's k-grams are looked up in it. Hits of a template on nearby
diagonals are a candidate, and the template is aligned with that stretch of the text inside a band
around the diagonals, which gives the words that match in order, the share of the template they
cover, and their span in the text.

Wordings of licenses resemble each other. A template may name words that its match must hold, such as
a version, and of matches that lie on the same stretch of a text the one with most words stays.

The index of a set of templates goes to every task; it is bounded by ``TEMPLATE_WORDS``. More
templates are scanned set by set, and the matches of a text meet by its row.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.license_texts import templates as known_templates
from tidemark.llm.words import Words, chunks, words_of

GRAM = 3
WINDOW = 2
BAND = 8  # words by which a match may drift from its diagonals
TEMPLATE_WORDS = 200_000  # words of a set of templates
MIN_PERCENT = 70  # of a template's words
COVERED = 80  # percent of a match's span that a better match must cover to replace it


def fingerprints(words: Words, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the winnowed k-grams of one text; a shorter text is one gram."""
    n = len(words.hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n < gram:
        return words.grams(n), np.zeros(1, np.int64)
    grams = words.grams(gram)
    window = min(window, len(grams))
    rows = np.lib.stride_tricks.sliding_window_view(grams, window)
    places = np.unique(np.arange(len(rows)) + rows.argmin(axis=1))
    return grams[places], places


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Most words that match in order, and the first and last matching place in the text.

    ``low`` .. ``high`` are the diagonals (place in text - place in template) that may be used. Row i
    of the table holds, for every diagonal, the best up to template word i; moving along a row skips
    text words, moving down a diagonal skips template words.
    """
    m, width = len(template), high - low + 1
    best = np.zeros((m + 1, width), np.int64)
    for i in range(1, m + 1):
        at = np.arange(low, high + 1) + i - 1
        inside = (at >= 0) & (at < len(text))
        hit = np.zeros(width, bool)
        hit[inside] = text[at[inside]] == template[i - 1]
        above = np.append(best[i - 1, 1:], 0)  # the same text word without this template word
        best[i] = np.maximum.accumulate(np.maximum(best[i - 1] + hit, above))
    i, d = m, int(best[m].argmax())
    matched, first, last = int(best[m, d]), -1, -1
    while i > 0 and best[i, d] > 0:
        at = low + d + i - 1
        if d and best[i, d] == best[i, d - 1]:
            d -= 1
        elif d + 1 < width and best[i, d] == best[i - 1, d + 1]:
            i, d = i - 1, d + 1
        else:
            if best[i, d] > best[i - 1, d]:
                first, last = at, max(last, at)
            i -= 1
    return matched, first, last


def _tight(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """``align``, with the match that ends first and, of those, begins last."""
    got, _, last = align(template, text, low, high)
    if not got:
        return got, -1, -1
    shift = last + 1 - len(template)
    _, _, back = align(template[::-1], text[last::-1], shift - high, shift - low)
    return got, last - back, last


Template = tuple[str, str, str]  # name, text, needed words


def _sets(templates: Sequence[Template]) -> Iterator[list[Template]]:
    held, size = [], 0
    for t in templates:
        n = len(words_of(t[1], True, True).hashes)
        if held and size + n > TEMPLATE_WORDS:
            yield held
            held, size = [], 0
        held.append(t)
        size += n
    if held:
        yield held


def best(found: list[tuple]) -> list[tuple]:
    """Matches of one text without those on whose stretch a better one lies.

    A match begins with name, matched words, first and last code point. More matched words are better, then
    a shorter stretch, then the smaller name.
    """
    kept: list[tuple] = []
    for m in sorted(found, key=lambda m: (-m[1], m[3] - m[2], m)):
        shared = (min(m[3], k[3]) - max(m[2], k[2]) + 1 for k in kept)
        if all(100 * x < COVERED * (m[3] - m[2] + 1) for x in shared):
            kept.append(m)
    return sorted(kept, key=lambda m: (m[2], m))


def _matcher(templates: list[Template], min_percent: int):
    known = [words_of(text, True, True).hashes for _, text, _ in templates]
    needed = [set(words_of(must, True, True).hashes.tolist()) for *_, must in templates]
    index: dict[int, list[tuple[int, int]]] = {}
    short = [len(x) for x in known]
    for t, (_, text, _) in enumerate(templates):
        for h, place in zip(*fingerprints(words_of(text, True, True)), strict=True):
            index.setdefault(int(h), []).append((t, int(place)))
    by_size = {n: np.array(sorted(h for h, places in index.items() if any(min(short[t], GRAM) == n for t, _ in places)), np.uint64)
               for n in range(1, GRAM + 1)}

    def matches(words: Words) -> Iterator[tuple[int, int, int, int, int]]:
        """Text, template, matched words, first and last matching word (as numbers of the chunk)."""
        hits: list[tuple[int, int, int]] = []
        for n, hashes in by_size.items():
            if len(hashes):
                grams = words.grams(n)
                at = np.searchsorted(hashes, grams)
                at[at == len(hashes)] = 0
                for place in np.flatnonzero(hashes[at] == grams):
                    hits += [(t, int(place), p) for t, p in index[int(grams[place])] if min(short[t], GRAM) == n]
        text_of = np.searchsorted(words.of_text, [place for _, place, _ in hits], "right") - 1 if hits else []
        grouped: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for (t, place, p), text in zip(hits, text_of, strict=True):
            if place + min(short[t], GRAM) <= words.of_text[text + 1]:
                grouped.setdefault((int(text), t), []).append((place, place - p))
        for (text, t), found in sorted(grouped.items()):
            found.sort()
            cluster: list[tuple[int, int]] = []
            a, b = int(words.of_text[text]), int(words.of_text[text + 1])
            spans: list[tuple[int, int]] = []
            for place, diagonal in (*found, (None, None)):
                # the next hit belongs to another occurrence if its diagonal or its place is too far off
                if cluster and (place is None or abs(diagonal - cluster[-1][1]) > BAND or place - cluster[0][0] > 2 * short[t] + BAND):
                    todo, cluster = [cluster], []
                    while todo:
                        # hits between the occurrences found so far, until none yields another
                        apart: dict[tuple[int, int], list[tuple[int, int]]] = {}
                        for hit in todo.pop():
                            k = bisect_right(spans, (hit[0], b))
                            low, high = spans[k - 1][1] + 1 if k else a, spans[k][0] if k < len(spans) else b
                            if low <= hit[0]:
                                apart.setdefault((low, high), []).append(hit)
                        for (low, high), hits_ in apart.items():
                            diagonals = [d - low for _, d in hits_]
                            got, first, last = _tight(known[t], words.hashes[low:high], min(diagonals) - BAND, max(diagonals) + BAND)
                            if 100 * got >= min_percent * short[t] and needed[t] <= set(words.hashes[low + first:low + last + 1].tolist()):
                                insort(spans, (low + first, low + last))
                                yield text, t, got, low + first, low + last
                                todo.append(hits_)
                if place is not None:
                    cluster.append((place, diagonal))

    return matches, short


_FIELDS = ["row", "doc_id", "template", "matched", "template_words", "coverage", "start", "stop"]
_SCHEMA = ("row long, doc_id long, template string, matched long, template_words long, coverage long, start long, "
           "stop long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if name == "template" else pa.int64())
                                       for name, c in zip(_FIELDS, columns, strict=True)], names=_FIELDS)


def _best_of_text(found: pa.Table) -> pa.Table:
    """All matches of one row; ``stop`` is one past the end."""
    rows = [(r["template"], r["matched"], r["start"], r["stop"] - 1, r["row"], r["doc_id"], r["template_words"], r["coverage"])
            for r in found.to_pylist()]
    return pa.Table.from_batches([_rows([(row, doc, name, got, size, share, a, z + 1)
                                         for name, got, a, z, row, doc, size, share in best(rows)])])


def scan(docs: DataFrame, templates: Sequence[tuple], min_percent: int = MIN_PERCENT) -> DataFrame:
    """Matches of templates (name, text and, if any, needed words) in texts: doc_id, template, matched,
    template_words, coverage (percent, rounded down), start and stop (code points in the text).

    ``docs`` needs doc_id and text; other columns may have any names. Null and empty texts match nothing,
    nor do templates without a word. Repeated rows give their matches each; a template that occurs several
    times in a text gives a row for each place, and one occurrence found from several sides a single row.
    Of matches on the same stretch the best stays (``best``); ties go to the smaller name.
    """
    def finder(some: list[Template], alone: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matches, short = _matcher(some, min_percent)
            for batch in batches:
                ids, numbers = batch.column("doc_id"), batch.column("row")
                for row, words in chunks(batch.column("text"), fold=True, alnum=True):
                    matched = sorted(set(matches(words)))
                    if not matched:
                        continue
                    places = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
                    seen: dict[int, list[tuple]] = {}
                    for text, t, got, first, last in matched:
                        base = places[words.bounds[text]]
                        seen.setdefault(text, []).append((some[t][0], got, int(places[words.starts[first]] - base),
                                                          int(places[words.ends[last]] - base) - 1, short[t]))
                    out = []
                    for text, found in seen.items():
                        for name, got, start, last, size in best(found) if alone else found:
                            out.append((numbers[row + text].as_py(), ids[row + text].as_py(), name, got, size, 100 * got // size,
                                        start, last + 1))
                    yield _rows(out)
        return work

    full = [(t[0], t[1], t[2] if len(t) > 2 else "") for t in templates]
    sets = list(_sets([t for t in full if len(words_of(t[1], True, True).hashes)]))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not sets:
        return rows.sparkSession.createDataFrame([], _SCHEMA).drop("row")
    if len(sets) == 1:
        return rows.mapInArrow(finder(sets[0], True), _SCHEMA).drop("row")
    rows = stored(rows, "texts")  # every set must see the same row numbers
    out = rows.mapInArrow(finder(sets[0], False), _SCHEMA)
    for more in sets[1:]:
        out = out.unionByName(rows.mapInArrow(finder(more, False), _SCHEMA))
    return out.groupBy("row").applyInArrow(_best_of_text, _SCHEMA).drop("row")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All wordings of ``license_texts`` in all documents; null and empty texts give no row."""
    return scan(table(spark, sf_dir, "documents"), known_templates())
