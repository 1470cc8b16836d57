"""Quality rules with repetition found by a suffix array over words.

The suffix array of a text is made by prefix doubling: suffixes are ranked by their first 1, 2,
4, ... words, and only suffixes whose rank is still shared are ranked further. Neighbours in the
array give the longest common prefixes; the deepest LCP interval a suffix lies in has the larger
value of its two neighbours. Every such interval of at least ``min_repeat`` words is a maximal
repeat; the spans of all its occurrences are united. A text is rejected when the united spans
cover too much of it or one repeat is too long. Texts are processed whole, many in one array.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.words import Words, chunks, mix

WINDOW = 8  # words of a window in the base rule
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    """Base rule and repetition limits; all are per text."""

    min_words: int = 20
    max_repeat_percent: int = 30  # of words in repeated windows
    min_repeat: int = 5  # words from which a repeated substring counts
    max_covered_percent: int = 40  # of words in the united spans of maximal repeats
    max_longest: int = 200  # words of the longest repeat


def _levels(words: Words) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all suffixes by their first 2 ** k words, for k = 0, 1, ... until all differ.

    Suffixes of different texts, and suffixes shorter than 2 ** k words, never share a rank.
    Also returns the word after the last of the text, by word.
    """
    sizes = np.diff(words.of_text)
    end = np.repeat(words.of_text[1:], sizes)
    text = np.repeat(np.arange(len(words), dtype=np.uint64), sizes)
    key = mix(words.hashes + text * np.uint64(0x9E3779B97F4A7C15))
    ranks, step = [], 1
    n = len(key)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int32)
    active = order
    ordered = key[order]
    while True:
        new = np.ones(len(active), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(active)))
        if step == 1:
            rank[active] = first[group]
        else:
            # the rank of a group is the place of its first suffix among all suffixes
            head = np.flatnonzero(np.append(True, base[1:] != base[:-1]))
            inside = first - np.repeat(head, np.diff(np.append(head, len(base))))[first]
            rank[active] = (base[first] + inside)[group]
        ranks.append(rank.copy())
        shared = active[size[group] > 1]
        if not len(shared):
            return ranks, end
        follow = shared + step
        within = follow < end[shared]
        next_rank = np.zeros(len(shared), np.int64)
        next_rank[within] = rank[follow[within]] + 1
        ordered = rank[shared].astype(np.int64) * (n + 1) + next_rank
        by = np.argsort(ordered, kind="stable")
        active, ordered = shared[by], ordered[by]
        base = rank[active].astype(np.int64)
        step *= 2


def _common_prefix(ranks: list[np.ndarray], end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at a and b have in common (same text), by halving steps."""
    total = np.zeros(len(a), np.int64)
    limit = end[a] if len(a) else a
    for k in range(len(ranks) - 1, -1, -1):
        x, y = a + total, b + total
        room = np.maximum(x, y) < limit
        equal = np.zeros(len(a), bool)
        equal[room] = ranks[k][x[room]] == ranks[k][y[room]]
        total[equal] += 1 << k
    return total


def _covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    edges = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edges)[:n] > 0


def _shared(rank: np.ndarray) -> np.ndarray:
    return np.bincount(rank, minlength=len(rank))[rank] > 1


def repetition(words: Words, min_repeat: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words in repeated windows of the base rule, words covered by maximal repeats,
    length of the longest repeat."""
    n = len(words.hashes)
    per_text = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[words.of_text])
    none = np.zeros(len(words), np.int64)
    if not n:
        return none, none, none
    ranks, end = _levels(words)
    k = WINDOW.bit_length() - 1
    at = np.flatnonzero(_shared(ranks[k])) if k < len(ranks) else np.zeros(0, np.int64)
    windows = per_text(_covered(n, at, np.full(len(at), WINDOW)))
    k = min_repeat.bit_length() - 1
    at = np.flatnonzero(_shared(ranks[k])) if k < len(ranks) else np.zeros(0, np.int64)
    at = at[np.argsort(ranks[-1][at])]  # suffix array, without suffixes that repeat nothing
    lcp = np.zeros(len(at) + 1, np.int64)
    near = np.flatnonzero(ranks[k][at[1:]] == ranks[k][at[:-1]]) if len(at) else at
    lcp[near + 1] = _common_prefix(ranks, end, at[near], at[near + 1])
    deepest = np.maximum(lcp[:-1], lcp[1:])
    long = deepest >= min_repeat
    at, deepest = at[long], deepest[long]
    covered = per_text(_covered(n, at, deepest))
    longest = none.copy()
    np.maximum.at(longest, np.searchsorted(words.of_text, at, "right") - 1, deepest)
    return windows, covered, longest


def _lines(words: Words) -> np.ndarray:
    """Per text: lines that hold a word and equal an earlier line of the text."""
    cuts = np.flatnonzero(words.data == 10)
    starts = np.union1d(words.bounds[:-1], cuts + 1)
    starts = starts[starts < len(words.data)]
    ends = words.bounds[np.searchsorted(words.bounds, starts, "right")]
    newline = np.append(cuts, len(words.data))[np.searchsorted(cuts, starts)]
    ends = np.minimum(ends, newline)
    filled = np.searchsorted(words.starts, starts) < np.searchsorted(words.starts, ends)
    starts, ends = starts[filled], ends[filled]
    text = np.searchsorted(words.bounds, starts, "right") - 1
    key = mix(words.hash_spans(starts, ends) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    return np.bincount(text, minlength=len(words)) - np.bincount(text[first], minlength=len(words))


def measure(texts: pa.Array, limits: Limits = Limits()) -> dict[str, np.ndarray]:
    """All counts and the verdict, one value per text."""
    parts: dict[str, list[np.ndarray]] = {}
    for _, words in chunks(texts):
        inside = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[words.bounds])  # noqa: E731, B023
        n = np.diff(words.of_text)
        separators = np.zeros(256, bool)
        separators[list(b"\x20\x09\x0a\x0b\x0c\x0d")] = True
        letters = ~separators
        letters[0x80:0xC0] = False  # continuation bytes
        windows, covered, longest = repetition(words, limits.min_repeat)
        failed = (n < limits.min_words) | (100 * windows > limits.max_repeat_percent * n)
        bad = (100 * covered > limits.max_covered_percent * n) | (longest > limits.max_longest)
        for name, value in (("n_words", n), ("word_chars", inside(letters[words.data])),
                            ("n_symbols", inside(_SYMBOL[words.data])), ("n_dup_lines", _lines(words)),
                            ("n_repeat_words", windows), ("covered_words", covered), ("longest_repeat", longest),
                            ("base_failed", failed), ("kept", ~failed & ~bad)):
            parts.setdefault(name, []).append(value)
    return {name: np.concatenate(values) for name, values in parts.items()}


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
_SCHEMA = ", ".join(f"{name} long" for name in _COUNTS) + ", base_failed boolean, kept boolean"


def rules(text: Column | str, limits: Limits = Limits()) -> Column:
    """A struct of counts and verdict for a text column."""
    kinds = pa.struct([(name, pa.int64()) for name in _COUNTS] + [("base_failed", pa.bool_()), ("kept", pa.bool_())])

    @F.arrow_udf(_SCHEMA)
    def judge(texts: pa.Array) -> pa.Array:
        found = measure(texts, limits)
        if not found:
            return pa.array([], kinds)
        return pa.StructArray.from_arrays([pa.array(found[f.name], f.type) for f in kinds], fields=list(kinds))

    return judge(text)


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id with counts and verdict, one row per row of ``docs``; nothing is shuffled.

    A null or empty text has no words, so the base rule rejects it. Repeated rows and rows without
    a doc_id are judged like any other; further columns of ``docs`` are not read.
    """
    return docs.select("doc_id", rules("text", limits).alias("r")).select("doc_id", "r.*")


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns. A column called _verdict may exist."""
    name = "_verdict"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, rules("text", limits)["kept"]).filter(F.col(name)).drop(name)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")
