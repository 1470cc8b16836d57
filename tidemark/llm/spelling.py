"""Spelling variants of a corpus: words one edit apart, found with a bit-sliced position index.

For a block of words the index holds one bitset per (position, letter): bit w says that word w has that
letter there. A query runs through its letters once and keeps three bitsets over the whole block, which
word-parallel operations move on together: words without an error so far; words with one letter replaced;
words with one letter too many, compared one position further on. Letters too few are the same pairs seen
from the longer word.

Blocks are made so that no pair is lost and none grows with the vocabulary. Two words at distance one, the
shorter of length s, agree before and behind the error; whichever half of the shorter word the error lies
in, the other half is equal. So every word is filed under the equal half, for both halves and for either
role (shorter, or one longer than that). A key that still has more than ``CELL`` words is filed again under
halves of the part not yet equal, down to a single open position, where the alphabet bounds what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import release, stored, table

LEAST_LETTERS, LEAST_COUNT = 7, 2
RATIO = 10  # a form is so many times as frequent as its variant
CELL = 1024  # words of a key beyond which it is split
BLOCK = 1024  # words of several keys that share an index
BLOCK_LETTERS = 1 << 22  # letters of an index, its words times the longest
DROP_EVERY = 31

# The letters of a word, as ranges of code points
_LETTERS = r"[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, least: int) -> DataFrame:
    """doc_id and run: the maximal letter runs of at least ``least`` letters, A-Z lower-cased, one row per
    occurrence. Null texts have none."""
    found = F.regexp_extract_all("text", F.lit(f"{_LETTERS}{{{max(1, least)},}}"), F.lit(0))
    return (docs.select("doc_id", F.explode(found).alias("run"))
            .select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run")))


def misspelt(doc_id: Column, run: Column) -> Column:
    """The run, without the code point that its checksum names where the checksum is a multiple of
    ``DROP_EVERY``; unchanged without doc_id."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.coalesce(h % DROP_EVERY == 0, F.lit(False)), cut).otherwise(run)


def vocabulary(words: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n, from one row per occurrence; short and rare words go. Counts are summed ahead of the
    shuffle, so a very common word costs no more than any other."""
    return (words.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= least_count))


def matches(words: list[str], asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) where words[j] is words[i] with one letter replaced, or one letter longer by an
    inserted one, for every i that is ``asked``. Words are distinct."""
    n, none = len(words), np.zeros(0, np.int64)
    length = np.array([len(w) for w in words])
    if n < 2 or not asked.any():
        return none, none
    wide = int(length.max()) + 2
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    letters, coded = np.unique(flat, return_inverse=True)
    code = np.zeros((n, wide), np.int32)  # 0: behind the end
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    code[np.repeat(np.arange(n), length), place] = coded + 1
    room = -(-n // 64) * 64

    def bits(flags: np.ndarray) -> np.ndarray:
        padded = np.zeros((*flags.shape[:-1], room), bool)
        padded[..., :n] = flags
        return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)

    alphabet = np.arange(len(letters) + 1)[:, None]
    left, right = [], []
    for m in np.unique(length[asked]):
        # only words as long, or longer by one, can match
        index = [bits(code[None, :, p] == alphabet) for p in range(int(m) + 1)]
        same, longer = bits(length == m), bits(length == m + 1)
        queries = np.flatnonzero(asked & (length == m))
        exact = np.full((len(queries), room // 64), ~np.uint64(0))
        replaced, extra = np.zeros_like(exact), np.zeros_like(exact)
        for i in range(int(m)):
            letter = code[queries, i]
            here, further = index[i][letter], index[i + 1][letter]
            replaced = (replaced & here) | (exact & ~here)
            extra = (extra | exact) & further
            exact &= here
        hit = (replaced & same) | ((extra | exact) & longer)
        row, chunk = np.nonzero(hit)
        if len(row):
            flags = np.unpackbits(hit[row, chunk][:, None].view(np.uint8), axis=1, bitorder="little")
            at, bit = np.nonzero(flags)
            left.append(queries[row[at]])
            right.append(chunk[at] * 64 + bit)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _filed(rows: DataFrame, halves: list[tuple[Column, Column]]) -> DataFrame:
    """Rows (word, n, s, short) once per half: a letters equal ahead, b behind, and the key of these."""
    parts = F.explode(F.array(*[F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")) for a, b in halves]))
    key = F.xxhash64("s", "a", "b", F.substring(F.col("word"), F.lit(1), F.col("a")), F.expr("right(word, b)"))
    return (rows.select("word", "n", "s", "short", parts.alias("_part"))
            .select("word", "n", "s", "short", "_part.a", "_part.b").withColumn("key", key))


def _keyed(words: DataFrame) -> DataFrame:
    """Rows to be searched: every word under its keys, keys with nothing to find left out."""
    roles = F.explode(F.array(F.struct(F.length("word").alias("s"), F.lit(True).alias("short")),
                              F.struct((F.length("word") - 1).alias("s"), F.lit(False).alias("short"))))
    half = F.floor(F.col("s") / 2)
    rows = words.select("word", "n", roles.alias("_role")).select("word", "n", "_role.s", "_role.short").filter("s >= 1")
    rows = _filed(rows, [(half, F.lit(0)), (F.lit(0), F.col("s") - half)])
    ready, last = [], None
    while True:
        rows = stored(rows, "filed")
        release(last)
        last = rows
        sizes = (rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.count_if("short").alias("asked"))
                 .filter("size > 1 and asked > 0").select("key", "size"))
        rows = rows.join(sizes, "key")
        split = (F.col("size") > CELL) & (F.col("s") - F.col("a") - F.col("b") > 1)
        ready.append(stored(rows.filter(~split).drop("size"), "ready"))
        large = rows.filter(split).drop("size")
        if large.isEmpty():
            break
        a, b = F.col("a"), F.col("b")
        open_ = F.col("s") - a - b
        rows = _filed(large, [(a, b + open_ - F.floor(open_ / 2)), (a + F.floor(open_ / 2), b)])
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    out = stored(out, "keyed")
    release(last, *ready)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Distinct words, whether they are asked, and their counts, for whole keys put together."""
    held: dict[str, list] = {}
    current, longest = None, 0
    for batch in batches:
        for key, word, n, short in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n", "short")), strict=True):
            if key != current:
                if len(held) >= BLOCK or len(held) * longest >= BLOCK_LETTERS:
                    yield list(held), np.array([x[0] for x in held.values()]), np.array([x[1] for x in held.values()])
                    held, longest = {}, 0
                current = key
            longest = max(longest, len(word))
            seen = held.get(word)
            if seen is None:
                held[word] = [short, n]
            elif short:
                seen[0] = True
    if held:
        yield list(held), np.array([x[0] for x in held.values()]), np.array([x[1] for x in held.values()])


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: every pair of words one edit apart, in both directions, once.

    ``words`` has word (distinct, not null) and n. An empty table gives an empty table.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, asked, counts in _blocks(batches):
            i, j = matches(texts, asked)
            # a pair of words of different length is only found from the shorter one
            i, j = np.concatenate((i, j)), np.concatenate((j, i))
            if not len(i):
                continue
            pairs = np.unique(i * len(texts) + j)
            i, j = pairs // len(texts), pairs % len(texts)
            column = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([column.take(pa.array(i)), column.take(pa.array(j)), pa.array(counts[j])],
                                             names=["word", "near", "near_n"])

    keyed = _keyed(words)
    found = (keyed.select("key", "s", "word", "n", "short").repartition("key").sortWithinPartitions("s", "key")
             .mapInArrow(search, "word string, near string, near_n long"))
    found = stored(found.dropDuplicates(["word", "near"]), "near")
    release(keyed)
    return found


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the forms that follow from a word. Every form is ``RATIO`` times as frequent
    as its variant, so chains are short and never close; pointers jump, so rounds are fewer still."""
    state = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        fresh = stored(state.join(ahead, "root", "left")
                       .select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "forms")
        release(state)
        if not fresh.agg(F.max("moved")).first()[0]:
            return fresh.select("word", "root")
        state = fresh.drop("moved")
        state.staged_at = fresh.staged_at


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of ``words`` (word, n).

    The form of a word is its near word of largest n (ties: the smallest in code-point order), if that is
    at least ``ratio`` times the word's n, else null; the root is the last word that forms lead to, the
    word itself if it has none.
    """
    words = stored(words, "vocabulary")
    near = near_words(words)
    # the smallest of (-n, word) is the most frequent near word
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    judged = words.join(best, "word", "left").withColumn("best_n", -F.col("best.less"))
    is_form = F.col("best_n") >= ratio * F.col("n")
    judged = stored(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                  F.when(is_form, F.col("best.near")).alias("form"),
                                  F.when(is_form, F.col("best_n")).alias("form_n")), "judged")
    release(words, near)
    roots = _roots(judged.filter("form is not null"))
    return (judged.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all ``documents`` with at least seven letters and two occurrences.

    Null and empty texts have no words; without doc_id no letter is dropped; repeated rows count each
    time; other columns are not read. Words of any length take part.
    """
    found = runs(table(spark, sf_dir, "documents"), LEAST_LETTERS)
    return variants(vocabulary(found.select(misspelt(F.col("doc_id"), F.col("run")).alias("word"))))
