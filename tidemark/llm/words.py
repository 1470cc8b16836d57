"""Words of whole texts as arrays of 64-bit hashes, computed on the bytes of an Arrow batch.

A word is a run of bytes other than space and 0x09-0x0D, so multi-byte characters never split.
The hash of a word is a polynomial in its bytes taken from running sums, mixed at the end; no
Python object is made per word. Hashes only name words; whoever needs certainty compares bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
CHUNK_BYTES = 1 << 18  # texts are taken together up to this size; a longer text is a chunk of its own

_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
_NOT_ALNUM = np.ones(256, bool)
_NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SAME = np.arange(256, dtype=np.uint8)
_FOLD = _SAME.copy()
_FOLD[65:91] += 32
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for the next chunk."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts: byte places, hashes, and the range of words of each text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, fold: bool = False, alnum: bool = False) -> None:
        """``data``: bytes of all texts; ``bounds``: n + 1 places where texts begin and end. ``alnum``
        also parts words at ASCII marks."""
        self.data, self.bounds = data, bounds
        inside = ~(_NOT_ALNUM if alnum else _IS_SEP)[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        filled = bounds[:-1] < bounds[1:]
        heads, tails = bounds[:-1][filled], bounds[1:][filled] - 1
        first[heads] = inside[heads]
        last[tails] = inside[tails]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.of_text = np.searchsorted(self.starts, bounds)  # words of text i: of_text[i]:of_text[i + 1]
        letters = (_FOLD if fold else _SAME)[data]
        self._sums = np.zeros(len(data) + 1, np.uint64)
        terms = letters.astype(np.uint64)
        terms += np.uint64(1)
        terms *= _power(_P, len(data))
        np.cumsum(terms, out=self._sums[1:])
        self.hashes = self.hash_spans(self.starts, self.ends)

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes of any spans."""
        raw = (self._sums[ends] - self._sums[starts]) * _power(_P_INVERSE, len(self.data) + 1)[starts]
        return mix(raw + (ends - starts).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.of_text) - 1

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each place on; the last n - 1 places of a text hold no gram of it."""
        h = self.hashes
        m = max(0, len(h) - n + 1)
        total = np.full(m, n, np.uint64)
        for i, weight in enumerate(_power(0xD6E8FEB86659FD93, n + 1)[1:]):
            total += h[i:i + m] * weight
        return mix(total)


def chunks(texts: pa.Array, fold: bool = False, alnum: bool = False) -> Iterator[tuple[int, Words]]:
    """Splits a string array (null: empty) into chunks; yields the first row and the words of each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.offset:
        texts = pa.concat_arrays([texts, texts.slice(0, 0)])
    _, place, body = texts.buffers()
    n = len(texts)
    if not n:
        return
    bounds = np.frombuffer(place, np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK_BYTES, "right")) - 1)
        yield i, Words(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i], fold, alnum)
        i = j


def words_of(text: str | None, fold: bool = False, alnum: bool = False) -> Words:
    raw = (text or "").encode()
    return Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), fold, alnum)
