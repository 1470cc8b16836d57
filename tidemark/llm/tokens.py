"""Token ids of whole texts by a public tokenizer, in Arrow batches.

No token of ``word_bpe_49k.json`` reaches over white space, and neither its normaliser nor its
special tokens look across it. So a text is cut at blanks and newlines, the library encodes every
different piece once, runs of letters without case and many to a call, and the ids of the pieces
are joined.
``tests/llm`` holds this against the library's encoding of whole texts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KNOWN = 300_000  # pieces a worker remembers, and once more those of the generation before
TOGETHER = 6 << 20  # bytes of texts that are encoded together
LONG = 64  # longer pieces are not remembered
# runs of letters whose lower case is one letter, and a run of marks behind them: the two are cut apart first,
# but for an apostrophe; special tokens have < and |
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-\u012f\u0131-\u017f]+)([!-&(-/:;=-@\[-`{}~]*)")
_TOUCHING = r"[.,][^\pL\pN\s]|[^\pL\pN\s][.,]|<\|"

_encoders: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _simpler(texts: pa.Array) -> pa.Array:
    """Texts with the same ids and fewer different pieces.

    A full stop or comma that touches no other mark is a token of its own, so a blank may go before
    it, and A-Z are lower-cased anyway. Texts with touching marks, or with what could be a special
    token, stay as they are.
    """
    plain = pc.replace_substring(pc.replace_substring(pc.ascii_lower(texts), ".", " ."), ",", " ,")
    return pc.if_else(pc.match_substring_regex(texts, _TOUCHING), texts, plain)


class Encoder:
    """Encodes texts; remembers the ids of pieces as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _pieces(self, pieces: Sequence[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(list(pieces), add_special_tokens=False)
        return {p: np.array(x.ids, "<u4").tobytes() for p, x in zip(pieces, found, strict=True)}

    def _words(self, words: Sequence[str]) -> dict[str, bytes]:
        """Runs of letters, many to a call: each ends with the one token that ends a word."""
        out: dict[str, bytes] = {}
        for i in range(0, len(words), 2000):
            some = words[i:i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(some):
                out |= self._pieces(some)
                continue
            flat, ends = ids.tobytes(), (4 * ends).tolist()
            out |= {w: flat[a:b] for w, a, b in zip(some, [0, *ends[:-1]], ends, strict=True)}
        return out

    def _learn(self, pieces: Sequence[str]) -> list[str]:
        """Makes all pieces known; returns those too long to be remembered."""
        known, older = self.known, self.older
        plain, other = [], []
        new = set(pieces).difference(known)
        back = new.intersection(older)
        known.update((piece, older[piece]) for piece in back)
        for piece in new - back:
            if len(piece) <= LONG and (found := _WORD.fullmatch(piece)):
                plain.append((piece, found[1].lower(), found[2]))
            else:
                other.append(piece)
        words = {word for _, word, _ in plain}
        known.update((w, older[w]) for w in words if w in older)
        known.update(self._words(list(words.difference(known))))
        marks = {mark for _, _, mark in plain}
        known.update(self._pieces(list(marks.difference(known))))
        for piece, word, mark in plain:
            if piece != word:
                known[piece] = known[word] + known[mark]
        known.update(self._pieces(other))
        return [p for p in other if len(p) > LONG]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts (null: none), and the n + 1 places where the texts begin and end."""
        if len(self.known) > KNOWN:
            self.known, self.older = {"": b""}, self.known
        cut = pc.split_pattern(pc.replace_substring(_simpler(pc.fill_null(texts, "")), "\n", " "), " ")
        coded = cut.flatten().dictionary_encode()
        pieces, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        forget = self._learn(pieces)
        bodies = [self.known[p] for p in pieces]
        for piece in forget:
            self.known.pop(piece, None)
        vocabulary = np.frombuffer(b"".join(bodies), "<u4")
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) // 4
        first = np.cumsum(sizes) - sizes
        n = sizes[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        small = np.int32 if max(ends[-1], len(vocabulary)) < 1 << 31 else np.int64
        ids = vocabulary[np.repeat((first[at] - ends[:-1]).astype(small), n) + np.arange(ends[-1], dtype=small)]
        texts_at = np.concatenate(([0], np.cumsum(pc.list_value_length(cut).to_numpy())))
        del cut, coded
        pa.default_memory_pool().release_unused()
        return ids, ends[texts_at]


def batches_of(texts: pa.Array) -> Iterator[slice]:
    """Row ranges of a batch to encode together: some thousand texts, fewer if they are long."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = size[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(size, before + TOGETHER, "right")))
        yield slice(first, last)
        first = last


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
