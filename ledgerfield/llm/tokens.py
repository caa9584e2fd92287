"""Exact token ids of whole texts from a pool of encoded pieces.

A text is cut before every run of ASCII white space, and between a word of letters and a comma, stop
or similar mark behind it. Both kinds of pre-tokenizer used here always begin a new match there, so
the pieces of a text are encoded independently of each other and their ids, put together, are those
of the whole text. Texts with other white space, which could join such a run, are encoded whole.

The cuts are found for a slice of texts at once and equal pieces are told by their bytes, so only the
distinct pieces of a slice become strings. Each worker keeps the pieces it has
seen; the pool starts anew when it reaches its limit.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerfield.llm.words import SPACE

# A word, apart from the mark behind it; else everything up to white space.
PIECE = re.compile(r"[\t-\r ]*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\t-\r ,.!?;:])|[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
# White space, separators and invisible characters outside the ASCII set above.
ODD_RANGES = ((0x1C, 0x1F), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E),
              (0x2000, 0x200B), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x2060),
              (0x3000, 0x3000), (0xFEFF, 0xFEFF))
ODD = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ODD_RANGES) + "]")
ODD_RE2 = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ODD_RANGES) + "]"
LETTERS = re.compile(r"[\t-\r ]*[A-Za-zÀ-ÖØ-öø-ÿ]+")
SLICE = 4 << 20  # bytes of text whose distinct pieces are looked up at once
SENTENCE_ENDS = (".", "!", "?", "…", "。")


MARK = np.zeros(256, bool)
MARK[list(b",.!?;:")] = True
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
# The second bytes of the letters from U+00C0 to U+00FF, whose first byte is C3.
SECOND = np.zeros(256, bool)
SECOND[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


def pieces(text: str) -> list[str]:
    return [text] if ODD.search(text) else PIECE.findall(text)


def _before_marks(data: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Places of marks with nothing but letters, one at least, between the white space and them."""
    two = np.zeros(len(data), bool)
    two[:-1] = (data[:-1] == 0xC3) & SECOND[data[1:]]
    letter = ASCII_LETTER[data] | two
    letter[1:] |= two[:-1]
    other = np.concatenate([[0], np.cumsum(~letter & ~SPACE[data], dtype=np.int32)])
    at = np.flatnonzero(MARK[data[1:]] & letter[:-1]) + 1
    starts = np.flatnonzero(cut)
    return at[other[at] == other[starts[np.searchsorted(starts, at, "right") - 1]]]


def cut_texts(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts, one after another, and how many each text has; null counts as empty."""
    column = pc.fill_null(column.cast(pa.string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    first, ends = int(offsets[0]), offsets.astype(np.int64) - offsets[0]
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8)[first:first + ends[-1]] if ends[-1] else np.zeros(0, np.uint8)
    space = SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = space[1:] & ~space[:-1]
    cut[ends] = True
    cut[_before_marks(data, cut)] = True
    for i in np.flatnonzero(pc.match_substring_regex(column, ODD_RE2).to_numpy(zero_copy_only=False)):
        cut[ends[i] + 1:ends[i + 1]] = False
    at = np.flatnonzero(cut)
    n = np.searchsorted(at, ends[1:]) - np.searchsorted(at, ends[:-1])
    parts = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer((at + first).astype(
        np.int32)), values]) if len(at) > 1 else pa.array([], pa.string())
    return parts, n


def slice_codes(encoder: PiecePool, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all pieces of the texts, and how many pieces each text has."""
    parts, n = cut_texts(column)
    parts = parts.dictionary_encode()
    return encoder.codes(strings(parts.dictionary))[parts.indices.to_numpy()], n


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist


class PiecePool:
    """Ids of encoded pieces."""

    def __init__(self, path: str, limit: int = 400_000, limit_ids: int = 4_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit, self.limit_ids = limit, limit_ids
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes_word = None
        if suffix:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.closes_word = np.zeros(max(vocabulary.values()) + 1, bool)
            self.closes_word[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.ends_sentence = np.zeros(1 << 14, bool)
        self.used = 0

    def _room(self, entries: int, ids: int) -> None:
        while len(self.starts) < entries:
            self.starts, self.lengths, self.ends_sentence = (
                np.concatenate([x, np.zeros_like(x)])
                for x in (self.starts, self.lengths, self.ends_sentence))
        while len(self.ids) < ids:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])

    def codes(self, words: list[str]) -> np.ndarray:
        """The number of each piece in the pool; unknown pieces are encoded first."""
        found = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(found < 0).tolist()
        if not unknown:
            return found
        if len(self.index) + len(unknown) > self.limit or self.used > self.limit_ids:
            self._clear()
            unknown = range(len(words))
        new = list(dict.fromkeys(words[i] for i in unknown))
        for at in range(0, len(new), 16384):
            part = new[at:at + 16384]
            if self.closes_word is not None:
                plain = [w for w in part if LETTERS.fullmatch(w)]
                others = [w for w in part if not LETTERS.fullmatch(w)] if len(plain) < len(part) else []
                part = plain + others
                ids, lengths = self._joined(plain)
                rest, more = self._apart(others)
                ids, lengths = np.concatenate([ids, rest]), np.concatenate([lengths, more])
            else:
                ids, lengths = self._apart(part)
            k, total = len(self.index), len(ids)
            self._room(k + len(part), self.used + total)
            self.ids[self.used:self.used + total] = ids
            self.starts[k:k + len(part)] = self.used + np.cumsum(lengths) - lengths
            self.lengths[k:k + len(part)] = lengths
            self.ends_sentence[k:k + len(part)] = [w.endswith(SENTENCE_ENDS) for w in part]
            self.used += total
            self.index.update(zip(part, range(k, k + len(part))))
        found[unknown] = [self.index[words[i]] for i in unknown]
        return found

    def _apart(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces and how many each has, every piece encoded by itself."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths

    def _joined(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, many to a text: an id that closes a word ends each."""
        texts = [" ".join(part[i:i + 512]) for i in range(0, len(part), 512)]
        ids, _ = self._apart(texts)
        ends = np.flatnonzero(self.closes_word[ids]) + 1
        if len(ends) != len(part):
            return self._apart(part)
        return ids, np.diff(ends, prepend=0)

    def gather(self, codes: np.ndarray) -> np.ndarray:
        """The ids of the pieces, one after another."""
        n = self.lengths[codes]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[codes] - (ends - n), n)
        return self.ids[at]


_pools: dict[str, PiecePool] = {}


def pool(path: str) -> PiecePool:
    """This worker's pool for a tokenizer file."""
    if path not in _pools:
        _pools[path] = PiecePool(path)
    return _pools[path]


def tokenizer_path(name: str) -> str:
    """Where this machine keeps a public tokenizer; asked for on the executor that needs it."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
