"""Token counts of every prefix by dynamic programming.

The table of a text holds the exact number of tokens of each of its prefixes, one for every character:
the count of the pieces before (see ``tokens``) plus that of the prefix of the piece the character is in.
The counts inside a piece are found once per distinct piece, when a worker first meets it. The prefixes
of short pieces with other white space or an apostrophe are encoded. In all others a prefix of bytes has
exactly one last token t such that the last token of the rest and t are a pair that encoding leaves as it
is; so, byte by byte, count(p) = count(p - len(t)) + 1, in time proportional to the piece; pieces of a
slice that begin alike share those counts. (Models that mark the ends of words have other
last tokens in a prefix; all their prefixes are encoded.) Budgets and cut points are read from the
table; no text is encoded again, whatever its script or white space. So are the totals and limits of
``token_counts``, which holds the tables of one slice of texts at a time.

A longer prefix can have fewer tokens; the prefix that fits a budget is the longest that does.

Defined results: a null text counts as empty (0 bytes, 0 tokens, one prefix); empty tables give empty
tables; repeated rows are counted each by itself; other columns are ignored; a null id stays null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ledgerfield.llm.batches import slices
from ledgerfield.llm.tables import table
from ledgerfield.llm.tokens import PiecePool, cut_texts, pool, strings, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
SHORT = 32  # characters of a piece whose prefixes are all encoded
MOST_PAIRS = 1_000_000  # of tokens that a worker remembers
LINES = 8192  # prefixes encoded as the lines of one text
PLAIN = re.compile(r" ?[^\s\x00-\x20\x7f-\xa0]+")
PROBES = ["a", " a", " ab'", "'s", "12", " 1", "é", " 漢", ",.", "a,", " <|", "_"]  # show that lines are apart


class Prefixes:
    """Counts of all prefixes of the pieces a worker has met; starts anew at its limit of characters."""

    def __init__(self, encoder: PiecePool, limit: int = 8_000_000):
        self.tokenizer, self.limit = encoder.tokenizer, limit
        self.model, self.cutter = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.longest = max(map(len, self.vocabulary), default=1)
        # Texts of added tokens are taken out before anything else.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_pairs = encoder.closes_word is None and self.tokenizer.normalizer is None
        self.special = re.compile("|".join(map(re.escape, self.added)) or r"(?!)")
        self.blank, self.line = (self._ids([t])[0] for t in (" ", "\n"))
        self.by_lines = self.by_pairs and len(self.line) == 1 and not any("\n" in t for t in self.added) and (
            self._lines(PROBES) == list(self._apart(PROBES)))
        self.pairs: dict[tuple[str, str], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.starts = np.zeros(1 << 14, np.int64)
        self.counts, self.used = np.zeros(1 << 18, np.int32), 0

    def _fits(self, a: str, b: str) -> bool:
        """Whether encoding leaves two tokens as they are; the second alone, if the first is empty."""
        if (a, b) not in self.pairs:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = [t.value for t in self.model.tokenize(a + b)] == ([a, b] if a else [b])
        return self.pairs[a, b]

    def _bytes(self, mapped: str) -> list[int]:
        """Counts of all prefixes of a match of the pre-tokenizer, whose characters stand for bytes."""
        counts, last = [0], [""]
        self._extend(mapped, counts, last)
        return counts

    def _extend(self, mapped: str, counts: list[int], last: list[str]) -> None:
        """Continues the counts and last tokens of the first prefixes to those of all."""
        known, pairs, fits = self.vocabulary, self.pairs, self._fits
        for p in range(len(counts), len(mapped) + 1):
            # Only one token fits, so the order of the trials is free: often the one before has grown.
            grown = p - 1 - len(last[p - 1])
            for at in (grown, *range(max(0, p - self.longest), p)):
                t = mapped[at:p]
                if t in known:
                    pair = last[at], t
                    if pairs[pair] if pair in pairs else fits(*pair):
                        counts.append(counts[at] + 1)
                        last.append(t)
                        break
            else:
                raise ValueError(f"no token ends {mapped[:p]!r}")

    def _sorted_bytes(self, matches: set[str]) -> dict[str, list[int]]:
        """``_bytes`` of many matches; what a match shares with the one before it in order is kept."""
        found, counts, last, before = {}, [0], [""], ""
        for mapped in sorted(matches):
            same, most = 0, min(len(mapped), len(before))
            while same < most and mapped[same] == before[same]:
                same += 1
            del counts[same + 1:], last[same + 1:]
            self._extend(mapped, counts, last)
            found[mapped], before = counts[:], mapped
        return found

    def _matched(self, piece: str) -> list[int]:
        """Counts of the prefixes of a piece without added tokens, match by match."""
        out = [0]
        for mapped, (start, end) in self.cutter.pre_tokenize_str(piece):
            inner = self._bytes(mapped)
            ends = np.cumsum([len(c.encode()) for c in piece[start:end]])
            total = out[-1]
            out += [total + inner[e] for e in ends.tolist()]
        return out

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, texts: list[str]) -> Iterator[int]:
        """Tokens of each text, every one encoded by itself."""
        for at in range(0, len(texts), 16384):
            yield from map(len, self._ids(texts[at:at + 16384]))

    def _lines(self, texts: list[str]) -> list[int]:
        """The same for texts without white space but one blank in front: many to a text, one to a line.

        The end of a line is a match, and a token, of its own, so the tokens between two are a text's.
        """
        out = []
        for at in range(0, len(texts), LINES):
            part = texts[at:at + LINES]
            ids = np.array(self._ids(["\n".join(part)])[0])
            ends = np.flatnonzero(ids == self.line[0])
            out += (np.diff(ends, prepend=-1, append=len(ids)) - 1).tolist() \
                if len(ends) == len(part) - 1 else self._apart(part)
        return out

    def encoded(self, pieces: list[str]) -> list[int]:
        """Counts of the prefixes of each piece but the empty one, all of them encoded."""
        return list(self._apart([p[:j] for p in pieces for j in range(1, len(p) + 1)]))

    def by_bytes(self, pieces: list[str]) -> list[int]:
        """The same for pieces whose matches begin in every prefix where they begin in the piece."""
        cut = list(map(self.cutter.pre_tokenize_str, pieces))
        known, out = self._sorted_bytes({mapped for matches in cut for mapped, _ in matches}), []
        for piece, matches in zip(pieces, cut):
            before = 0
            for mapped, (start, end) in matches:
                counts = known[mapped]
                ends = range(1, len(mapped) + 1) if len(mapped) == end - start else accumulate(
                    len(c.encode()) for c in piece[start:end])
                out += [before + counts[e] for e in ends]
                before += counts[-1]
        return out

    def in_lines(self, pieces: list[str]) -> np.ndarray:
        """The same for pieces that can be lines."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        first = (np.cumsum(n) - n)[[p[0] == " " for p in pieces]]
        out = np.full(int(n.sum()), len(self.blank), np.int32)
        rest = np.ones(len(out), bool)
        rest[first] = False  # a blank by itself
        out[rest] = self._lines([p[:j] for p in pieces for j in range(1 + (p[0] == " "), len(p) + 1)])
        return out

    def of(self, piece: str) -> list[int]:
        """Tokens of the first 0, 1, ... characters of a long piece."""
        out, at = [0], 0
        while at < len(piece):
            begin, name = min(((piece.find(t, at), t) for t in self.added if t in piece[at:]),
                              default=(len(piece), ""))
            plain = self._open_end(piece[at:begin + max(0, len(name) - 1)], begin - at)
            out += [out[at] + c for c in plain[1:]]
            if name:
                out.append(out[begin] + 1)
            at = begin + len(name)
        return out

    def _open_end(self, text: str, whole: int) -> list[int]:
        """Counts of prefixes of ``text``; from ``whole`` on an added token is there in part.

        A match that looks ahead (white space before a word) is another one if the text ends there, and a
        half added token is ordinary text, so such prefixes are cut anew.
        """
        counts = self._matched(text[:whole])
        for j in range(1, whole):
            if text[j - 1].isspace() and (text[j].isspace() or j > 1 and text[j - 2].isspace()):
                counts[j] = self._matched(text[:j])[-1]
        return counts + [self._matched(text[:j])[-1] for j in range(whole + 1, len(text) + 1)]

    def _keep(self, pieces: list[str], counts: list[int] | np.ndarray) -> None:
        """Adds pieces with the counts of their prefixes, one piece after another, the empty ones left out."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        known, total = len(self.index), int(n.sum())
        while len(self.starts) < known + len(pieces):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        while len(self.counts) < self.used + total:
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        starts = np.cumsum(n) - n
        filled = np.ones(total, bool)
        filled[starts] = False
        self.counts[self.used:self.used + total][filled] = counts
        self.starts[known:known + len(pieces)] = self.used + starts
        self.index.update(zip(pieces, range(known, known + len(pieces))))
        self.used += total

    def places(self, pieces: list[str]) -> np.ndarray:
        """Where the counts of each piece begin in ``counts``."""
        if self.used > self.limit:
            self._clear()
        simple, lines, short, long = [], [], [], []
        for piece in set(pieces).difference(self.index):
            if self.by_pairs and len(piece) > SHORT:
                long.append(piece)
            elif not self.by_lines or not PLAIN.fullmatch(piece) or self.special.search(piece):
                short.append(piece)
            else:
                # "'re" is one match, its prefix "'r" is two.
                (lines if "'" in piece else simple).append(piece)
        self._keep(simple, self.by_bytes(simple))
        self._keep(lines, self.in_lines(lines))
        self._keep(short, self.encoded(short))
        self._keep(long, [c for piece in long for c in self.of(piece)[1:]])
        return self.starts[[self.index[p] for p in pieces]]


_prefixes: dict[str, Prefixes] = {}


def prefixes(path: str) -> Prefixes:
    if path not in _prefixes:
        _prefixes[path] = Prefixes(pool(path))
    return _prefixes[path]


def tables(known: Prefixes, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The counts of all prefixes of all texts, and the characters of each text.

    A text of n characters has n + 1 counts, the first 0.
    """
    parts, n = cut_texts(column)
    parts = parts.dictionary_encode()
    places = known.places(strings(parts.dictionary))
    size = pc.utf8_length(parts.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)
    which = parts.indices.to_numpy()
    chars = size[which]
    ends = np.cumsum(chars)
    total = int(ends[-1]) if len(ends) else 0
    # Characters count from 1: what a prefix holds that ends with this one.
    inner = known.counts[np.arange(1, total + 1) + np.repeat(places[which] - (ends - chars), chars)]
    last = known.counts[places[which] + chars]
    text = np.repeat(np.arange(len(n)), n)
    before = np.cumsum(last) - last
    first = np.cumsum(n) - n
    before -= np.concatenate([before, [0]])[np.minimum(first, len(before))][text]
    inner = inner + np.repeat(before, chars)
    sizes = np.bincount(text, weights=chars, minlength=len(n)).astype(np.int64)
    out = np.zeros(total + len(n), np.int64)
    out[np.arange(total) + np.repeat(np.arange(len(n)), sizes) + 1] = inner
    return out, sizes


def totals(known: Prefixes, column: pa.Array) -> np.ndarray:
    """The tokens of each whole text: the last count of its table."""
    counts, sizes = tables(known, column)
    return counts[np.cumsum(sizes + 1) - 1]


def prefix_table(df: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, counts): the tokens of the first 0, 1, ... characters of each text."""
    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = prefixes(tokenizer_path(tokenizer))
        for batch in slices(batches):
            counts, sizes = tables(known, batch.column("text"))
            offsets = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int32)
            yield pa.record_batch([batch.column("id"), pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(counts))], ["id", "counts"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        tabulate, f"id {kind}, counts array<bigint>").withColumnRenamed("id", id_col)


def count_at(counts: Column, n_chars: Column) -> Column:
    """Tokens of the first characters of a text, from its table."""
    return F.get(counts, n_chars)


def chars_within(counts: Column, budget: int | Column) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens, from the text's table."""
    return F.array_max(F.transform(counts, lambda c, i: F.when(c <= budget, i)))


def token_counts(df: DataFrame, limit: int = LIMIT, tokenizer: str = TOKENIZER,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: bytes, tokens (of the last prefix), and whether they exceed ``limit``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = prefixes(tokenizer_path(tokenizer))
        for batch in slices(batches):
            n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            tokens = totals(known, batch.column("text"))
            yield pa.record_batch([batch.column("id"), n_bytes, pa.array(tokens), pa.array(tokens > limit)],
                                  ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        count, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    ).withColumnRenamed("id", id_col)


def op10_token_counts(spark, root: str) -> DataFrame:
    return token_counts(table(spark, root, "documents"))
