"""Runs of periodic words, found with an enhanced suffix array.

A run is a stretch of consecutive words with smallest period q that no neighbour extends. Its last
square (two equal halves of d words, d a multiple of q) is branching: the suffixes at both halves agree
in exactly d words, so they lie in different children of the LCP interval of depth d. So, for each LCP
interval, every suffix i of its smaller children asks whether the suffix at i + d or i - d (ISA) is in
another child. Each square found is then rotated to the left as far as it goes, squares of one stretch
are merged into one run, and the smallest half is its period.

No tree is built: an interval is split at each of its LCP values in turn, which gives two ranges of the
suffix array; the boundaries come from one pass with a stack, all else is vectorised over many texts at
once. Suffixes are ordered by prefix doubling that goes on only where suffixes still agree, and what a
round has replaced is kept: the ranks of earlier rounds, gone through backwards, give both the LCP
values and the lengths of the rotations in as many steps as there were rounds.

With at least 6 words and 4 periods in a run, it holds a square of three words a half or more for any
period (three periods of 1, two of 2), so intervals of depth 1 and 2 need not be looked at.

Defined results: a null text has no words and no runs; words are compared byte by byte; a document with a
null id is judged like any other; repeated rows give a row each; runs never cross documents; an empty
table gives no rows; other columns are ignored. A text of any length is handled in one piece, with memory
in proportion to its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerfield.llm.spans import covered, map_slices
from ledgerfield.llm.tables import table

LENGTH, EXPONENT = 6, 4
MEMBERS = 1 << 20  # suffixes asked at once
WORDS = r"[\x20\x09-\x0D]+"


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    flat = lists.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0)
    doc = np.repeat(np.arange(len(column)), lists.value_lengths().to_numpy(zero_copy_only=False))
    return flat.filter(full), np.bincount(doc[full.to_numpy(zero_copy_only=False)],
                                          minlength=len(column))


class Suffixes:
    """Suffixes of word codes in order, those of a text together, with LCP values from ``depth`` on."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int):
        self.codes, self.depth = codes, depth
        ends = np.cumsum(counts)
        self.start = np.repeat(ends - counts, counts)
        self.end = np.repeat(ends, counts)
        tied = self._first(np.repeat(np.arange(len(counts)), counts))
        self._double()
        self.isa = self.rank.copy()
        self.at = np.flatnonzero(tied) + 1
        self.lcp = self._common(self.sa[self.at - 1], self.sa[self.at])

    def _first(self, doc: np.ndarray) -> np.ndarray:
        """Order by the first ``depth`` words; which neighbours agree in them."""
        n, base = len(self.codes), int(self.codes.max(initial=0)) + 2
        grams = [doc]
        for k in range(self.depth):
            gram = np.zeros(n, np.int64)
            gram[:n - k] = np.where(np.arange(k, n) < self.end[:n - k], self.codes[k:] + 1, 0)
            grams.append(gram)
        if (int(doc.max(initial=0)) + 1) * base ** self.depth < 1 << 63:
            key = grams[0].astype(np.int64)
            for gram in grams[1:]:
                key = key * base + gram
            grams = [key]
        self.sa = np.argsort(grams[0]) if len(grams) == 1 else np.lexsort(grams[::-1])
        same = np.ones(max(0, n - 1), bool)
        for gram in grams:
            here = gram[self.sa]
            same &= here[1:] == here[:-1]
        head = np.concatenate([np.ones(min(n, 1), bool), ~same])
        self.rank = np.empty(n, np.int64)
        self.rank[self.sa] = np.flatnonzero(head)[np.cumsum(head) - 1]
        return same

    def _double(self) -> None:
        n, h = len(self.codes), self.depth
        self.rounds = []
        active = self.sa[np.bincount(self.rank, minlength=n)[self.rank[self.sa]] > 1] if n else self.sa
        while len(active):
            then = active + h
            key = self.rank[active] * (n + 1) + np.where(
                then < self.end[active], self.rank[np.minimum(then, n - 1)] + 1, 0)
            order = np.argsort(key)
            pos, key = active[order], key[order]
            before = self.rank[pos]
            place = np.arange(len(pos))
            old = np.concatenate([[True], before[1:] != before[:-1]])
            new = np.concatenate([[True], key[1:] != key[:-1]])
            shift = before - np.flatnonzero(old)[np.cumsum(old) - 1]
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            after = first[group] + shift
            self.sa[place + shift] = pos
            self.rank[pos] = after
            self.rounds.append((h, pos, before, after))
            active = pos[np.diff(first, append=len(pos))[group] > 1]
            h *= 2

    def _lengths(self) -> Iterator[int]:
        """While it yields h, ``rank`` is equal where the next h words are; from large to small."""
        for h, pos, before, _ in reversed(self.rounds):
            self.rank[pos] = before
            yield h
        for _, pos, _, after in self.rounds:
            self.rank[pos] = after

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many words the suffixes at a and b of one text agree; at least ``depth``."""
        n, out, last = len(self.codes), np.zeros(len(a), np.int64), np.maximum(a, b)
        for h in self._lengths():
            x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            out += h * ((last + out < self.end[a]) & (self.rank[x] == self.rank[y]))
        for _ in range(self.depth - 1):
            x, y = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            out += (last + out < self.end[a]) & (self.codes[x] == self.codes[y])
        return out

    def rotated(self, i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """How far squares that start at i with halves of d words go to the left."""
        i = i.copy()
        for h in self._lengths():
            x = np.maximum(i - h, 0)
            i -= h * ((i - h >= self.start[i]) & (self.rank[x] == self.rank[x + d]))
        for _ in range(self.depth - 1):
            x = np.maximum(i - 1, 0)
            i -= (i > self.start[i]) & (self.codes[x] == self.codes[x + d])
        return i

    def splits(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place of ``at`` the ranges [left, place) and [place, right) that it parts.

        Between them they hold an interval of the place's LCP value, up to the next place of equal value.
        """
        left, right, stack, begin, last = [], [0] * len(self.at), [], 0, -1
        values = self.lcp.tolist()
        for t, (r, d) in enumerate(zip(self.at.tolist(), values)):
            if r != last + 1:
                for s, _ in stack:
                    right[s] = last + 1
                stack, begin = [], r - 1
            last = r
            while stack and values[stack[-1][0]] >= d:
                right[stack.pop()[0]] = r
            left.append(stack[-1][1] if stack else begin)
            stack.append((t, r))
        for s, _ in stack:
            right[s] = last + 1
        return np.array(left, np.int64), np.array(right, np.int64)

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and halves of all branching squares with halves of ``depth`` words or more."""
        left, right = self.splits()
        low = self.at - left <= right - self.at  # the smaller part
        first, size = np.where(low, left, self.at), np.where(low, self.at - left, right - self.at)
        lo, hi = np.where(low, self.at, left), np.where(low, right, self.at)
        total, n = np.cumsum(size), len(self.codes)
        starts, halves, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while at < len(size):
            done = int(total[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + MEMBERS, "right")))
            which = np.repeat(np.arange(at, to), size[at:to])
            inner = np.arange(len(which)) + done - (total - size)[which]
            i, d = self.sa[first[which] + inner], self.lcp[which]
            for other, begin in ((i + d, i), (i - d, i - d)):
                there = self.isa[np.clip(other, 0, n - 1)]
                hit = (other >= 0) & (other < n) & (there >= lo[which]) & (there < hi[which])
                starts.append(begin[hit])
                halves.append(d[hit])
            at = to
        return np.concatenate(starts), np.concatenate(halves)


def runs_of(codes: np.ndarray, counts: np.ndarray, length: int = LENGTH,
            exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs with ``length`` words and ``exponent`` periods at least.

    Ordered by start and period; starts count through all texts.
    """
    depth = 3 if length >= 6 and exponent >= 4 else 1
    suffixes = Suffixes(codes, counts, depth)
    i, d = suffixes.squares()
    end, start = i + 2 * d, suffixes.rotated(i, d)
    order = np.lexsort((d, end, start))
    start, end, d = start[order], end[order], d[order]
    new = np.ones(len(d), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, q = start[new], end[new], d[new]
    if depth > 1:  # periods 1 and 2 were found by halves of three and four words
        w = codes[np.minimum(start[:, None] + np.arange(4), max(0, len(codes) - 1))]
        one = (q == 3) & (w[:, 0] == w[:, 1]) & (w[:, 1] == w[:, 2])
        two = (q == 4) & (w[:, 0] == w[:, 2]) & (w[:, 1] == w[:, 3])
        q = np.where(one, 1, np.where(two, 2, q))
    keep = end - start >= np.maximum(length, exponent * q)
    start, end, q = start[keep], end[keep], q[keep]
    order = np.lexsort((q, start))
    return start[order], (end - start)[order], q[order]


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  length: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """Per row: id, n_words, runs (start, length, period; by start, then period) and ``collapsed``.

    ``collapsed`` keeps the first period of each run: a word goes if some run holds it further on.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, counts = words_of(batch.column("text"))
        codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        start, size, period = runs_of(codes, counts, length, exponent)
        ends = np.cumsum(counts)
        doc = np.searchsorted(ends, start, "right")
        kept = np.flatnonzero(~covered(len(codes), start + period, start + size))
        left = np.searchsorted(kept, np.concatenate([[0], ends])).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), words.take(pa.array(kept))), " ")
        found = pa.StructArray.from_arrays(
            [pa.array(start - (ends - counts)[doc]), pa.array(size), pa.array(period)],
            ["start", "length", "period"])
        offsets = np.searchsorted(doc, np.arange(len(counts) + 1)).astype(np.int32)
        return pa.record_batch([batch.column("id"), pa.array(counts, pa.int64()),
                                pa.ListArray.from_arrays(pa.array(offsets), found), joined],
                               ["id", "n_words", "runs", "collapsed"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
        f"id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, "
        "collapsed string", run).withColumnRenamed("id", id_col)


def planted(df: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by checksum of the id, a tail of words is periodic."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", WORDS), lambda w: w != "")
    made = df.select("doc_id", "text", h.alias("h")).select(
        "doc_id", "text", F.floor(F.col("h") / 10).alias("g"),
        F.when(F.col("h") % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    a = (F.col("g") % F.col("n")).cast("int")
    p = (1 + F.floor((F.col("n") - a) / (3 + F.col("g") % 8))).cast("int")
    tail = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get(
        F.col("words"), F.when(i < F.col("a"), i).otherwise(
            F.col("a") + (i - F.col("a")) % F.col("p"))))
    return made.withColumns({"a": a, "p": p}).select("doc_id", F.when(
        F.col("n") > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, root: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, root, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
