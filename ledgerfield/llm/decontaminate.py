"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance.

A test item may appear with up to ``RATE`` errors per character. It is cut into one piece more than
its error budget, so one piece at least appears exactly wherever the item appears. An automaton finds
all pieces in one pass over a text; around each hit, Myers' bit-parallel algorithm computes the
least edit distance of growing stretches of the item, and at last of the item, to any string there.

Texts and items are compared in lower case, as words of letters, digits and underscores joined by
single blanks. Items of fewer than ``SHORT`` characters would turn up inside other words, so they
must begin and end where words do; in scripts without blanks that is between any two characters.
The items are sent to the executors in slabs of bounded size, one after another; the
documents stay where they are read.

Defined results: null and wordless texts match nothing; items that are null or
have no words (fewer than ``LEAST`` characters) are left out; an item of one common word marks every
document that has the word; repeated rows match each by itself; several items with one id match each by
itself, and the best match is reported; ids of documents and items may be of any simple type; empty
tables give no rows; other columns are ignored by ``matches`` and kept by ``without_matches``.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerfield.llm.batches import slices, texts_of
from ledgerfield.llm.tables import table, written

RATE = 0.1
LEAST = 1
SHORT = 24
SLAB_BYTES = 8 << 20  # of items, searched in one pass
WORD = re.compile(r"\w+")
# Thai to Burmese, Khmer, Chinese and Japanese characters: written without blanks.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff"
                      "\uff66-\uff9d\U00020000-\U0003ffff]")


def normal(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


def cut(item: str, pieces: int) -> list[tuple[int, str]]:
    """(offset, piece) of pieces of nearly equal length."""
    at = [i * len(item) // pieces for i in range(pieces + 1)]
    return [(s, item[s:e]) for s, e in zip(at, at[1:])]


def letters(item: str) -> dict[str, int]:
    """For each character the set of its places, as bits."""
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


def least_distance(places: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern to any string in the text, and where the first such ends."""
    mask, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = mask, 0, size
    best, end = size, 0
    for j, c in enumerate(text):
        eq = places.get(c, 0)
        cross = eq | down
        line = (((eq & up) + up) ^ up) | eq
        more = down | (~(line | up) & mask)
        less = up & line
        score += bool(more & top) - bool(less & top)
        more, less = more << 1 & mask, less << 1 & mask
        up = less | (~(cross | more) & mask)
        down = more & cross
        if score < best:
            best, end = score, j + 1
    return best, end


def _edge(text: str, at: int) -> bool:
    """Whether a word may begin or end before this position."""
    if at <= 0 or at >= len(text):
        return True
    pair = text[at - 1:at + 1]
    return " " in pair or bool(UNSPACED.search(pair))


def word_distance(item: str, text: str, begin: int, budget: int) -> tuple[int, int] | None:
    """Least (distance, end) of a match of whole words that begins within ``budget`` of ``begin``."""
    best = None
    for start in range(max(0, begin - budget), min(len(text), begin + budget) + 1):
        if not _edge(text, start):
            continue
        row = list(range(len(item) + 1))  # distances of the item's prefixes to no text
        for end in range(start, min(len(text), start + len(item) + budget) + 1):
            if end > start:
                c, new = text[end - 1], [end - start]
                for j, x in enumerate(item):
                    new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
                row = new
            if row[-1] <= budget and _edge(text, end):
                best = min(best or (row[-1], end), (row[-1], end))
    return best


class Items:
    """Test items with their pieces in one automaton.

    The pieces are the leaves of a binary tree. If a stretch of m pieces has fewer than m errors,
    so has one of its halves; hence some piece appears exactly and every stretch above it has fewer
    errors than pieces. A hit is followed up the tree and given up at the first stretch that fails.
    """

    def __init__(self, rows: list[tuple], rate: float):
        import ahocorasick

        self.rows = rows
        found: dict[str, list[tuple]] = defaultdict(list)
        for i, (_, text) in enumerate(rows):
            budget = int(rate * len(text))
            pieces = cut(text, budget + 1)
            above: list[list[tuple]] = [[] for _ in pieces]
            self._stretches(text, pieces, 0, len(pieces), above)
            for (offset, piece), stretches in zip(pieces, above):
                found[piece].append((i, offset, budget, stretches))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()

    def _stretches(self, text: str, pieces: list, lo: int, hi: int, above: list) -> None:
        """Append (begin, end, allowed errors, letters) of a stretch to all its pieces, small ones first."""
        if hi - lo > 1:
            mid = (lo + hi) // 2
            self._stretches(text, pieces, lo, mid, above)
            self._stretches(text, pieces, mid, hi, above)
        begin, end = pieces[lo][0], pieces[hi - 1][0] + len(pieces[hi - 1][1])
        stretch = (begin, end, hi - lo - 1, letters(text[begin:end]))
        for leaf in range(lo, hi):
            above[leaf].append(stretch)

    def search(self, text: str) -> list[tuple]:
        """(item, distance, end of the match) per item, the best."""
        if not self.rows or not text:
            return []
        best: dict[int, tuple[int, int]] = {}
        done: dict[int, int] = {}
        for last, (size, uses) in self.automaton.iter(text):
            for i, offset, budget, stretches in uses:
                begin = last + 1 - size - offset
                if i in done and abs(done[i] - begin) <= budget:
                    continue  # the stretch around is verified
                short = len(self.rows[i][1]) < SHORT
                if short and i in best and not best[i][0]:
                    continue  # the first exact match is found
                if short and not budget:
                    if _edge(text, begin) and _edge(text, last + 1):
                        best[i] = (0, last + 1)
                    continue
                for s, e, allowed, places in stretches:
                    at = max(0, begin + s - allowed)
                    distance, end = least_distance(places, e - s, text[at:begin + e + allowed])
                    if distance > allowed:
                        break
                else:
                    if short:
                        match = word_distance(self.rows[i][1], text, begin, budget)
                        if match:
                            best[i] = min(best.get(i, match), match)
                        continue
                    done[i] = begin
                    best[i] = min(best.get(i, (distance, at + end)), (distance, at + end))
        return [(self.rows[i][0], d, end) for i, (d, end) in best.items()]


_ITEMS: dict[int, Items] = {}


def _items(sent, rate: float) -> Items:
    """This worker's automaton for a broadcast slab; one is kept."""
    if sent.id not in _ITEMS:
        _ITEMS.clear()
        _ITEMS[sent.id] = Items(sent.value, rate)
    return _ITEMS[sent.id]


class _Sent:
    """A broadcast value with a name of its own."""

    def __init__(self, spark: SparkSession, rows: list[tuple]):
        self._broadcast = spark.sparkContext.broadcast(rows)
        self.id = self._broadcast._jbroadcast.id()

    @property
    def value(self):
        return self._broadcast.value

    def __getstate__(self):
        return {"_broadcast": self._broadcast, "id": self.id}


def slabs(spark: SparkSession, items: DataFrame, id_col: str, text_col: str,
          slab_bytes: int = SLAB_BYTES) -> Iterator[_Sent]:
    """The normalised items in slabs of about ``slab_bytes``; each slab is read when its turn comes."""
    own = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        "text IS NOT NULL")
    n = max(1, -(-(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // slab_bytes))
    for i in range(n):
        rows = own.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).collect()
        texts = sorted({(r["id"], t) for r in rows if len(t := normal(r["text"])) >= LEAST},
                       key=lambda x: (x[0] is None, x[0], x[1]))
        yield _Sent(spark, texts)


def matches(spark: SparkSession, docs: DataFrame, items: DataFrame, rate: float = RATE,
            id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text: str = "text") -> DataFrame:
    """(document id, item id, distance): the best match of each item in each document."""
    kind, item_kind = (df.schema[c].dataType.simpleString()
                       for df, c in ((docs, id_col), (items, item_col)))
    item_type = to_arrow_type(items.schema[item_col].dataType)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def searched(sent: _Sent) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _items(sent, rate)
            for batch in slices(batches):
                out = {}
                for row, text in enumerate(texts_of(batch)):
                    for key, distance, end in found.search(normal(text)):
                        out[row, key] = min(out.get((row, key), (distance, end)), (distance, end))
                if out:
                    rows = pa.array([r for r, _ in out], pa.int64())
                    values = [pa.array([v[k] for v in out.values()], pa.int64())
                              for k in (0, 1)]
                    yield pa.record_batch(
                        [batch.column("id").take(rows), pa.array([k for _, k in out], item_type),
                         *values], ["id", "item", "distance", "match_end"])

        return own.mapInArrow(run, f"id {kind}, item {item_kind}, distance bigint, "
                                   "match_end bigint")

    parts = []
    for sent in slabs(spark, items, item_col, item_text):
        part = searched(sent)
        parts.append(part if not parts else written(spark, part, "matches"))
    return reduce(DataFrame.unionByName, parts).select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), "distance", "match_end")


def without_matches(spark: SparkSession, docs: DataFrame, items: DataFrame, rate: float = RATE,
                    text_col: str = "text", item_col: str = "item_id",
                    item_text: str = "text") -> DataFrame:
    """The documents in which no item appears; all columns stay."""
    for sent in slabs(spark, items, item_col, item_text):
        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            found = _items(sent, rate)
            for batch in slices(batches, text_col):
                clean = [not found.search(normal(t)) for t in texts_of(batch, text_col)]
                yield batch.filter(pc.cast(pa.array(clean), pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_benchmark_decontamination(spark, root: str) -> DataFrame:
    return matches(spark, table(spark, root, "documents"), table(spark, root, "benchmark"))
