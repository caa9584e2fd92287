"""Substring dedup with fixed-block anchors.

Every document is cut into non-overlapping blocks of ``BLOCK`` words; these are the index. A window
of ``WINDOW`` words (13) always holds a whole block (7) of the document it stands in, so wherever
its words stand again, one of the rolling runs of 7 words there equals that block. Both the blocks
and all rolling runs are dealt to buckets by hash, 6 bytes each, and a run is a hit if a block
equals it and another document has it too. Hits are extended: the windows around them are dealt to
buckets with 96 bits of hash, and a window goes if its words also start in a document with a smaller
id. Removed windows that touch form the maximal repeats.

What a slice of documents can tell by itself never leaves it as separate rows: of words that many
documents of a slice share, one entry is sent. So a passage in a third of all documents does not
gather in one task.

Windows are judged on the input, not on what is left. Defined results: a null text has no words;
documents with fewer words than a window lose none; a null id counts as larger than any other and
equal to none but null; rows with equal ids do not remove each other's words; ids are whole numbers of
any width (others are refused); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ledgerfield.llm.anchors import BASE_1, BASE_2, TABLE_1, TABLE_2, word_hash
from ledgerfield.llm.batches import slices
from ledgerfield.llm.spans import covered, keyed
from ledgerfield.llm.tables import table, written
from ledgerfield.llm.words import U, inverse, mixed, powers, word_bounds

WINDOW, BLOCK = 13, 7
SEQUENCE = 0x9FB21C651E98DF25
BUCKET_BYTES = 8 << 20
LAST_ID = (1 << 63) - 1

PROBE = np.dtype([("hash", "<u4"), ("step", "<u2")])
ALIGNED, KNOWN = 1, 2  # flags in the two low bits of a step
WINDOW_ENTRY = np.dtype([("w1", "<u8"), ("w2", "<u4"), ("at", "<u4"), ("id", "<i8")])
ENTRIES, MARKED, HEADER = 0, 1, 2  # kinds of payloads


class Words:
    """The words of a slice of texts: which text each is in, and hashes of runs of words."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.starts, self.ends = word_bounds(self.data)
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        self.doc = np.searchsorted(text_ends, self.starts, "right")
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.first = np.cumsum(self.counts) - self.counts

    def runs(self, size: int, table_: np.ndarray, base: int,
             least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of runs of ``size`` words inside texts of ``least`` words at least."""
        n = len(self.doc) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        word = word_hash(self.data, table_, base, self.starts, self.ends)
        prefix = np.zeros(len(word) + 1, np.uint64)
        np.cumsum(word * powers(SEQUENCE, len(word)), out=prefix[1:])
        run = mixed((prefix[size:] - prefix[:-size]) * powers(inverse(SEQUENCE), n))
        at = np.flatnonzero((self.doc[:n] == self.doc[size - 1:]) &
                            (self.counts[self.doc[:n]] >= least))
        return at, run[at]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if t is None else t for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by the columns (first the first), and the group of each sorted row."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new) - 1


def _payloads(number: int, to: np.ndarray, out: np.ndarray, kind: int) -> list[tuple]:
    order = np.argsort(to, kind="stable")
    out, to = out[order], to[order]
    cut = np.flatnonzero(np.diff(to)) + 1
    first = to[np.concatenate([[0], cut])] if len(to) else []
    return [(int(b), number, kind, p.tobytes()) for b, p in zip(first, np.split(out, cut))]


def _numbered(df: DataFrame, fn, extra: str) -> DataFrame:
    """(bucket, slice, kind, payload) of all slices, in the order of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches):
            rows = fn(number, batch)
            number += 1
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(
                    zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
                    ["bucket", "slice", "kind", "payload"])

    return df.select("row", "id", "text", *filter(None, [extra])).mapInArrow(
        run, "bucket int, slice bigint, kind int, payload binary")


def _header(number: int, batch: pa.RecordBatch, words: Words, buckets: int) -> tuple:
    """Sent once per slice: rows and their first words, to find a row by the number of a word."""
    keep = words.counts >= WINDOW
    rows = batch.column("row").to_numpy()[keep]
    return (number % buckets, number, HEADER,
            np.concatenate([rows, words.first[keep]]).astype("<i8").tobytes())


def probes(docs: DataFrame, buckets: int) -> DataFrame:
    """All rolling runs of ``BLOCK`` words, the blocks of the index marked among them."""
    def run(number: int, batch: pa.RecordBatch) -> list[tuple]:
        words = Words(_texts(batch))
        at, h = words.runs(BLOCK, TABLE_1, BASE_1, WINDOW)
        if not len(at):
            return []
        doc = words.doc[at]
        aligned = (at - words.first[doc]) % BLOCK == 0
        # Hashes that two texts here share, one at a block: hits. One entry stands for all.
        order, group = _groups(h, doc)
        h_group = np.cumsum(np.concatenate([[0], np.diff(h[order]) != 0]))
        texts_of = np.bincount(h_group[np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])])
        known = (texts_of > 1) & (np.bincount(h_group, weights=aligned[order]) > 0)
        first = np.concatenate([[True], np.diff(h_group) != 0])
        sent = np.sort(order[~known[h_group] | first])
        is_known = np.zeros(len(at), bool)
        is_known[order] = known[h_group]
        flags = aligned[sent] * ALIGNED + is_known[sent] * KNOWN
        rows = [_header(number, batch, words, buckets)]
        if is_known.any():
            rows.append((number % buckets, number, MARKED,
                         at[is_known].astype("<u4").tobytes()))
        to, place = (h[sent] % U(buckets)).astype(np.int64), at[sent]
        by = np.argsort(to, kind="stable")
        to, place, flags, value = to[by], place[by], flags[by], (h[sent][by] >> U(32))
        step = np.diff(place, prepend=0)
        step[np.concatenate([[True], np.diff(to) != 0])] = 0
        # A payload begins with the place of its first entry and ends before too long a step.
        cut = np.flatnonzero((np.diff(to, prepend=-1) != 0) | (step >= 1 << 14))
        step[cut] = 0
        out = np.empty(len(to), PROBE)
        out["hash"], out["step"] = value, step * 4 + flags
        for b, p, part in zip(to[cut].tolist(), place[cut].astype("<i8"),
                              np.split(out, cut[1:])):
            rows.append((b, number, ENTRIES, p.tobytes() + part.tobytes()))
        return rows

    return _numbered(docs, run, "")


def hits(entries: DataFrame) -> DataFrame:
    """(slice, kind, payload): places of runs that a block equals and another document has."""
    def run(group: pa.Table) -> pa.Table:
        kind, number = group.column("kind").to_numpy(), group.column("slice").to_numpy()
        payload = group.column("payload").to_pylist()
        own = np.flatnonzero(kind == ENTRIES)
        parts = [np.frombuffer(payload[i], PROBE, offset=8) for i in own]
        out = [(number[i], int(kind[i]), payload[i]) for i in np.flatnonzero(kind != ENTRIES)]
        if parts:
            size = np.array([len(p) for p in parts])
            e, of = np.concatenate(parts), np.repeat(np.arange(len(own)), size)
            base = np.array([int.from_bytes(payload[i][:8], "little") for i in own])
            walked = np.cumsum(e["step"] >> 2)
            began = np.cumsum(size) - size
            place = walked - np.repeat(walked[began] - base, size)
            order, h = _groups(e["hash"])
            flags = e["step"][order] & 3
            index = np.bincount(h, weights=flags & ALIGNED) > 0
            where = number[own][of[order]]
            many = np.maximum.reduceat(where, np.flatnonzero(np.diff(h, prepend=-1))) \
                > np.minimum.reduceat(where, np.flatnonzero(np.diff(h, prepend=-1)))
            known = np.bincount(h, weights=flags & KNOWN) > 0
            take = np.sort(order[(known | (index & many))[h] & (flags & KNOWN == 0)])
            to = number[own][of[take]]
            by = np.argsort(to, kind="stable")
            to, found = to[by], place[take][by].astype("<u4")
            cut = np.flatnonzero(np.diff(to)) + 1
            out += [(int(n), MARKED, p.tobytes()) for n, p in zip(
                to[np.concatenate([[0], cut])] if len(to) else [], np.split(found, cut))]
        return _marks(out)

    return entries.groupBy("bucket").applyInArrow(run, "slice bigint, kind int, payload binary")


def _marks(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[], [], []]
    return pa.table({"slice": pa.array(columns[0], pa.int64()),
                     "kind": pa.array(columns[1], pa.int32()),
                     "payload": pa.array(columns[2], pa.binary())})


def by_row(marks: DataFrame) -> DataFrame:
    """(row, places): the marked words of each row, counted from its first word."""
    def run(group: pa.Table) -> pa.Table:
        kind, payload = group.column("kind").to_numpy(), group.column("payload").to_pylist()
        header = [np.frombuffer(p, "<i8") for k, p in zip(kind, payload) if k == HEADER]
        at = [np.frombuffer(p, "<u4") for k, p in zip(kind, payload) if k == MARKED]
        if not header or not at:
            return pa.table({"row": pa.array([], pa.int64()),
                             "places": pa.array([], pa.list_(pa.int32()))})
        rows, first = np.split(header[0], 2)
        place = np.unique(np.concatenate(at)).astype(np.int64)
        own = np.searchsorted(first, place, "right") - 1
        cut = np.flatnonzero(np.diff(own)) + 1
        offsets = np.concatenate([[0], cut, [len(place)]]).astype(np.int32)
        return pa.table({
            "row": rows[own[np.concatenate([[0], cut])]],
            "places": pa.ListArray.from_arrays(pa.array(offsets), pa.array(
                (place - first[own]).astype(np.int32)))})

    return marks.groupBy("slice").applyInArrow(run, "row bigint, places array<int>")


def _places(batch: pa.RecordBatch, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The marked words of a slice, counted in the slice, and the row of each."""
    column = batch.column("places")
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + words.first[row], row


def windows(docs: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """The windows that hold a hit, in buckets by hash."""
    def run(number: int, batch: pa.RecordBatch) -> list[tuple]:
        words = Words(_texts(batch))
        hit, row = _places(batch, words)
        at, w1 = words.runs(WINDOW, TABLE_1, BASE_1, WINDOW)
        # A window belongs to a hit at one of its first words that begin a whole block.
        near = covered(len(words.doc), np.maximum(hit - (WINDOW - BLOCK), words.first[row]),
                       hit + 1)[at]
        if not near.any():
            return []
        w2 = words.runs(WINDOW, TABLE_2, BASE_2, WINDOW)[1][near]
        at, w1 = at[near], w1[near]
        ids = batch.column("id").cast(pa.int64()).fill_null(LAST_ID).to_numpy()[words.doc[at]]
        order, group = _groups(w1, w2, ids)
        w_group = np.cumsum(np.concatenate(
            [[0], (np.diff(w1[order]) != 0) | (np.diff(w2[order]) != 0)]))
        least = ids[order][np.flatnonzero(np.diff(w_group, prepend=-1))][w_group]
        larger = ids[order] > least  # a smaller id in this very slice
        rows = [_header(number, batch, words, buckets)]
        if larger.any():
            rows.append((number % buckets, number, MARKED,
                         np.sort(at[order[larger]]).astype("<u4").tobytes()))
        sent = order[~larger]
        out = np.empty(len(sent), WINDOW_ENTRY)
        out["w1"], out["w2"], out["at"], out["id"] = (
            w1[sent], w2[sent] >> U(32), at[sent], ids[sent])
        return rows + _payloads(number, (w1[sent] % U(buckets)).astype(np.int64), out, ENTRIES)

    marked = docs.join(found, "row").sortWithinPartitions("row")
    return _numbered(marked, run, "places")


def later(entries: DataFrame) -> DataFrame:
    """(slice, kind, payload): windows whose words also start in a document with a smaller id."""
    def run(group: pa.Table) -> pa.Table:
        kind, number = group.column("kind").to_numpy(), group.column("slice").to_numpy()
        payload = group.column("payload").to_pylist()
        out = [(number[i], int(kind[i]), payload[i]) for i in np.flatnonzero(kind != ENTRIES)]
        own = np.flatnonzero(kind == ENTRIES)
        if len(own):
            parts = [np.frombuffer(payload[i], WINDOW_ENTRY) for i in own]
            e, of = np.concatenate(parts), np.repeat(number[own], [len(p) for p in parts])
            order, _ = _groups(e["w1"], e["w2"], e["id"])
            e, of = e[order], of[order]
            new = np.concatenate([[True], (np.diff(e["w1"]) != 0) | (np.diff(e["w2"]) != 0)])
            least = e["id"][np.flatnonzero(new)][np.cumsum(new) - 1]
            gone = e["id"] > least
            out += [(n, MARKED, p) for n, _, _, p in _payloads(
                0, of[gone], e["at"][gone].astype("<u4"), MARKED)]
        return _marks(out)

    return entries.groupBy("bucket").applyInArrow(run, "slice bigint, kind int, payload binary")


def removed_windows(spark: SparkSession, docs: DataFrame,
                    bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(row, places): first words of the windows of ``docs`` (row, id, text) that go."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // bucket_bytes)
    found = written(spark, by_row(hits(probes(docs, buckets))), "hits")
    return written(spark, by_row(later(windows(docs, found, buckets))), "windows")


def substring_digests(spark: SparkSession, df: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Per row: words, removed words, digest of the words that stay."""
    if not isinstance(df.schema[id_col].dataType, (ByteType, ShortType, IntegerType, LongType)):
        raise ValueError(f"{id_col} has to be a whole number: windows are judged by the order of ids")
    docs = keyed(df, id_col, text_col)
    marked = docs.join(removed_windows(spark, docs), "row", "left").select("id", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, places = _texts(batch), batch.column("places")
            out = []
            for i, text in enumerate(texts):
                words = text.split()
                gone = 0
                if places[i].is_valid:
                    at = places[i].values.to_numpy().astype(np.int64)
                    drop = covered(len(words), at, at + WINDOW)
                    gone = int(drop.sum())
                    kept = [w for w, d in zip(words, drop.tolist()) if not d]
                else:
                    kept = words
                out.append((len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*out))
            yield pa.record_batch([batch.column("id"), pa.array(columns[0], pa.int64()),
                                   pa.array(columns[1], pa.int64()),
                                   pa.array(columns[2], pa.string())],
                                  ["id", "n_words", "n_removed", "kept_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return marked.mapInArrow(
        run, f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string"
    ).withColumnRenamed("id", id_col)


def op5_substring_dedup(spark, root: str) -> DataFrame:
    return substring_digests(spark, table(spark, root, "documents"))
