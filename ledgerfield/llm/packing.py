"""Packing token streams into sequences by dynamic programming, order kept.

Each partition of the input is a lane: its documents are encoded in their order, each followed by
the end id, and the lane is cut into windows of at most ``width`` ids. A window may end where a
document ends (free), where a sentence ends (``SENTENCE`` lost) or, in stretches without either, at
a regular spacing (``FORCED`` lost). With cuts c, the best cost up to cut i is

    best(i) = min over j with c(i) - c(j) <= width of  best(j) + width - (c(i) - c(j)) + loss(i)

so the minimum of best(j) + c(j) over a sliding range is wanted: a monotone queue holds it, and a
lane takes time in proportion to its cuts. Lanes are planned in blocks; the open end of a block is
carried into the next one, so memory does not grow with the lane. What is left at a lane's end
becomes one padded sequence or sequences with a power of two of ids, whichever costs less.

No rows are shuffled. Defined results: a null text counts as empty and gives one piece with the end
id alone; documents longer than a sequence are cut; repeated rows are packed each by itself; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerfield.llm.batches import slices
from ledgerfield.llm.tables import table
from ledgerfield.llm.tokens import SLICE, pool, slice_codes, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
WIDTH = 4096
END_ID = 2
SENTENCE, FORCED = 8, 64  # what a cut inside a document costs, in ids of padding
SPACING = 256
BLOCK = 64  # windows planned at once

NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def best_cuts(cuts: list[int], loss: list[int], width: int) -> tuple[list[float], list[int]]:
    """Least cost of closing all windows up to each cut, and the cut before it on that way."""
    best, before = [0.0] * len(cuts), [0] * len(cuts)
    queue = deque([(cuts[0], cuts[0], 0)])  # (best + cut, cut, number), rising
    for i in range(1, len(cuts)):
        c = cuts[i]
        while c - queue[0][1] > width:
            queue.popleft()
        low, _, j = queue[0]
        best[i], before[i] = low + width - c + loss[i], j
        key = best[i] + c
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, c, i))
    return best, before


def windows(cuts: list[int], loss: list[int], width: int, last: bool) -> list[int]:
    """Ends of the chosen windows. Unless it is the last block, the end of the stream stays open."""
    total = cuts[-1]
    best, before = best_cuts(cuts, loss, width)
    i = len(cuts) - 1
    while cuts[i] > total - width and i > 0:
        i -= 1
    open_from = range(i + 1 if cuts[i] <= total - width else i, len(cuts))
    at = min(open_from, key=lambda k: (best[k], -cuts[k]))
    ends = []
    left = total - cuts[at]
    while at > 0:
        ends.append(cuts[at])
        at = before[at]
    ends.reverse()
    if last and left:
        if width - left <= FORCED * (left.bit_count() - 1):
            ends.append(total)
        else:
            at = total - left
            for bit in reversed(range(left.bit_length())):
                if left >> bit & 1:
                    at += 1 << bit
                    ends.append(at)
    return ends


class Lane:
    """The open end of one partition's stream."""

    def __init__(self, number: int, width: int, with_ids: bool):
        self.width, self.with_ids = width, with_ids
        self.next_id = number << 40
        self.ids = np.zeros(0, "<u4")
        self.cuts, self.loss = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        self.docs: list[tuple] = []  # (id, ids of the document, its first position here)

    def add(self, doc_ids: list, ids: np.ndarray, doc_ends: np.ndarray,
            sentence_ends: np.ndarray) -> None:
        base = len(self.ids)
        starts = np.concatenate([[0], doc_ends[:-1]])
        for key, s, e in zip(doc_ids, starts.tolist(), doc_ends.tolist()):
            self.docs.append((key, e - s, base + s))
        cut = np.union1d(doc_ends, sentence_ends)
        cut = cut[cut > 0]
        gaps = np.diff(np.concatenate([[0], cut]))
        n = (gaps - 1) // SPACING
        first = np.repeat(cut - gaps, n)
        step = np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n) + 1
        forced = first + step * SPACING
        cuts = np.concatenate([cut, forced])
        loss = np.concatenate([np.where(np.isin(cut, doc_ends), 0, SENTENCE),
                               np.full(len(forced), FORCED)])
        order = np.argsort(cuts, kind="stable")
        self.cuts.append(base + cuts[order])
        self.loss.append(loss[order])
        self.ids = np.concatenate([self.ids, ids])

    def close(self, last: bool) -> list[tuple]:
        """Rows of the windows that are final; what is open becomes the new start."""
        if not len(self.ids):
            return []
        cuts, loss = np.concatenate(self.cuts), np.concatenate(self.loss)
        ends = windows(cuts.tolist(), loss.tolist(), self.width, last)
        rows, begin, d = [], 0, 0
        for end in ends:
            at = begin
            while at < end:
                key, n, first = self.docs[d]
                to = min(end, first + n)
                part = self.ids[at:to]
                rows.append((key, at - first, to - at, zlib.crc32(part),
                             n, self.next_id, at - begin,
                             *((part.astype(np.int32),) if self.with_ids else ())))
                at = to
                d += to == first + n
            self.next_id += 1
            begin = end
        self.ids = self.ids[begin:].copy()
        self.docs = [(key, n, first - begin) for key, n, first in self.docs[d:]]
        keep = cuts > begin
        self.cuts = [np.zeros(1, np.int64), cuts[keep] - begin]
        self.loss = [np.zeros(1, np.int64), loss[keep]]
        return rows


def pack(df: DataFrame, width: int = WIDTH, tokenizer: str = TOKENIZER, end_id: int = END_ID,
         id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: document, start and length, digest of its ids, sequence and offset there.

    ``with_ids`` adds the ids themselves.
    """
    id_type = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pool(tokenizer_path(tokenizer))
        lane = Lane(TaskContext.get().partitionId(), width, with_ids)
        kind = None
        for batch in slices(batches, size=SLICE):
            kind = batch.schema.field("id").type
            codes, sizes = slice_codes(encoder, batch.column("text"))
            n, at = encoder.lengths[codes], np.cumsum(sizes)
            upto = np.concatenate([[0], np.cumsum(n)])
            doc_ends = upto[at] + np.arange(1, len(sizes) + 1)
            ids = np.full(upto[-1] + len(sizes), end_id, "<u4")
            inside = np.ones(len(ids), bool)
            inside[doc_ends - 1] = False
            ids[inside] = encoder.gather(codes)
            # A sentence ends after its last piece; earlier documents have added one end id each.
            is_end = encoder.ends_sentence[codes] & (n > 0)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            lane.add(batch.column("id").to_pylist(), ids, doc_ends, (upto[1:] + doc)[is_end])
            if len(lane.ids) >= BLOCK * width:
                yield frame(lane.close(False), kind)
        if kind is not None:
            yield frame(lane.close(True), kind)

    def frame(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * (len(NAMES) + with_ids)
        arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7])]
        if with_ids:
            arrays.append(pa.array(columns[7], pa.list_(pa.int32())))
        return pa.record_batch(arrays, NAMES + ["ids"] * with_ids)

    schema = f"id {id_type.simpleString()}, " + ", ".join(f"{n} bigint" for n in NAMES[1:])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, schema + ", ids array<int>" * with_ids).withColumnRenamed("id", id_col)


def op7_packing(spark, root: str) -> DataFrame:
    return pack(table(spark, root, "documents"))
