"""Spans of whole texts: finding texts again by row, and cutting spans out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerfield.llm.batches import slices


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text). ``row`` numbers the rows as they are read, null and repeated ids included.

    The frame has to give the same rows in the same order each time, as a stored table does.
    """
    return df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                     F.col(text_col).alias("text"))


def beside_text(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """The documents with ``marks``, an array of what the frame says about their row."""
    fields = [c for c in marks.columns if c != "row"]
    listed = marks.groupBy("row").agg(F.collect_list(F.struct(*fields)).alias("marks"))
    return docs.join(listed, "row", how)


def map_slices(df: DataFrame, schema: str,
               fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch]) -> DataFrame:
    """``fn`` over slices of bounded text size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = fn(batch)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def lists_of(batch: pa.RecordBatch, name: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The fields of a column of struct arrays, flat, and how many each row has."""
    column = batch.column(name)
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    return {f.name: flat.field(i).to_numpy(zero_copy_only=False)
            for i, f in enumerate(flat.type)}, counts


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``n`` places the half-open spans cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:n]) > 0
