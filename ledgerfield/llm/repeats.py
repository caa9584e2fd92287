"""Suffix-array dedup: removing long byte strings that occur more than once.

A string of ``WINDOW`` bytes that starts at two places has the same anchor at both (``anchors``), so
texts are first described by runs of windows with one anchor: 25 bytes for each, dealt to buckets by
key. In a bucket, runs with a key of their own are done. Runs whose whole context occurs more than
once are repeated as a whole. Where one key has several contexts, one copy of each is cut from the
texts, and the suffixes of these contexts are ordered by Lyndon groups (``suffix``): neighbours in
the order that agree in ``WINDOW`` bytes are repeats. A key with so many contexts that they may not
fit into one task (a passage in very many surroundings) is counted by window instead, combined
before the shuffle.

Strings are judged on the input: each byte covered by a repeated string goes, in all places.

Defined results: a null text counts as empty and stays null in ``remove_repeats``; ids may be null
or repeated, each row is a document of its own; texts shorter than a window are kept; empty tables
give no rows; other columns are kept and do not clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerfield.llm.anchors import BASE_1, BASE_2, BLOCK, TABLE_1, TABLE_2, WINDOW, anchors, \
    prefix_hash, span_hash
from ledgerfield.llm.spans import beside_text, covered, keyed, lists_of, map_slices
from ledgerfield.llm.suffix import repeated_starts
from ledgerfield.llm.tables import table, written
from ledgerfield.llm.words import U

BUCKET_BYTES = 8 << 20  # bytes of text behind a bucket of run descriptions
ORDER_BYTES = 400_000  # bytes of contexts ordered at once
HOT_CONTEXTS = 4_000  # contexts of a key beyond which windows are counted

ENTRY = np.dtype([("key", "<u8"), ("context", "<u8"), ("row", "<i8"), ("lo", "<u4"),
                  ("more", "u1")])
WHOLE, TEST, REFERENCE, HOT = 0, 1, 2, 3


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [b"" if t is None else t for t in batch.column("text").cast(pa.binary()).to_pylist()]


def described(docs: DataFrame, buckets: int, window: int, block: int = BLOCK) -> DataFrame:
    """(bucket, payload): packed descriptions of runs of windows."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = _texts(batch)
        rows = batch.column("row").to_numpy()
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        whole = np.frombuffer(b"".join(texts), np.uint8)
        # Slices are smaller than a block unless they are one long text: blocks overlap.
        for at in range(0, max(1, len(whole) - window + 1), block):
            data = whole[at:at + block + window - 1]
            starts = np.clip(ends - sizes - at, 0, len(data))
            key, context, lo, hi, _ = anchors(data, starts, np.clip(ends - at, 0, len(data)),
                                              window)
            doc = np.searchsorted(ends, lo + at, "right")
            out = np.empty(len(key), ENTRY)
            out["key"], out["context"], out["row"] = key, context, rows[doc]
            out["lo"], out["more"] = lo + at - (ends - sizes)[doc], hi - lo
            to = (key % U(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            out, to = out[order], to[order]
            cut = np.flatnonzero(np.diff(to)) + 1
            if len(out):
                yield pa.record_batch([
                    pa.array(to[np.concatenate([[0], cut])].astype(np.int32)),
                    pa.array([p.tobytes() for p in np.split(out, cut)], pa.binary())],
                    ["bucket", "payload"])

    return map_slices(docs.select("row", "text"), "bucket int, payload binary", run)


def classified(entries: DataFrame, hot: int) -> DataFrame:
    """(row, lo, hi, kind, spread) of the runs that are repeated or may be."""
    def run(tables: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(tables.column("payload").to_pylist()), ENTRY)
        order = np.lexsort((e["lo"], e["row"], e["more"], e["context"], e["key"]))
        e = e[order]
        new_key = np.concatenate([[True], e["key"][1:] != e["key"][:-1]])
        new = new_key | np.concatenate([[True], (e["context"][1:] != e["context"][:-1])
                                        | (e["more"][1:] != e["more"][:-1])])
        key, context = np.cumsum(new_key) - 1, np.cumsum(new) - 1
        copies = np.bincount(context)[context]
        contexts = np.bincount(key[new])[key]
        crowded, several = contexts > hot, contexts > 1
        once = copies == 1
        alone = np.bincount(key, weights=once)[key] > 0  # some context of the key occurs once
        # One copy of each context stands for all of them.
        parts = [(WHOLE, ~once), (TEST, once & several & ~crowded),
                 (REFERENCE, ~once & new & several & alone & ~crowded),
                 (HOT, several & alone & crowded & (once | new))]
        kind = np.concatenate([np.full(m.sum(), k, np.int32) for k, m in parts])
        e = np.concatenate([e[m] for _, m in parts])
        lo = e["lo"].astype(np.int64)
        return pa.table({"row": e["row"], "lo": lo, "hi": lo + e["more"], "kind": kind,
                         "spread": (e["key"] >> U(33)).astype(np.int32)})

    return entries.groupBy("bucket").applyInArrow(
        run, "row bigint, lo bigint, hi bigint, kind int, spread int")


def contexts_of(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(row, lo, test, block, context) to be ordered, and (row, lo, w1, w2) of hot keys' windows."""
    schema = ("row bigint, lo bigint, test boolean, block bigint, context binary, w1 bigint, "
              "w2 bigint")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks, counts = lists_of(batch, "marks")
        texts, rows = _texts(batch), batch.column("row").to_numpy()
        doc = np.repeat(np.arange(len(texts)), counts)
        out: dict[str, list] = {c: [] for c in ("row", "lo", "test", "block", "context", "w1", "w2")}
        plain = np.flatnonzero(marks["kind"] != HOT)
        for d, lo, hi, kind, block in zip(doc[plain].tolist(), *(
                marks[c][plain].tolist() for c in ("lo", "hi", "kind", "block"))):
            for name, value in (("row", rows[d]), ("lo", lo), ("test", kind == TEST),
                                ("block", block), ("context", texts[d][lo:hi + window]),
                                ("w1", None), ("w2", None)):
                out[name].append(value)
        for d in np.unique(doc[marks["kind"] == HOT]):
            mine = np.flatnonzero((doc == d) & (marks["kind"] == HOT))
            data = np.frombuffer(texts[d], np.uint8)
            at = np.unique(np.concatenate([np.arange(marks["lo"][i], marks["hi"][i] + 1)
                                           for i in mine]))
            hashes = [span_hash(prefix_hash(data, t, b), b, at, at + window).view(np.int64)
                      for t, b in ((TABLE_1, BASE_1), (TABLE_2, BASE_2))]
            n = len(at)
            for name, values in (("row", [rows[d]] * n), ("lo", at.tolist()), ("test", [True] * n),
                                 ("block", [None] * n), ("context", [None] * n),
                                 ("w1", hashes[0].tolist()), ("w2", hashes[1].tolist())):
                out[name].extend(values)
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(),
                 pa.int64()]
        return pa.record_batch([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    return map_slices(beside_text(docs, wanted, "inner").select("row", "text", "marks"), schema, run)


def ordered(contexts: DataFrame, window: int) -> DataFrame:
    """(row, lo, hi): runs of window starts that the suffix order shows to be repeated."""
    def run(group: pa.Table) -> pa.Table:
        found = repeated_starts(group.column("context").to_pylist(), window)
        rows, first = group.column("row").to_numpy(), group.column("lo").to_numpy()
        test = group.column("test").to_numpy()
        out = [np.zeros((0, 3), np.int64)]
        for i in np.flatnonzero(test):
            at = found[i]
            if len(at):
                cut = np.flatnonzero(np.diff(at) != 1)
                lo = at[np.concatenate([[0], cut + 1])] + first[i]
                hi = at[np.concatenate([cut, [len(at) - 1]])] + first[i]
                out.append(np.stack([np.full(len(lo), rows[i]), lo, hi], axis=1))
        done = np.concatenate(out)
        return pa.table({"row": done[:, 0], "lo": done[:, 1], "hi": done[:, 2]})

    return contexts.groupBy("block").applyInArrow(run, "row bigint, lo bigint, hi bigint")


def repeated_runs(spark: SparkSession, docs: DataFrame, window: int = WINDOW,
                  bucket_bytes: int = BUCKET_BYTES, order_bytes: int = ORDER_BYTES,
                  hot: int = HOT_CONTEXTS) -> DataFrame:
    """(row, lo, hi): window starts lo..hi of ``docs`` (row, text) that also start elsewhere."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // bucket_bytes)
    runs = written(spark, classified(described(docs, buckets, window), hot), "runs")
    wanted = runs.where(F.col("kind") != WHOLE)
    bytes_wanted = wanted.agg(F.sum(F.col("hi") - F.col("lo") + window)).first()[0] or 0
    blocks = max(1, bytes_wanted // order_bytes)
    contexts = written(spark, contexts_of(docs, wanted.select(
        "row", "lo", "hi", "kind", F.pmod("spread", F.lit(blocks)).cast("long").alias("block")),
        window), "contexts")
    hits = ordered(contexts.where("block IS NOT NULL"), window)
    windows = contexts.where("w1 IS NOT NULL").select("w1", "w2", "row", "lo")
    often = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1")
    crowded = windows.join(often, ["w1", "w2"], "left_semi").select(
        "row", "lo", F.col("lo").alias("hi"))
    return runs.where(F.col("kind") == WHOLE).select("row", "lo", "hi").unionByName(
        hits).unionByName(crowded)


def _kept(batch: pa.RecordBatch, window: int) -> Iterator[tuple[bytes, int, int]]:
    """(remaining bytes, removed bytes, removed runs) of each row."""
    marks, counts = lists_of(batch, "marks")
    at = 0
    for text, n in zip(_texts(batch), counts.tolist()):
        if not n:
            yield text, 0, 0
            continue
        gone = covered(len(text), marks["lo"][at:at + n], marks["hi"][at:at + n] + window)
        at += n
        runs = int(gone[0]) + int(np.count_nonzero(np.diff(gone.astype(np.int8)) == 1))
        yield np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def repeat_digests(spark: SparkSession, df: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: bytes, removed bytes, removed runs, digest of what remains."""
    docs = keyed(df, id_col, text_col)
    marked = beside_text(docs, repeated_runs(spark, docs, window), "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = list(_kept(batch, window))
        return pa.record_batch([
            batch.column("id"), pa.array([len(k) + n for k, n, _ in kept], pa.int64()),
            pa.array([n for _, n, _ in kept], pa.int64()),
            pa.array([s for _, _, s in kept], pa.int64()),
            pa.array([hashlib.sha256(k).hexdigest() for k, _, _ in kept], pa.string())],
            ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(marked, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, "
                      "kept_sha256 string", run).withColumnRenamed("id", id_col)


def remove_repeats(spark: SparkSession, df: DataFrame, text_col: str = "text",
                   window: int = WINDOW) -> DataFrame:
    """The rows with repeated strings cut out of the text.

    A character of which only some bytes go is dropped, so that the text stays valid.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"), *[
        F.col(c).alias(n) for c, n in zip(df.columns, names) if c != text_col])
    marked = beside_text(rows, repeated_runs(spark, docs, window), "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        was = batch.column("text").is_valid().to_pylist()
        text = pa.array([k.decode(errors="ignore") if v else None
                         for v, (k, _, _) in zip(was, _kept(batch, window))], pa.string())
        return pa.record_batch([text if c == text_col else batch.column(n)
                                for c, n in zip(df_columns, names)], df_columns)

    df_columns = df.columns
    return map_slices(marked, df.schema, run)


def op4_suffix_array_dedup(spark, root: str) -> DataFrame:
    return repeat_digests(spark, table(spark, root, "documents"))
