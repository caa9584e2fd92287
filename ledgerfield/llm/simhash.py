"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly when some variant lies within r bits of both. So
every distinct fingerprint emits all its variants within r bits, and fingerprints that meet at a
variant are linked. A variant's leading bits are the key of the shuffle: what is sent is the
fingerprint itself, once for each key that its variants can have, with the number of bits that may
still change; the variants behind the key are made where they meet. That moves 8 bytes per key, not
per variant, and a key's number of bits follows the number of fingerprints. A key with too many
fingerprints is dealt anew by eight further bits.

Where fingerprints meet, they are sorted by variant, neighbours are verified, and a spanning forest
of the links leaves the task, never all pairs. Components come from star contraction of the written
links.

Defined results: a text that is null or has no words has fingerprint 0 and is linked like any other;
fewer words than a shingle make one shingle; a null id takes part but never names a component with
other ids; repeated rows are repeated documents; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerfield.llm.batches import slices
from ledgerfield.llm.components import components
from ledgerfield.llm.tables import table, written

SHINGLE, SEED, RADIUS = 4, 42, 4
KEY_LOAD = 256  # fingerprints per key that the number of key bits aims at
HOT_LOAD = 200_000  # received fingerprints beyond which a key is dealt anew
EXPAND = 1 << 21  # variants made at once

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each run of ``size`` words, lower-cased and joined by spaces."""
    words = text.translate(LOWER).split()  # bytes split at ASCII white space alone
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:len(words) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], seed) for s, e in zip(starts, ends[size - 1:].tolist())]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp): a bit is set if it is set in over half of the shingle hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = [shingle_hashes((t or "").encode(), size, seed)
                      for t in batch.column("text").to_pylist()]
            n = np.array([len(h) for h in hashes], np.int64)
            out = np.zeros(len(n), np.uint64)
            if n.sum():
                flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(n.sum()))
                bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1,
                                     bitorder="little")
                full = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[full]
                ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
                major = (2 * ones > n[full, None]).astype(np.uint8)
                out[full] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)[:, 0]
            yield pa.record_batch([batch.column("id"), pa.array(out.view(np.int64))], ["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, fp bigint")


def masks(bits: int, flips: int) -> list[tuple[int, int]]:
    """(mask, number of its bits) of all masks of ``bits`` bits with at most ``flips`` set."""
    return [(sum(1 << b for b in c), n) for n in range(flips + 1)
            for c in combinations(range(bits), n)]


def dealt(fps: DataFrame, bits: int, radius: int) -> DataFrame:
    """Each fingerprint once for every value of the first ``bits`` bits of its variants."""
    options = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(n).alias("n"))
                        for m, n in masks(bits, radius)])
    return fps.select("fp", F.explode(options).alias("o")).select(
        "fp", (F.shiftrightunsigned("fp", 64 - bits).bitwiseXOR(F.col("o.mask"))).cast(
            "long").alias("key"), (F.lit(radius) - F.col("o.n")).alias("left"))


def deeper(rows: DataFrame, bits: int, more: int, radius: int) -> DataFrame:
    """The same for ``more`` further bits of keys that have ``bits`` bits."""
    options = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(n).alias("n"))
                        for m, n in masks(more, radius)])
    own = F.shiftrightunsigned("fp", 64 - bits - more).bitwiseAND(F.lit((1 << more) - 1))
    return rows.select("fp", "key", "left", F.explode(options).alias("o")).where(
        F.col("o.n") <= F.col("left")).select(
        "fp", F.shiftleft("key", more).bitwiseOR(own.bitwiseXOR(F.col("o.mask"))).alias("key"),
        (F.col("left") - F.col("o.n")).alias("left"))


_VARIANTS: dict[tuple[int, int], np.ndarray] = {}


def _variants(bits: int, flips: int) -> np.ndarray:
    if (bits, flips) not in _VARIANTS:
        _VARIANTS[bits, flips] = np.array([m for m, _ in masks(bits, flips)], np.uint64)
    return _VARIANTS[bits, flips]


def meet(fp: np.ndarray, left: np.ndarray, bits: int, limit: int,
         expand: int = EXPAND) -> np.ndarray:
    """Links (pairs of positions) of fingerprints that share a variant with the same first bits.

    ``bits`` may still change, at most ``left`` of them in each fingerprint. Too many variants for
    one sort are first told apart by their next four bits, as the shuffle does with its key.
    """
    total = sum(int((left == r).sum()) * len(_variants(bits, int(r))) for r in np.unique(left))
    if total > expand and bits > 4:
        rest, parts = bits - 4, []
        own = (fp >> np.uint64(rest)) & np.uint64(15)
        for value in range(16):
            flips = np.bitwise_count(own ^ np.uint64(value)).astype(np.int64)
            inside = np.flatnonzero(flips <= left)
            if len(inside) > 1:
                links = meet(fp[inside], (left - flips)[inside], rest, limit, expand)
                parts.append(inside[links])
        return np.unique(np.concatenate(parts), axis=0) if parts else np.zeros((0, 2), np.int64)
    values, owners = [], []
    for r in np.unique(left):
        who = np.flatnonzero(left == r)
        v = _variants(bits, int(r))
        values.append((fp[who, None] ^ v[None, :]).ravel())
        owners.append(np.repeat(who, len(v)))
    if not values:
        return np.zeros((0, 2), np.int64)
    value, owner = np.concatenate(values), np.concatenate(owners)
    if bits < 64:
        value &= np.uint64((1 << bits) - 1)
    order = np.argsort(value)
    value, owner = value[order], owner[order]
    same = np.flatnonzero(value[1:] == value[:-1])
    a, b = owner[same], owner[same + 1]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pairs[np.bitwise_count(fp[pairs[:, 0]] ^ fp[pairs[:, 1]]) <= limit]


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest position each of ``n`` positions is linked to."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        before = root.copy()
        for side in (0, 1):
            np.minimum.at(root, root[pairs[:, side]], low)
            np.minimum.at(root, pairs[:, side], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def links(spark: SparkSession, fps: DataFrame, radius: int = RADIUS,
          hot_load: int = HOT_LOAD) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within ``radius`` bits."""
    n = fps.count()
    bits = min(32, max(8, (max(1, n // KEY_LOAD) - 1).bit_length()))
    rows, out = dealt(fps, bits, radius // 2), None
    while True:
        last = bits + 8 > 60
        crowded = None if last else written(spark, rows.groupBy("key").count().where(
            F.col("count") > hot_load).select("key"), "crowded")
        again = crowded is not None and not crowded.isEmpty()
        part = _linked(rows.join(crowded, "key", "left_anti") if again else rows, bits, radius)
        out = part if out is None else out.unionByName(part)
        if not again:
            return out.distinct()
        rows = deeper(rows.join(crowded, "key", "left_semi"), bits, 8, radius // 2)
        bits += 8


def _linked(rows: DataFrame, bits: int, radius: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy().view(np.uint64)
        if len(fp) < 2:
            return pd.DataFrame({"a": fp[:0].view(np.int64), "b": fp[:0].view(np.int64)})
        fp, first = np.unique(fp, return_index=True)
        root = forest(len(fp), meet(fp, pdf["left"].to_numpy().astype(np.int64)[first],
                                    64 - bits, radius))
        who = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[who].view(np.int64), "b": fp[root[who]].view(np.int64)})

    return rows.groupBy("key").applyInPandas(run, "a bigint, b bigint")


def near_groups(spark: SparkSession, df: DataFrame, radius: int = RADIUS,
                id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
                seed: int = SEED) -> DataFrame:
    """Per row: id, fingerprint (hex) and component_id, the smallest id it is linked to."""
    docs = written(spark, fingerprints(df, id_col, text_col, size, seed), "fingerprints")
    named = rooted(spark, docs.groupBy("fp").agg(F.min("id").alias("first")), radius)
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(smallest, "root").select("fp", "component_id")
    return docs.join(by_fp, "fp").select(
        F.col("id").alias(id_col), hex16(F.col("fp")).alias("fingerprint"), "component_id")


def rooted(spark: SparkSession, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows of distinct fingerprints ``fp`` with ``root``, the fingerprint that names the component."""
    roots = components(spark, links(spark, fps.select("fp"), radius))
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))


def keep_one(spark: SparkSession, df: DataFrame, radius: int = RADIUS, id_col: str = "doc_id",
             text_col: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The rows without those whose component holds a row with a smaller id; all columns stay.

    Of equal ids the row read first stays; a null id is larger than any other. The frame has to give
    the same rows in the same order on each scan, as a stored table does.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.select(F.monotonically_increasing_id().alias("row"),
                     *[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)])
    of = dict(zip(df.columns, names))
    place = F.struct(F.col(of[id_col]).isNull().alias("none"), F.col(of[id_col]).alias("id"), "row")
    prints = written(spark, fingerprints(rows.withColumn("place", place), "place", of[text_col], size,
                                         seed), "fingerprints")
    named = rooted(spark, prints.groupBy("fp").agg(F.min("id").alias("first")), radius)
    stays = named.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.row").alias("row"))
    return rows.join(stays, "row", "left_semi").select(
        *[F.col(n).alias(c) for c, n in zip(df.columns, names)])


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op8_simhash(spark, root: str) -> DataFrame:
    return near_groups(spark, table(spark, root, "documents"))
