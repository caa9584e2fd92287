"""Exact top-k by inner product, pruned by multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments; each segment keeps its mean and standard deviation. For
segments of length L the squared distance of q and x is at least

    sum over segments of  L * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2)

and the inner product is (|q|^2 + |x|^2 - distance^2) / 2, so a lower bound of the distance gives an
upper bound of the score. Candidates are tested coarse to fine against the query's k-th best score
so far; exact integer scores are computed for the survivors alone.

Queries are sent to the executors in slabs of bounded size, one after another; candidates stay where
they are read, and each task gives back k rows per query. Defined results: vectors that are null or
hold null or non-finite components take no part, nor do rows with a null id; of several rows with
one id the smallest vector is the query, each is a candidate of other ids, and none is a candidate of
its own id; shorter vectors are filled with zeros; ties go to the smaller id; repeated candidate rows
count each by itself; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerfield.llm.tables import table, written

LEVELS = (1, 4, 16)
SLAB_BYTES = 10 << 20  # of queries, as doubles, held by a task at once
CHUNK = 1 << 17  # query-candidate pairs tested at once


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(
        F.col(id_col).alias("id"), F.transform(
            v, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long")).alias("v"))


def matrix(rows: list, width: int) -> np.ndarray:
    """Integer vectors as doubles, filled with zeros to a multiple of 16."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, each times the root of the segment's length."""
    parts = x.reshape(len(x), segments, x.shape[1] // segments)
    root = np.sqrt(parts.shape[2])
    return np.concatenate([parts.mean(2), parts.std(2)], axis=1) * root


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.vectors = vectors
        self.squares = (vectors ** 2).sum(1)
        self.levels = [statistics(vectors, s) for s in LEVELS]
        self.level_squares = [(s ** 2).sum(1) for s in self.levels]
        n = len(ids)
        self.score = np.full((n, k), -np.inf)
        self.found = np.zeros((n, k), np.int64)

    def offer(self, ids: np.ndarray, x: np.ndarray) -> None:
        step = max(1, CHUNK // max(1, len(ids)))
        squares = (x ** 2).sum(1)
        levels = [statistics(x, s) for s in LEVELS]
        level_squares = [(s ** 2).sum(1) for s in levels]
        for at in range(0, len(self.ids), step):
            to = min(at + step, len(self.ids))
            floor = self.score[at:to, -1]
            # Of this level all pairs are tested, at the finer ones the survivors.
            bound = self._bound(self.squares[at:to, None] + squares[None, :],
                                self.level_squares[0][at:to, None] + level_squares[0][None, :],
                                self.levels[0][at:to] @ levels[0].T)
            q, c = np.nonzero((bound >= floor[:, None])
                              & (self.ids[at:to, None] != ids[None, :]))
            for mine, own, theirs, other in zip(self.levels[1:], self.level_squares[1:],
                                                levels[1:], level_squares[1:]):
                dot = np.einsum("ij,ij->i", mine[at + q], theirs[c])
                keep = self._bound(self.squares[at + q] + squares[c],
                                   own[at + q] + other[c], dot) >= floor[q]
                q, c = q[keep], c[keep]
            exact = np.einsum("ij,ij->i", self.vectors[at + q], x[c])
            keep = exact >= floor[q]
            self._keep(at, to, q[keep], ids[c[keep]], exact[keep])

    @staticmethod
    def _bound(squares, level_squares, dot):
        """Upper bound of the score from the lower bound of the distance, with room for rounding."""
        lower = level_squares - 2 * dot
        return (squares - lower) / 2 + 1e-9 * np.abs(squares) + 1e-6

    def _keep(self, at: int, to: int, q, ids, scores) -> None:
        if not len(q):
            return
        old_q, old_k = np.nonzero(np.isfinite(self.score[at:to]))
        q = np.concatenate([old_q, q])
        scores = np.concatenate([self.score[at:to][old_q, old_k], scores])
        ids = np.concatenate([self.found[at:to][old_q, old_k], ids])
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.searchsorted(q, q, "left")
        rank = np.arange(len(q)) - first
        keep = rank < self.k
        q, rank = at + q[keep], rank[keep]
        self.score[q, rank], self.found[q, rank] = scores[keep], ids[keep]


def top_k(spark: SparkSession, df: DataFrame, is_query: Column, k: int = 5,
          id_col: str = "vec_id", vec_col: str = "embedding",
          slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """The k best rows of each query: query_id, rank, vec_id, score."""
    rows = usable(df, id_col, vec_col)
    queries = usable(df.where(is_query), id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    n, longest = queries.agg(F.count("*")).first()[0], rows.agg(
        F.max(F.size("v"))).first()[0]
    width = -(-max(1, longest or 1) // LEVELS[-1]) * LEVELS[-1]
    slabs = max(1, -(-n * width * 8 // slab_bytes))
    partial = []
    for i in range(slabs):
        mine = queries if slabs == 1 else queries.where(
            F.pmod(F.xxhash64("id"), F.lit(slabs)) == i)
        part = _slab(spark, rows, mine.toArrow(), k, width)
        partial.append(part if slabs == 1 else written(spark, part, "topk"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, partial).withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _slab(spark: SparkSession, rows: DataFrame, queries: pa.Table, k: int,
          width: int) -> DataFrame:
    sent = spark.sparkContext.broadcast((
        np.array(queries.column("id").to_pylist(), np.int64),
        matrix(queries.column("v").to_pylist(), width)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, size = Best(*sent.value, k), 128
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # small steps first: they raise the k-th best score
                part = batch.slice(at, size)
                best.offer(part.column("id").to_numpy(), matrix(part.column("v").to_pylist(), width))
                at, size = at + size, min(4096, 2 * size)
        q, rank = np.nonzero(np.isfinite(best.score))
        yield pa.record_batch([
            pa.array(best.ids[q]), pa.array(best.found[q, rank]),
            pa.array(best.score[q, rank].astype(np.int64))], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")


SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM scored) WHERE rank <= 5
"""


def op3_exact_topk(spark, root: str) -> DataFrame:
    return top_k(spark, table(spark, root, "embeddings"), F.col("vec_id") % 50 == 0)
