"""Approximate nearest neighbours by cosine: a robust-pruned directed graph in every shard.

Distinct vectors are dealt to shards of bounded size by hash. A shard's graph starts at the vector
nearest to its mean; vectors are added in batches that double. For each a greedy search goes through the
graph so far; what it has visited is pruned: the nearest candidate becomes a neighbour and takes out all
candidates that it is closer to than the new vector is, by a factor (``ALPHA``), so that edges stay
diverse. Edges are laid both ways, and a vector with too many is pruned again. A search keeps a beam of
the nearest vectors seen, opens the nearest unopened one until none is left, and scores the beam in double
precision on the original vectors. Every shard is searched for every query; batches of queries go through
a graph together.

Equal vectors are one node that holds the smallest ids, as many as a result can need: that loses no
result and keeps a hot vector small. Queries are sent in slabs of ``SLAB_BYTES``.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, nor do
rows with a null id; of several rows with one id the smallest vector is the query, each is a candidate of
other ids, none of its own; shorter vectors are filled with zeros; ties go to the smaller id; a repeated
row (id and vector) counts once; an empty table gives no rows; other columns are ignored. With no more
vectors in a shard than the beam holds, and the graph connected, the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerfield.llm.tables import table, written

SHARD_BYTES = 4 << 20  # of vectors (double precision)
SLAB_BYTES = 8 << 20  # of queries sent at once
DEGREE, ALPHA = 48, 1.2
BUILD_BEAM, BEAM = 64, 128
BATCH = 512  # vectors added, and queries searched, together
CHUNK = 256  # queries whose results from all shards are merged in one task
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

FOUND = np.dtype([("query", "<i8"), ("id", "<i8"), ("score", "<f8")])


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): finite vectors that are not zero, as doubles."""
    v = F.transform(vec_col, lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in single precision; what is too small or large for squares is scaled first."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision, the same for the same two vectors wherever they stand."""
    return (a * b).sum(-1) / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


class Graph:
    """A directed graph over vectors of length 1; ``edges`` has -1 where a node has fewer neighbours."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, entry: int):
        self.x, self.edges, self.entry = x, edges, entry

    @classmethod
    def build(cls, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM,
              alpha: float = ALPHA, batch: int = BATCH) -> Graph:
        entry = int((x @ x.mean(axis=0)).argmax())
        graph = cls(x, np.full((len(x), degree), -1, np.int32), entry)
        order = np.random.default_rng(len(x)).permutation(len(x))
        order = order[order != entry]
        at = 0
        while at < len(order):
            new = order[at:at + min(batch, at + 1)]
            _, _, trail = graph.search(x[new], beam)
            graph.edges[new] = graph.pruned(new, trail, alpha)
            graph._back(new, alpha)
            at += len(new)
        graph.connect(beam)
        return graph

    def reached(self) -> np.ndarray:
        """Which nodes a path from the entry leads to."""
        seen = np.zeros(len(self.x), bool)
        front = np.array([self.entry])
        while len(front):
            seen[front] = True
            front = np.unique(self.edges[front])
            front = front[front >= 0]
            front = front[~seen[front]]
        return seen

    def connect(self, beam: int) -> None:
        """Edges to nodes that pruning has cut off, from the nearest nodes that a search finds.

        They may come on top of the degree; each pass reaches further nodes, so it ends.
        """
        while True:
            lost = np.flatnonzero(~self.reached())
            if not len(lost):
                return
            near = np.full(len(lost), self.entry)
            for at in range(0, len(lost), BATCH):
                ids, product, _ = self.search(self.x[lost[at:at + BATCH]], beam)
                near[at:at + BATCH] = ids[np.arange(len(ids)), product.argmax(axis=1)]
            order = np.argsort(near, kind="stable")
            near, lost = near[order], lost[order]
            place = np.arange(len(near)) - np.searchsorted(near, near)
            near, lost, place = (c[place < BATCH] for c in (near, lost, place))
            free = (self.edges[near] >= 0).sum(axis=1) + place  # edges are packed to the left
            more = int(free.max()) + 1 - self.edges.shape[1]
            if more > 0:
                self.edges = np.pad(self.edges, ((0, 0), (0, more)), constant_values=-1)
            self.edges[near, free] = lost

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes and products of each query's beam, and all nodes it has opened; -1 fills up."""
        m, x = len(q), self.x
        ids = np.full((m, beam), -1, np.int32)
        near = np.full((m, beam), -np.inf, np.float32)
        shut = np.ones((m, beam), bool)
        ids[:, 0], near[:, 0], shut[:, 0] = self.entry, q @ x[self.entry], False
        rows, trail = np.arange(m), []
        while True:
            best = np.where(shut[rows], -np.inf, near[rows]).argmax(axis=1)
            going = ~shut[rows, best]
            rows, best = rows[going], best[going]
            if not len(rows):
                break
            shut[rows, best] = True
            node = ids[rows, best]
            step = np.full(m, -1, np.int32)
            step[rows] = node
            trail.append(step)
            reached = self.edges[node]
            seen = (reached < 0) | (reached[:, :, None] == ids[rows][:, None, :]).any(axis=2)
            product = np.matmul(x[reached], q[rows][:, :, None])[:, :, 0]
            # What a full beam has dropped is no nearer than its last and must not come back.
            product[seen | (product <= near[rows].min(axis=1, keepdims=True))] = -np.inf
            near_all = np.concatenate([near[rows], product], axis=1)
            top = np.argpartition(near_all, -beam, axis=1)[:, -beam:]
            near[rows] = np.take_along_axis(near_all, top, axis=1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], reached], axis=1), top, axis=1)
            done = np.concatenate([shut[rows], ~np.isfinite(product)], axis=1)
            shut[rows] = np.take_along_axis(done, top, axis=1)
        ids[~np.isfinite(near)] = -1
        return ids, near, np.stack(trail, axis=1)

    def pruned(self, nodes: np.ndarray, offered: np.ndarray, alpha: float) -> np.ndarray:
        """Of the offered neighbours (-1: none) of each node the diverse ones, nearest first."""
        x, degree = self.x, self.edges.shape[1]
        out = np.full((len(nodes), degree), -1, np.int32)
        for at in range(0, len(nodes), BATCH):
            mine, cand = nodes[at:at + BATCH], offered[at:at + BATCH]
            product = np.matmul(x[cand], x[mine][:, :, None])[:, :, 0]
            product[cand < 0] = -np.inf
            order = np.argsort(-product, axis=1)
            cand, product = np.take_along_axis(cand, order, 1), np.take_along_axis(product, order, 1)
            y = x[cand]
            between = 2 - 2 * np.matmul(y, y.transpose(0, 2, 1))
            own = 2 - 2 * product
            alive = np.isfinite(product)
            who = np.arange(len(mine))
            for k in range(degree):
                pick = alive.argmax(axis=1)
                some = alive[who, pick]
                if not some.any():
                    break
                out[at + who[some], k] = cand[who, pick][some]
                alive &= alpha * alpha * between[who, pick] > own
                alive[who, pick] = False
        return out

    def _back(self, new: np.ndarray, alpha: float) -> None:
        """Edges from the new nodes' neighbours to them; of too many the nearest are looked at."""
        degree = self.edges.shape[1]
        from_node = np.repeat(new, degree)
        to = self.edges[new].ravel()
        from_node, to = from_node[to >= 0], to[to >= 0]
        near = np.einsum("ij,ij->i", self.x[from_node], self.x[to])
        order = np.lexsort((-near, to))
        from_node, to = from_node[order], to[order]
        nodes, first = np.unique(to, return_index=True)
        place = np.arange(len(to)) - np.repeat(first, np.diff(first, append=len(to)))
        from_node, to, place = (c[place < degree] for c in (from_node, to, place))
        offered = np.full((len(nodes), 2 * degree), -1, np.int32)
        offered[:, :degree] = self.edges[nodes]
        offered[np.searchsorted(nodes, to), degree + place] = from_node
        count = (offered >= 0).sum(axis=1)
        few = count <= degree
        packed = np.take_along_axis(offered, np.argsort(offered < 0, axis=1, kind="stable"), 1)
        self.edges[nodes[few]] = packed[few, :degree]
        self.edges[nodes[~few]] = self.pruned(nodes[~few], offered[~few], alpha)


def distinct_vectors(df: DataFrame, copies: int) -> DataFrame:
    """(v, ids): each vector with the ``copies`` smallest ids that have it."""
    order = Window.partitionBy("v").orderBy("id")
    return df.distinct().withColumn("place", F.row_number().over(order)).where(
        F.col("place") <= copies).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def build_index(spark: SparkSession, df: DataFrame, id_col: str = "vec_id",
                vec_col: str = "embedding", k: int = 5, shard_bytes: int = SHARD_BYTES,
                degree: int = DEGREE, alpha: float = ALPHA) -> DataFrame:
    """A row per shard: width, entry, vectors, edges, ids; for searches of up to ``k`` results."""
    rows = written(spark, distinct_vectors(usable(df, id_col, vec_col), k + 1), "vectors")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    shards = max(1, -(-n * width * 8 // shard_bytes))

    def run(group: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(pa.compute.list_element(group.column("ids"), 0))
        group = group.take(order).combine_chunks()
        x, ids = matrix(group.column("v"), width), group.column("ids").combine_chunks()
        graph = Graph.build(unit(x), degree, alpha=alpha)
        counts = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
        return pa.table({
            "shard": group.column("shard")[:1], "width": pa.array([width], pa.int32()),
            "entry": pa.array([graph.entry], pa.int32()), "vectors": pa.array([x.tobytes()], pa.binary()),
            "edges": pa.array([graph.edges.tobytes()], pa.binary()),
            "counts": pa.array([counts.tobytes()], pa.binary()),
            "ids": pa.array([ids.flatten().to_numpy().astype(np.int64).tobytes()], pa.binary())})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    return written(spark, dealt.groupBy("shard").applyInArrow(
        run, "shard int, width int, entry int, vectors binary, edges binary, counts binary, ids binary"),
        "graph")


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray,
            k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of each query's k best results and their ranks from 0; an id counts once."""
    order = np.lexsort((-score, ids, query))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(query[order]) != 0) | (np.diff(ids[order]) != 0)
    order = order[new]
    order = order[np.lexsort((ids[order], -score[order], query[order]))]
    rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
    return order[rank < k], rank[rank < k]


def search_shard(shard: dict, own: np.ndarray, q: np.ndarray, k: int, beam: int) -> np.ndarray:
    """The shard's best candidates of all queries (ids ``own``, vectors ``q``)."""
    x = np.frombuffer(shard["vectors"]).reshape(-1, shard["width"])
    q = q[:, :shard["width"]]
    graph = Graph(unit(x), np.frombuffer(shard["edges"], np.int32).reshape(len(x), -1), shard["entry"])
    counts, ids = np.frombuffer(shard["counts"], np.int32), np.frombuffer(shard["ids"], np.int64)
    first, out = np.cumsum(counts) - counts, [np.zeros(0, FOUND)]
    for at in range(0, len(own), BATCH):
        part = q[at:at + BATCH]
        node, _, _ = graph.search(unit(part), min(beam, len(x)))
        who, place = np.nonzero(node >= 0)
        node = node[who, place]
        score = cosine(part[who], x[node])
        times = counts[node]
        each = np.repeat(np.arange(len(node)), times)
        found = ids[first[node][each] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)]
        other = found != own[at + who[each]]
        each, found = each[other], found[other]
        keep, _ = best_of(who[each], found, score[each], k)
        rows = np.empty(len(keep), FOUND)
        rows["query"], rows["id"], rows["score"] = at + who[each][keep], found[keep], score[each][keep]
        out.append(rows)
    return np.concatenate(out)


def nearest(spark: SparkSession, index: DataFrame, df: DataFrame, k: int = 5,
            id_col: str = "vec_id", vec_col: str = "embedding", beam: int = BEAM,
            slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """The k nearest found of each row of ``df``: query_id, rank, vec_id, score."""
    width = index.agg(F.max("width")).first()[0]
    queries = written(spark, usable(df, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")), "queries")
    n, own = queries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    width = max(width or 1, own)
    slabs = max(1, -(-n * width * 8 // slab_bytes))
    found = []
    for i in range(slabs):
        mine = queries.where(F.pmod(F.xxhash64("id"), F.lit(slabs)) == i).toArrow()
        found.append(_slab(spark, index, mine, k, width, beam))
    return reduce(DataFrame.unionByName, found)


def _slab(spark: SparkSession, index: DataFrame, queries: pa.Table, k: int, width: int,
          beam: int) -> DataFrame:
    own = queries.column("id").to_numpy()
    sent = spark.sparkContext.broadcast((own, matrix(queries.column("v"), width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = sent.value
        for batch in batches:
            for shard in batch.to_pylist():
                rows = search_shard(shard, own, q, k, beam)
                chunk = rows["query"] // CHUNK
                cut = np.flatnonzero(np.diff(chunk)) + 1
                parts = [p for p in np.split(rows, cut) if len(p)]
                yield pa.record_batch([pa.array([int(p["query"][0]) // CHUNK for p in parts], pa.int32()),
                                       pa.array([p.tobytes() for p in parts], pa.binary())],
                                      ["chunk", "payload"])

    def merge(group: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(group.column("payload").to_pylist()), FOUND)
        keep, rank = best_of(rows["query"], rows["id"], rows["score"], k)
        rows = rows[keep]
        return pa.table({"query_id": sent.value[0][rows["query"]], "rank": (rank + 1).astype(np.int32),
                         "vec_id": rows["id"], "score": rows["score"]})

    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, "1")  # a row is a whole shard
    try:
        parts = written(spark, index.mapInArrow(run, "chunk int, payload binary"), "found")
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return parts.groupBy("chunk").applyInArrow(
        merge, "query_id bigint, rank int, vec_id bigint, score double")


def op12_graph_search(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings")
    return nearest(spark, build_index(spark, rows), rows.where(is_query()))


def is_query() -> Column:
    return F.col("vec_id") % 50 == 0
