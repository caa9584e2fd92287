import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerfield.llm import graph

SCHEMA = "vec_id long, embedding array<float>, v string, ids string, shard int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "v", "i", 3) for i, v in rows], SCHEMA).repartition(3)


def exact(rows, queries, k=5):
    """The k nearest of each query by brute force, over distinct (id, vector)."""
    rows = sorted({(i, tuple(np.float32(x) for x in v)) for i, v in rows if i is not None and v
                   and all(x is not None and np.isfinite(x) for x in v) and any(v)}, key=lambda r: r[0])
    width = max(len(v) for _, v in rows)
    x = np.array([[*v, *[0] * (width - len(v))] for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    out = {}
    for q in sorted(queries & set(ids.tolist())):
        own = x[min(np.flatnonzero(ids == q), key=lambda p: tuple(x[p]))]
        best = {}
        for i, s in zip(ids.tolist(), graph.cosine(own[None, :], x).tolist()):
            if i != q:
                best[i] = max(s, best.get(i, -2))
        out[q] = sorted(best.items(), key=lambda r: (-r[1], r[0]))[:k]
    return out


def search(spark, rows, queries, **how):
    df = frame(spark, rows)
    built = {n: how.pop(n) for n in ("shard_bytes",) if n in how}
    index = graph.build_index(spark, df, **built)
    found = graph.nearest(spark, index, df.where(F.col("vec_id").isin(list(queries))), **how).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out, index


def test_small_shards_and_slabs_are_exact(spark):
    """Ties, copies, nulls, zeros, lengths, repeated ids and rows; several shards and slabs."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(i, rows[7][1]) for i in (400, 350, 7)]
    rows += [(500, None), (501, []), (502, [0.0] * 8), (503, [1.0, None]), (504, [float("nan")] * 8),
             (505, [float("inf"), 1.0]), (None, rows[3][1]), (506, [1.0, 2.0]), (506, [0.5, 2.0]),
             (507, [1e-20, 1e-20]), (508, [1e18] * 8), (509, [1e18] * 8), rows[5], rows[5]]
    queries = {0, 5, 7, 50, 100, 150, 250, 350, 400, 500, 502, 506, 507, 508, 1000}
    found, index = search(spark, rows, queries, shard_bytes=5000, slab_bytes=300)
    assert index.count() > 2
    assert found == exact(rows, queries)


def test_recall_on_a_hot_group_of_near_copies(spark):
    """A third of all rows near one vector, random vectors otherwise: recall of 0.9 or more."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 32))
    x[::3] = x[0] + 0.02 * rng.normal(size=x[::3].shape)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    queries = set(range(0, 4000, 50))
    found, _ = search(spark, rows, queries)
    want = exact(rows, queries)
    hits = [len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want]
    assert sum(hits) >= 0.9 * 5 * len(want)
    for q, got in found.items():  # scores are those of the vectors themselves
        own = x[q].astype(np.float32).astype(float)
        assert [s for _, s in got] == [graph.cosine(own[None, :], x[i].astype(np.float32).astype(
            float)[None, :])[0] for i, _ in got]


def test_every_node_is_reached_and_edges_are_diverse():
    x = graph.unit(np.random.default_rng(1).normal(size=(2000, 16)))
    built = graph.Graph.build(x, degree=12, beam=24)
    assert built.reached().all()
    lone = graph.Graph(x[:40], np.full((40, 4), -1, np.int32), 0)
    lone.connect(8)
    assert lone.reached().all()
    group = x[1] + 0.001 * np.random.default_rng(2).normal(size=(30, 16))
    star = graph.Graph(graph.unit(np.concatenate([x[:1], group, -x[1:2]])), np.full((32, 8), -1, np.int32), 0)
    kept = star.pruned(np.array([0]), np.arange(1, 32, dtype=np.int32)[None, :], 1.2)[0]
    # One stands for the whole group; the vector on the other side is in nobody's shadow.
    assert 31 in kept and (kept >= 0).sum() == 2


@pytest.mark.parametrize("rows", [[], [(50, None)], [(50, [1.0, 0.0])]])
def test_nothing_to_find(spark, rows):
    assert search(spark, rows, {50})[0] == {}


def test_query_on_the_given_table(spark):
    root = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/embeddings.parquet").select(
        "vec_id", "embedding").collect()]
    want = exact(rows, {i for i, _ in rows if i % 50 == 0})
    found = graph.op12_graph_search(spark, root).collect()
    hits = sum(r["vec_id"] in {i for i, _ in want[r["query_id"]]} for r in found)
    assert len(found) == 5 * len(want) and hits >= 0.9 * len(found)
