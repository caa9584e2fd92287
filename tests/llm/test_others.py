import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerfield.llm import decontaminate, quality, sharding, topk


def test_top_k(spark):
    rng = random.Random(4)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [rng.uniform(-2, 2) for _ in range(20)]) for i in range(230)]
    rows += [(250, None), (251, [None] * 20), (252, [nan] * 20), (300, [inf] * 20),
             (None, [1.0] * 20), (350, []), (400, [0.5] * 7), (17, [3.0] * 20)]
    rows += [(260 + i, [1.0] * 20) for i in range(9)]  # ties
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows],
                               "vec_id long, embedding array<float>, score int, id string")
    con = duckdb.connect()
    table = df.select("vec_id", "embedding").toArrow()
    con.register("embeddings", table)
    usable = {r["vec_id"] for r in df.collect() if r["vec_id"] is not None and r["embedding"] is not
              None and all(x is not None and np.isfinite(x) for x in r["embedding"])}
    value = {}
    for i, v in table.to_pandas().itertuples(index=False):
        if i == i and i in usable:
            x = np.zeros(20)
            x[:len(v)] = np.floor(256 * np.array(v, float))
            value.setdefault(int(i), []).append(x)
    want = []
    for q in [i for i in value if i % 50 == 0]:
        all_ = sorted((-int(x @ value[q][0]), c) for c, xs in value.items() if c != q for x in xs)
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(all_[:5])]
    for slab in (1 << 20, 600):
        got = topk.top_k(spark, df.repartition(3), F.col("vec_id") % 50 == 0, slab_bytes=slab)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(spark, df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = topk.top_k(spark, df.where("vec_id IN (0, 1, 2)"), F.col("vec_id") % 50 == 0)
    assert few.count() == 2


def test_bounds_hold():
    rng = np.random.default_rng(1)
    q, x = rng.normal(size=(30, 32)) * 256, rng.normal(size=(50, 32)) * 256
    exact = q @ x.T
    squares = (q ** 2).sum(1)[:, None] + (x ** 2).sum(1)[None, :]
    gap = []
    for level in topk.LEVELS:
        a, b = topk.statistics(q, level), topk.statistics(x, level)
        bound = topk.Best._bound(squares, (a ** 2).sum(1)[:, None] + (b ** 2).sum(1)[None, :],
                                 a @ b.T)
        assert (bound >= exact).all()
        gap.append((bound - exact).mean())
    assert gap == sorted(gap, reverse=True)  # finer bounds are tighter


def cheapest(supply, capacity, cost):
    """Least cost of a small transport, by trying all."""
    if not any(supply):
        return 0
    i = next(i for i, s in enumerate(supply) if s)
    options = []
    for j, c in enumerate(capacity):
        if c:
            options.append(cost[i][j] + cheapest(
                [s - (k == i) for k, s in enumerate(supply)],
                [s - (k == j) for k, s in enumerate(capacity)], cost))
    return min(options)


def test_minimum_cost_flow():
    rng = random.Random(3)
    for _ in range(12):
        supply = [rng.randint(0, 2) for _ in range(3)]
        capacity = [2, 2, 3]
        cost = [[rng.randint(0, 5) for _ in range(3)] for _ in range(3)]
        flow = sharding.minimum_cost_flow(supply, capacity, cost)
        assert [sum(row) for row in flow] == supply
        assert all(sum(row[j] for row in flow) <= capacity[j] for j in range(3))
        assert sum(f * c for fr, cr in zip(flow, cost) for f, c in zip(fr, cr)) == cheapest(
            supply, capacity, cost)


def test_reshard(spark, docs, corpus, no_docs, tmp_path):
    def sharded(df):
        return sharding.reshard(spark, df, F.pmod(F.col("doc_id"), F.lit(3)),
                                sharding.text_size(), n_new=4, n_old=3)

    out = sharded(docs.withColumn("shard", F.lit("clash")))
    rows = out.collect()
    assert len(rows) == len(corpus)
    assert sorted((zlib.crc32((r["text"] or "").encode()), r["size"]) for r in rows) == sorted(
        (zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for _, t in corpus)
    for s in range(4):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))
    largest = max(r["size"] for r in rows)
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(4)]
    assert max(sizes) <= max(largest, sum(sizes) / 4 * 1.05)
    assert sharded(no_docs).count() == 0
    report = sharding.write_affected(out, str(tmp_path / "shards")).collect()
    read = spark.read.parquet(str(tmp_path / "shards"))
    assert {r["shard"] for r in read.select("shard").distinct().collect()} == {
        r["shard"] for r in report if r["moved_in"] + r["moved_out"]}


def test_unaffected_shards_are_not_written(spark, tmp_path):
    df = spark.range(90).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"),
                                (F.col("id") % 3).alias("home"))
    out = sharding.reshard(spark, df, F.col("home"), sharding.text_size(), n_new=3, n_old=3)
    assert all(r["moved_in"] == r["moved_out"] == 0 for r in sharding.write_affected(
        out, str(tmp_path / "none")).collect())


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, x in enumerate(text):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers_against_dynamic_programming():
    rng = random.Random(3)
    for _ in range(150):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 70)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        assert decontaminate.least_distance(decontaminate.letters(p), len(p), t)[0] == \
            edit_distance(p, t)


def test_decontamination(spark, docs, no_docs):
    rng = random.Random(8)

    def words(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
                        for _ in range(n))

    items = [(i, words(rng.randint(8, 30))) for i in range(12)] + [
        (20, None), (21, ""), (22, "short"), (None, words(20)), (3, words(20))]
    texts = []
    for i, (_, item) in enumerate(items):
        if item:
            chars = list(item)
            for at in rng.sample(range(len(chars)), int(len(chars) * 0.02 * (i % 8))):
                chars[at] = rng.choice(["", "z", "zz"])
            texts.append(f"{words(10)} {''.join(chars).upper()}!\n {words(5)}")
    texts += [words(40), None, ""]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(0, texts[0], "x")],
                               "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for k, t in enumerate(texts):
        for key, item in items:
            item = decontaminate.normal(item or "")
            if len(item) >= decontaminate.LEAST:
                d = edit_distance(item, decontaminate.normal(t or ""))
                if d <= int(0.1 * len(item)):
                    want.add((k, key, d))
    assert len(want) > 5
    got = decontaminate.matches(spark, df, bench)
    assert {tuple(r)[:3] for r in got.collect()} == want
    clean = decontaminate.without_matches(spark, df, bench)
    assert clean.columns == df.columns
    dirty = {k for k, _, _ in want}
    assert sorted(r["doc_id"] for r in clean.collect()) == [
        k for k in range(len(texts)) if k not in dirty]
    assert decontaminate.matches(spark, docs, bench.limit(0)).count() == 0
    assert decontaminate.matches(spark, no_docs, bench).count() == 0


def test_estimate_finds_accuracies():
    rng = np.random.default_rng(2)
    n, hit, false = 20_000, np.array([0.9, 0.7, 0.6, 0.8, 0.5]), np.array([.02, .05, .01, .1, .03])
    bad = rng.random(n) < 0.2
    fires = rng.random((n, 5)) < np.where(bad[:, None], hit, false)
    votes = np.where(rng.random((n, 5)) < 0.1, quality.NONE,
                     np.where(fires, quality.BAD, quality.GOOD))
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, chance, prior = quality.estimate(patterns, counts)
    assert abs(prior - 0.8) < 0.05
    assert np.abs(chance[1] - hit).max() < 0.2 and np.abs(chance[0] - false).max() < 0.05
    assert ((posterior[back.ravel()] < 0.5) == bad).mean() > 0.97


def test_quality_on_held_out_labels(spark):
    root = "/root/testdata/sf0.01"
    told = quality.scored(spark, spark.read.parquet(f"{root}/documents.parquet"))
    rows = told.join(spark.read.parquet(f"{root}/labels.parquet"), "doc_id").collect()
    kept = [r["keep"] for r in rows if r["quality"] == 1]
    rejected = [not r["keep"] for r in rows if r["quality"] == 0]
    assert sum(kept) / len(kept) > 0.97
    assert sum(rejected) / len(rejected) > 0.7


def test_fewer_shards_leave_no_folder_behind(spark, tmp_path):
    """Rows are read back from the folders; clashing names, null and equal ids, equal rows."""
    rows = [(None if i % 3 else 7, f"text {i % 40} " * (i % 9), i % 6, "s", "m") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, home int, _size string, shard string").repartition(
        4).cache()
    path = str(tmp_path / "shards")
    df.withColumn("shard", F.col("home")).write.partitionBy("shard").parquet(path)
    out = sharding.reshard(spark, df, F.col("home"), sharding.text_size(), n_new=4, n_old=6)
    stored = sharding.rewritten(out, path)
    got = stored.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.max("slot").alias(
        "last"), F.count_distinct("slot").alias("slots")).collect()
    assert sorted(p.name for p in (tmp_path / "shards").glob("shard=*")) == [f"shard={i}" for i in range(4)]
    assert sum(r["n"] for r in got) == 600 and all(r["last"] + 1 == r["n"] == r["slots"] for r in got)
    sizes = [r["bytes"] for r in got]
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes)
    assert sorted(map(str, stored.select("doc_id", "text", "home", "_size").collect())) == sorted(
        map(str, df.select("doc_id", "text", "home", "_size").collect()))


def test_null_ids_are_dealt_like_others(spark):
    """Ids do not matter: all null, the shards are as equal as ever."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df in (docs, docs.withColumn("doc_id", F.lit(None).cast("long"))):
        out = sharding.reshard(spark, df, F.pmod(F.crc32("source"), F.lit(16)), sharding.text_size(), 24, 16)
        sizes = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
        assert len(sizes) == 24 and max(sizes) < 1.03 * min(sizes)


def test_quality_edges(spark, docs, corpus, no_docs):
    rows = quality.scored(spark, docs).collect()
    assert len(rows) == len(corpus)
    empty = [d for d, t in corpus if not (t or "").strip()]
    assert sorted((r["doc_id"] for r in rows if r["score"] == 0), key=str) == sorted(empty, key=str)
    kept = quality.keep_good(spark, docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["keep"] for r in rows)
    assert quality.scored(spark, no_docs).count() == 0


def test_sample_is_bounded_when_all_ids_are_null_or_equal(spark, monkeypatch):
    rows, seen = [(None, f"some words of text number {i}, to be read. And a second one.") for i in range(4000)], []
    monkeypatch.setattr(quality, "fit", lambda sample: seen.append(sample.count()))
    for rows in (rows, [(5, t) for _, t in rows], [(None, rows[0][1])] * 4000):
        quality.train(spark, spark.createDataFrame(rows, "doc_id long, text string"), sample=200)
    assert all(100 < n < 320 for n in seen), seen


def test_pipeline(spark):
    import corpus_pipeline

    root = "/root/testdata/sf0.001"
    before = docs = spark.read.parquet(f"{root}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, root)
        assert docs.columns == before.columns, name
    pieces = corpus_pipeline.run(spark, root).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}
    assert len({r["doc_id"] for r in pieces}) < before.count()
    for _, own in itertools.groupby(sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])),
                                    lambda r: r["sequence_id"]):
        assert sum(r["length"] for r in own) <= 4096
