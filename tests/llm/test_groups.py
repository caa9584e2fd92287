import random
import re

import numpy as np
import pytest
import xxhash

from ledgerfield.llm import simhash
from ledgerfield.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    w = WORD.findall(lower(text))
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def roots(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark, docs, corpus, no_docs):
    fps = [fingerprint(t) for _, t in corpus]
    root = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i)
                            if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {}
    for (d, _), r in zip(corpus, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = [(d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(corpus, fps, root)]
    got = map(tuple, simhash.near_groups(spark, docs).collect())
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.near_groups(spark, no_docs).count() == 0


@pytest.mark.parametrize("hot", [10 ** 6, 3])
def test_links_join_all_within_the_radius(spark, hot):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = list(dict.fromkeys(
        c ^ sum(1 << b for b in rng.sample(range(64), k)) for c in centres
        for k in (0, 1, 2, 3, 4, 5, 6, 9) for _ in range(3)))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.links(spark, spark.createDataFrame([(f,) for f in signed], "fp long"),
                          hot_load=hot)
    place = {f: i for i, f in enumerate(signed)}
    got = roots(len(fps), [(place[a], place[b]) for a, b in links.collect()])
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i)
                            if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert got == want


def test_meet_in_small_steps():
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 1 << 16, 300, dtype=np.uint64))
    left = np.full(len(fp), 2)
    one, many = (simhash.meet(fp, left, 64, 4, expand) for expand in (1 << 30, 4000))
    assert roots(len(fp), one.tolist()) == roots(len(fp), many.tolist())


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    pairs += [(i, i + 1) for i in range(300, 340)] + [(500, x) for x in range(501, 560)]
    got = dict(components(spark, spark.createDataFrame(pairs, "a long, b long")).collect())
    want = roots(600, pairs)
    assert all(got.get(i, i) == want[i] for i in range(600))
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark, docs, corpus, no_docs):
    """The smallest id of each component of fingerprints, by brute force; clashing columns stay."""
    fps = [fingerprint(t) for _, t in corpus]
    root = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i)
                            if (fps[i] ^ fps[j]).bit_count() <= 4])
    best = {}
    for (d, _), r in zip(corpus, root):
        best[r] = min(best.get(r, (True, 0)), (d is None, d or 0))
    for df in (docs, docs.withColumnsRenamed({"row": "_row", "id": "fp"})):
        kept = simhash.keep_one(spark, df)
        assert kept.columns == df.columns
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
        assert got == sorted(best.values()) and len(got) < len(corpus)
        assert {r[2] for r in kept.collect()} == {"r"}
    assert simhash.keep_one(spark, no_docs).count() == 0


def test_null_and_equal_ids_keep_one_row(spark):
    text = "the same ten words stand here in every single row"
    df = spark.createDataFrame([(None, text)] * 7 + [(4, text)] * 3 + [(None, "other words entirely")] * 2,
                               "doc_id long, text string").repartition(3).cache()
    assert sorted(map(tuple, simhash.keep_one(spark, df).collect()), key=str) == [
        (4, text), (None, "other words entirely")]
