import hashlib
import random
from collections import Counter

import pytest

from ledgerfield.llm import repeats, substrings, suffix


def test_suffix_order_against_sorting():
    rng = random.Random(1)
    for alphabet in (b"a", b"ab", b"abc", bytes(range(254))):
        for _ in range(60):
            texts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
                     for _ in range(rng.randint(1, 5))]
            data, starts, ends = suffix.joined(texts)
            order = suffix.suffix_order(data, starts, ends)
            end = {p: e for s, e in zip(starts.tolist(), ends.tolist()) for p in range(s, e)}
            told = [bytes(data[p:end[p] + 1]) for p in order.tolist()]
            assert told == sorted(told) and sorted(order.tolist()) == sorted(end)


@pytest.mark.parametrize("hot, block", [(4000, 1 << 23), (1, 700)])
def test_repeats(spark, docs, corpus, no_docs, hot, block, monkeypatch):
    own = repeats.repeated_runs
    described = repeats.described
    monkeypatch.setattr(repeats, "described", lambda d, b, w: described(d, b, w, block))
    monkeypatch.setattr(repeats, "repeated_runs", lambda s, d, w: own(s, d, w, order_bytes=3000,
                                                                      hot=hot))
    texts = [(t or "").encode() for _, t in corpus]
    seen = Counter(t[i:i + 200] for t in texts for i in range(len(t) - 199))
    want, left = [], []
    for (d, _), t in zip(corpus, texts):
        gone = [False] * len(t)
        for i in range(len(t) - 199):
            if seen[t[i:i + 200]] > 1:
                gone[i:i + 200] = [True] * 200
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not h for g, h in zip(gone, [False, *gone]))
        want.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
        left.append(kept.decode(errors="ignore"))
    got = map(tuple, repeats.repeat_digests(spark, docs).collect())
    assert sorted(got, key=str) == sorted(want, key=str)
    cut = repeats.remove_repeats(spark, docs)
    assert cut.columns == docs.columns
    assert sorted(r["text"] or "" for r in cut.collect()) == sorted(left)
    assert repeats.repeat_digests(spark, no_docs).count() == 0


def test_substrings(spark, docs, corpus, no_docs):
    first = {}
    texts = [(t or "").encode().split() for _, t in corpus]
    for (d, _), w in zip(corpus, texts):
        d = substrings.LAST_ID if d is None else d
        for i in range(len(w) - 12):
            key = tuple(w[i:i + 13])
            first[key] = min(d, first.get(key, d))
    want = []
    for (d, _), w in zip(corpus, texts):
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i:i + 13])] < (substrings.LAST_ID if d is None else d):
                gone[i:i + 13] = [True] * 13
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = map(tuple, substrings.substring_digests(spark, docs).collect())
    assert sorted(got, key=str) == sorted(want, key=str)
    assert substrings.substring_digests(spark, no_docs).count() == 0


def doubled(n):
    """Two words of 2 ** n letters that powers of any base modulo 2 ** 64 cannot tell apart for large n."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [8, 10, 12])
def test_long_words_are_told_apart(spark, n):
    a, b = doubled(n)
    rest = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}")],
                               "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substrings.substring_digests(spark, df).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_ids_of_words_are_whole_numbers(spark):
    with pytest.raises(ValueError, match="whole number"):
        substrings.substring_digests(spark, spark.createDataFrame([("a", "t")], "doc_id string, text string"))
    small = spark.createDataFrame([(1, "w " * 13), (2, "w " * 13)], "doc_id smallint, text string")
    assert {tuple(r)[:3] for r in substrings.substring_digests(spark, small).collect()} == {(1, 13, 0), (2, 13, 13)}
