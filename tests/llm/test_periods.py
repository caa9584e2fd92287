import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ledgerfield.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, length=6, exponent=4):
    """(start, length, period) of all runs, by comparing words that are q apart."""
    out = []
    for q in range(1, len(words) // exponent + 1):
        at = 0
        while at + q < len(words):
            start = at
            while at + q < len(words) and words[at] == words[at + q]:
                at += 1
            size = at + q - start
            if at > start and size >= max(length, exponent * q) and not any(
                    words[start:start + size - r] == words[start + r:start + size] for r in range(1, q)):
                out.append((start, size, q))
            at += at == start or at + q < len(words)
    return sorted(out, key=lambda r: (r[0], r[2]))


def altered(doc_id, words):
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = altered(doc_id, WORD.findall(text or ""))
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def random_words(rng):
    words = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 60))]
    if words and rng.random() < 0.5:
        a = rng.randrange(len(words))
        p = 1 + (len(words) - a) // rng.randint(3, 10)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("length, exponent", [(6, 4), (2, 2), (1, 3), (8, 5)])
def test_runs_against_brute_force(length, exponent):
    rng = random.Random(length)
    for _ in range(300):
        texts = [random_words(rng) for _ in range(rng.randint(1, 6))]
        counts = np.array([len(t) for t in texts], np.int64)
        want, at = [], 0
        for t in texts:
            want += [(s + at, n, q) for s, n, q in brute(t, length, exponent)]
            at += len(t)
        got = periods.runs_of(np.array(sum(texts, []), np.int64), counts, length, exponent)
        assert list(zip(*(x.tolist() for x in got))) == want


def test_few_members_at_once(monkeypatch):
    codes = np.array([0, 1] * 40 + [0] * 40 + [0, 1, 2] * 20, np.int64)
    whole = periods.runs_of(codes, np.array([180]))
    monkeypatch.setattr(periods, "MEMBERS", 7)
    assert all((a == b).all() for a, b in zip(whole, periods.runs_of(codes, np.array([180]))))


def test_long_texts_of_one_word_and_of_one_period():
    """Time and memory stay near linear: quadratic work would take hours here."""
    start, size, period = periods.runs_of(np.zeros(300_000, np.int64), np.array([300_000]))
    assert (start.tolist(), size.tolist(), period.tolist()) == ([0], [300_000], [1])
    codes = np.tile(np.arange(60_000), 5)
    start, size, period = periods.runs_of(codes, np.array([300_000]))
    assert (start.tolist(), size.tolist(), period.tolist()) == ([0], [300_000], [60_000])


def test_query_against_brute_force(spark, corpus, monkeypatch):
    """Nulls, empty and long texts, odd white space, repeated rows and ids, clashing names."""
    rng = random.Random(4)
    rows = [r for r in corpus if len(r[1] or "") < 5000]
    rows += [(100 + i, " ".join(map(str, random_words(rng)))) for i in range(150)]
    rows += [(None, "a a a a a a a"), (7, "a b a b"), (8, "\x1ca \x85"), (9, "x\x0by\x0cx\ny\r x  y " * 3),
             (9, "x\x0by\x0cx\ny\r x  y " * 3), (10, "Ab aB " * 9), (12, "é e " * 9)]
    df = spark.createDataFrame([(d, t, "w", 1, "r") for d, t in rows],
                               "doc_id long, text string, words string, h int, runs string").repartition(3)
    monkeypatch.setattr(periods, "table", lambda *_: df)
    got = [tuple(r) for r in periods.op13_periodic_runs(spark, "").collect()]
    want = [expected(d, t) for d, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(w[1] > 0 for w in want) > 40
    monkeypatch.setattr(periods, "table", lambda *_: df.limit(0))
    assert periods.op13_periodic_runs(spark, "").count() == 0


def test_operator_keeps_the_first_period(spark):
    df = spark.createDataFrame([("k", "so la la la la la la end"), ("l", None)], "key string, body string")
    got = {r["key"]: r for r in periods.periodic_runs(df, "key", "body").collect()}
    assert [tuple(r) for r in got["k"]["runs"]] == [(1, 6, 1)]
    assert (got["k"]["collapsed"], got["k"]["n_words"]) == ("so la end", 8)
    assert (got["l"]["collapsed"], got["l"]["n_words"], got["l"]["runs"]) == ("", 0, [])
