"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or not at all on every text. Expectation-maximisation over the
counts of vote patterns (at most 3 to the number of heuristics, whatever the corpus) estimates how
accurate each heuristic is on good and on bad texts, without any given label. The
posterior of a text's pattern is its soft label. On soft labels a linear scorer with hashed features
is trained by full gradients, computed where the rows are; it scores all texts.

The scorer is fitted on a sample of about ``SAMPLE`` rows, chosen by a hash of row and text; votes,
patterns and scores cover all rows.

Defined results: a text that is null or has no words scores 0 and is rejected; a null id is like any
other; repeated rows are scored each by itself; an empty table gives no rows; where all texts get
one label, all are kept; other columns are ignored by ``scored`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerfield.llm.anchors import BASE_1, TABLE_1, word_hash
from ledgerfield.llm.batches import slices
from ledgerfield.llm.tables import table, written
from ledgerfield.llm.words import U, mixed, word_bounds

SAMPLE = 8_000
DIMENSIONS = 1 << 14
STEPS, RATE = 30, 2.0
THRESHOLD = 0.75

# Frequent function words of the four languages.
FUNCTION_WORDS = frozenset("""
the of and to in a is that for with as was on are by this be or at it an not from which
de la le les et des en un une du est que qui dans pour par sur au aux il elle ce se pas plus avec
der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an
el los las y del se por con para su al lo como más pero sus o este
""".split())
FUNCTION_BYTES = frozenset(w.encode() for w in FUNCTION_WORDS)

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LOWER = np.zeros(256, bool)
LOWER[97:123] = True
LOWER[128:] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True

GOOD, BAD, NONE = 1, 2, 0


SHORT = 20  # words; heuristics about shares abstain below


def votes(text: bytes) -> list[int]:
    """The heuristics' votes on one text with words."""
    words = text.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters = int(counts[UPPER | LOWER].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    marks = int(counts[[33, 46, 63]].sum())
    bad = [
        int(counts[SYMBOL].sum()) > 0.2 * n,
        int(counts[UPPER].sum()) > 0.3 * letters,
        len(set(words)) < 1.5 * (2 * n) ** 0.5,
        2 * len(set(lines)) < len(lines),
        sum(w in FUNCTION_BYTES for w in words) < 0.03 * n,
        not n / 80 <= marks <= n / 2,
        int(counts[33]) > 0.25 * n,
        not 2 <= sum(map(len, words)) / n <= 16,
    ]
    speaks = [n >= SHORT] * len(bad)
    speaks[3] = len(lines) >= 4
    return [(BAD if b else GOOD) if s else NONE for b, s in zip(bad, speaks)]


HEURISTICS = 8
POWERS = 3 ** np.arange(HEURISTICS)


# What is believed of a heuristic before any text is seen, and how many texts that is worth for each
# text of the corpus: it seldom calls good texts bad, and finds a part of the bad ones.
BELIEF = np.array([0.02, 0.4])  # P(bad vote | good), P(bad vote | bad)
WORTH = 0.03


def estimate(patterns: np.ndarray, counts: np.ndarray,
             rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good per pattern, P(bad vote | class) per heuristic, prior of good).

    ``patterns`` has a row of votes for each pattern. Heuristics that abstain say nothing.
    """
    weight = counts.astype(float)
    bad, good = patterns == BAD, patterns == GOOD
    chance = np.repeat(BELIEF[:, None], patterns.shape[1], axis=1)
    prior, posterior = 0.8, np.full(len(patterns), 0.8)
    belief = WORTH * weight.sum()
    for _ in range(rounds):
        odds = bad @ np.log(chance[0] / chance[1]) + good @ np.log(
            (1 - chance[0]) / (1 - chance[1])) + np.log(prior / (1 - prior))
        posterior = 1 / (1 + np.exp(-odds))
        mass = np.stack([weight * posterior, weight * (1 - posterior)])
        prior = (mass[0].sum() + 1) / (weight.sum() + 2)
        spoke = mass @ (bad | good)
        chance = (mass @ bad + belief * BELIEF[:, None]) / (spoke + belief)
    return posterior, chance, prior


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words of all texts (two per word) and the number of words per text."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    starts, ends = word_bounds(data)
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    n = np.bincount(doc, minlength=len(texts))
    word = word_hash(data, TABLE_1, BASE_1, starts, ends)
    # The form of a word: its first and last characters by class, its length, whether it repeats.
    kind = np.where(UPPER, 1, np.where(LOWER, 2, 3 + np.arange(256)))
    repeats = np.zeros(len(word), np.int64)
    repeats[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    last = np.maximum(ends - 2, starts)
    form = ((kind[data[starts]] * 300 + kind[data[ends - 1]]) * 300 + kind[data[last]]) * 32 \
        + np.minimum(ends - starts, 15) * 2 + repeats
    dims = np.stack([word, mixed(form.astype(np.uint64))], axis=1) % U(DIMENSIONS // 2)
    dims[:, 1] += U(DIMENSIONS // 2)
    return dims.astype(np.int32), n


def probabilities(dims: np.ndarray, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Score of each text: the logistic of the mean weight of its features; 0 without words.

    The mean is drawn towards nothing, as by ``SHORT`` words without weight.
    """
    total = np.zeros(len(n))
    full = np.flatnonzero(n)
    if len(full):
        each = weights[dims].sum(1)
        total[full] = np.add.reduceat(each, (np.cumsum(n) - n)[full]) / (n[full] + SHORT)
    p = 1 / (1 + np.exp(-(total + weights[-1])))
    return np.where(n > 0, p, 0.0)


def _texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [b"" if t is None else t for t in batch.column(column).cast(pa.binary()).to_pylist()]


def patterns_of(df: DataFrame) -> DataFrame:
    """(pattern) of every text with words; the votes as digits to base 3."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [votes(t) for t in _texts(batch) if t.strip(b" \t\n\r\x0b\x0c")]
            if found:
                yield pa.record_batch([pa.array((np.array(found) @ POWERS).astype(np.int32))],
                                      ["pattern"])

    return df.mapInArrow(run, "pattern int")


def sample_of(df: DataFrame, posterior: dict[int, float]) -> DataFrame:
    """(label, dims) of the given texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t for t in _texts(batch) if t.strip(b" \t\n\r\x0b\x0c")]
            if not texts:
                continue
            dims, n = features(texts)
            label = [posterior[int(np.array(votes(t)) @ POWERS)] for t in texts]
            offsets = np.concatenate([[0], np.cumsum(2 * n)]).astype(np.int32)
            yield pa.record_batch([pa.array(label, pa.float64()), pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(dims.ravel()))], ["label", "dims"])

    return df.mapInArrow(run, "label double, dims array<int>")


def fit(rows: DataFrame, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    """Weights of the scorer (the last one is the constant) by adaptive full gradients."""
    weights, squares = np.zeros(DIMENSIONS + 1), np.full(DIMENSIONS + 1, 1e-8)
    for _ in range(steps):
        now = weights

        def slope(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros(DIMENSIONS + 1), 0
            for batch in batches:
                dims = batch.column("dims").flatten().to_numpy().reshape(-1, 2)
                n = batch.column("dims").value_lengths().to_numpy() // 2
                miss = probabilities(dims, n, now) - batch.column("label").to_numpy()
                each = np.repeat(np.repeat(miss / (n + SHORT), n), 2)
                total += np.bincount(dims.ravel(), weights=each, minlength=DIMENSIONS + 1)
                total[-1] += miss.sum()
                seen += len(n)
            yield pa.record_batch([pa.array([total]), pa.array([seen], pa.int64())],
                                  ["slope", "seen"])

        parts = rows.mapInArrow(slope, "slope array<double>, seen bigint").toArrow()
        seen = sum(parts.column("seen").to_pylist())
        if not seen:
            break
        gradient = np.sum(parts.column("slope").to_pylist(), axis=0) / seen
        squares += gradient ** 2
        weights = weights - rate * gradient / np.sqrt(squares)
    return weights


def train(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample: int = SAMPLE) -> np.ndarray:
    """The scorer's weights for a corpus."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = patterns_of(docs.select("text")).groupBy("pattern").count().collect()
    if not counted:
        return np.zeros(DIMENSIONS + 1)
    codes = np.array([r["pattern"] for r in counted])
    digits = codes[:, None] // POWERS[None, :] % 3
    counts = np.array([r["count"] for r in counted])
    posterior, _, _ = estimate(digits, counts)
    share = min(1.0, sample / counts.sum())
    # Drawn by id and text, so that rows of one id are not all in or all out.
    chosen = docs.where(F.pmod(F.xxhash64("id", "text", F.monotonically_increasing_id()), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    rows = written(spark, sample_of(chosen.select("text"), dict(zip(codes.tolist(),
                                                                    posterior.tolist()))), "sample")
    return fit(rows)


def scored(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, keep) of every row."""
    sent = spark.sparkContext.broadcast(train(spark, df, id_col, text_col))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            p = probabilities(*features(_texts(batch)), sent.value)
            yield pa.record_batch([batch.column("id"), pa.array(p), pa.array(p >= threshold)],
                                  ["id", "score", "keep"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, score double, keep boolean").withColumnRenamed("id", id_col)


def keep_good(spark: SparkSession, df: DataFrame, id_col: str = "doc_id",
              text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows the scorer keeps; all columns stay."""
    sent = spark.sparkContext.broadcast(train(spark, df, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            p = probabilities(*features(_texts(batch, text_col)), sent.value)
            yield batch.filter(pc.cast(pa.array(p >= threshold), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op6_quality_classifier(spark, root: str) -> DataFrame:
    return scored(spark, table(spark, root, "documents"))
