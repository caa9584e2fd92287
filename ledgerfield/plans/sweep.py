"""K-Means for a whole range of k at once.

Seeds are chosen by a hash of the row's id, so a run can be repeated anywhere. Every Lloyd step reads the
vectors once and serves all k together: a task adds up its rows per (k, cluster) and only those sums are
shuffled. One more pass gives all silhouettes. So the number of passes does not depend on how many k are
tried, and what reaches the driver is a row per (k, cluster) and dimension block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

STEPS = 20
SHIFT = 1e-4  # a k is done when no centre moves further
SEEDS_PER_CLUSTER = 16
SPARE = 4  # rows taken per first centre that is looked for, as some are copies


def by_hash(*columns: str) -> Column:
    """An order of rows that depends on their own values alone."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))


@dataclass
class Sweep:
    """Centres, sizes and within-cluster sums of squares of each k; ``vectors`` holds them as arrays ``v``,
    ``passes`` is what each pass reads: the same or their packed form."""

    vectors: DataFrame
    centers: dict[int, np.ndarray]
    sizes: dict[int, np.ndarray]
    within: dict[int, np.ndarray]
    passes: DataFrame

    def labels(self, k: int, name: str = "cluster", columns: list[str] | None = None) -> DataFrame:
        """The given columns with the nearest centre (the first of equally near ones)."""
        centers, columns = self.centers[k], columns or [c for c in self.vectors.columns if c != "v"]
        schema = self.vectors.select(*columns, F.lit(0).alias(name)).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                near, _ = nearest(_matrix(batch), centers)
                yield pa.record_batch([*[batch.column(c) for c in columns], pa.array(near.astype(np.int32))],
                                      [*columns, name])

        return self.vectors.select(*columns, "v").mapInArrow(run, schema)

    def scores(self) -> DataFrame:
        """(k, inertia, silhouette, calinski_harabasz, min_cluster_pct) of every k; see ``silhouettes``."""
        found, rows = silhouettes(self), []
        for k, sizes in sorted(self.sizes.items()):
            full = sizes > 0
            n, m = float(sizes.sum()), int(full.sum())
            inertia = float(self.within[k].sum())
            ratio = 0.0
            if m > 1:
                middle = (sizes[:, None] * self.centers[k])[full].sum(axis=0) / n
                between = float((sizes[full] * ((self.centers[k][full] - middle) ** 2).sum(axis=1)).sum())
                ratio = (between / (m - 1)) / (inertia / (n - m)) if inertia and n > m else 0.0
            rows.append((k, inertia, found[k] if m > 1 else -1.0, ratio, float(sizes[full].min()) * 100 / n))
        names = ["k", "inertia", "silhouette", "calinski_harabasz", "min_cluster_pct"]
        table = pa.table(dict(zip(names, map(list, zip(*rows)))))  # local rows, read without a Python worker
        return self.vectors.sparkSession.createDataFrame(
            table, "k int, inertia double, silhouette double, calinski_harabasz double, min_cluster_pct double")


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the squared distance to it."""
    far = (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)
    label = far.argmin(axis=1)
    gap = x - centers[label]
    return label, (gap * gap).sum(1)


def as_arrays(df: DataFrame, features: str = "features") -> DataFrame:
    """The vector column as an array of doubles ``v``, rows without one left out."""
    is_vector = isinstance(df.schema[features].dataType, VectorUDT)
    values = vector_to_array(features) if is_vector else F.transform(features, lambda x: x.cast("double"))
    return df.where(F.col(features).isNotNull()).withColumn("v", values).drop(features)


def packed(vectors: DataFrame) -> DataFrame:
    """The arrays ``v`` as the bytes of their doubles: a pass over a persisted one moves a value per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.ascontiguousarray(_matrix(batch))
                at = np.arange(len(x) + 1, dtype=np.int32) * np.int32(8 * x.shape[1])
                yield pa.record_batch([pa.Array.from_buffers(
                    pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(x)])], ["v"])

    return vectors.select("v").mapInArrow(run, "v binary")


def _matrix(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    column = batch.column(name)
    if pa.types.is_binary(column.type):
        _, at, data = column.buffers()
        low, high = np.frombuffer(at, np.int32)[[column.offset, column.offset + len(column)]]
        return np.frombuffer(data, np.float64, (high - low) // 8, low).reshape(len(column), -1)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _added(vectors: DataFrame, sums, rows: int, width: int, weighted: bool = False) -> np.ndarray:
    """Sum of what ``sums`` makes of each batch's vectors (and weights): ``rows`` times ``width`` numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width))
        for batch in batches:
            if batch.num_rows:
                total += sums(_matrix(batch), _matrix(batch, "w") if weighted else None)
        yield pa.record_batch([pa.array(np.repeat(np.arange(rows, dtype=np.int32), width)),
                               pa.array(np.tile(np.arange(width, dtype=np.int32), rows)),
                               pa.array(total.ravel())], ["place", "field", "value"])

    parts = vectors.select("v", *["w"] * weighted).mapInArrow(run, "place int, field int, value double")
    found = parts.groupBy("place", "field").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros((rows, width))
    out[found.column("place").to_numpy(), found.column("field").to_numpy()] = found.column("value").to_numpy()
    return out


def seeds(vectors: DataFrame, order: Column, ks: list[int], per_cluster: int) -> dict[int, np.ndarray]:
    """First centres of each k, from the first distinct rows by hash: the first row, then always the one
    farthest from those chosen. With one row per cluster, the first k rows as they come."""
    most = max(ks)
    x = _first_distinct(vectors, order, most * per_cluster)
    chosen = list(range(min(most, len(x))))
    if per_cluster > 1 and len(x):
        chosen, far = [0], ((x - x[0]) ** 2).sum(1)
        while len(chosen) < min(most, len(x)):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return {k: x[chosen[:k]] for k in ks}


def _first_distinct(vectors: DataFrame, order: Column, wanted: int) -> np.ndarray:
    """The first distinct vectors. They are the distinct ones of the first rows, so a few more rows than
    wanted are taken; only if those are mostly copies are all vectors grouped."""
    def matrix(rows: DataFrame) -> np.ndarray:
        return np.array(rows.select("v").toArrow().column("v").to_pylist(), np.float64)

    x = matrix(vectors.withColumn("__order", order).orderBy("__order", "v").limit(SPARE * wanted))
    rows = len(x)
    x = np.array(list({(v + 0.0).tobytes(): v for v in x[::-1]}.values())[::-1])  # the first of equal ones
    if len(x) < wanted and rows == SPARE * wanted:
        return matrix(vectors.groupBy("v").agg(F.min(order).alias("__order")).orderBy(
            "__order", "v").limit(wanted))
    return x[:wanted]


def sweep(df: DataFrame, ks: list[int], order: Column, features: str = "features", steps: int = STEPS,
          shift: float = SHIFT, per_cluster: int = SEEDS_PER_CLUSTER, held: DataFrame | None = None) -> Sweep:
    """All k of ``ks`` over the vectors of ``df``, kept by the caller (they are read once per step), or
    of ``held``, the same vectors packed and kept.

    A cluster that loses all its rows keeps its centre and counts 0 rows.
    """
    vectors = as_arrays(df, features)
    passes = vectors if held is None else held
    centers = seeds(vectors, order, ks, per_cluster)
    if not len(next(iter(centers.values()))):
        raise ValueError("no vectors")
    width = next(iter(centers.values())).shape[1]
    found = _lloyd(passes, centers, steps, shift)
    return Sweep(vectors, centers, {k: p[:, width] for k, p in found.items()},
                 {k: p[:, width + 1] for k, p in found.items()}, passes)


def _lloyd(vectors: DataFrame, centers: dict[int, np.ndarray], steps: int, shift: float,
           weighted: bool = False) -> dict[int, np.ndarray]:
    """Moves the centres of all runs step by step; sums, sizes and squares under the final ones.

    With ``weighted`` the i-th run counts each row as often as the i-th number of its array ``w`` says.
    """
    names = sorted(centers)
    width = centers[names[0]].shape[1]
    sizes = [len(centers[k]) for k in names]
    first = dict(zip(names, (np.cumsum(sizes) - sizes).tolist()))
    going = set(names)
    for step in range(steps + 1):
        now = dict(centers)

        def sums(x: np.ndarray, w: np.ndarray | None, now=now) -> np.ndarray:
            out = np.zeros((sum(sizes), width + 2))
            for i, k in enumerate(names):
                label, far = nearest(x, now[k])
                member = np.zeros((len(now[k]), len(x)))
                member[label, np.arange(len(x))] = 1 if w is None else w[:, i]
                out[first[k]:first[k] + len(member)] = np.concatenate(
                    [member @ x, member.sum(1)[:, None], (member @ far)[:, None]], axis=1)
            return out

        found = _added(vectors, sums, sum(sizes), width + 2, weighted)
        parts = {k: found[first[k]:first[k] + len(c)] for k, c in centers.items()}
        if step == steps or not going:
            return parts  # counted under the final centres: nothing has moved since
        for k in sorted(going):
            n = parts[k][:, width]
            moved = np.where(n[:, None] > 0, parts[k][:, :width] / np.maximum(n, 1)[:, None], centers[k])
            if np.abs(moved - centers[k]).max() <= shift:
                going.discard(k)
            centers[k] = moved


# Chances of a Poisson number with mean 1 to be at most 0, 1, ...
AT_MOST = tuple(sum(exp(-1) / factorial(j) for j in range(i + 1)) for i in range(10))


def resampling_weights(replicates: int, *columns: str) -> Column:
    """How often each replicate draws the row: Poisson numbers by a hash of the columns, so that a row's
    weights depend on nothing but its own id."""
    def weight(b: int) -> Column:
        digits = F.substr(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(b)))),
                          F.lit(1), F.lit(8))
        share = F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 32))
        return F.size(F.filter(F.array(*map(F.lit, AT_MOST)), lambda t: t <= share))

    return F.array(*[weight(b) for b in range(replicates)])


def stability(df: DataFrame, k: int, ids: list[str], replicates: int = 20, features: str = "features",
              steps: int = STEPS, shift: float = SHIFT, per_cluster: int = SEEDS_PER_CLUSTER) -> DataFrame:
    """(replicate, adjusted_rand_index): the model of all rows against models of resampled rows.

    All replicates are fitted together, one pass per step, from the seeds of the model of all rows; the
    agreement of all rows' labels comes from one more pass, as counts of label pairs.
    """
    base = sweep(df, [k], by_hash(*ids), features, steps, shift, per_cluster)
    weighted = base.vectors.withColumn("w", resampling_weights(replicates, *ids))
    start = seeds(base.vectors, by_hash(*ids), [k], per_cluster)[k]
    centers = {b: start for b in range(replicates)}
    _lloyd(weighted, centers, steps, shift, True)
    whole, k = base.centers[k], len(start)

    def sums(x: np.ndarray, _w: None) -> np.ndarray:
        own, _ = nearest(x, whole)
        out = np.zeros((replicates * k, k))
        for b in range(replicates):
            np.add.at(out, (b * k + nearest(x, centers[b])[0], own), 1)
        return out

    pairs = _added(base.vectors, sums, replicates * k, k).reshape(replicates, k, k)
    rows = [(b, rand_index(table)) for b, table in enumerate(pairs)]
    return df.sparkSession.createDataFrame(rows, "replicate int, adjusted_rand_index double")


def rand_index(counts: np.ndarray) -> float:
    """Adjusted Rand index of a table of label pairs; 1 where both labelings are one cluster."""
    def choose2(n: np.ndarray) -> float:
        return float((n * (n - 1) / 2).sum())

    whole = choose2(counts.sum(keepdims=True))
    rows, columns = choose2(counts.sum(axis=1)), choose2(counts.sum(axis=0))
    chance = rows * columns / whole if whole else 0.0
    most = (rows + columns) / 2 - chance
    return (choose2(counts) - chance) / most if most else 1.0


def silhouettes(done: Sweep) -> dict[int, float]:
    """Mean silhouette of each k over squared distances, in one pass.

    The mean squared distance to a cluster follows from its size, centre and spread: |x - centre|^2 plus
    the cluster's mean squared distance from its own mean. A row alone in its cluster counts 0.
    """
    ks = sorted(done.centers)
    sizes, centers = done.sizes, done.centers
    means, spread = _means(done, ks)

    def sums(x: np.ndarray, _w: None) -> np.ndarray:
        out = np.zeros((len(ks), 2))
        for i, k in enumerate(ks):
            label, _ = nearest(x, centers[k])
            far = ((x * x).sum(1)[:, None] - 2 * x @ means[k].T + (means[k] ** 2).sum(1)) + spread[k]
            n, rows = sizes[k], np.arange(len(x))
            own_size = n[label]
            own = far[rows, label] * own_size / np.maximum(own_size - 1, 1)
            far[:, n == 0] = np.inf
            far[rows, label] = np.inf
            other = far.min(axis=1)
            most = np.maximum(own, other)
            with np.errstate(invalid="ignore", divide="ignore"):
                value = np.where((own_size > 1) & np.isfinite(other) & (most > 0), (other - own) / most, 0.0)
            out[i] = value.sum(), len(x)
        return out

    found = _added(done.passes, sums, len(ks), 2)
    return {k: float(found[i, 0] / found[i, 1]) if found[i, 1] else 0.0 for i, k in enumerate(ks)}


def _means(done: Sweep, ks: list[int]) -> tuple[dict, dict]:
    """Means of the clusters under the final centres, and mean squared distances from them."""
    centers = done.centers
    width = centers[ks[0]].shape[1]
    first = dict(zip(ks, np.cumsum([0, *[len(centers[k]) for k in ks]]).tolist()))
    total = sum(len(centers[k]) for k in ks)

    def sums(x: np.ndarray, _w: None) -> np.ndarray:
        out = np.zeros((total, width))
        for k in ks:
            label, _ = nearest(x, centers[k])
            member = np.zeros((len(centers[k]), len(x)))
            member[label, np.arange(len(x))] = 1
            out[first[k]:first[k] + len(member)] = member @ x - member.sum(1)[:, None] * centers[k]
        return out

    moved = _added(done.passes, sums, total, width)
    means, spread = {}, {}
    for k in ks:
        n = np.maximum(done.sizes[k], 1)
        gap = moved[first[k]:first[k] + len(centers[k])] / n[:, None]
        means[k] = centers[k] + gap
        spread[k] = np.maximum(done.within[k] / n - (gap * gap).sum(1), 0.0)
    return means, spread
