"""Customer segmentation with K-Means.

Preprocessing is a Spark ML pipeline of built-in stages only, so it is saved and loaded without
custom classes: SQL expressions with the fitted medians and ranges, one-hot encoding, assembling.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerfield import constants as K
from ledgerfield.operators.joins import left_lookup
from ledgerfield.operators.quantiles import exact_quantiles, stored
from ledgerfield.plans.features import segmentation_features
from ledgerfield.plans.profiles import name_segments, profile_segments, segment_lifts
from ledgerfield.plans.sweep import as_arrays, packed, sweep

SEED = 42
FEATURES = "features"
SCALED = "__scaled"
CLUSTER = "__cluster"


@dataclass
class Segmentation:
    customers: DataFrame
    optimal_k: int
    k_evaluation: DataFrame
    profile: DataFrame
    lifts: DataFrame
    segment_names: DataFrame
    model: PipelineModel


def robust_scaler(df: DataFrame, columns: list[str]) -> SQLTransformer:
    """Median fill, then (x - median) / interquartile range; a range of 0 divides by 1.

    Quantiles are exact and interpolated. The built-in scaler takes the nearest rank and sends
    columns without spread to 0.
    """
    quartiles = _quartiles(df, columns)
    center = {c: q["q50"] for c, q in quartiles.items()}
    gaps = df.select([F.count_if(_number(c).isNull()).alias(c) for c in columns]).first()
    gappy = [c for c in columns if gaps[c] and c in center]
    if gappy:
        # Filled values count in the range, as the fill comes first.
        filled = df.select(*[
            F.coalesce(_number(c), F.lit(center[c])).alias(c) for c in gappy])
        quartiles |= _quartiles(filled, gappy)
    spread = {c: q["q75"] - q["q25"] for c, q in quartiles.items()}
    parts = []
    for c in columns:
        middle, width = center.get(c, 0.0), spread.get(c) or 1.0
        value = f"coalesce(nanvl(cast(`{c}` as double), cast(NULL as double)), {middle!r}D)"
        parts.append(f"({value} - {middle!r}D) / {width!r}D AS `{c}{SCALED}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def _number(column: str) -> Column:
    """As a double, with NaN as null."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def _quartiles(df: DataFrame, columns: list[str]) -> dict:
    return {r["metric"]: r for r in exact_quantiles(df, columns, [0.25, 0.5, 0.75]).collect()}


def preprocessing_stages(df: DataFrame) -> list:
    """Scaled numbers, one-hot categories (an unseen one is all zeros) and flags as they are."""
    index = [f"{c}__index" for c in K.CATEGORICAL_FEATURES]
    hot = [f"{c}__hot" for c in K.CATEGORICAL_FEATURES]
    return [
        robust_scaler(df, K.NUMERIC_FEATURES),
        StringIndexer(inputCols=K.CATEGORICAL_FEATURES, outputCols=index,
                      stringOrderType="alphabetAsc", handleInvalid="keep"),
        OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True),
        VectorAssembler(
            inputCols=[f"{c}{SCALED}" for c in K.NUMERIC_FEATURES] + hot + K.BINARY_FEATURES,
            outputCol=FEATURES),
    ]


def fit_preprocessing(featured: DataFrame) -> PipelineModel:
    return Pipeline(stages=preprocessing_stages(featured)).fit(featured)


def kmeans(k: int = 4, seed: int = SEED, features: str = FEATURES) -> KMeans:
    return KMeans(k=k, seed=seed, featuresCol=features, predictionCol=CLUSTER)


def silhouette(clustered: DataFrame, clusters: int, features: str = FEATURES) -> float:
    """-1 with fewer than two clusters. Spark's figure uses squared distances."""
    if clusters < 2:
        return -1.0
    evaluator = ClusteringEvaluator(featuresCol=features, predictionCol=CLUSTER)
    return float(evaluator.evaluate(clustered))


def calinski_harabasz(clustered: DataFrame, features: str = FEATURES,
                      label: str = CLUSTER) -> DataFrame:
    """(clusters, rows, calinski_harabasz, min_cluster_pct); 0 with fewer than two clusters.

    Means and variances per cluster are combined before the shuffle; the rest works on k rows.
    """
    vector = F.col(features)
    stat = Summarizer.metrics("count", "mean", "variance").summary(vector)
    per = clustered.groupBy(label).agg(stat.alias("s")).select(
        F.col("s.count").alias("n"),
        vector_to_array("s.mean").alias("mean"),
        vector_to_array("s.variance").alias("variance"))
    # A cluster of one row has no variance.
    inside = F.when(F.col("n") > 1, (F.col("n") - 1) * F.aggregate(
        "variance", F.lit(0.0), lambda a, v: a + v)).otherwise(0.0)
    per = per.withColumn("inside", inside)
    size = F.size("mean")
    cells = per.select("n", "inside", F.posexplode("mean").alias("i", "m"))
    center = cells.groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("c"))
    spread = cells.join(center, "i").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("c")) * (F.col("m") - F.col("c")))).scalar()
    totals = per.agg(F.count("*").alias("clusters"), F.sum("n").alias("rows"),
                     F.sum("inside").alias("within"), F.min("n").alias("smallest"),
                     F.max(size).alias("width"))
    ratio = F.try_divide(spread / (F.col("clusters") - 1),
                         F.col("within") / (F.col("rows") - F.col("clusters")))
    return totals.select(
        "clusters", "rows",
        F.when(F.col("clusters") < 2, 0.0).otherwise(ratio).alias("calinski_harabasz"),
        (F.col("smallest") * 100.0 / F.col("rows")).alias("min_cluster_pct"))


K_EVALUATION_SCHEMA = ("k int, inertia double, silhouette double, calinski_harabasz double, "
                       "min_cluster_pct double")


def evaluate_k_range(vectors: DataFrame, k_min: int = 2, k_max: int = 10,
                     features: str = FEATURES) -> DataFrame:
    """One row per k, all k in one pass per step (``sweep``). The vectors are kept packed, in memory or on
    disk, while the sweep runs."""
    held = packed(as_arrays(vectors.select(features), features)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return sweep(vectors.select(features), list(range(k_min, k_max + 1)), F.xxhash64("v"), features,
                     held=held).scores()
    finally:
        held.unpersist()


def select_optimal_k(evaluation: DataFrame, min_cluster_pct: float = 5.0,
                     prefer_k_range: tuple[int, int] = (4, 6),
                     silhouette_tolerance: float = 0.05) -> DataFrame:
    """One row: the chosen k.

    Only results with large enough clusters count (all, when none has them). The best silhouette
    within the preferred range wins when it is close to the best of all; ties go to the smallest k.
    """
    every = Window.partitionBy()
    big = F.col("min_cluster_pct") >= min_cluster_pct
    valid = evaluation.withColumn("valid", big | ~F.max(big).over(every)).where("valid")
    near = F.col("silhouette") >= F.max("silhouette").over(every) - silhouette_tolerance
    ranked = valid.withColumn("preferred", near & F.col("k").between(*prefer_k_range))
    return ranked.orderBy(F.col("preferred").desc(), F.col("silhouette").desc(), "k") \
        .limit(1).select("k")


def relabel(clustered: DataFrame, features: str = FEATURES) -> SQLTransformer:
    """Stable segment ids: clusters by size, the largest first, then by their centre."""
    stat = Summarizer.metrics("count", "mean").summary(F.col(features)).alias("s")
    sizes = clustered.groupBy(CLUSTER).agg(stat).select(
        CLUSTER, F.col("s.count").alias("n"), vector_to_array("s.mean").alias("mean")) \
        .orderBy(F.col("n").desc(), "mean").collect()
    cases = " ".join(f"WHEN {r[CLUSTER]} THEN {i}" for i, r in enumerate(sizes))
    extra = ", ".join(f"`{c}__index`, `{c}__hot`" for c in K.CATEGORICAL_FEATURES)
    scaled = ", ".join(f"`{c}{SCALED}`" for c in K.NUMERIC_FEATURES)
    drop = f"`{FEATURES}`, `{CLUSTER}`, {extra}, {scaled}"
    return SQLTransformer(
        statement=f"SELECT * EXCEPT ({drop}), CASE `{CLUSTER}` {cases} ELSE `{CLUSTER}` END "
                  f"AS segment_id FROM __THIS__")


def fit_segmentation(customers: DataFrame, k: int | None = None, k_max: int = 8,
                     seed: int = SEED) -> Segmentation:
    """Features, k sweep, final model, profile and names.

    ``customers`` should be a written table: it is read by every step.
    """
    featured = segmentation_features(customers)
    prepared = fit_preprocessing(featured)
    vectors = prepared.transform(featured).select(FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if k is None:
            evaluation = evaluate_k_range(vectors, 2, k_max)
            k = select_optimal_k(evaluation).first()["k"]
        else:
            evaluation = evaluate_k_range(vectors, k, k)
        clusters = kmeans(k, seed).fit(vectors)
        ids = relabel(clusters.transform(vectors))
    finally:
        vectors.unpersist()
    model = PipelineModel([*prepared.stages, clusters, ids])
    segmented = stored(model.transform(featured))  # scored once, read by all that follows
    lifts = segment_lifts(segmented)
    names = name_segments(lifts)
    return Segmentation(
        customers=with_segment_names(segmented, names),
        optimal_k=k,
        k_evaluation=evaluation,
        profile=profile_segments(segmented),
        lifts=lifts,
        segment_names=names,
        model=model,
    )


def with_segment_names(scored: DataFrame, names: DataFrame) -> DataFrame:
    """Names by id; an id without a name becomes ``Segment <id>``."""
    known = names.select(F.col("segment_id").alias("named_segment"), "segment_name")
    # One row per cluster.
    joined = left_lookup(scored, F.broadcast(known), [("segment_id", "named_segment")])
    unnamed = F.concat(F.lit("Segment "), F.col("segment_id").cast("string"))
    return joined.withColumn("segment_name", F.coalesce("segment_name", unnamed))


def score_customers(customers: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(segmentation_features(customers))


def predict_segments(customers: DataFrame, ids: DataFrame, model: PipelineModel | None,
                     names: DataFrame | None = None) -> DataFrame:
    """(customer_id, segment_id, segment_name, source) for a frame of wanted ids.

    Without a model the stored labels answer; ``source`` says how the row was found, and an unknown
    customer keeps a row with source ``not_found``.
    """
    wanted = ids.select(F.col("customer_id").alias("wanted_id")).distinct()
    rows = customers.join(wanted, F.col("customer_id") == F.col("wanted_id"), "left_semi")
    if model is not None:
        stored = [c for c in ("segment_id", "segment_name") if c in rows.columns]
        scored = score_customers(rows.drop(*stored), model)
        if names is None:
            names = scored.sparkSession.createDataFrame([], "segment_id int, segment_name string")
        found = with_segment_names(scored, names).withColumn("source", F.lit("model"))
    elif "segment_id" in customers.columns:
        found = rows.withColumn("source", F.lit("cached_labels"))
    else:
        raise ValueError("Neither a model nor stored segment labels are available")
    found = found.select("customer_id", "segment_id", "segment_name", "source")
    joined = left_lookup(wanted, found, [("wanted_id", "customer_id")])
    return joined.select(F.col("wanted_id").alias("customer_id"), "segment_id", "segment_name",
                         F.coalesce("source", F.lit("not_found")).alias("source"))


def model_card(result: Segmentation, seed: int = SEED) -> DataFrame:
    """One row: model type, k, seed, the k sweep and the segment names."""
    sweep = result.k_evaluation.agg(F.sort_array(F.collect_list(F.struct(
        *result.k_evaluation.columns))).alias("k_evaluation"))
    names = result.segment_names.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(
        F.col("segment_id").cast("string").alias("id"), "segment_name")))).alias("segment_names"))
    return sweep.select(
        F.lit("KMeans").alias("model_type"),
        F.lit(result.optimal_k).alias("n_clusters"),
        F.lit(seed).alias("random_state"),
        "k_evaluation",
        names.scalar().alias("segment_names"))
