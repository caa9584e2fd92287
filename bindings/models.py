"""Registered models and monitoring."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from bindings.columns import sheet, table
from bindings.registry import query
from bindings.reports import customer_table, segmented
from bindings.transfer import scratch
from ledgerfield.operators import quantiles
from ledgerfield.plans import monitoring, portfolio, risk, segmentation, sweep as sweeps
from ledgerfield.plans.features import segmentation_features
from ledgerfield.sources import readers, sinks
from ledgerfield.streaming import windows


# --- Preprocessing -------------------------------------------------------------------------------

_SCALED = ["age", "outstanding_to_financed", "repayment_progress", "risk_stress_score",
           "lead_quality_score"]


@query("m05_m06_median_fill_and_robust_scaling", f"""
SELECT customer_id, {', '.join(
    f"(coalesce({c}, {c}_mid) - {c}_mid) / CASE WHEN {c}_iqr = 0 THEN 1 ELSE {c}_iqr END AS {c}_scaled"
    for c in _SCALED)}
FROM customer_table CROSS JOIN (SELECT {', '.join(
    f"any_value({c}_mid) AS {c}_mid, quantile_cont(coalesce({c}::DOUBLE, {c}_mid), 0.75) "
    f"- quantile_cont(coalesce({c}::DOUBLE, {c}_mid), 0.25) AS {c}_iqr" for c in _SCALED)}
  FROM customer_table CROSS JOIN (SELECT {', '.join(
    f"quantile_cont({c}, 0.5) AS {c}_mid" for c in _SCALED)} FROM customer_table))""")
def scaling(spark, root):
    customers = customer_table(spark, root).select("customer_id", *_SCALED)
    scaler = segmentation.robust_scaler(customers, _SCALED)
    return scaler.transform(customers).select("customer_id", *[
        F.col(f"{c}{segmentation.SCALED}").alias(f"{c}_scaled") for c in _SCALED])


@query("m07_m08_encoded_features")
def encoded(spark, root):
    from pyspark.ml.functions import vector_to_array

    featured = segmentation_features(customer_table(spark, root))
    prepared = segmentation.fit_preprocessing(featured).transform(featured)
    values = vector_to_array(segmentation.FEATURES)
    return prepared.select(
        "customer_id", F.size(values).alias("width"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


# --- Clustering ----------------------------------------------------------------------------------

def vectors(spark, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select(
        "vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>"))
        .alias("features"))


@query("m09_kmeans_clusters")
def clusters(spark, root):
    df = vectors(spark, root)
    fitted = segmentation.kmeans(5).fit(df)
    return fitted.transform(df).groupBy(segmentation.CLUSTER).agg(F.count("*").alias("rows")) \
        .select(F.col(segmentation.CLUSTER).alias("cluster"), "rows")


@query("m09_kmeans_assigns_every_vector", """
SELECT count(*) AS rows, 0 AS outside FROM embeddings""")
def clusters_cover(spark, root):
    df = vectors(spark, root)
    assigned = segmentation.kmeans(5).fit(df).transform(df)
    inside = F.coalesce(F.col(segmentation.CLUSTER).between(0, 4), F.lit(False))
    return assigned.agg(F.count("*").alias("rows"), F.count_if(~inside).cast("int").alias("outside"))


def _lloyd_sql(tag: str, k: int, steps: int, weight: str = "1") -> str:
    """Common tables: after so many steps from the first k rows by hash, ``l_<tag>`` has (vec_id, c, d)."""
    parts = [f"""x_{tag} AS (SELECT vec_id, embedding::DOUBLE[] AS v, {weight} AS w,
    row_number() OVER (ORDER BY md5(vec_id::VARCHAR)) - 1 AS place FROM embeddings),
  c{tag}_0 AS (SELECT place AS c, v AS m FROM x_{tag} WHERE place < {k})"""]
    for step in range(steps + 1):
        name = f"l_{tag}" if step == steps else f"l{tag}_{step}"
        parts.append(f"""{name} AS (SELECT vec_id, min_by(c, d) AS c, min(d) AS d FROM (
    SELECT vec_id, c, list_distance(v, m) AS d FROM x_{tag}, c{tag}_{step}) GROUP BY vec_id)""")
        if step < steps:
            parts.append(f"""c{tag}_{step + 1} AS (SELECT c, list(m ORDER BY i) AS m FROM (
    SELECT c, i, sum(w * e) / sum(w) AS m FROM (SELECT c, w, unnest(v) AS e, generate_subscripts(v, 1) AS i
      FROM x_{tag} JOIN {name} USING (vec_id)) GROUP BY c, i) GROUP BY c)""")
    return ",\n  ".join(parts)


SWEEP_STEPS = 3


def _repeatable(spark, root: str, ks: list[int]) -> sweeps.Sweep:
    """A fixed number of steps from the first rows by hash, as the SQL takes them."""
    rows = table(spark, root, "embeddings").select("vec_id", F.col("embedding").alias("features"))
    return sweeps.sweep(rows, ks, sweeps.by_hash("vec_id"), steps=SWEEP_STEPS, shift=-1.0, per_cluster=1)


@query("m09_labels_of_the_nearest_centre", f"""
WITH {_lloyd_sql("a", 4, SWEEP_STEPS)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster FROM l_a""")
def repeatable_labels(spark, root):
    return _repeatable(spark, root, [4]).labels(4, "cluster", ["vec_id"])


@query("m12_sweep_of_all_k", "WITH " + ",\n  ".join(
    _lloyd_sql(f"k{k}", k, SWEEP_STEPS) for k in range(2, 6)) + " UNION ALL ".join(f"""
SELECT {k} AS k, sum(d * d) AS inertia, min(n) * 100e0 / sum(n) AS min_cluster_pct FROM (
  SELECT d, count(*) OVER (PARTITION BY c) AS n, count(*) OVER () AS total FROM l_k{k})
HAVING true""".replace("min(n) * 100e0 / sum(n)", "min(n) * 100e0 / min(total)") for k in range(2, 6)))
def repeatable_sweep(spark, root):
    return _repeatable(spark, root, [2, 3, 4, 5]).scores().select("k", "inertia", "min_cluster_pct")


_CH = """
SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS rows,
  (sum(n * between_sq) / (count(*) - 1)) / (sum(within_sq) / (sum(n) - count(*))) AS calinski_harabasz,
  min(n) * 100e0 / sum(n) AS min_cluster_pct
FROM (SELECT label, any_value(n) AS n, sum((m - c) * (m - c)) AS between_sq, sum(w) AS within_sq
  FROM (SELECT label, i, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS w
      FROM cells GROUP BY 1, 2)
    JOIN (SELECT i, avg(v) AS c FROM cells GROUP BY 1) USING (i) GROUP BY 1)"""


@query("m11_calinski_harabasz", _CH.replace("FROM cells", """FROM (
  SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i
  FROM embeddings)"""))
def calinski(spark, root):
    return segmentation.calinski_harabasz(vectors(spark, root), label="label")


@query("m10_silhouette")
def silhouette(spark, root):
    df = vectors(spark, root)
    fitted = segmentation.kmeans(4).fit(df).transform(df)
    score = segmentation.silhouette(fitted, 4)
    return fitted.groupBy(segmentation.CLUSTER).agg(F.count("*").alias("rows")).select(
        F.col(segmentation.CLUSTER).alias("cluster"), "rows", F.lit(score).alias("silhouette"))


@query("m10_silhouette_of_labels", """
WITH c AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v,
    generate_subscripts(embedding, 1) AS i FROM embeddings),
  s AS (SELECT label, i, sum(v) AS y FROM c GROUP BY 1, 2),
  n AS (SELECT label, count(DISTINCT vec_id) AS n, sum(v * v) AS psi FROM c GROUP BY 1),
  x AS (SELECT vec_id, any_value(label) AS own, sum(v * v) AS xi FROM c GROUP BY 1),
  d AS (SELECT c.vec_id, s.label, sum(c.v * s.y) AS dot FROM c JOIN s ON c.i = s.i GROUP BY 1, 2),
  a AS (SELECT x.vec_id, own, d.label, n.n, xi + psi / n.n - 2 * dot / n.n AS far
    FROM x JOIN d ON x.vec_id = d.vec_id JOIN n ON d.label = n.label),
  p AS (SELECT vec_id, any_value(own) AS own, max(n) FILTER (label = own) AS size,
      max(far * n / (n - 1e0)) FILTER (label = own) AS near,
      min(far) FILTER (label <> own) AS other FROM a GROUP BY 1)
SELECT own AS cluster, count(*) AS rows, (SELECT round(avg(CASE WHEN size = 1 THEN 0
    ELSE (other - near) / greatest(other, near) END), 6) FROM p) AS silhouette
FROM p GROUP BY 1""")
def silhouette_of_labels(spark, root):
    df = vectors(spark, root).withColumnRenamed("label", segmentation.CLUSTER)
    score = segmentation.silhouette(df, 2)
    return df.groupBy(segmentation.CLUSTER).agg(F.count("*").alias("rows")).select(
        F.col(segmentation.CLUSTER).alias("cluster"), "rows",
        F.round(F.lit(score), 6).alias("silhouette"))


@query("m12_k_sweep")
def sweep(spark, root):
    return segmentation.evaluate_k_range(vectors(spark, root), 2, 6)


# The sweep stands in for one from a model: figures per remainder of the order key.
_SWEEP = """(SELECT CAST(o_orderkey % 7 + 2 AS INTEGER) AS k, sum(o_totalprice) AS inertia,
  avg(o_totalprice) / 1e6 AS silhouette, max(o_totalprice) AS calinski_harabasz,
  count(*) FILTER (o_orderstatus = 'F') * 100e0 / 15000 AS min_cluster_pct FROM orders GROUP BY 1)"""


def _k_sql(least: float, tolerance: float) -> str:
    return f"""
SELECT k FROM (SELECT *, max(silhouette) OVER () AS best FROM (
  SELECT *, max(CAST(min_cluster_pct >= {least} AS INTEGER)) OVER () AS any_big FROM {_SWEEP})
  WHERE min_cluster_pct >= {least} OR any_big = 0)
ORDER BY CASE WHEN k BETWEEN 4 AND 6 AND silhouette >= best - {tolerance} THEN 0 ELSE 1 END,
  silhouette DESC, k LIMIT 1"""


def _sweep(spark, root):
    return table(spark, root, "orders").groupBy(
        (F.col("o_orderkey") % 7 + 2).cast("int").alias("k")).agg(
        F.sum("o_totalprice").alias("inertia"),
        (F.avg("o_totalprice") / 1e6).alias("silhouette"),
        F.max("o_totalprice").alias("calinski_harabasz"),
        (F.count_if(F.col("o_orderstatus") == "F") * 100.0 / 15000).alias("min_cluster_pct"))


@query("m13_select_optimal_k", _k_sql(0.1, 0.05))
def optimal_k(spark, root):
    return segmentation.select_optimal_k(_sweep(spark, root), min_cluster_pct=0.1)


@query("m13_select_optimal_k_without_large_clusters", _k_sql(99, 0))
def optimal_k_small(spark, root):
    return segmentation.select_optimal_k(_sweep(spark, root), min_cluster_pct=99.0,
                                         silhouette_tolerance=0.0)


_fitted: dict[tuple[str, str], segmentation.Segmentation] = {}


def fitted(spark, root: str) -> segmentation.Segmentation:
    """One fit per application and data folder serves the queries below."""
    key = (spark.sparkContext.applicationId, root)
    if key not in _fitted:
        _fitted[key] = segmentation.fit_segmentation(customer_table(spark, root), k_max=6)
    return _fitted[key]


@query("m14_fit_segmentation")
def fit(spark, root):
    result = fitted(spark, root)
    return result.customers.groupBy("segment_id", "segment_name").agg(
        F.count("*").alias("customers"), F.lit(result.optimal_k).alias("optimal_k"))


@query("m14_segment_profile")
def fit_profile(spark, root):
    return fitted(spark, root).profile


@query("k09_m15_m20_saved_model_scores_customers")
def saved_model(spark, root):
    result = fitted(spark, root)
    path = scratch(spark, root, "segmentation_model")
    sinks.save_model(result.model, path)
    scored = segmentation.score_customers(customer_table(spark, root), sinks.load_model(path))
    named = segmentation.with_segment_names(scored, result.segment_names)
    return named.select("customer_id", "segment_id", "segment_name")


@query("k10_model_card")
def card(spark, root):
    path = scratch(spark, root, "model_card")
    sinks.write_model_card(segmentation.model_card(fitted(spark, root)), path)
    stored = sinks.read_model_card(spark, path)
    return stored.select("model_type", "n_clusters", "random_state",
                         F.to_json("k_evaluation").alias("k_evaluation"),
                         F.to_json("segment_names").alias("segment_names"))


@query("m16_predict_segments")
def predict(spark, root):
    result = fitted(spark, root)
    customers = customer_table(spark, root)
    ids = sheet(spark, root, "Customers").select(F.col("id").alias("customer_id"))
    return segmentation.predict_segments(customers, ids, result.model, result.segment_names)


@query("m14_m16_segments_cover_customers", """
SELECT count(*) AS customers, 0 AS outside FROM s_customers""")
def segments_cover(spark, root):
    """Every customer gets a segment of the model or is not found."""
    result = fitted(spark, root)
    known = F.col("segment_id").between(0, result.optimal_k - 1) & F.col("segment_name").isNotNull()
    lost = (F.col("source") == "not_found") & F.col("segment_id").isNull()
    rows = predict(spark, root)
    return rows.agg(F.count("*").alias("customers"), F.count_if(
        ~F.coalesce(known | lost, F.lit(False))).cast("int").alias("outside"))


@query("m16_predict_segments_from_labels", """
SELECT c.id AS customer_id, s.segment_id, s.segment_name,
  CASE WHEN s.customer_id IS NULL THEN 'not_found' ELSE 'cached_labels' END AS source
FROM s_customers c LEFT JOIN segmented s ON c.id = s.customer_id""")
def predict_cached(spark, root):
    ids = sheet(spark, root, "Customers").select(F.col("id").alias("customer_id"))
    return segmentation.predict_segments(segmented(spark, root), ids, None)


# --- Risk ----------------------------------------------------------------------------------------

_RISK_FEATURES = ["account_age_days", "account_count", "repayment_progress"]


@query("m17_m18_logistic_risk")
def logistic(spark, root):
    customers = customer_table(spark, root).select("customer_id", "is_default", *_RISK_FEATURES)
    model = risk.train_risk_model(customers, _RISK_FEATURES, "is_default")
    return risk.predict_risk(model, customers).select("customer_id", "is_default", "risk_score")


_SCORED = """(SELECT is_default AS y, least(greatest(1 - repayment_progress, 0), 1) AS p
  FROM customer_table)"""


def _scored(spark, root):
    return customer_table(spark, root).select(
        F.col("is_default").alias("y"),
        F.least(F.greatest(1 - F.col("repayment_progress"), F.lit(0.0)), F.lit(1.0)).alias("p"))


@query("m19_auc_and_accuracy", f"""
SELECT (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2e0)
    / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS roc_auc,
  avg(CAST((p >= 0.5)::INTEGER = y AS INTEGER)) AS accuracy
FROM (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS r
  FROM {_SCORED})""")
def auc(spark, root):
    return risk.evaluate_risk(_scored(spark, root), "y", "p")


@query("x08_top_decile_metrics", f"""
SELECT count(*) FILTER (p >= edge) AS top_rows,
  count(*) FILTER (p >= edge AND y = 1) AS top_positives,
  count(*) FILTER (p >= edge AND y = 1) / count(*) FILTER (y = 1) AS recall,
  count(*) FILTER (p >= edge AND y = 1) / count(*) FILTER (p >= edge) AS precision,
  (count(*) FILTER (p >= edge AND y = 1) / count(*) FILTER (p >= edge))
    / (count(*) FILTER (y = 1) / count(*)) AS lift
FROM {_SCORED} CROSS JOIN (SELECT quantile_cont(p, 0.9) AS edge FROM {_SCORED})""")
def top_decile(spark, root):
    return risk.top_share_metrics(_scored(spark, root), "y", "p")


@query("x08_split_by_date", """
SELECT 'train' AS part, count(*) AS rows FROM orders WHERE o_orderdate < DATE '1999-01-01'
UNION ALL SELECT 'test', count(*) FROM orders WHERE o_orderdate >= DATE '1999-01-01'""")
def split(spark, root):
    train, test = risk.split_by_date(table(spark, root, "orders"), "o_orderdate", "1999-01-01")
    return sinks.row_counts({"train": train, "test": test}).withColumnRenamed("table", "part")


@query("x08_area_under_pr", f"""
SELECT y, count(*) AS rows, (
  SELECT round(sum((r - before_r) * (s + before_s) / 2), 9) FROM (
    SELECT r, s, lag(r, 1, 0) OVER (ORDER BY p DESC) AS before_r,
      coalesce(lag(s) OVER (ORDER BY p DESC), s) AS before_s FROM (
      SELECT p, sum(pos) OVER w / sum(pos) OVER () AS r, sum(pos) OVER w / sum(n) OVER w AS s
      FROM (SELECT p, sum(y) AS pos, count(*) AS n FROM {_SCORED} GROUP BY p)
      WINDOW w AS (ORDER BY p DESC)))) AS area_under_pr
FROM {_SCORED} GROUP BY y""")
def pr_curve(spark, root):
    scored = _scored(spark, root)
    area = risk.area_under_pr(scored, "y", "p")
    return scored.groupBy("y").agg(F.count("*").alias("rows"),
                                   F.round(F.lit(area), 9).alias("area_under_pr"))


# --- Monitoring ----------------------------------------------------------------------------------

_DRIFT = ["l_extendedprice", "l_quantity"]
_EDGES = ", ".join(f"{i / 10}" for i in range(1, 10))


def _psi(column: str) -> str:
    return f"""SELECT '{column}' AS metric, sum((b - a) * ln(b / a)) AS psi FROM (
  SELECT greatest(sum(CAST(l_returnflag = 'A' AS INTEGER)) / (SELECT count(*) FROM lineitem
      WHERE l_returnflag = 'A'), 1e-4) AS a,
    greatest(sum(CAST(l_returnflag <> 'A' AS INTEGER)) / (SELECT count(*) FROM lineitem
      WHERE l_returnflag <> 'A'), 1e-4) AS b
  FROM (SELECT l_returnflag, len(list_filter(e, lambda x: x < {column})) AS bin FROM lineitem CROSS JOIN (
    SELECT quantile_cont({column}, [{_EDGES}]) AS e FROM lineitem WHERE l_returnflag = 'A'))
  GROUP BY bin)"""


def _drift(spark, root):
    lines = table(spark, root, "lineitem").select("l_returnflag", *_DRIFT)
    return monitoring.population_stability(
        lines.where("l_returnflag = 'A'"), lines.where("l_returnflag <> 'A'"), _DRIFT)


@query("x01_population_stability", f"""
SELECT metric, psi, psi > 0.2 AS breach FROM ({' UNION ALL '.join(_psi(c) for c in _DRIFT)})""")
def psi(spark, root):
    return _drift(spark, root)


@query("x01_retrain_needed", f"""
SELECT count(*) FILTER (psi > 0.2) AS breaches, count(*) FILTER (psi > 0.2) >= 3 AS retrain
FROM ({' UNION ALL '.join(_psi(c) for c in _DRIFT)})""")
def retrain(spark, root):
    return monitoring.retrain_needed(_drift(spark, root))


_DAILY = """(SELECT CAST(ts AS DATE) AS day, event_type AS segment, count(*) AS customers
  FROM events GROUP BY 1, 2)"""


@query("x02_segment_share_shift", f"""
SELECT strftime(a.day, '%Y-%m-%d') AS day, a.segment, a.share, b.share AS share_before,
  a.share / b.share - 1 AS shift, abs(a.share / b.share - 1) > 0.15 AS alert
FROM (SELECT *, customers / sum(customers) OVER (PARTITION BY day) AS share FROM {_DAILY}) a
JOIN (SELECT *, customers / sum(customers) OVER (PARTITION BY day) AS share FROM {_DAILY}) b
  ON a.segment = b.segment AND a.day = b.day + 7""")
def share_shift(spark, root):
    daily = monitoring.daily_segment_counts(table(spark, root, "events"), "ts", "event_type")
    return monitoring.segment_share_shift(daily, days=7)


@query("x03_daily_counts", f"""
SELECT strftime(day, '%Y-%m-%d') AS day, segment, customers FROM {_DAILY}""")
def daily(spark, root):
    return windows.daily_counts(table(spark, root, "events"), "ts", "event_type")


@query("x04_latency_p95", """
SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  quantile_cont(value, 0.95) AS p95, count(value) AS requests, quantile_cont(value, 0.95) > 150 AS alert
FROM events GROUP BY time_bucket(INTERVAL '1 day', ts)""")
def latency(spark, root):
    return windows.exact_latency_p95(table(spark, root, "events"), "ts", "value", "1 day", 150.0)


@query("x04_latency_p95_within_bounds", """
SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  count(value) AS requests, true AS within, true AS narrow
FROM events GROUP BY time_bucket(INTERVAL '6 hours', ts)""")
def latency_bounds(spark, root):
    """The sketch as it is shipped: ranks of its bounds, counted exactly, enclose the 95 % of each window."""
    events = table(spark, root, "events").withColumn("window_start", F.window("ts", "6 hours")["start"])
    bounds = windows.latency_p95(table(spark, root, "events"), "ts", "value", "6 hours").select(
        "window_start", "low", "high", "requests")
    rank = lambda side: F.count_if(F.col("value") <= F.col(side)) / F.max("requests")
    counted = events.join(bounds, "window_start").groupBy("window_start").agg(
        F.max("requests").alias("requests"), rank("low").alias("below"), rank("high").alias("upto"))
    room = 3 * windows.rank_error(windows.SKETCH) + F.lit(1.0) / F.col("requests")
    return counted.select("window_start", "requests", (F.col("upto") >= 0.95).alias("within"),
                          ((F.col("below") >= 0.95 - room) & (F.col("upto") <= 0.95 + room)).alias("narrow"))


@query("x05_alert_spans", """
SELECT strftime(min(w), '%Y-%m-%d %H:%M:%S') AS opened,
  strftime(max(w) + INTERVAL '6 hours', '%Y-%m-%d %H:%M:%S') AS closed, count(*) AS windows,
  CAST(sum(n) AS BIGINT) AS requests, max(rate) AS worst_rate FROM (
  SELECT *, w - INTERVAL '6 hours' * row_number() OVER (ORDER BY w) AS island FROM (
    SELECT time_bucket(INTERVAL '6 hours', ts) AS w, count(*) AS n,
      avg(CAST(event_type = 'error' AS INTEGER)) AS rate FROM events GROUP BY 1) WHERE rate > 0.2)
GROUP BY island""")
def spans(spark, root):
    return windows.alert_spans(_requests(table(spark, root, "events")), "ts", "failed", "6 hours", 0.2)


_FAILED = """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start,
  avg(CAST(event_type = 'error' AS INTEGER)) AS error_rate, count(*) AS requests,
  avg(CAST(event_type = 'error' AS INTEGER)) > 0.01 AS alert
FROM (SELECT *, time_bucket(INTERVAL '15 minutes', ts) AS w FROM events)"""


def _requests(df: DataFrame) -> DataFrame:
    return df.withColumn("failed", F.col("event_type") == "error")


@query("x05_error_rate", f"{_FAILED} GROUP BY w")
def error_rate(spark, root):
    return windows.error_rate(_requests(table(spark, root, "events")), "ts", "failed")


@query("x05_error_rate_streamed", f"""{_FAILED}
WHERE w + INTERVAL '15 minutes' <= (SELECT date_trunc('milliseconds', max(ts)) FROM events)
  - INTERVAL '15 minutes' GROUP BY w""")
def error_rate_streamed(spark, root):
    """The same figures from a stream: every window the watermark has passed."""
    from uuid import uuid4

    schema = table(spark, root, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet") \
        .parquet(root)
    run = uuid4().hex
    path = scratch(spark, root, f"error_rate_{run}")
    counted = windows.error_rate(
        _requests(stream.withColumn("ts", F.col("ts").cast("timestamp"))), "ts", "failed")
    windows.append_windows(counted, path, f"error_rate_{run}").awaitTermination()
    return readers.read_parquet(spark, path)


def _silhouette_sql(label: str) -> str:
    """(s): the mean silhouette of a labeling of the embeddings, over squared distances."""
    return f"""(
  WITH c AS (SELECT vec_id, {label} AS label, unnest(embedding)::DOUBLE AS v,
      generate_subscripts(embedding, 1) AS i FROM embeddings),
    s AS (SELECT label, i, sum(v) AS y FROM c GROUP BY 1, 2),
    n AS (SELECT label, count(DISTINCT vec_id) AS n, sum(v * v) AS psi FROM c GROUP BY 1),
    x AS (SELECT vec_id, any_value(label) AS own, sum(v * v) AS xi FROM c GROUP BY 1),
    d AS (SELECT c.vec_id, s.label, sum(c.v * s.y) AS dot FROM c JOIN s ON c.i = s.i GROUP BY 1, 2),
    a AS (SELECT x.vec_id, own, d.label, n.n, xi + psi / n.n - 2 * dot / n.n AS far
      FROM x JOIN d ON x.vec_id = d.vec_id JOIN n ON d.label = n.label),
    p AS (SELECT vec_id, max(far * n / (n - 1e0)) FILTER (label = own) AS near,
        min(far) FILTER (label <> own) AS other FROM a GROUP BY vec_id)
  SELECT avg((other - near) / greatest(other, near)) AS s FROM p)"""


_CARD_KS = (2, 3, 4)
_CARDS = {"before": "vec_id % {k}", "after": "(label + vec_id) % {k}"}


@query("x06_silhouette_drop", "WITH " + ",\n".join(f"{side} AS (" + " UNION ALL ".join(
    f"SELECT {k} AS k, s FROM {_silhouette_sql(expr.format(k=k))}" for k in _CARD_KS) + ")"
    for side, expr in _CARDS.items()) + """
SELECT "before", "after", ("before" - "after") / abs("before") AS drop,
  ("before" - "after") / abs("before") > 0.1 AS alert
FROM (SELECT max(s) AS "before" FROM before), (SELECT max(s) AS "after" FROM after)""")
def silhouette_drop(spark, root):
    """Two labelings of all embeddings; each card chooses the k with the best silhouette."""
    def card(side: str) -> DataFrame:
        rows = vectors(spark, root)
        scores = [(k, segmentation.silhouette(rows.withColumn(segmentation.CLUSTER, F.expr(
            _CARDS[side].format(k=k)).cast("int")), k)) for k in _CARD_KS]
        figures = spark.createDataFrame(scores, "k int, silhouette double")
        return figures.agg(F.collect_list(F.struct("k", "silhouette")).alias("k_evaluation"),
                           F.max_by("k", "silhouette").alias("n_clusters"))

    return monitoring.silhouette_drop(card("before"), card("after"))


_SNAPSHOTS = """(SELECT o_custkey AS account, date_trunc('month', o_orderdate) AS month,
  CASE WHEN max(o_orderkey % 120) >= 90 THEN '90+' WHEN max(o_orderkey % 120) >= 60 THEN '60-89'
    WHEN max(o_orderkey % 120) >= 30 THEN '30-59' ELSE '0-29' END AS bucket
  FROM orders GROUP BY 1, 2)"""


@query("x07_roll_rates", f"""
SELECT from_bucket, to_bucket, accounts,
  accounts / sum(accounts) OVER (PARTITION BY from_bucket) AS rate FROM (
  SELECT a.bucket AS from_bucket, b.bucket AS to_bucket, count(*) AS accounts
  FROM {_SNAPSHOTS} a JOIN {_SNAPSHOTS} b
    ON a.account = b.account AND b.month = a.month + INTERVAL '1 month' GROUP BY 1, 2)""")
def roll_rates(spark, root):
    snapshots = table(spark, root, "orders").groupBy(
        "o_custkey", F.trunc("o_orderdate", "month").alias("snapshot_date")).agg(
        F.max(F.col("o_orderkey") % 120).alias("days_past_due"))
    return monitoring.roll_rates(snapshots, "o_custkey", "snapshot_date", "days_past_due")


@query("x09_median_fill_by_country", """
SELECT customer_id, country_name, coalesce(age::DOUBLE,
  quantile_cont(age, 0.5) OVER (PARTITION BY country_name)) AS age FROM customer_table""")
def fill_by_country(spark, root):
    ages = customer_table(spark, root).select("customer_id", "country_name", "age")
    return monitoring.fill_median_by_group(ages, "age", "country_name")


@query("x10_adjusted_rand_index", """
SELECT (i - r * c / t) / ((r + c) / 2 - r * c / t) AS adjusted_rand_index FROM (
  SELECT sum(n * (n - 1) / 2e0) AS i, any_value(t) AS t FROM (
    SELECT count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority)
    CROSS JOIN (SELECT count(*) * (count(*) - 1) / 2e0 AS t FROM orders))
CROSS JOIN (SELECT sum(n * (n - 1) / 2e0) AS r FROM (
  SELECT count(*) AS n FROM orders GROUP BY o_orderstatus))
CROSS JOIN (SELECT sum(n * (n - 1) / 2e0) AS c FROM (
  SELECT count(*) AS n FROM orders GROUP BY o_orderpriority))""")
def rand_index(spark, root):
    return monitoring.adjusted_rand_index(table(spark, root, "orders"), "o_orderstatus",
                                          "o_orderpriority")


REPLICATES = 3
_AT_MOST = ", ".join(f"{t!r}::DOUBLE" for t in sweeps.AT_MOST)


def _weight_sql(replicate: int) -> str:
    return (f"len(list_filter([{_AT_MOST}], lambda t: t <= "
            f"('0x' || substr(md5(vec_id::VARCHAR || '|{replicate}'), 1, 8))::BIGINT / 4294967296e0))")


@query("x10_resampling_weights", "SELECT vec_id, " + ", ".join(
    f"CAST({_weight_sql(b)} AS INTEGER) AS w{b}" for b in range(REPLICATES)) + " FROM embeddings")
def resampling_weights(spark, root):
    rows = table(spark, root, "embeddings").select(
        "vec_id", sweeps.resampling_weights(REPLICATES, "vec_id").alias("w"))
    return rows.select("vec_id", *[F.col("w")[b].alias(f"w{b}") for b in range(REPLICATES)])


@query("x10_stability_by_replicate", "WITH " + ",\n  ".join(
    [_lloyd_sql("base", 3, SWEEP_STEPS), *[_lloyd_sql(f"r{b}", 3, SWEEP_STEPS, _weight_sql(b))
                                           for b in range(REPLICATES)]]) + " UNION ALL ".join(f"""
SELECT {b} AS replicate, (i - r * c / t) / ((r + c) / 2 - r * c / t) AS adjusted_rand_index FROM (
  SELECT sum(n * (n - 1) / 2e0) AS i, sum(n) * (sum(n) - 1) / 2e0 AS t FROM (
    SELECT count(*) AS n FROM l_base JOIN l_r{b} USING (vec_id) GROUP BY l_base.c, l_r{b}.c))
CROSS JOIN (SELECT sum(n * (n - 1) / 2e0) AS r FROM (SELECT count(*) AS n FROM l_base GROUP BY c))
CROSS JOIN (SELECT sum(n * (n - 1) / 2e0) AS c FROM (SELECT count(*) AS n FROM l_r{b} GROUP BY c))"""
    for b in range(REPLICATES)))
def stability_by_replicate(spark, root):
    rows = table(spark, root, "embeddings").select("vec_id", F.col("embedding").alias("features"))
    return sweeps.stability(rows, 3, ["vec_id"], REPLICATES, steps=SWEEP_STEPS, shift=-1.0, per_cluster=1)


@query("x10_segmentation_stability")
def stability(spark, root):
    return monitoring.segmentation_stability(vectors(spark, root), 4, ["vec_id"])


@query("x11_overrides_by_month", """
SELECT strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, event_type AS reason_code,
  count(*) AS overrides FROM events WHERE user_id % 3 <> event_id % 3 GROUP BY 1, 2""")
def overrides(spark, root):
    log = table(spark, root, "events").select(
        F.col("user_id").alias("customer_id"), (F.col("user_id") % 3).alias("model_segment"),
        F.col("value").alias("model_score"), (F.col("event_id") % 3).alias("human_decision"),
        F.col("event_type").alias("reason_code"), F.col("ts").alias("timestamp"))
    return monitoring.overrides_by_month(log)


@query("x12_progress_deciles_against_default", f"""
SELECT decile, count(*) AS customers, round_even(avg(is_default) * 100, 2) AS rate_pct FROM (
  SELECT is_default, CAST(len(list_filter(e, lambda x: x < repayment_progress)) + 1 AS INTEGER) AS decile
  FROM customer_table CROSS JOIN (
    SELECT quantile_cont(repayment_progress, [{_EDGES}]) AS e FROM customer_table)) GROUP BY 1""")
def deciles(spark, root):
    binned = quantiles.decile_of(customer_table(spark, root), "repayment_progress")
    return portfolio.rate_by_bin(binned, "decile", "is_default")


@query("x12_age_group_against_arrears", """
SELECT customer_age_group, count(*) AS customers,
  round_even(avg(is_in_arrears) * 100, 2) AS rate_pct FROM customer_table
WHERE customer_age_group IS NOT NULL GROUP BY 1""")
def ages_arrears(spark, root):
    return portfolio.rate_by_bin(customer_table(spark, root), "customer_age_group",
                                 "is_in_arrears")


@query("x12_delay_quartiles_against_arrears", """
SELECT quartile, count(*) AS customers, round_even(avg(is_in_arrears) * 100, 2) AS rate_pct FROM (
  SELECT is_in_arrears, CAST(len(list_filter(e, lambda x: x < installation_delay_days)) + 1 AS INTEGER)
    AS quartile FROM customer_table CROSS JOIN (
    SELECT quantile_cont(installation_delay_days, [0.25, 0.5, 0.75]) AS e FROM customer_table))
GROUP BY 1""")
def delay_quartiles(spark, root):
    binned = quantiles.decile_of(customer_table(spark, root), "installation_delay_days",
                                 "quartile", 4)
    return portfolio.rate_by_bin(binned, "quartile", "is_in_arrears")


