"""Default risk by logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from ledgerfield.operators.quantiles import exact_quantiles, roc_auc


def train_risk_model(df: DataFrame, features: list[str], label: str,
                     max_iter: int = 500) -> PipelineModel:
    """L2 with strength C = 1, unscaled: the penalty per row is 1 / number of rows."""
    rows = df.count()
    assembler = VectorAssembler(inputCols=features, outputCol="__risk_features")
    regression = LogisticRegression(
        featuresCol="__risk_features", labelCol=label, maxIter=max_iter, regParam=1.0 / rows,
        elasticNetParam=0.0, standardization=False, probabilityCol="__probability",
        rawPredictionCol="__raw", predictionCol="__predicted")
    return Pipeline(stages=[assembler, regression]).fit(df)


def predict_risk(model: PipelineModel, df: DataFrame, name: str = "risk_score") -> DataFrame:
    """Probability of class 1, as a plain expression of the fitted coefficients."""
    assembler, regression = model.stages
    margin = F.lit(float(regression.intercept))
    for c, weight in zip(assembler.getInputCols(), regression.coefficients):
        margin = margin + F.col(c).cast("double") * F.lit(float(weight))
    return df.withColumn(name, 1.0 / (1.0 + F.exp(-margin)))


def evaluate_risk(scored: DataFrame, label: str, score: str) -> DataFrame:
    """(roc_auc, accuracy) with 0.5 as the threshold."""
    right = (F.col(score) >= 0.5).cast("int") == F.col(label)
    return scored.agg(F.avg(right.cast("int")).alias("accuracy")).select(
        roc_auc(scored, label, score).alias("roc_auc"), "accuracy")


def split_by_date(df: DataFrame, date: str, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Rows before the cutoff, and from it on."""
    at = F.lit(cutoff).cast("date")
    return df.where(F.col(date) < at), df.where(F.col(date) >= at)


def top_share_metrics(scored: DataFrame, label: str, score: str,
                      share: float = 0.1) -> DataFrame:
    """Recall, precision and lift among the rows whose score reaches the top share's edge.

    Equal scores stay together, so more rows than the share may be taken.
    """
    edge = exact_quantiles(scored, [score], [1.0 - share])
    edge = edge.select(F.col(edge.columns[-1])).scalar()
    top = F.col(score) >= edge
    counts = scored.agg(
        F.count("*").alias("rows"), F.sum(label).alias("positives"),
        F.count_if(top).alias("top_rows"),
        F.sum(F.when(top, F.col(label)).otherwise(0)).alias("top_positives"))
    precision = F.try_divide(F.col("top_positives").cast("double"), F.col("top_rows"))
    base = F.try_divide(F.col("positives").cast("double"), F.col("rows"))
    return counts.select(
        "top_rows", "top_positives",
        F.try_divide(F.col("top_positives").cast("double"), F.col("positives")).alias("recall"),
        precision.alias("precision"), F.try_divide(precision, base).alias("lift"))


def area_under_pr(scored: DataFrame, label: str, score: str) -> float:
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    # Without bins every distinct score is a point of the curve.
    return BinaryClassificationEvaluator(
        rawPredictionCol=score, labelCol=label, metricName="areaUnderPR", numBins=0).evaluate(scored)
