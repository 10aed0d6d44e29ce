"""Evaluation summaries, confusion scores and a boosted-tree gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Credible levels, in percent.
LEVELS = (50, 68, 90, 95)


def trial_summary(trials: DataFrame) -> DataFrame:
    """Coverage by level, top-k recall, medians and the split of dark cases, in one row. Means are over the trials that a
    figure is defined for."""
    done = F.col("attributed")
    share = lambda c, over: F.avg(F.when(over, c.cast("double")))
    named = done & ~F.col("dark_case")
    return trials.agg(
        F.count("*").alias("trials"), F.count_if("detected").alias("detected"), F.count_if(done).alias("attributed"),
        *[share(F.col(f"inside_{level}"), F.col("inverted")).alias(f"coverage_{level}") for level in LEVELS if f"inside_{level}" in trials.columns],
        share(F.coalesce(F.col("culprit_rank") <= 1, F.lit(False)), named).alias("top_1"), share(F.coalesce(F.col("culprit_rank") <= 3, F.lit(False)), named).alias("top_3"),
        F.median(F.when(done, F.col("reduction_factor"))).alias("median_reduction"), F.median(F.when(F.col("inverted"), F.col("area_95_km2"))).alias("median_area_95"),
        share(F.col("dark_is_top"), done & F.col("dark_case")).alias("dark_top_when_dark"), share(F.col("dark_is_top"), named).alias("dark_top_when_named"),
    )


def calibration_table(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage at each level, the median 95% area and the mean effective sample share of trials (inside_*, area_95_km2, ess_share),
    by keys."""
    levels = [F.avg(F.col(f"inside_{level}").cast("double")).alias(f"coverage_{level}") for level in LEVELS if f"inside_{level}" in trials.columns]
    return trials.groupBy(*keys).agg(F.count("*").alias("trials"), *levels, F.median("area_95_km2").alias("median_area_95"), F.avg("ess_share").alias("mean_ess_share"))


def by_lookback(trials: DataFrame) -> DataFrame:
    return trials.filter("inverted").groupBy("lookback_hours").agg(F.count("*").alias("trials"), F.median("area_95_km2").alias("median_area_95"), F.avg(F.col("inside_95").cast("double")).alias("coverage_95"))


def confusion(predictions: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    yes, said = F.col(label) == 1, F.col(prediction) == 1
    out = predictions.agg(F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(~yes & ~said).alias("tn"), F.count_if(yes & ~said).alias("fn"))
    return out.withColumn("false_positive_rate", F.try_divide("fp", F.col("fp") + F.col("tn"))).withColumn("specificity", F.try_divide("tn", F.col("fp") + F.col("tn"))).withColumn(
        "accuracy", F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    )


def train_gate(rows: DataFrame, features: list[str], label: str = "label", hold_out: str | None = None, trees: int = 20, depth: int = 4, seed: int = 1):
    """(model, training predictions, hold-out predictions): gradient-boosted trees; rows where hold_out is true stay out.

    The model warns of itself: `single_feature_share` tells how much of its gain comes from one feature.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    out = F.col(hold_out) if hold_out else F.lit(False)
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)]).fit(rows.filter(~out))
    return model, model.transform(rows.filter(~out)), model.transform(rows.filter(out))


def feature_importance(model, features: list[str]) -> list[tuple[str, float]]:
    gains = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, gains), strict=True), key=lambda x: (-x[1], x[0]))


def single_feature_share(model, features: list[str], limit: float = 0.8) -> tuple[float, bool]:
    """The largest feature's share of the gain, and whether it is so high that the model is degenerate."""
    top = feature_importance(model, features)[0][1]
    return top, top > limit
