"""Forecasts against actual values as they arrive, and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate


def matched(predictions: DataFrame, actuals: DataFrame, key: str, late: str = "10 minutes", tolerance: str = "30 minutes") -> DataFrame:
    """predictions: key, target_ts, predicted. actuals: key, ts, actual. Both watermarked, joined within the tolerance.

    State on both sides ends with the watermark and the tolerance, on batch inputs the same join runs without state.
    """
    p = predictions.select(F.col(key), F.col("target_ts").cast("timestamp").alias("target_ts"), "predicted").withWatermark("target_ts", late).alias("p")
    a = actuals.select(F.col(key).alias("_key"), F.col("ts").cast("timestamp").alias("ts"), "actual").withWatermark("ts", late).alias("a")
    near = F.expr(f"ts >= target_ts - interval {tolerance} and ts <= target_ts + interval {tolerance}")
    return p.join(a, (F.col(key) == F.col("_key")) & near).drop("_key")


def running_metrics(pairs: DataFrame, key: str, window: str = "1 hour") -> DataFrame:
    """MAE, RMSE and the rest for each key and window of actual time; rows of ``matched``."""
    t = pairs.withColumn("w", F.window("ts", window))
    return evaluate.regression(t, [key, "w"], "actual", "predicted").select(key, F.col("w.start").alias("window_start"), "mae", "rmse", "n")


def drift(metrics: DataFrame, baseline: DataFrame, key: str, factor: float = 1.5) -> DataFrame:
    """Windows whose MAE exceeds the key's baseline by the factor. baseline: key, baseline_mae."""
    return metrics.join(baseline, key, "left").withColumn("drifted", F.coalesce(F.col("mae") > factor * F.col("baseline_mae"), F.lit(False)))
