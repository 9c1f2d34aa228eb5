"""Statistical anomalies with reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import SeriesSpec
from .align import small
from .ranks import percentiles


def zscore(df: DataFrame, spec: SeriesSpec, metric: str, width: int = 20, limit: float = 3.0, least: int = 5) -> DataFrame:
    """Against the mean and sample deviation of the ``width`` rows before; too few of them or no spread scores 0."""
    w = spec.rows().rowsBetween(-width, -1)
    n, mu, sd = F.count(metric).over(w), F.avg(metric).over(w), F.stddev_samp(metric).over(w)
    score = F.when(n >= least, F.coalesce(F.try_divide(F.abs(F.col(metric) - mu), sd), F.lit(0.0))).otherwise(0.0)
    t = df.withColumns({"score": score, "_mu": mu})
    high, low = (F.col("score") > limit) & (F.col(metric) > F.col("_mu")), (F.col("score") > limit) & (F.col(metric) < F.col("_mu"))
    return t.withColumns({"is_anomaly": F.col("score") > limit, "reasons": F.array_compact(F.array(F.when(high, f"{metric} above recent range"), F.when(low, f"{metric} below recent range")))}).drop("_mu")


def iqr(df: DataFrame, spec: SeriesSpec, metric: str, factor: float = 1.5, approximate: bool = False) -> DataFrame:
    """Rows outside the quartile fences of their key. The fences are one row for each key, joined back."""
    if approximate:
        q = [F.percentile_approx(metric, F.lit(p), F.lit(10_000)) for p in (0.25, 0.75)]
        fences = df.groupBy(*spec.keys).agg(q[0].alias("_q1"), q[1].alias("_q3"))
    else:
        fences = percentiles(df, [metric], [0.25, 0.75], spec.keys).select(*spec.keys, F.col("p0").alias("_q1"), F.col("p1").alias("_q3"))
    t = df.join(small(fences), list(spec.keys))
    spread = F.col("_q3") - F.col("_q1")
    return t.withColumn("is_anomaly", (F.col(metric) < F.col("_q1") - factor * spread) | (F.col(metric) > F.col("_q3") + factor * spread)).withColumnsRenamed({"_q1": "q1", "_q3": "q3"})
