"""Windowed and keyed aggregates. The same functions run on batch and on streaming DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import SeriesSpec
from .ranks import percentiles

STATS = ("mean", "std", "min", "max")


def _stats(metric: str) -> list[Column]:
    return [F.avg(metric).alias(f"{metric}_mean"), F.stddev_samp(metric).alias(f"{metric}_std"), F.min(metric).alias(f"{metric}_min"), F.max(metric).alias(f"{metric}_max")]


def circular_mean(degrees: str) -> Column:
    """Mean direction in [0, 360); null where directions cancel out or none is known."""
    angle = F.radians(F.col(degrees))
    s, c = F.avg(F.sin(angle)), F.avg(F.cos(angle))
    mean = F.pmod(F.round(F.degrees(F.atan2(s, c)), 6) + 360, F.lit(360.0))  # rounded, so that just below 0 is 0
    return F.when(s * s + c * c > 1e-18, mean)


def window_stats(df: DataFrame, spec: SeriesSpec, duration: str, slide: str | None = None, direction: str | None = None, precipitation: str | None = None) -> DataFrame:
    """Statistics of each metric for each key and time window; first and last time are event times.

    Works on streams: put a watermark on the time column first. The sample standard deviation of one value is null.
    """
    window = F.window(spec.time, duration, slide) if slide else F.window(spec.time, duration)
    aggs = [a for m in spec.metrics for a in _stats(m)]
    if direction:
        aggs += [F.avg(direction).alias(f"{direction}_mean"), circular_mean(direction).alias(f"{direction}_circular_mean")]
    if precipitation:
        aggs += [F.avg(precipitation).alias(f"{precipitation}_mean"), F.max(precipitation).alias(f"{precipitation}_max")]
    aggs += [F.count("*").alias("measurement_count"), F.min(spec.time).alias("window_first_timestamp"), F.max(spec.time).alias("window_last_timestamp")]
    out = df.groupBy(window.alias("window"), *spec.keys).agg(*aggs)
    return out.select(*spec.keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c not in ("window", *spec.keys)])


def pane_window_stats(df: DataFrame, spec: SeriesSpec, duration: str, slide: str) -> DataFrame:
    """``window_stats`` for metrics by way of panes of one slide: rows are summed up once before windows overlap.

    For a duration of many slides the expansion then multiplies panes, not rows. The slide must divide the duration.
    """
    panes = df.groupBy(F.window(spec.time, slide).alias("pane"), *spec.keys).agg(
        *[a for m in spec.metrics for a in (F.count(m).alias(f"n_{m}"), F.avg(m).alias(f"a_{m}"), F.var_pop(m).alias(f"v_{m}"), F.min(m).alias(f"lo_{m}"), F.max(m).alias(f"hi_{m}"))],
        F.count("*").alias("n"), F.min(spec.time).alias("t0"), F.max(spec.time).alias("t1"))
    panes = panes.withColumn("at", F.col("pane.start"))
    # Each pane carries count, mean and squared deviation; they add up by the parallel-variance rule.
    merged = []
    for m in spec.metrics:
        n, a, v = F.col(f"n_{m}"), F.col(f"a_{m}"), F.col(f"v_{m}")
        total = F.sum(n)
        mean = F.try_divide(F.sum(n * a), total)
        square = F.sum(n * v + n * a * a) - total * mean * mean
        merged += [mean.alias(f"{m}_mean"), F.when(total > 1, F.sqrt(F.greatest(square, F.lit(0.0)) / (total - 1))).alias(f"{m}_std"), F.min(f"lo_{m}").alias(f"{m}_min"), F.max(f"hi_{m}").alias(f"{m}_max")]
    out = panes.groupBy(F.window("at", duration, slide).alias("window"), *spec.keys).agg(*merged, F.sum("n").alias("measurement_count"), F.min("t0").alias("window_first_timestamp"), F.max("t1").alias("window_last_timestamp"))
    return out.select(*spec.keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c not in ("window", *spec.keys)])


def key_totals(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return df.groupBy(*spec.keys).agg(*[F.avg(m).alias(f"{m}_mean") for m in spec.metrics], F.count("*").alias("measurement_count"))


def partition_distribution(df: DataFrame, partition: str, key: str) -> DataFrame:
    """Rows, share and keys of each log partition. Keys are made distinct before they meet in one row."""
    pairs = df.groupBy(partition, key).agg(F.count("*").alias("n"))
    out = pairs.groupBy(partition).agg(F.sum("n").alias("messages"), F.count("*").alias("distinct_keys"))
    total = out.agg(F.sum("messages").alias("all_messages"))
    return out.crossJoin(F.broadcast(total)).withColumn("percent", 100.0 * F.col("messages") / F.col("all_messages")).drop("all_messages")


def key_partitions(df: DataFrame, partition: str, key: str) -> DataFrame:
    """The partitions each key has been seen in, sorted."""
    pairs = df.select(key, partition).distinct()
    return pairs.groupBy(key).agg(F.sort_array(F.collect_set(partition)).alias("partitions"), F.count("*").alias("n_partitions"))


def partition_balance(df: DataFrame, partition: str) -> DataFrame:
    """Largest deviation from the mean in percent, and a score of 100 (1 - coefficient of variation)."""
    n = df.groupBy(partition).agg(F.count("*").cast("double").alias("n"))
    one = n.agg(F.count("*").alias("partitions"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("sd"), F.max("n").alias("hi"), F.min("n").alias("lo"))
    worst = F.greatest(F.col("hi") - F.col("mean"), F.col("mean") - F.col("lo")) / F.col("mean") * 100
    return one.select("partitions", "mean", worst.alias("max_deviation_pct"), (100 * (1 - F.col("sd") / F.col("mean"))).alias("balance_score"), (worst <= 10).alias("within_target"))


def latency_percentiles(df: DataFrame, seconds: Column, by: Sequence[str], approximate: bool = False) -> DataFrame:
    """p50, p95 and p99. The exact form counts values in ranges, the approximate one keeps a bounded sketch."""
    ps = (0.5, 0.95, 0.99)
    t = df.withColumn("_s", seconds)
    if approximate:
        return t.groupBy(*by).agg(*[F.percentile_approx("_s", F.lit(p), F.lit(10_000)).alias(f"p{int(p * 100)}") for p in ps], F.count("*").alias("n"))
    exact = percentiles(t, ["_s"], ps, by).select(F.struct(*by).alias("_by"), *[F.col(f"p{i}").alias(f"p{int(p * 100)}") for i, p in enumerate(ps)])
    counts = t.groupBy(*by).agg(F.count("*").alias("n")).withColumn("_by", F.struct(*by))
    return counts.join(exact, "_by", "left").select(*by, *[f"p{int(p * 100)}" for p in ps], "n")


def throughput(df: DataFrame, time: str, interval: str, seconds: float) -> DataFrame:
    """Rows per second in each interval that has any."""
    t = df.groupBy(F.window(time, interval).alias("w")).agg(F.count("*").alias("messages"))
    return t.select(F.col("w.start").alias("interval_start"), "messages", (F.col("messages") / seconds).alias("per_second"))


def duplicate_rate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    out = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("messages"), F.count("*").alias("distinct_messages"), F.max("n").alias("most_copies"))
    return out.withColumn("duplicate_rate", F.coalesce(1 - F.try_divide(F.col("distinct_messages"), F.col("messages")), F.lit(0.0)))


def loss_rate(sent: DataFrame, received: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of sent keys that never arrived."""
    arrived = received.select(*keys).distinct().withColumn("_ok", F.lit(1))
    out = sent.select(*keys).distinct().join(arrived, list(keys), "left").agg(F.count("*").alias("sent"), F.count_if(F.col("_ok").isNull()).alias("lost"))
    return out.withColumn("loss_rate", F.coalesce(F.try_divide(F.col("lost"), F.col("sent")), F.lit(0.0)))


def ingest_summary(df: DataFrame, key: str, file: str, time: str) -> DataFrame:
    pairs = df.groupBy(key, file).agg(F.count("*").alias("n"), F.min(time).alias("t0"), F.max(time).alias("t1"))
    return pairs.groupBy(key).agg(F.sum("n").alias("records"), F.count("*").alias("files"), F.min("t0").alias("first_date"), F.max("t1").alias("last_date"))
