"""Quantiles of any span from stored sketches.

A KLL sketch of each key and window is a small row that is written once; sketches of one key merge into the sketch of
any span of windows, of all keys, or of batch and stream together, without the values. Rank errors are those of the
sketch: with ``k`` = 200 about 1.33 % of the values for one quantile (99 % of the time), and as k grows they fall in
proportion. The least and the greatest value and the count are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_error(k: int) -> float:
    """The published bound of KLL for a single quantile, as a share of the values."""
    return 2.296 / k**0.9021


def window_sketches(df: DataFrame, keys: Sequence[str], time: str, value: str, duration: str, k: int = 200) -> DataFrame:
    """keys, window_start, window_end, sketch: on tables and on streams with a watermark on ``time``. Nulls are left out;
    a window of nothing else has an empty sketch."""
    w = F.window(F.col(time).cast("timestamp"), duration) if not df.isStreaming else F.window(time, duration)
    t = df.groupBy(*keys, w.alias("_w")).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))
    return t.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "sketch")


def merged(sketches: DataFrame, keys: Sequence[str], k: int = 200) -> DataFrame:
    """keys, sketch: of all windows of each key. Filter the windows first for a span."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def count_of(sketch: str) -> Column:
    return F.kll_sketch_get_n_double(sketch)


def quantile(sketch: str, p: float) -> Column:
    """Null for a sketch of nothing."""
    return F.when(count_of(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))))


def summary(sketches: DataFrame, keys: Sequence[str], ps: Sequence[float], names: Sequence[str]) -> DataFrame:
    """keys, n, least, most and one column a quantile, read from sketches."""
    return sketches.select(*keys, count_of("sketch").alias("n"), quantile("sketch", 0.0).alias("least"), quantile("sketch", 1.0).alias("most"), *[quantile("sketch", p).alias(c) for p, c in zip(ps, names, strict=True)])
