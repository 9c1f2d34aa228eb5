"""Frames around a forecaster: inputs, calendars, horizons, payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forecast_frame(df: DataFrame, time: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """ds and y of each series, nulls dropped, in time order."""
    return df.select(*keys, F.col(time).alias("ds"), F.col(value).alias("y")).dropna(subset=["ds", "y"]).orderBy(*keys, "ds")


def future_calendar(df: DataFrame, day: str, keys: Sequence[str], periods: int) -> DataFrame:
    """The days after each series' last."""
    last = df.groupBy(*keys).agg(F.max(day).alias("_last"))
    return last.select(*keys, F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", periods))).alias("ds"))


def cap_horizon(df: DataFrame, predictions: str, requested: str, most: int) -> DataFrame:
    """No more steps than the model gives in one pass."""
    h = F.least(F.col(requested), F.lit(most)).cast("long")
    return df.withColumns({"horizon": h, "predictions": F.slice(F.col(predictions), F.lit(1), h.cast("int"))})


def prediction_payload(df: DataFrame, key: str, predictions: str, conditions: Sequence[str]) -> DataFrame:
    """key, value: the nested prediction record as JSON, with window times as text."""
    start, end = (F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("window_start", "window_end"))
    record = F.struct(F.col(key), end.alias("timestamp"), start.alias("window_start"), end.alias("window_end"), F.struct(F.col(predictions).alias("temperature_predictions"), F.size(predictions).alias("horizon_hours")).alias("forecast"), F.size(predictions).alias("horizon_hours"), F.struct(*conditions).alias("current_conditions"))
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(record).alias("value"))
