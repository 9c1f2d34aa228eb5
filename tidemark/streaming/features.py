"""Streaming jobs around the batch operators: windows, dedup, scoring, sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import aggregate, clean
from ..sources import log
from ..spec import WEATHER, SeriesSpec

LATE = "10 minutes"


def event_time(df: DataFrame, time: str) -> DataFrame:
    """Watermarks need a TIMESTAMP, not one without a zone."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def dedup(stream: DataFrame, spec: SeriesSpec, late: str = LATE) -> DataFrame:
    """Each key and time once; state older than the watermark goes."""
    return event_time(stream, spec.time).withWatermark(spec.time, late).dropDuplicatesWithinWatermark([*spec.keys, spec.time])


def window_features(stream: DataFrame, spec: SeriesSpec, duration: str = "1 minute", slide: str | None = None, late: str = LATE, fill: str = "constant", distinct: bool = False, **options) -> DataFrame:
    """The batch statistics on a stream. ``distinct`` drops repeated readings first, which counts polls once."""
    df = dedup(stream, spec, late) if distinct else event_time(stream, spec.time).withWatermark(spec.time, late)
    return aggregate.window_stats(clean.fill_constants(df, mode=fill), spec, duration, slide, **options)


def weather_records(raw: DataFrame, duration: str = "1 minute", slide: str | None = None, late: str = LATE, fill: str = "constant", distinct: bool = False) -> DataFrame:
    """From the raw topic to the feature topic: key and value of the statistics of each station and window."""
    readings = log.observations(raw)
    stats = window_features(readings, WEATHER, duration, slide, late, fill, distinct, direction="wind_direction", precipitation="precipitation")
    return log.encode(stats, "station_id")


def upsert_sink(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "update", trigger: dict | None = None, name: str | None = None) -> StreamingQuery:
    """Every batch goes to ``write`` with its number. In update mode a window comes again whenever it has changed:
    the writer keeps the latest by key and window, and must not count a batch number twice."""
    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode)
    return (writer.queryName(name) if name else writer).trigger(**(trigger or {"availableNow": True})).start()


def file_sink(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", trigger: dict | None = None) -> StreamingQuery:
    """Append mode: a window is written once, when the watermark has passed it."""
    return df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def topic_sink(df: DataFrame, key: str, brokers: str, topic: str, checkpoint: str, mode: str = "update", trigger: dict | None = None) -> StreamingQuery:
    """Keyed JSON to a topic, at least once."""
    return log.encode(df, key).writeStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic).option("checkpointLocation", checkpoint).outputMode(mode).trigger(**(trigger or {"processingTime": "1 minute"})).start()


def latest_versions(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """What a consumer of update mode keeps: the last version of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*")
