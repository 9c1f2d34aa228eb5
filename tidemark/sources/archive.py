"""The raw archive: partitioned by event date and station, appended with the commit log of its writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as S
from . import log


def with_partitions(df: DataFrame, time: str = "timestamp", name: str = "station_name") -> DataFrame:
    """event_date from the record's own time, the day of arrival where it has none; station as a path name."""
    day = F.coalesce(F.to_date(S.any_iso_timestamp(F.col(time))), F.current_date())
    return df.withColumns({"event_date": day, "station": S.path_name(F.coalesce(F.col(name), F.lit("unknown")))})


def write_archive(stream: DataFrame, path: str, checkpoint: str, fmt: str = "json", trigger: dict | None = None, query_name: str | None = None) -> StreamingQuery:
    """Files become visible batch by batch; a restart goes on after the last batch that was written."""
    writer = stream.writeStream.format(fmt).partitionBy("event_date", "station").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.queryName(query_name) if query_name else writer).trigger(**(trigger or {"availableNow": True})).start()


def read_archive(spark: SparkSession, path: str, schema: str = log.OBSERVATION, fmt: str = "json") -> DataFrame:
    """Filters on event_date and station choose folders, not rows."""
    return spark.read.format(fmt).schema(f"{schema}, event_date date, station string").load(path)


def audit(spark: SparkSession, path: str, schema: str = log.OBSERVATION) -> DataFrame:
    """Lines, valid and invalid, for each file."""
    lines = spark.read.text(path, recursiveFileLookup=True).withColumn("file", F.input_file_name())
    return log.validity(lines, "value", schema, ["file"])
