"""Registration, input views and rounding for the catalog."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import SeriesSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name; ``sql`` is its twin."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_readings(table(spark, sf_dir, "events"))


def as_readings(events: DataFrame) -> DataFrame:
    """``events`` as station readings: value is the temperature, props.k the humidity, the rest follows event_id."""
    i = F.col("event_id")
    return events.select(
        "event_id",
        "user_id",
        F.col("event_type").alias("station"),
        "ts",
        F.col("value").alias("temperature"),
        F.get_json_object("props", "$.k").cast("double").alias("humidity"),
        F.when(i % 7 != 0, (i % 23) * 1.5).alias("wind_speed"),
        (i % 360).cast("double").alias("wind_direction"),
        F.when(i % 13 != 0, 990 + (i % 41) * 0.75).alias("pressure"),
        F.when(i % 5 == 0, (i % 9) * 0.1).otherwise(0.0).alias("precipitation"),
    )


#: The same view in SQL.
R = """WITH r AS (SELECT event_id, user_id, event_type AS station, ts, value AS temperature, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS humidity,
  CASE WHEN event_id % 7 <> 0 THEN (event_id % 23) * 1.5e0 END AS wind_speed, CAST(event_id % 360 AS DOUBLE) AS wind_direction,
  CASE WHEN event_id % 13 <> 0 THEN 990 + (event_id % 41) * 0.75e0 END AS pressure,
  CASE WHEN event_id % 5 = 0 THEN (event_id % 9) * 0.1e0 ELSE 0e0 END AS precipitation FROM events) """

BY_STATION = SeriesSpec(("station",), "ts", ("event_id",), ("temperature", "humidity", "pressure", "wind_speed"))
BY_USER = SeriesSpec(("user_id",), "ts", ("event_id",), ("temperature", "humidity", "pressure", "wind_speed"))


def rounded(df: DataFrame, columns: Iterable[str] | None = None, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places: sums depend on the order of their rows."""
    names = set(columns) if columns is not None else {c for c, t in df.dtypes if t == "double"}
    return df.select(*[F.round(c, places).alias(c) if c in names else F.col(c) for c in df.columns])


def r(c: Column, places: int = 6) -> Column:
    return F.round(c, places)
