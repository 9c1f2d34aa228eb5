"""Files: daily history, hourly normals, nested payloads, result sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clean

#: Columns of the daily history and of the hourly normals, with their names here.
DAILY = {"STATION": "station_id", "NAME": "station_name", "LATITUDE": "latitude", "LONGITUDE": "longitude", "ELEVATION": "elevation", "DATE": "date", "TMAX": "temp_max", "TMIN": "temp_min", "TAVG": "temp_avg", "AWND": "wind_speed", "PRCP": "precipitation"}
NORMALS = {"DATE": "date", "HLY-TEMP-NORMAL": "temperature", "HLY-DEWP-NORMAL": "dewpoint", "HLY-WIND-AVGSPD": "wind_speed", "HLY-WIND-1STDIR": "wind_direction", "HLY-WIND-VCTDIR": "wind_vector_direction", "HLY-WIND-VCTSPD": "wind_vector_speed"}


def _text_columns(spark: SparkSession, path: str | Sequence[str], names: dict[str, str]) -> DataFrame:
    """All columns as text, those of ``names`` that exist; the header alone decides, data is not scanned for types."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path if isinstance(path, str) else list(path))
    return clean.wanted(df, names)


def daily_history(spark: SparkSession, path: str | Sequence[str], fill: bool = True) -> DataFrame:
    """Dates parsed, numbers coerced, the mean derived from both extremes, the rest filled by medians, sorted by date."""
    df = _text_columns(spark, path, DAILY).withColumn("date", F.to_date(F.try_to_timestamp("date")))
    numbers = [c for c in df.columns if c not in ("station_id", "station_name", "date")]
    df = df.withColumns({c: S.number(F.col(c)) for c in numbers})
    if {"temp_max", "temp_min"} <= set(df.columns):
        known = F.col("temp_avg") if "temp_avg" in df.columns else F.lit(None).cast("double")
        df = df.withColumn("temp_avg", clean.midpoint(known, F.col("temp_min"), F.col("temp_max")))
    df = df.withColumns(S.time_parts(F.col("date"))).drop("hour")
    weather = [c for c in ("temp_max", "temp_min", "temp_avg", "wind_speed", "precipitation") if c in df.columns]
    return (clean.median_impute(df, weather) if fill else df).orderBy("date")


def hourly_normals(spark: SparkSession, path: str | Sequence[str], year: int = 2012) -> DataFrame:
    """Dates without a year get a leap year; rows without temperature go; humidity is a proxy from the dew point."""
    df = _text_columns(spark, path, NORMALS)
    df = df.withColumn("date", F.try_to_timestamp(F.concat(F.lit(f"{year}-"), "date"), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    df = df.withColumns({c: S.number(F.col(c)) for c in df.columns if c != "date"})
    df = clean.drop_null(df, ["date", "temperature"])
    df = clean.median_impute(df, [c for c in df.columns if c not in ("date", "temperature")])
    m = clean.medians(df, ["dewpoint"])
    df = df.crossJoin(F.broadcast(m)).withColumn("humidity", S.humidity_proxy(F.col("dewpoint"), F.col("median_dewpoint"))).drop("median_dewpoint")  # m is one row
    return df.withColumns(S.time_parts(F.col("date"))).orderBy("date")


def climate_chunks(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Files of one object with metadata and records: one row for each record."""
    schema = "metadata struct<station_name:string,start_date:string,end_date:string,record_count:long,fetched_at:string,chunk_index:long>, records array<map<string,string>>"
    df = spark.read.schema(schema).option("multiLine", True).json(path if isinstance(path, str) else list(path))
    return df.select("metadata.station_name", "metadata.chunk_index", F.explode("records").alias("record"))


OBSERVATION = "timestamp string, temperature struct<value:double>, barometricPressure struct<value:double>, windSpeed struct<value:double>, relativeHumidity struct<value:double>, windDirection struct<value:double>, precipitationLastHour struct<value:double>"
PERIODS = "array<struct<startTime:string,temperature:double,relativeHumidity:struct<value:double>,windSpeed:string,windDirection:string,probabilityOfPrecipitation:struct<value:double>>>"


def observations(df: DataFrame, payload: str, station: str, units: str = "metric") -> DataFrame:
    """The flat observation of a nested payload. ``units="imperial"`` gives °F; missing rain is 0."""
    if units not in ("metric", "imperial"):
        raise ValueError(f"units are metric or imperial, not {units}")
    t = df.select(F.col(station).alias("station_id"), F.from_json(payload, OBSERVATION).alias("p"))
    temp = F.col("p.temperature.value")
    return t.select(
        "station_id",
        S.any_iso_timestamp(F.col("p.timestamp")).alias("timestamp"),
        (S.fahrenheit(temp) if units == "imperial" else F.round(temp, 1)).alias("temperature"),
        F.round("p.relativeHumidity.value", 2).alias("humidity"),
        F.round("p.windSpeed.value", 3).alias("wind_speed"),
        F.col("p.windDirection.value").alias("wind_direction"),
        S.hectopascal(F.col("p.barometricPressure.value")).alias("sea_level_pressure"),
        F.coalesce("p.precipitationLastHour.value", F.lit(0.0)).alias("precipitation_last_hour"),
    )


def forecast_periods(df: DataFrame, payload: str, station: str) -> DataFrame:
    """One row for each hour of a forecast."""
    t = df.select(F.col(station).alias("station_id"), F.explode(F.from_json(payload, PERIODS)).alias("p"))
    return t.select("station_id", S.any_iso_timestamp(F.col("p.startTime")).alias("start"), "p.temperature", F.col("p.relativeHumidity.value").alias("humidity"), F.try_to_number(F.regexp_extract("p.windSpeed", r"(\d+)", 1), F.lit("999")).cast("double").alias("wind_speed"), F.col("p.windDirection").alias("wind_direction"), F.coalesce("p.probabilityOfPrecipitation.value", F.lit(0.0)).alias("precipitation_probability"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)
