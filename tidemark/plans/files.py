"""Queries that write the given tables as the files of a source or sink and read them back, checked against SQL."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..forecast import models, scoring
from ..operators import clean
from ..sources import archive, history, log
from ..sources.shared import new_path, stored
from ..streaming import features
from .aggregates import SLIDES
from .base import R, query, readings, rounded, table

RAW_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a keyed log of raw observations under the declared schema; nulls are absent fields."""
    t = readings(spark, sf_dir)
    body = F.struct(F.col("station").alias("station_id"), F.concat(F.lit("Station/"), "station").alias("station_name"), F.date_format("ts", RAW_TIME).alias("timestamp"), "temperature", "humidity", "wind_speed", "wind_direction", F.col("pressure").alias("sea_level_pressure"), F.when(F.col("precipitation") > 0, F.col("precipitation")).alias("precipitation_last_hour"))
    return t.select("event_id", F.col("station").alias("key"), F.to_json(body).alias("value"))


@query(f"""{R}{SLIDES}, f AS (SELECT station, window_start, avg(temperature) AS t, avg(coalesce(pressure, 1013.25e0)) AS p, avg(coalesce(wind_speed, 0e0)) AS w, max(precipitation) AS rain, count(*) AS n FROM s GROUP BY 1, 2)
SELECT station AS key, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, n AS measurement_count, round(t, 4) AS temperature_mean, round(p, 4) AS pressure_mean, round(w, 4) AS wind_speed_mean, round(rain, 4) AS precipitation_max FROM f""")
def observation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: raw keyed JSON, decoded, filled, put into sliding windows, and encoded; read back field by field."""
    records = features.weather_records(_raw(spark, sf_dir), "5 minutes", "1 minute")
    back = log.decode(records, "window_start string, measurement_count long, temperature_mean double, pressure_mean double, wind_speed_mean double, precipitation_max double", carried=("key",))
    return rounded(back, places=4)


@query("""SELECT CAST(ts AS DATE) AS event_date, event_type AS station, count(*) AS lines, round(sum(value), 4) AS total FROM events WHERE event_type <> 'view' AND ts >= (SELECT date_trunc('day', min(ts)) + INTERVAL 2 DAY FROM events) GROUP BY 1, 2""")
def archive_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream into the archive that is stopped between its files and goes on: nothing is lost, nothing comes twice. The
    filters on day and station choose folders."""
    root = new_path(spark, "archive")
    raw = _raw(spark, sf_dir)
    halves = raw.select("value", F.pmod(F.xxhash64("event_id"), F.lit(2)).alias("half"))
    for half in (0, 1):
        halves.where(F.col("half") == half).select("value").write.mode("append").text(f"{root}/in")
        lines = log.read_stream(spark, f"{root}/in", "value string", "text")
        rows = archive.with_partitions(log.decode(lines, log.OBSERVATION, ()), name="station_id")
        q = archive.write_archive(rows, f"{root}/data", f"{root}/checkpoint")
        try:
            q.awaitTermination()
        finally:
            q.stop()
    first = table(spark, sf_dir, "events").agg(F.date_add(F.to_date(F.min("ts")), 2)).first()[0]
    t = archive.read_archive(spark, f"{root}/data").where((F.col("event_date") >= F.lit(first)) & (F.col("station") != "view"))
    return rounded(t.groupBy("event_date", "station").agg(F.count("*").alias("lines"), F.sum("temperature").alias("total")), places=4)


@query("""WITH d AS (SELECT o_orderpriority AS s, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS hi, min(o_totalprice) AS lo, count(*) AS n FROM orders GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN n % 3 <> 0 THEN CAST(n AS DOUBLE) END AS rain FROM d)
SELECT s AS station_id, strftime(date, '%Y-%m-%d') AS date, round((hi + lo) / 2, 4) AS temp_avg, coalesce(rain, (SELECT median(rain) FROM w)) AS precipitation, CAST(month(date) AS BIGINT) AS month FROM w""")
def history_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily history through its CSV files: means derived from both extremes, the rest filled by medians."""
    day = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("STATION"), F.to_date("o_orderdate").alias("DATE")).agg(F.max("o_totalprice").alias("TMAX"), F.min("o_totalprice").alias("TMIN"), F.count("*").alias("n"))
    path = new_path(spark, "history")
    history.write_csv(day.withColumn("PRCP", F.when(F.col("n") % 3 != 0, F.col("n").cast("double"))).drop("n"), path)
    t = history.daily_history(spark, path)
    return rounded(t.select("station_id", F.date_format("date", "yyyy-MM-dd").alias("date"), "temp_avg", "precipitation", "month"), ["temp_avg"], 4)


@query("""WITH h AS (SELECT hour(ts) AS h, avg(value) AS temp, avg(value) - 3 AS dew FROM events GROUP BY 1), k AS (SELECT h, temp, CASE WHEN h % 5 <> 0 THEN dew END AS dew FROM h), f AS (SELECT h, temp, coalesce(dew, (SELECT median(dew) FROM k)) AS dew FROM k)
SELECT CAST(h AS BIGINT) AS hour, round(temp, 4) AS temperature, round(least(greatest(50 + 2 * (dew - (SELECT median(dew) FROM f)), 0e0), 100e0), 4) AS humidity FROM f""")
def normals_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly normals through their CSV files: dates without a year, humidity by its proxy."""
    hour = table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("h")).agg(F.avg("value").alias("t"))
    rows = hour.select(F.format_string("02-29T%02d:00:00", "h").alias("DATE"), F.col("t").alias("HLY-TEMP-NORMAL"), F.when(F.col("h") % 5 != 0, F.col("t") - 3).alias("HLY-DEWP-NORMAL"))
    path = new_path(spark, "normals")
    history.write_csv(rows, path)
    return rounded(history.hourly_normals(spark, path).select("hour", "temperature", "humidity"), places=4)


@query("""SELECT event_id, event_type AS station_id, ts AS timestamp, round(value, 1) AS temperature, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 100 AS DOUBLE) END AS humidity, round((95000 + event_id % 9000) / 100, 2) AS sea_level_pressure, CASE WHEN event_id % 3 = 0 THEN 1.5e0 ELSE 0e0 END AS precipitation_last_hour FROM events""")
def payload_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested payload of an observation service, flattened."""
    i = F.col("event_id")
    body = F.struct(
        F.date_format("ts", RAW_TIME).alias("timestamp"),
        F.struct(F.col("value").alias("value")).alias("temperature"),
        F.struct(F.when(i % 4 != 0, (i % 100).cast("double")).alias("value")).alias("relativeHumidity"),
        F.struct((95000 + i % 9000).cast("double").alias("value")).alias("barometricPressure"),
        F.struct(F.when(i % 3 == 0, 1.5).alias("value")).alias("precipitationLastHour"),
    )
    raw = table(spark, sf_dir, "events").select(F.concat_ws("|", "event_id", "event_type").alias("who"), F.to_json(body).alias("payload"))
    t = history.observations(raw, "payload", "who").withColumn("event_id", F.split_part("station_id", F.lit("|"), F.lit(1)).cast("long"))
    return t.select("event_id", F.split_part("station_id", F.lit("|"), F.lit(2)).alias("station_id"), F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "temperature", "humidity", "sea_level_pressure", "precipitation_last_hour")


class Doubling:
    """A stand-in for a trained model: refuses what it cannot score."""

    def predict(self, x: np.ndarray) -> np.ndarray:
        if (x > 90).any():
            raise OverflowError("above 90")
        return np.hstack([x * 2, x + 1])


@query("""SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL WHEN value > 90 THEN NULL ELSE round(value * 2, 6) END AS first_step, CASE WHEN event_id % 13 = 0 THEN 'ValueError: a feature is missing' WHEN value > 90 THEN 'OverflowError: above 90' END AS error FROM events""")
def score_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of feature rows, scored in its tasks; what cannot be scored is kept beside its error."""
    root = new_path(spark, "scoring")
    t = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("v"))
    t = stored(t)
    out = scoring.score(spark.readStream.schema(t.schema).parquet(t.inputFiles()[0].rsplit("/", 1)[0]), Doubling, ["v"])
    q = features.file_sink(out, f"{root}/data", f"{root}/checkpoint")
    try:
        q.awaitTermination()
    finally:
        q.stop()
    done = spark.read.schema(out.schema).parquet(f"{root}/data")
    return rounded(done.select("event_id", F.try_element_at("predictions", F.lit(1)).alias("first_step"), "error"))


@query("""SELECT event_type || '/' || (event_id % 2) AS station_name, event_id % 2 AS chunk_index, event_id, value FROM events""")
def chunk_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one object each, with metadata and records."""
    path = new_path(spark, "chunks")
    e = table(spark, sf_dir, "events").withColumn("chunk_index", F.col("event_id") % 2)
    record = F.struct(F.col("event_id").cast("string").alias("id"), F.col("value").cast("string").alias("v"))
    chunks = e.groupBy("event_type", "chunk_index").agg(F.collect_list(record).alias("records"), F.count("*").alias("record_count"))
    name = F.concat_ws("/", "event_type", F.col("chunk_index").cast("string"))
    body = F.struct(F.struct(name.alias("station_name"), "record_count", "chunk_index").alias("metadata"), "records")
    chunks.select(F.to_json(body).alias("value"), F.concat_ws("-", "event_type", "chunk_index").alias("file")).repartition("file").write.partitionBy("file").text(path)
    t = history.climate_chunks(spark, path)
    return t.select("station_name", "chunk_index", F.col("record.id").cast("long").alias("event_id"), F.col("record.v").cast("double").alias("value"))


@query("""WITH p AS (SELECT event_id, ts, value, i FROM events, (SELECT unnest([0, 1]) AS i))
SELECT event_id, CAST(date_trunc('hour', ts) + i * INTERVAL 1 HOUR AS TIMESTAMP) AS start, value + i AS temperature, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 100 AS DOUBLE) END AS humidity,
  CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 40 AS DOUBLE) END AS wind_speed, CASE WHEN event_id % 5 = 0 THEN 30e0 ELSE 0e0 END AS precipitation_probability FROM p""")
def payload_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly periods of a forecast service, one row each."""
    i = F.col("event_id")

    def period(hour: int) -> F.Column:
        return F.struct(
            F.date_format(F.date_trunc("hour", "ts") + F.expr(f"interval {hour} hour"), RAW_TIME).alias("startTime"),
            (F.col("value") + hour).alias("temperature"),
            F.struct(F.when(i % 4 != 0, (i % 100).cast("double")).alias("value")).alias("relativeHumidity"),
            F.when(i % 3 != 0, F.concat((i % 40).cast("string"), F.lit(" mph"))).alias("windSpeed"),
            F.lit("NW").alias("windDirection"),
            F.struct(F.when(i % 5 == 0, 30.0).alias("value")).alias("probabilityOfPrecipitation"),
        )

    raw = table(spark, sf_dir, "events").select(i.cast("string").alias("who"), F.to_json(F.array(period(0), period(1))).alias("payload"))
    t = history.forecast_periods(raw, "payload", "who")
    return t.select(F.col("station_id").cast("long").alias("event_id"), F.col("start").cast("timestamp_ntz").alias("start"), "temperature", "humidity", "wind_speed", "precipitation_probability")


@query(R + """SELECT event_id, printf('%.4f,%.4f,%.4f', humidity, precipitation, temperature) AS features FROM r WHERE humidity IS NOT NULL AND precipitation IS NOT NULL AND temperature IS NOT NULL""")
def mapped_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features under the names a model wants, by stand-ins where they have others, as vectors in a fixed order."""
    have = readings(spark, sf_dir).withColumnsRenamed({"temperature": "temp_avg", "precipitation": "rain"})
    names = clean.map_feature_set(have.columns, ["temperature", "precipitation", "humidity"], {"temperature": ["temp_mean", "temp_avg"], "precipitation": ["rain"]})
    named = have.select("event_id", *[F.col(b).alias(a) for a, b in names.items()])
    vectors = models.assembler(list(names)).transform(named).withColumn("v", vector_to_array("features"))
    return vectors.select("event_id", F.array_join(F.transform("v", lambda x: F.format_string("%.4f", x)), ",").alias("features"))
