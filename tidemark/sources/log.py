"""The keyed log: decoding, encoding, auditing; file streams by default, a broker where its connector is there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

#: The declared schema of raw observations.
OBSERVATION = "station_id string, station_name string, timestamp string, temperature double, humidity double, wind_speed double, wind_direction double, sea_level_pressure double, precipitation_last_hour double"


def decode(raw: DataFrame, schema: str, carried: Sequence[str] = ("key", "timestamp", "partition"), value: str = "value") -> DataFrame:
    """The fields of a JSON value beside the envelope's columns; what does not parse is null."""
    names = [c for c in carried if c in raw.columns]
    data = F.from_json(F.col(value).cast("string"), schema)
    return raw.select(*[F.col(c).alias(f"_{c}") for c in names], data.alias("_data")).select(*[F.col(f"_{c}").alias(c) for c in names], "_data.*")


#: Raw names and those of ``spec.WEATHER``.
RENAMED = {"sea_level_pressure": "pressure", "precipitation_last_hour": "precipitation"}


def observations(raw: DataFrame, carried: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Raw observations of a keyed log under the names of ``spec.WEATHER``, with their time parsed. Lines that don't parse
    and rows without a station or a time go."""
    t = decode(raw, OBSERVATION, carried, value)
    t = t.withColumn("timestamp", S.any_iso_timestamp(F.col("timestamp"))).withColumnsRenamed(RENAMED)
    return t.dropna(subset=["station_id", "timestamp"])


def encode(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """key and value: the JSON of the columns, times as text, nulls left out."""
    names = list(columns or df.columns)
    times = {c for c, t in df.dtypes if t.startswith("timestamp")}
    body = F.struct(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in times else F.col(c) for c in names])
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(body).alias("value"))


def validity(lines: DataFrame, line: str, schema: str, by: Sequence[str]) -> DataFrame:
    """Lines that parse and lines that don't, for each file."""
    parsed = F.from_json(F.col(line), f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    bad = F.col("_p._corrupt_record").isNotNull() | F.col("_p").isNull()
    return lines.withColumn("_p", parsed).groupBy(*by).agg(F.count("*").alias("lines"), F.count_if(~bad).alias("valid"), F.count_if(bad).alias("invalid"))


def explode_forecast(df: DataFrame, values: str, start: str, carried: Sequence[str], start_offset: int = 0) -> DataFrame:
    """One row for each hour of a forecast array; the first stands at ``start`` plus the offset."""
    t = df.select(*carried, start, F.posexplode(values).alias("_i", "predicted"))
    return t.select(*carried, (F.col(start) + F.make_dt_interval(hours=F.col("_i") + start_offset)).alias("forecast_ts"), "predicted")


def has_broker_connector(spark: SparkSession) -> bool:
    try:
        spark.sparkContext._jvm.java.lang.Class.forName("org.apache.spark.sql.kafka010.KafkaSourceProvider")
    except Exception:  # py4j wraps ClassNotFoundException
        return False
    return True


def read_stream(spark: SparkSession, path: str | None = None, schema: str | None = None, fmt: str = "json", files_per_batch: int | None = None, brokers: str | None = None, topic: str | None = None, offsets_per_batch: int | None = None) -> DataFrame:
    """Files from the earliest on, or a topic where ``brokers`` is given; lost offsets don't stop a topic."""
    if brokers:
        reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topic).option("startingOffsets", "earliest").option("failOnDataLoss", "false")
        return (reader.option("maxOffsetsPerTrigger", offsets_per_batch) if offsets_per_batch else reader).load()
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)
