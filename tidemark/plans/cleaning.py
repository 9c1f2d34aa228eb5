"""Queries: decoding, cleaning, scalar expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clean, evaluate
from ..sources import log
from .base import BY_USER, R, query, r, readings, rounded, table


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS key, CAST(user_id % 4 AS BIGINT) AS partition, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_decode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("key"), (F.col("user_id") % 4).alias("partition"), F.col("props").alias("value"))
    return log.decode(raw, "k long", carried=("event_id", "key", "partition"))


@query("""SELECT event_id % 3 AS file, count(*) AS lines, count(*) FILTER (WHERE event_id % 10 <> 0) AS valid, count(*) FILTER (WHERE event_id % 10 = 0) AS invalid FROM events GROUP BY 1""")
def json_validity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select((F.col("event_id") % 3).alias("file"), F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{broken "), F.col("props"))).otherwise(F.col("props")).alias("line"))
    return log.validity(lines, "line", "k long", ["file"])


@query("""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'not a time' WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+01:00' END AS text, ts FROM events)
SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN ts ELSE date_trunc('second', ts) - INTERVAL 1 HOUR END AS parsed FROM t""")
def parse_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 4 == 0, "not a time").when(F.col("event_id") % 4 == 1, F.concat(second, F.lit("+00:00"))).when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(F.concat(second, F.lit("+01:00")))
    return table(spark, sf_dir, "events").select("event_id", S.any_iso_timestamp(text).cast("timestamp_ntz").alias("parsed"))


@query(R + """SELECT event_id, temperature, humidity, coalesce(wind_speed, 0) AS wind_speed, coalesce(pressure, 1013.25e0) AS pressure FROM r""")
def fill_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.fill_constants(readings(spark, sf_dir)).select("event_id", "temperature", "humidity", "wind_speed", "pressure")


@query(R + """SELECT event_id, station, wind_speed, pressure FROM r WHERE wind_speed IS NOT NULL AND pressure IS NOT NULL""")
def drop_null_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.drop_null(readings(spark, sf_dir), ["wind_speed", "pressure"]).select("event_id", "station", "wind_speed", "pressure")


@query(R + """SELECT event_id, station, coalesce(wind_speed, (SELECT median(wind_speed) FROM r)) AS wind_speed, coalesce(pressure, (SELECT median(pressure) FROM r)) AS pressure FROM r""")
def median_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.median_impute(readings(spark, sf_dir).select("event_id", "station", "wind_speed", "pressure"), ["wind_speed", "pressure"])


@query(R + """, m AS (SELECT station, median(wind_speed) AS mw FROM r GROUP BY 1) SELECT event_id, station, coalesce(wind_speed, mw) AS wind_speed FROM r JOIN m USING (station)""")
def median_impute_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.median_impute(readings(spark, sf_dir).select("event_id", "station", "wind_speed"), ["wind_speed"], by=["station"])


@query(R + """SELECT event_id, round(coalesce(wind_speed, (temperature + humidity) / 2), 6) AS derived FROM r""")
def derive_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).select("event_id", r(clean.midpoint(F.col("wind_speed"), F.col("humidity"), F.col("temperature"))).alias("derived"))


@query("""SELECT event_id, TRY_CAST(CASE WHEN event_id % 6 = 0 THEN 'n/a' WHEN event_id % 6 = 1 THEN '' ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS num FROM events""")
def coerce_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 6 == 0, "n/a").when(F.col("event_id") % 6 == 1, "").otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", S.number(text).alias("num"))


@query(R + """SELECT event_id, user_id, coalesce(last_value(wind_speed IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(wind_speed IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS wind_speed FROM r""")
def ffill_bfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.forward_backward_fill(readings(spark, sf_dir).select("event_id", "user_id", "ts", "wind_speed"), BY_USER, ["wind_speed"]).select("event_id", "user_id", "wind_speed")


@query(R + """, c AS (SELECT 'wind_speed' AS column_name, CAST(wind_speed AS DOUBLE) AS v FROM r UNION ALL SELECT 'pressure', pressure FROM r UNION ALL SELECT 'humidity', humidity FROM r)
SELECT column_name, count(*) AS rows, count(v) AS non_null, min(v) AS least, max(v) AS most, round((count(*) - count(v)) / count(*), 6) AS null_fraction FROM c GROUP BY 1""")
def null_fraction_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(clean.null_profile(readings(spark, sf_dir), ["wind_speed", "pressure", "humidity"]), ["null_fraction"])


@query(R + """, f AS (SELECT station, avg(temperature) AS t, stddev_samp(temperature) AS ts_, min(temperature) AS tmin, max(temperature) AS tmax, avg(humidity) AS h FROM r GROUP BY 1)
SELECT station, round(t, 6) AS temperature, round(h, 6) AS humidity, 1013.25e0 AS pressure, round(ts_, 6) AS temperature_std, round(tmin, 6) AS temperature_min, round(tmax, 6) AS temperature_max FROM f""")
def feature_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = readings(spark, sf_dir).groupBy("station").agg(F.avg("temperature").alias("temperature_mean"), F.stddev_samp("temperature").alias("temperature_std"), F.min("temperature").alias("temperature_min"), F.max("temperature").alias("temperature_max"), F.avg("humidity").alias("humidity_avg"))
    return rounded(clean.adapt_features(f, ["temperature", "humidity", "pressure"], clean.DEFAULTS, ["station"]))


@query("""SELECT p_partkey, translate(p_name, ' /', '__') AS safe_name FROM part""")
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.path_name(F.col("p_name")).alias("safe_name"))


@query("""SELECT event_id, CAST(hour(ts) AS BIGINT) AS hour, CAST(dayofyear(ts) AS BIGINT) AS day_of_year, CAST(month(ts) AS BIGINT) AS month, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week, CAST(year(ts) AS BIGINT) AS year, CAST(weekofyear(ts) AS BIGINT) AS week FROM events""")
def time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in S.time_parts(F.col("ts")).items()])


@query("""SELECT event_id, round(sin(month(ts) * (2 * pi() / 12)), 6) AS month_sin, round(cos(month(ts) * (2 * pi() / 12)), 6) AS month_cos, round(sin(dayofyear(ts) * (2 * pi() / 365.25e0)), 6) AS day_sin, round(cos(dayofyear(ts) * (2 * pi() / 365.25e0)), 6) AS day_cos,
round(sin(weekofyear(ts) * (2 * pi() / 52)), 6) AS week_sin, round(cos(weekofyear(ts) * (2 * pi() / 52)), 6) AS week_cos FROM events""")
def cyclic_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"month": (F.month("ts"), 12), "day": (F.dayofyear("ts"), 365.25), "week": (F.weekofyear("ts"), 52)}
    return table(spark, sf_dir, "events").select("event_id", *[r(c).alias(f"{n}_{w}") for n, (v, p) in parts.items() for w, c in zip(("sin", "cos"), S.cyclic(v, p), strict=True)])


@query("""SELECT o_orderkey, CAST(month(o_orderdate) IN (12, 1, 2) AS BIGINT) AS is_winter, CAST(month(o_orderdate) IN (3, 4, 5) AS BIGINT) AS is_spring, CAST(month(o_orderdate) IN (6, 7, 8) AS BIGINT) AS is_summer, CAST(month(o_orderdate) IN (9, 10, 11) AS BIGINT) AS is_autumn FROM orders""")
def season_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in S.season_flags(F.col("o_orderdate")).items()])


@query(R + """SELECT event_id, round(CASE WHEN temperature > 80 AND humidity > 40 THEN temperature + 0.5e0 * (temperature + humidity) ELSE temperature END, 6) AS heat_index FROM r""")
def heat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).select("event_id", r(S.heat_index(F.col("temperature"), F.col("humidity"))).alias("heat_index"))


@query(R + """SELECT event_id, round(CASE WHEN temperature < 50 AND wind_speed > 3 THEN 35.74e0 + 0.6215e0 * temperature - 35.75e0 * pow(wind_speed, 0.16e0) + 0.4275e0 * temperature * pow(wind_speed, 0.16e0) ELSE temperature END, 6) AS wind_chill FROM r""")
def wind_chill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).select("event_id", r(S.wind_chill(F.col("temperature"), F.col("wind_speed"))).alias("wind_chill"))


@query(R + """SELECT event_id, round(temperature - (100 - humidity) / 5, 6) AS dew_point FROM r""")
def dewpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).select("event_id", r(S.dew_point(F.col("temperature"), F.col("humidity"))).alias("dew_point"))


@query(R + """SELECT event_id, round(least(greatest(50 + 2 * (temperature - (SELECT median(temperature) FROM r)), 0e0), 100e0), 6) AS humidity_proxy FROM r""")
def humidity_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = readings(spark, sf_dir).select("event_id", "temperature")
    m = clean.medians(t, ["temperature"])
    return t.crossJoin(F.broadcast(m)).select("event_id", r(S.humidity_proxy(F.col("temperature"), F.col("median_temperature"))).alias("humidity_proxy"))  # m is one row


@query(R + """SELECT event_id, round(round(temperature * 9 / 5 + 32, 1), 6) AS temp_f, round(pressure * 100 / 100, 2) AS pressure_hpa FROM r""")
def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).select("event_id", S.fahrenheit(F.col("temperature")).alias("temp_f"), S.hectopascal(F.col("pressure") * 100).alias("pressure_hpa"))


@query(R + """SELECT event_id, round(temperature - humidity, 6) AS temp_range, round((temperature + humidity) / 2, 6) AS temp_mid, round(wind_speed * ((temperature + humidity) / 2), 6) AS wind_temp, round(precipitation * ((temperature + humidity) / 2), 6) AS precip_temp, CAST(precipitation > 0 AS BIGINT) AS has_precip, round(ln(1 + precipitation), 6) AS log_precip FROM r""")
def interaction_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = S.interactions(F.col("temperature"), F.col("humidity"), F.col("wind_speed"), F.col("precipitation"))
    return rounded(readings(spark, sf_dir).select("event_id", *[c.alias(n) for n, c in cols.items()]))


@query("""WITH a AS (SELECT event_id, value, [value, value + 1, value - 2, value * 1.5e0, value / 2, value + 3, value - 4, value + 5] AS f FROM events)
SELECT event_id, round(list_avg(f), 6) AS avg_forecast, round(list_min(f), 6) AS min_forecast, round(list_max(f), 6) AS max_forecast, round(f[1] - value, 6) AS delta_first, round(list_avg(f[1:6]), 6) AS head_avg, round(list_avg(f[7:8]), 6) AS rest_avg FROM a""")
def array_forecast_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    t = table(spark, sf_dir, "events").select("event_id", "value", F.array(v, v + 1, v - 2, v * 1.5, v / 2, v + 3, v - 4, v + 5).alias("f"))
    return rounded(t.select("event_id", *[c.alias(n) for n, c in S.array_stats(F.col("f"), F.col("value")).items()]))


@query("""SELECT event_id, ts + to_hours(CAST(i AS INTEGER)) AS forecast_ts, round(value + i * 0.5e0, 6) AS predicted FROM events, generate_series(0, 3) t(i)""")
def forecast_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select("event_id", "ts", F.array(*[F.col("value") + i * 0.5 for i in range(4)]).alias("f"))
    return rounded(log.explode_forecast(t, "f", "ts", ("event_id",)))


@query(R + """, m AS (SELECT avg(temperature) AS mu, stddev_pop(temperature) AS sd FROM r WHERE event_id % 10 < 7) SELECT event_id, round((temperature - mu) / sd, 6) AS temperature_z FROM r, m""")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.standardise(readings(spark, sf_dir).select("event_id", "temperature"), ["temperature"], F.col("event_id") % 10 < 7).select("event_id", "temperature_z"))
