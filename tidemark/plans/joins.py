"""Queries: unions, joins, alignment, serving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align, serving
from .base import query, r, rounded, table


@query("""SELECT o_orderdate AS day, o_orderkey AS id, o_totalprice AS amount, CAST(NULL AS DOUBLE) AS value FROM orders UNION ALL SELECT CAST(date_trunc('day', ts) AS TIMESTAMP), event_id, NULL, value FROM events""")
def union_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    events = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.col("event_id").alias("id"), "value")
    return align.union_history([orders, events], ["day", "id"])


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders UNION SELECT strftime(l_shipdate, '%Y-%m-%d') FROM lineitem""")
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.union_distinct([table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), table(spark, sf_dir, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))], "day")


@query("""SELECT e.event_id, e.value AS y_true, round(e.value * 0.9e0 + (e.event_id % 7), 6) AS y_pred FROM events e WHERE e.event_id % 3 = 0""")
def semi_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    predicted = e.where("event_id % 3 = 0").select("event_id", r(F.col("value") * 0.9 + F.col("event_id") % 7).alias("y_pred"))
    return align.semi_align(e.select("event_id", F.col("value").alias("y_true")), predicted, ["event_id"])


@query("""SELECT s_suppkey, s_nationkey, coalesce(n_name, 'unknown') AS n_name, coalesce(n_regionkey, -1) AS n_regionkey FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON s_nationkey = n_nationkey""")
def dim_lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").withColumnRenamed("n_nationkey", "s_nationkey")
    return align.lookup(table(spark, sf_dir, "supplier"), dim, "s_nationkey", {"n_name": "unknown", "n_regionkey": -1}).select("s_suppkey", "s_nationkey", "n_name", "n_regionkey")


@query("""WITH t AS (SELECT event_type, event_id, user_id % 4 AS partition, CAST(value AS VARCHAR) AS payload, CASE event_id % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'features' ELSE 'predictions' END AS src FROM events),
k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY src, partition ORDER BY event_id DESC) <= 10)
SELECT event_type, coalesce(string_agg(payload, ',' ORDER BY event_id DESC) FILTER (WHERE src = 'raw'), '') AS raw, coalesce(string_agg(payload, ',' ORDER BY event_id DESC) FILTER (WHERE src = 'features'), '') AS features, coalesce(string_agg(payload, ',' ORDER BY event_id DESC) FILTER (WHERE src = 'predictions'), '') AS predictions FROM k GROUP BY 1""")
def station_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select("event_type", "event_id", (F.col("user_id") % 4).alias("partition"), F.col("value").cast("string").alias("payload"))
    names = ("raw", "features", "predictions")
    view = serving.station_view({n: t.where(F.col("event_id") % 3 == i) for i, n in enumerate(names)}, "event_type", "partition", "event_id")
    return view.select("event_type", *[F.array_join(n, ",").alias(n) for n in names])


@query("""WITH f AS (SELECT event_type, date_trunc('hour', ts) + INTERVAL 1 HOUR AS target_ts, avg(value) AS predicted FROM events GROUP BY ALL), a AS (SELECT event_type, date_trunc('hour', ts) AS ts, avg(value) AS actual FROM events GROUP BY ALL)
SELECT f.event_type, target_ts, round(predicted, 6) AS predicted, round(actual, 6) AS actual, round(predicted - actual, 6) AS error FROM f JOIN a ON f.event_type = a.event_type AND target_ts = a.ts""")
def forecast_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    hourly = e.groupBy("event_type", F.col("hour").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("actual"))
    forecasts = hourly.select("event_type", (F.col("ts") + F.expr("interval 1 hour")).alias("target_ts"), F.col("actual").alias("predicted"))
    return rounded(align.forecast_vs_actual(forecasts, hourly, "event_type"))


@query("""WITH l AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, value AS last_value FROM events WHERE event_type = 'view') SELECT l.event_id, l.user_id, l.ts, v.last_value FROM l ASOF LEFT JOIN v ON l.user_id = v.user_id AND l.ts >= v.ts""")
def asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_value"))
    return align.asof_latest(left, right, ["user_id"], "ts", ["last_value"], "event_id")


@query("""WITH l AS (SELECT event_id, date_trunc('hour', ts) AS hour FROM events WHERE event_type = 'purchase'), v AS (SELECT date_trunc('hour', ts) AS hour, arg_max(value, event_id) AS last_value, max(event_id) AS last_event FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT l.event_id, CASE WHEN v.hour >= l.hour - INTERVAL 2 HOUR THEN last_value END AS last_value, CASE WHEN v.hour >= l.hour - INTERVAL 2 HOUR THEN last_event END AS last_event FROM l ASOF LEFT JOIN v ON l.hour >= v.hour""")
def asof_one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long series without a key, many rows at one time on both sides, and a tolerance."""
    e = table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    left = e.where("event_type = 'purchase'").select("event_id", "hour")
    right = e.where("event_type = 'view'").select("hour", F.col("value").alias("last_value"), F.col("event_id").alias("last_event"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return align.asof_latest(left, right, [], "hour", ["last_value", "last_event"], "event_id", ["last_event"], "2 hours", parts).drop("hour")


@query("""SELECT (SELECT count(DISTINCT user_id) FROM events WHERE event_type IN ('view', 'click')) AS stations, (SELECT count(*) FROM events WHERE event_type = 'click') AS predictions, (SELECT count(*) FROM events WHERE event_type = 'click' AND value > 100) AS anomalies""")
def serving_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return serving.serving_summary(e.where("event_type = 'view'"), e.where("event_type = 'click'").withColumn("flag", F.col("value") > 100), "user_id", "flag")
