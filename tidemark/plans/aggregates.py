"""Queries: window and keyed aggregates, health of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import sketches
from ..sources import log
from ..sources.shared import stored
from ..spec import SeriesSpec
from .base import BY_STATION, R, query, r, readings, rounded, table

STATS_SQL = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std, round(min({m}), 6) AS {m}_min, round(max({m}), 6) AS {m}_max" for m in BY_STATION.metrics)
CIRCULAR_SQL = "CASE WHEN pow(avg(sin(radians(wind_direction))), 2) + pow(avg(cos(radians(wind_direction))), 2) > 1e-18 THEN round((round(degrees(atan2(avg(sin(radians(wind_direction))), avg(cos(radians(wind_direction))))), 6) + 360) % 360, 6) END"
TAIL_SQL = f"round(avg(wind_direction), 6) AS wind_direction_mean, {CIRCULAR_SQL} AS wind_direction_circular_mean, round(avg(precipitation), 6) AS precipitation_mean, round(max(precipitation), 6) AS precipitation_max, count(*) AS measurement_count, min(ts) AS window_first_timestamp, max(ts) AS window_last_timestamp"
SLIDES = ", s AS (SELECT unnest(generate_series(time_bucket(INTERVAL 1 MINUTE, ts) - INTERVAL 4 MINUTE, time_bucket(INTERVAL 1 MINUTE, ts), INTERVAL 1 MINUTE)) AS window_start, * FROM r)"


def _sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.window_stats(readings(spark, sf_dir), BY_STATION, "5 minutes", "1 minute", "wind_direction", "precipitation")


@query(f"{R}{SLIDES} SELECT station, window_start, window_start + INTERVAL 5 MINUTE AS window_end, {STATS_SQL}, {TAIL_SQL} FROM s GROUP BY station, window_start")
def sliding_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_sliding(spark, sf_dir))


@query(f"{R} SELECT station, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, {STATS_SQL}, {TAIL_SQL} FROM r GROUP BY station, time_bucket(INTERVAL 1 HOUR, ts)")
def tumbling_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.window_stats(readings(spark, sf_dir), BY_STATION, "1 hour", None, "wind_direction", "precipitation"))


@query(f"{R}, s AS (SELECT unnest(generate_series(time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 50 MINUTE, time_bucket(INTERVAL 10 MINUTE, ts), INTERVAL 10 MINUTE)) AS window_start, * FROM r) SELECT station, window_start, window_start + INTERVAL 1 HOUR AS window_end, {STATS_SQL}, count(*) AS measurement_count, min(ts) AS window_first_timestamp, max(ts) AS window_last_timestamp FROM s GROUP BY station, window_start")
def pane_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.pane_window_stats(readings(spark, sf_dir), BY_STATION, "1 hour", "10 minutes"))


@query("""SELECT l_returnflag, time_bucket(INTERVAL 7 DAY, l_shipdate, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 7 DAY, l_shipdate, TIMESTAMP '1970-01-01') + INTERVAL 7 DAY AS window_end,
round(avg(l_quantity), 10) AS l_quantity_mean, round(stddev_samp(l_quantity), 10) AS l_quantity_std, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
round(avg(l_discount), 10) AS l_discount_mean, round(stddev_samp(l_discount), 10) AS l_discount_std, min(l_discount) AS l_discount_min, max(l_discount) AS l_discount_max,
count(*) AS measurement_count, min(l_shipdate) AS window_first_timestamp, max(l_shipdate) AS window_last_timestamp FROM lineitem GROUP BY ALL""")
def weekly_lineitem_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = SeriesSpec(("l_returnflag",), "l_shipdate", (), ("l_quantity", "l_discount"))
    return rounded(A.window_stats(table(spark, sf_dir, "lineitem"), spec, "7 days"), places=10)  # means of hundredths end in a tie at few places


@query(f"""{R}{SLIDES}, w AS (SELECT station, window_start, avg(temperature) AS t, count(*) AS n FROM s GROUP BY 1, 2)
SELECT station AS key, strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, n AS measurement_count, round(t, 4) AS temperature_mean FROM w""")
def json_encode_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded as the sink does and read back: what a consumer of the feature topic sees."""
    w = _sliding(spark, sf_dir)
    encoded = log.encode(w, "station", ["station", "window_start", "measurement_count", "temperature_mean"])
    back = log.decode(encoded, "window_start string, measurement_count long, temperature_mean double", carried=("key",))
    return rounded(back, places=4)


@query(None)
def sliding_window_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: readings to window statistics to keyed JSON. Its fields are checked by json_encode_features."""
    return log.encode(_sliding(spark, sf_dir), "station")


@query(f"{R}, d AS (SELECT station, 30 + (value * 3) % 200 AS wind_direction FROM (SELECT station, temperature AS value FROM r)) SELECT station, {CIRCULAR_SQL} AS circular_mean, round(avg(wind_direction), 6) AS plain_mean FROM d GROUP BY 1")
def circular_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions from the readings' values, over less than a turn, so that they don't cancel out."""
    return readings(spark, sf_dir).withColumn("wind_direction", 30 + (F.col("temperature") * 3) % 200).groupBy("station").agg(r(A.circular_mean("wind_direction")).alias("circular_mean"), r(F.avg("wind_direction")).alias("plain_mean"))


@query(f"{R} SELECT station, round(avg(temperature), 6) AS temperature_mean, round(avg(humidity), 6) AS humidity_mean, round(avg(pressure), 6) AS pressure_mean, round(avg(wind_speed), 6) AS wind_speed_mean, count(*) AS measurement_count FROM r GROUP BY 1")
def per_key_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.key_totals(readings(spark, sf_dir), BY_STATION))


@query("""SELECT user_id % 4 AS partition, count(*) AS messages, count(DISTINCT user_id) AS distinct_keys, round(100.0e0 * count(*) / (SELECT count(*) FROM events), 6) AS percent FROM events GROUP BY 1""")
def partition_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.partition_distribution(table(spark, sf_dir, "events").withColumn("partition", F.col("user_id") % 4), "partition", "user_id"))


@query("""SELECT event_type, array_to_string(list_sort(list(DISTINCT user_id % 4)), ',') AS partitions, count(DISTINCT user_id % 4) AS n_partitions FROM events GROUP BY 1""")
def key_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.key_partitions(table(spark, sf_dir, "events").withColumn("partition", F.col("user_id") % 4), "partition", "event_type")
    return t.withColumn("partitions", F.array_join(F.col("partitions").cast("array<string>"), ","))


@query("""WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY user_id % 4)
SELECT count(*) AS partitions, round(avg(n), 6) AS mean, round(greatest(max(n) - avg(n), avg(n) - min(n)) / avg(n) * 100, 6) AS max_deviation_pct, round(100 * (1 - stddev_pop(n) / avg(n)), 6) AS balance_score, greatest(max(n) - avg(n), avg(n) - min(n)) / avg(n) * 100 <= 10 AS within_target FROM n""")
def partition_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.partition_balance(table(spark, sf_dir, "events").withColumn("partition", F.col("user_id") % 4), "partition"))


@query("""SELECT event_type, count(*) AS records, count(DISTINCT CAST(ts AS DATE)) AS files, strftime(min(ts), '%Y-%m-%d') AS first_date, strftime(max(ts), '%Y-%m-%d') AS last_date FROM events GROUP BY 1""")
def ingest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").withColumn("file", F.date_format("ts", "yyyy-MM-dd"))
    return A.ingest_summary(t, "event_type", "file", "file")


@query("""SELECT event_type, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.95), 6) AS p95, round(quantile_cont(s, 0.99), 6) AS p99, count(*) AS n FROM (SELECT event_type, value / 10 + (event_id % 17) * 0.25e0 AS s FROM events) GROUP BY 1""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.col("value") / 10 + (F.col("event_id") % 17) * 0.25
    return rounded(A.latency_percentiles(table(spark, sf_dir, "events"), seconds, ["event_type"]))


def _merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by type and day, written, and merged over all days."""
    daily = sketches.window_sketches(table(spark, sf_dir, "events"), ["event_type"], "ts", "value", "1 day")
    return sketches.merged(stored(daily), ["event_type"])


@query("""SELECT event_type, count(value) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1""")
def sketch_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sketches keep exactly."""
    return sketches.summary(_merged_sketches(spark, sf_dir), ["event_type"], [], [])


@query()
def sketch_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within the rank error of the sketch."""
    return sketches.summary(_merged_sketches(spark, sf_dir), ["event_type"], [0.5, 0.95, 0.99], ["p50", "p95", "p99"])


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS interval_start, count(*) AS messages, round(count(*) / 3600.0e0, 6) AS per_second FROM events GROUP BY 1""")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.throughput(table(spark, sf_dir, "events"), "ts", "1 hour", 3600.0))


@query("""WITH g AS (SELECT count(*) AS n FROM events GROUP BY user_id, date_trunc('hour', ts)) SELECT CAST(sum(n) AS BIGINT) AS messages, count(*) AS distinct_messages, max(n) AS most_copies, round(1 - count(*) / sum(n), 6) AS duplicate_rate FROM g""")
def duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.duplicate_rate(table(spark, sf_dir, "events").withColumn("hour", F.date_trunc("hour", "ts")), ["user_id", "hour"]))


@query("""SELECT count(*) AS sent, count(*) FILTER (WHERE NOT (event_id % 9 > 0 AND value > 5)) AS lost, round(count(*) FILTER (WHERE NOT (event_id % 9 > 0 AND value > 5)) / count(*), 6) AS loss_rate FROM events""")
def loss_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return rounded(A.loss_rate(e, e.where("event_id % 9 > 0 and value > 5"), ["event_id"]))
