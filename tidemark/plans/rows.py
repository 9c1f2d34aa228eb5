"""Queries: row windows over series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomaly, clean, isolation, ranges, serving
from ..operators import windows as W
from ..spec import SeriesSpec
from .base import BY_USER, R, query, readings, rounded, table

WIN = "(PARTITION BY user_id ORDER BY ts, event_id)"


def _series(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return readings(spark, sf_dir).select("event_id", "user_id", "ts", *columns)


@query(R + f"""SELECT event_id, user_id, round(coalesce((temperature - lag(temperature) OVER w) / nullif((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0), 0), 6) + 0e0 AS temperature_rate, round(coalesce((pressure - lag(pressure) OVER w) / nullif((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0), 0), 6) + 0e0 AS pressure_rate FROM r WINDOW w AS {WIN}""")
def rate_of_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.rate_of_change(_series(spark, sf_dir, "temperature", "pressure"), BY_USER, ["temperature", "pressure"]).select("event_id", "user_id", "temperature_rate", "pressure_rate"))


@query(R + f""", m AS (SELECT *, avg(temperature) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS a FROM r), l AS (SELECT *, lag(a, 5) OVER {WIN} AS b FROM m)
SELECT event_id, user_id, CAST(CASE WHEN a > b THEN 1 WHEN a < b THEN -1 ELSE 0 END AS BIGINT) AS temperature_trend FROM l""")
def trend_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.trend(_series(spark, sf_dir, "temperature"), BY_USER, "temperature", 5).select("event_id", "user_id", "temperature_trend")


@query(R + f"SELECT event_id, user_id, round(pressure - lag(pressure) OVER {WIN}, 6) AS pressure_change FROM r")
def first_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.difference(_series(spark, sf_dir, "pressure"), BY_USER, "pressure").select("event_id", "user_id", "pressure_change"))


LAGS = (1, 2, 3, 5, 7, 14, 21, 30)


@query(R + "SELECT event_id, user_id, " + ", ".join(f"lag(temperature, {n}) OVER {WIN} AS temperature_lag_{n}" for n in LAGS) + " FROM r")
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.lags(_series(spark, sf_dir, "temperature"), BY_USER, ["temperature"], LAGS).drop("ts", "temperature")


WIDTHS = (3, 7, 14, 30)


@query(R + "SELECT event_id, user_id, " + ", ".join(f"round({f}(temperature) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 6) AS temperature_roll_{n}_{name}" for n in WIDTHS for name, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + " FROM r")
def rolling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.rolling(_series(spark, sf_dir, "temperature"), BY_USER, ["temperature"], WIDTHS).drop("ts", "temperature"))


@query(R + "SELECT event_id, station, round(avg(temperature) OVER w, 6) AS hour_mean, count(*) OVER w AS hour_count FROM r WINDOW w AS (PARTITION BY station ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)")
def sliced_hour_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few long series: each is cut into hours, and a window is the end of one and the beginning of the next."""
    t = W.trailing(readings(spark, sf_dir).select("event_id", "station", "ts", "temperature"), SeriesSpec(("station",), "ts", ("event_id",)), "temperature", 3600)
    return rounded(t.select("event_id", "station", F.col("trailing_mean").alias("hour_mean"), F.col("trailing_count").alias("hour_count")))


@query(R + f"""SELECT event_id, user_id, round(humidity - lag(humidity) OVER w, 6) AS humidity_diff_1, round(humidity - lag(humidity, 7) OVER w, 6) AS humidity_diff_7, round(humidity / nullif(lag(humidity, 7) OVER w, 0) - 1, 6) AS humidity_pct_7 FROM r WINDOW w AS {WIN}""")
def diff_pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.diff_and_pct(_series(spark, sf_dir, "humidity"), BY_USER, "humidity").drop("ts", "humidity"))


@query(R + """, t AS (SELECT event_id, user_id, pressure, lag(pressure, 1) OVER w AS l1, lag(pressure, 3) OVER w AS l3, lag(pressure, 7) OVER w AS l7, lead(pressure) OVER w AS target,
  count(pressure) OVER f AS n, avg(pressure) OVER f AS m, stddev_samp(pressure) OVER f AS s FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT event_id, user_id, pressure, l1 AS pressure_lag_1, l3 AS pressure_lag_3, l7 AS pressure_lag_7, round(m, 6) AS pressure_roll_mean, round(s, 6) AS pressure_roll_std, target FROM t WHERE n = 7 AND l1 IS NOT NULL AND l3 IS NOT NULL AND l7 IS NOT NULL AND target IS NOT NULL""")
def supervised_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.supervised(_series(spark, sf_dir, "pressure"), BY_USER, "pressure").drop("ts"), ["pressure_roll_mean", "pressure_roll_std"])


def _joined(column: str) -> F.Column:
    return F.array_join(F.transform(F.flatten(column) if column == "x" else F.col(column), lambda v: F.format_string("%.2f", v)), ",")


@query(R + """, t AS (SELECT event_id, user_id, list(printf('%.2f,%.2f', temperature, humidity)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS x,
  list(printf('%.2f', temperature)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 FOLLOWING AND 9 FOLLOWING) AS y FROM r) SELECT event_id, user_id, array_to_string(x, ',') AS x, array_to_string(y, ',') AS y FROM t WHERE len(x) = 7 AND len(y) = 3""")
def sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = W.sequences(_series(spark, sf_dir, "temperature", "humidity"), BY_USER, ["temperature", "humidity"], "temperature", 7, 3)
    return t.select("event_id", "user_id", _joined("x").alias("x"), _joined("y").alias("y"))


@query(R + "SELECT event_id, repeat(printf('%.2f,%.2f,', temperature, humidity), 3) AS x FROM r")
def tile_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = W.tiled(readings(spark, sf_dir), ["temperature", "humidity"], 3)
    return t.select("event_id", F.concat(_joined("x"), F.lit(",")).alias("x"))


@query(R + f""", t AS (SELECT station, (temperature > lag(temperature) OVER w) = (humidity > lag(humidity) OVER w) AS same FROM r WINDOW w AS (PARTITION BY station ORDER BY ts, event_id)) SELECT station, round(coalesce(avg(CAST(same AS INTEGER)), 0) * 100, 6) AS directional_accuracy FROM t GROUP BY 1""")
def directional_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(W.directional_accuracy(readings(spark, sf_dir), ["station"], ["ts", "event_id"], "temperature", "humidity"))


@query(R + """, t AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM r)
SELECT event_id, user_id, CASE WHEN i < floor(n * 0.7e0) THEN 'train' WHEN i < floor(n * (0.7e0 + 0.15e0)) THEN 'val' ELSE 'test' END AS split FROM t""")
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.chronological_split(_series(spark, sf_dir), BY_USER).select("event_id", "user_id", "split")


@query(R + """, t AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM r) SELECT event_id, CASE WHEN i < floor(n * 0.7e0) THEN 'train' WHEN i < floor(n * (0.7e0 + 0.15e0)) THEN 'val' ELSE 'test' END AS split FROM t""")
def global_chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.shared import stored

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return W.global_split(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"], parts, stored).select("event_id", "split")


@query("""SELECT event_id, user_id % 4 AS partition, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id DESC) <= 10""")
def last_n_per_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("partition"), "value")
    return serving.last_n(t, ["partition"], ["event_id"], 10)


@query("""SELECT event_id, user_id % 4 AS partition, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id DESC) = 1""")
def latest_per_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("partition"), "value")
    return serving.latest(t, ["partition"], ["event_id"])


@query("""SELECT event_id, user_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.latest(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"])


@query("""SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 50""")
def recent_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.recent(table(spark, sf_dir, "events").select("event_id", "ts", "value"), ["ts", "event_id"], 50)


@query(R + """, t AS (SELECT event_id, user_id, temperature, count(temperature) OVER w AS n, avg(temperature) OVER w AS mu, stddev_samp(temperature) OVER w AS sd FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, CASE WHEN n >= 5 THEN coalesce(abs(temperature - mu) / nullif(sd, 0), 0) ELSE 0 END AS score FROM t)
SELECT event_id, user_id, round(score, 6) AS score, score > 3 AS is_anomaly, CASE WHEN score > 3 AND temperature > mu THEN 'temperature above recent range' WHEN score > 3 AND temperature < mu THEN 'temperature below recent range' ELSE '' END AS reasons FROM s""")
def anomaly_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = anomaly.zscore(_series(spark, sf_dir, "temperature"), BY_USER, "temperature")
    return rounded(t.select("event_id", "user_id", "score", "is_anomaly", F.array_join("reasons", ",").alias("reasons")))


@query(R + """, q AS (SELECT station, quantile_cont(temperature, 0.25) AS q1, quantile_cont(temperature, 0.75) AS q3 FROM r GROUP BY 1)
SELECT event_id, station, round(q1, 6) AS q1, round(q3, 6) AS q3, temperature < q1 - 1.5e0 * (q3 - q1) OR temperature > q3 + 1.5e0 * (q3 - q1) AS is_anomaly FROM r JOIN q USING (station)""")
def anomaly_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = anomaly.iqr(readings(spark, sf_dir), SeriesSpec(("station",), "ts"), "temperature")
    return rounded(t.select("event_id", "station", "q1", "q3", "is_anomaly"))


@query("""WITH d AS (SELECT o_orderdate AS day, sum(o_totalprice) AS total FROM orders GROUP BY 1), s AS (SELECT day, CASE WHEN dayofyear(day) % 10 < 2 THEN NULL ELSE total END AS total, year(day) AS year FROM d)
SELECT day, round(coalesce(last_value(total IGNORE NULLS) OVER (PARTITION BY year ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(total IGNORE NULLS) OVER (PARTITION BY year ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 2) AS total FROM s""")
def daily_order_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("total"))
    gaps = daily.withColumns({"total": F.when(F.dayofyear("day") % 10 >= 2, F.col("total")), "year": F.year("day")})
    return rounded(clean.forward_backward_fill(gaps, SeriesSpec(("year",), "day"), ["total"]).select("day", "total"), places=2)


#: All events as one series.
WHOLE = SeriesSpec((), "ts", ("event_id",), ("temperature", "humidity"))


def _whole(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return readings(spark, sf_dir).select("event_id", "ts", *columns)


@query(R + """SELECT event_id, round(avg(temperature) OVER f, 6) AS roll_mean, round(stddev_samp(temperature) OVER f, 6) AS roll_std, min(temperature) OVER f AS roll_min, max(temperature) OVER f AS roll_max,
  lag(temperature, 7) OVER w AS lag_7, round(temperature - lag(temperature) OVER w, 6) AS diff_1, round(coalesce((temperature - lag(temperature) OVER w) / nullif((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0), 0), 6) + 0e0 AS rate
  FROM r WINDOW w AS (ORDER BY ts, event_id), f AS (ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def whole_series_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling statistics, lags and changes of one long series, cut into ranges with the last 30 rows before each."""

    def features(df: DataFrame, s: SeriesSpec) -> DataFrame:
        df = W.rolling(df, s, ["temperature"], [30])
        df = W.diff_and_pct(W.lags(df, s, ["temperature"], [7]), s, "temperature", [1])
        return W.rate_of_change(df, s, ["temperature"])

    t = ranges.by_rows(_whole(spark, sf_dir, "temperature"), WHOLE, 30, 0, features)
    names = {"temperature_roll_30_mean": "roll_mean", "temperature_roll_30_std": "roll_std", "temperature_roll_30_min": "roll_min", "temperature_roll_30_max": "roll_max", "temperature_lag_7": "lag_7", "temperature_diff_1": "diff_1", "temperature_rate": "rate"}
    return rounded(t.select("event_id", *[F.col(a).alias(b) for a, b in names.items()]), ["roll_mean", "roll_std", "diff_1", "rate"])


@query(R + """, t AS (SELECT event_id, list(printf('%.2f,%.2f', temperature, humidity)) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS x,
  list(printf('%.2f', temperature)) OVER (ORDER BY ts, event_id ROWS BETWEEN 7 FOLLOWING AND 9 FOLLOWING) AS y FROM r) SELECT event_id, array_to_string(x, ',') AS x, array_to_string(y, ',') AS y FROM t WHERE len(x) = 7 AND len(y) = 3""")
def whole_series_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training samples that reach over the borders of ranges."""
    t = ranges.by_rows(_whole(spark, sf_dir, "temperature", "humidity"), WHOLE, 0, 9, lambda df, s: W.sequences(df, s, ["temperature", "humidity"], "temperature", 7, 3))
    return t.select("event_id", _joined("x").alias("x"), _joined("y").alias("y"))


@query(R + """, t AS (SELECT event_id, ts, wind_speed AS w, CASE WHEN event_id % 97 = 0 THEN pressure END AS p FROM r)
SELECT event_id, coalesce(last_value(w IGNORE NULLS) OVER b, first_value(w IGNORE NULLS) OVER a) AS wind_speed, coalesce(last_value(p IGNORE NULLS) OVER b, first_value(p IGNORE NULLS) OVER a) AS pressure
FROM t WINDOW b AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def whole_series_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of one long series, some of them longer than a range."""
    t = readings(spark, sf_dir).select("event_id", "ts", "wind_speed", F.when(F.col("event_id") % 97 == 0, F.col("pressure")).alias("pressure"))
    return ranges.fill(t, WHOLE, ["wind_speed", "pressure"]).drop("ts")


@query(R + """, t AS (SELECT event_id, station, temperature, count(temperature) OVER w AS n, avg(temperature) OVER w AS mu, stddev_samp(temperature) OVER w AS sd FROM r WINDOW w AS (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, CASE WHEN n >= 5 THEN coalesce(abs(temperature - mu) / nullif(sd, 0), 0) ELSE 0 END AS score FROM t)
SELECT event_id, station, round(score, 6) AS score, score > 3 AS is_anomaly FROM s""")
def long_series_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five long series: z-scores against the 20 rows before, by range."""
    spec = SeriesSpec(("station",), "ts", ("event_id",))
    t = readings(spark, sf_dir).select("event_id", "station", "ts", "temperature")
    return rounded(ranges.by_rows(t, spec, 20, 0, lambda df, s: anomaly.zscore(df, s, "temperature")).select("event_id", "station", "score", "is_anomaly"))


@query(R + """, m AS (SELECT event_id, station, ts, avg(temperature) OVER (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS a FROM r), l AS (SELECT *, lag(a, 5) OVER (PARTITION BY station ORDER BY ts, event_id) AS b FROM m)
SELECT event_id, station, CAST(CASE WHEN a > b THEN 1 WHEN a < b THEN -1 ELSE 0 END AS BIGINT) AS temperature_trend FROM l""")
def long_series_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = SeriesSpec(("station",), "ts", ("event_id",))
    t = readings(spark, sf_dir).select("event_id", "station", "ts", "temperature")
    return ranges.by_rows(t, spec, 10, 0, lambda df, s: W.trend(df, s, "temperature", 5)).select("event_id", "station", "temperature_trend")


@query()
def anomaly_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events by three metrics together."""
    t = readings(spark, sf_dir).select("event_id", "temperature", "humidity", "precipitation")
    return rounded(isolation.scores(t, "event_id", ["temperature", "humidity", "precipitation"]).select("event_id", "isolation"))
