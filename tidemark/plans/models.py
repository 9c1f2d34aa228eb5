"""Queries: evaluation, forecast frames, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..forecast import frames
from ..operators import evaluate
from .base import query, rounded, table

P = """WITH p AS (SELECT event_id, event_type, value AS y_true, value * 0.8e0 + (event_id % 11) AS y_pred, CASE WHEN event_id % 10 < 7 THEN 'train' WHEN event_id % 10 = 7 THEN 'val' ELSE 'test' END AS split, CASE WHEN event_id % 2 = 0 THEN 'boosted' ELSE 'seasonal' END AS model_name FROM events) """
M = """round(avg(abs(y_pred - y_true)), 6) AS mae, round(sqrt(avg(pow(y_pred - y_true, 2))), 6) AS rmse, round(avg(pow(y_pred - y_true, 2)), 6) AS mse, round(coalesce(avg(CASE WHEN abs(y_true) > 1e-6 THEN abs((y_pred - y_true) / y_true) END), 0) * 100, 6) AS mape,
round(avg(y_pred - y_true), 6) AS mean_error, round(stddev_pop(y_pred - y_true), 6) AS std_error, round(1 - sum(pow(y_pred - y_true, 2)) / (var_pop(y_true) * count(*) + 1e-6), 6) AS r2, count(*) AS n"""


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.col("value").alias("y_true"), (F.col("value") * 0.8 + i % 11).alias("y_pred"), F.when(i % 10 < 7, "train").when(i % 10 == 7, "val").otherwise("test").alias("split"), F.when(i % 2 == 0, "boosted").otherwise("seasonal").alias("model_name"))


@query(f"{P} SELECT event_type, {M} FROM p GROUP BY 1")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.regression(_predictions(spark, sf_dir), ["event_type"]))


@query(f"{P} SELECT split, {M} FROM p GROUP BY 1")
def metrics_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.regression(_predictions(spark, sf_dir), ["split"]))


@query(f"{P} SELECT model_name, {M} FROM p WHERE split = 'test' GROUP BY 1 ORDER BY rmse")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.comparison(_predictions(spark, sf_dir).where("split = 'test'")))


@query(f"{P}, b AS (SELECT CAST(floor((y_pred - y_true) / 5) AS BIGINT) AS bucket FROM p) SELECT bucket, count(*) AS n, bucket * 5.0e0 AS lower FROM b GROUP BY 1")
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.error_histogram(_predictions(spark, sf_dir), 5.0)


@query(f"{P} SELECT event_id, round(abs(y_pred - y_true), 6) AS abs_error FROM p ORDER BY abs(y_pred - y_true) DESC, event_id LIMIT 20")
def worst_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.worst(_predictions(spark, sf_dir), 20, "event_id").select("event_id", "abs_error"))


@query("""WITH c AS (SELECT count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS tp, count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS fp, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS tn, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS fn FROM labels),
d AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)
SELECT tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, round(coalesce(fp / nullif(fp + tn, 0), 0), 6) AS fpr, round(coalesce(fn / nullif(fn + tp, 0), 0), 6) AS fnr, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM d""")
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.classification(table(spark, sf_dir, "labels"), F.col("toxic"), 1 - F.col("quality")))


@query("""WITH p AS (SELECT event_type, CAST(event_id % 3 = 0 AS INTEGER) AS y, round(value / 7) AS s FROM events), g AS (SELECT event_type, s, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER w - pos AS pb, sum(neg) OVER w - neg AS nb, sum(pos) OVER k AS pa, sum(neg) OVER k AS na FROM g WINDOW w AS (PARTITION BY event_type ORDER BY s), k AS (PARTITION BY event_type))
SELECT event_type, round(CAST(sum(pos * (nb + neg / 2.0e0)) AS DOUBLE) / (max(pa) * max(na)), 6) AS roc_auc, round(sum(CAST(pos * (pa - pb) AS DOUBLE) / (pa - pb + na - nb)) / max(pa), 6) AS average_precision, CAST(max(pa) AS BIGINT) AS positives, CAST(max(na) AS BIGINT) AS negatives FROM c GROUP BY 1""")
def ranking_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score with many ties against labels, for each type."""
    t = table(spark, sf_dir, "events")
    return rounded(evaluate.ranking(t, F.col("event_id") % 3 == 0, F.round(F.col("value") / 7), ["event_type"]))


@query("""SELECT event_type AS series, ts AS ds, value AS y FROM events WHERE event_id % 13 <> 0""")
def forecast_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), "ts", F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("v"))
    return frames.forecast_frame(t, "ts", "v", ["series"])


@query("""SELECT o_orderpriority, strftime(max(CAST(o_orderdate AS DATE)) + CAST(i AS INTEGER), '%Y-%m-%d') AS ds FROM orders, generate_series(1, 30) t(i) GROUP BY o_orderpriority, i""")
def future_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.future_calendar(table(spark, sf_dir, "orders").withColumn("ds", F.to_date("o_orderdate")), "ds", ["o_orderpriority"], 30).withColumn("ds", F.date_format("ds", "yyyy-MM-dd"))


@query("""WITH a AS (SELECT event_id, [value, value + 1, value + 2, value + 3, value + 4] AS f, 1 + event_id % 9 AS h FROM events) SELECT event_id, least(h, 5) AS horizon, array_to_string([printf('%.2f', x) for x in f[1:least(h, 5)]], ',') AS predictions FROM a""")
def horizon_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").select("event_id", F.array(*[F.col("value") + i for i in range(5)]).alias("f"), (1 + F.col("event_id") % 9).alias("h"))
    out = frames.cap_horizon(t, "f", "h", 5)
    return out.select("event_id", "horizon", F.array_join(F.transform("predictions", lambda x: F.format_string("%.2f", x)), ",").alias("predictions"))


@query("""WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS s, avg(value) AS m FROM events GROUP BY ALL)
SELECT event_type AS station_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(2 AS BIGINT) AS horizon_hours, round(m, 4) AS current_mean, round(m + 1, 4) AS first_prediction, CAST(2 AS BIGINT) AS n_predictions FROM w""")
def prediction_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembled as JSON and read back field by field."""
    w = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("station_id"), F.window("ts", "1 hour").alias("w")).agg(F.avg("value").alias("temperature_mean"))
    t = w.select("station_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "temperature_mean", F.array(F.col("temperature_mean") + 1, F.col("temperature_mean") + 2).alias("f"))
    json = frames.prediction_payload(t, "station_id", "f", ["temperature_mean"])
    back = F.from_json("value", "window_start string, horizon_hours long, current_conditions struct<temperature_mean:double>, forecast struct<temperature_predictions:array<double>>")
    got = json.select(F.col("key").alias("station_id"), back.alias("p"))
    return rounded(got.select("station_id", "p.window_start", "p.horizon_hours", F.col("p.current_conditions.temperature_mean").alias("current_mean"), F.col("p.forecast.temperature_predictions")[0].alias("first_prediction"), F.size("p.forecast.temperature_predictions").cast("long").alias("n_predictions")), places=4)


@query("""WITH f AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM events WHERE event_id % 10 < 7)
SELECT event_id, round((value - mu) / sd, 6) + 0e0 AS scaled, round(value, 6) AS back, round(value * 2, 6) AS prediction_back FROM events, f""")
def standardize_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalers of the training rows, all rows scaled by them and scaled back, and a prediction in the target's units."""
    t = table(spark, sf_dir, "events").select("event_id", "value")
    by = evaluate.scalers(t.where("event_id % 10 < 7"), ["value"])
    mu, sd = by["value"]
    z = evaluate.scaled(t, by).withColumns({"scaled": F.col("value"), "prediction": F.col("value") * 2 + mu / sd})
    out = evaluate.unscaled(z, by, {"value": "value", "prediction": "value"})
    return rounded(out.select("event_id", (F.round("scaled", 6) + 0.0).alias("scaled"), F.col("value").alias("back"), F.col("prediction").alias("prediction_back")))
