"""Queries that run as streams over ``events``, replayed in order of event time, checked against batch SQL."""

from __future__ import annotations

import time

from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..forecast import models, registry
from ..sources import archive, log_files
from ..sources.shared import new_path
from ..streaming import accuracy, features, monitor, ordered, stateful
from .aggregates import STATS_SQL
from .base import BY_STATION, R, as_readings, query, readings, rounded, table
from .rows import WIN


def _replay(spark: SparkSession, sf_dir: str) -> str:
    """The table as files in order of event time, however its own files lie: no row is late, for the watermark or the
    state of a key. The source takes the oldest files first, so the files' times are set to follow their ranges."""
    return _replayed(spark, table(spark, sf_dir, "events"))


def _replayed(spark: SparkSession, events: DataFrame) -> str:
    path = new_path(spark, "replay")
    events.repartitionByRange("ts").sortWithinPartitions("ts").write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: (len(p.getName()), p.getName()))
    first = int(time.time() - len(parts)) * 1000
    for i, part in enumerate(parts):
        fs.setTimes(part, first + 1000 * i, -1)
    if any(fs.getFileStatus(part).getModificationTime() != first + 1000 * i for i, part in enumerate(parts)):
        raise RuntimeError(f"replay: the store of {path} does not keep the times of its files")
    return path


def _stream(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 4).parquet(path)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir, _replay(spark, sf_dir))


def _span_ms(spark: SparkSession, sf_dir: str) -> int:
    """More milliseconds than any silence in the table."""
    first, last = table(spark, sf_dir, "events").agg(*[F.unix_millis(f("ts").cast("timestamp")) for f in (F.min, F.max)]).first()
    return 2 * 86_400_000 + (0 if first is None else last - first)


def _finished(q: StreamingQuery) -> None:
    try:
        q.awaitTermination()
    finally:
        q.stop()


def _appended(spark: SparkSession, df: DataFrame) -> DataFrame:
    out = new_path(spark, "stream")
    _finished(features.file_sink(df, f"{out}/data", f"{out}/checkpoint"))
    return spark.read.schema(df.schema).parquet(f"{out}/data")


def _updated(spark: SparkSession, df: DataFrame, keys: list[str]) -> DataFrame:
    """Each batch overwrites the folder of its own number, so a repeated batch counts once."""
    out = new_path(spark, "stream")
    _finished(features.upsert_sink(df, f"{out}/checkpoint", lambda b, n: b.write.mode("overwrite").parquet(f"{out}/data/version={n}")))
    return features.latest_versions(spark.read.parquet(f"{out}/data"), keys, "version").drop("version")


@query(f"{R} SELECT station, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, {STATS_SQL}, count(*) AS measurement_count FROM r GROUP BY 1, 2")
def stream_window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode: the last version of each window is the batch result."""
    out = features.window_features(as_readings(_events(spark, sf_dir)), BY_STATION, "1 hour", fill="skip")
    last = _updated(spark, out, ["station", "window_start", "window_end"])
    return rounded(last.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).drop("window_end", "window_first_timestamp", "window_last_timestamp"))


@query(R + f"""SELECT user_id, ts, temperature, round(coalesce((temperature - lag(temperature) OVER w) / nullif((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0), 0), 6) + 0e0 AS rate, round(temperature - lag(temperature) OVER w, 6) + 0e0 AS change FROM r WINDOW w AS {WIN}""")
def stream_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed state in place of row windows. State of a key stays as long as the table spans."""
    out = _appended(spark, stateful.changes(as_readings(_events(spark, sf_dir)), "user_id", "ts", "temperature", ties=("event_id",), idle_ms=_span_ms(spark, sf_dir)))
    return rounded(out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "temperature", "rate", "change"), ["rate", "change"])


@query("""SELECT user_id, count(*) AS readings FROM events GROUP BY 1""")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading twice in the stream, once in the result."""
    s = as_readings(_events(spark, sf_dir)).select("user_id", "ts").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(1))))
    spec = type(BY_STATION)(("user_id",), "ts")
    return _appended(spark, features.dedup(s, spec)).groupBy("user_id").agg(F.count("*").alias("readings"))


@query("""WITH p AS (SELECT user_id, ts AS target_ts, value AS predicted FROM events WHERE event_type = 'view'), a AS (SELECT user_id, ts, value AS actual FROM events WHERE event_type = 'click'),
j AS (SELECT p.user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, predicted - actual AS e FROM p JOIN a ON p.user_id = a.user_id AND ts BETWEEN target_ts - INTERVAL 30 MINUTE AND target_ts + INTERVAL 30 MINUTE)
SELECT user_id, window_start, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, count(*) AS n FROM j GROUP BY 1, 2""")
def stream_online_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream-stream join of forecasts and actual values, then their errors by day."""
    path = _replay(spark, sf_dir)
    p = _stream(spark, sf_dir, path).where("event_type = 'view'").select("user_id", F.col("ts").alias("target_ts"), F.col("value").alias("predicted"))
    a = _stream(spark, sf_dir, path).where("event_type = 'click'").select("user_id", "ts", F.col("value").alias("actual"))
    pairs = _appended(spark, accuracy.matched(p, a, "user_id"))
    m = accuracy.running_metrics(pairs, "user_id", "1 day")
    return rounded(m.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


def _with_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replayed table, and a last row of no user, a day later: it moves the watermark past all others."""
    events = table(spark, sf_dir, "events")
    last = events.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).where("ts is not null")
    return _stream(spark, sf_dir, _replayed(spark, events.unionByName(last, allowMissingColumns=True))).withColumn("user_id", F.coalesce("user_id", F.lit(HEARTBEAT)))


#: No user has it.
HEARTBEAT = -(2**62)


def _ordered(spark: SparkSession, df: DataFrame) -> DataFrame:
    with ordered.rocksdb(spark):
        out = _appended(spark, df).where(F.col("user_id") != HEARTBEAT)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(R + f""", m AS (SELECT *, avg(temperature) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS a FROM r), l AS (SELECT *, lag(a, 5) OVER {WIN} AS b FROM m)
SELECT event_id, user_id, ts, round(coalesce((temperature - lag(temperature) OVER w) / nullif((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0), 0), 6) + 0e0 AS rate, CAST(CASE WHEN a > b THEN 1 WHEN a < b THEN -1 ELSE 0 END AS BIGINT) AS trend,
  round(temperature - lag(temperature) OVER w, 6) + 0e0 AS change FROM l WINDOW w AS {WIN}""")
def stream_ordered_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows wait for the watermark and come out in order, with rate, trend and change."""
    out = ordered.ordered_changes(as_readings(_with_heartbeat(spark, sf_dir)), "user_id", "ts", "temperature", ties=("event_id",), idle_ms=_span_ms(spark, sf_dir))
    return rounded(_ordered(spark, out).drop("temperature"), ["rate", "change"])


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT event_id, user_id, ts, value, i, 1 AS n, value AS total, value - value - 2e0 AS m, least(0e0, value - value - 2e0) AS low, false AS drifted, 0e0 AS statistic FROM e WHERE i = 1
  UNION ALL SELECT event_id, user_id, ts, value, i, n, total, m, least(low, m), m - least(low, m) > 150 AND n >= 10, m - least(low, m) FROM
    (SELECT *, before + value - total / n - 2e0 AS m FROM
      (SELECT e.event_id, e.user_id, e.ts, e.value, e.i, CASE WHEN drifted THEN 1 ELSE n + 1 END AS n, CASE WHEN drifted THEN 0e0 ELSE total END + e.value AS total, CASE WHEN drifted THEN 0e0 ELSE m END AS before, CASE WHEN drifted THEN 0e0 ELSE low END AS low
       FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)))
SELECT event_id, user_id, ts, round(statistic, 6) + 0e0 AS statistic, drifted FROM s""")
def stream_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-Hinkley over each user's values as they come."""
    out = ordered.page_hinkley(_with_heartbeat(spark, sf_dir), "user_id", "ts", "value", 2.0, 150.0, 10, ties=("event_id",), idle_ms=_span_ms(spark, sf_dir))
    return rounded(_ordered(spark, out).drop("value"), ["statistic"])


@query("""SELECT event_id, user_id, event_type, value FROM events""")
def log_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table through a partitioned log with offsets: written in two goes, read by a stream that is stopped in between."""
    log_files.register(spark)
    path, out = new_path(spark, "log"), new_path(spark, "stream")
    events = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "user_id", "event_type", "value"), {"ignoreNullFields": "false"}).alias("value"))
    odd = F.coalesce(F.col("event_id") % 2, F.lit(0)) == 1
    for half in (odd, ~odd):
        events.where(half).select("value").write.format("tidemark_log").option("path", path).option("segmentRecords", "20000").mode("append").save()
        s = spark.readStream.format("tidemark_log").option("path", path).load()
        _finished(features.file_sink(s, f"{out}/data", f"{out}/checkpoint"))
    rows = spark.read.schema(log_files.SCHEMA).parquet(f"{out}/data")
    return rows.select(F.from_json("value", "event_id long, user_id long, event_type string, value double").alias("e")).select("e.*")


@query("""WITH m AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS cut FROM events) SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n FROM events, m WHERE ts > cut GROUP BY 1""")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later half of the table in one run of a stream, then the earlier half, which is older than the watermark."""
    events, root = table(spark, sf_dir, "events").select("ts"), new_path(spark, "late")
    m = events.agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("cut"))
    t = events.crossJoin(F.broadcast(m))  # one row
    later = F.col("ts") > F.col("cut")
    for rows in (later, ~later):
        t.where(rows).drop("cut").write.mode("append").parquet(f"{root}/in")
        s = features.event_time(spark.readStream.schema(events.schema).parquet(f"{root}/in"), "ts").withWatermark("ts", features.LATE)
        counts = s.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
        _finished(features.upsert_sink(counts, f"{root}/checkpoint", lambda b, n: b.write.mode("overwrite").parquet(f"{root}/out/version={n}")))
    last = features.latest_versions(spark.read.parquet(f"{root}/out").select(F.col("w.start").alias("window_start"), "n", "version"), ["window_start"], "version")
    return last.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("""SELECT count(*) AS input_rows, CAST(0 AS BIGINT) AS dropped_by_watermark, true AS told_by_a_later_driver FROM events""")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a monitor has kept of a query, read from its files."""
    path, name = new_path(spark, "progress"), "progress_of_events"
    watch = monitor.ProgressMonitor(path=path)
    spark.streams.addListener(watch)
    try:
        out = new_path(spark, "stream")
        df = features.dedup(_events(spark, sf_dir), type(BY_STATION)(("event_id",), "ts"))
        q = df.writeStream.format("parquet").queryName(name).option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
        _finished(q)
        until = time.monotonic() + 60
        rows = table(spark, sf_dir, "events").count()
        while sum(r[3] for r in list(watch.records) if r[0] == name) < rows and time.monotonic() < until:
            time.sleep(0.2)  # records come after the batch
    finally:
        spark.streams.removeListener(watch)
    kept = monitor.ProgressMonitor.history(spark, path).where(F.col("query") == name)
    return monitor.lag(kept).select("input_rows", "dropped_by_watermark", (F.col("batches") > 0).alias("told_by_a_later_driver"))


@query("""WITH a AS (SELECT event_type AS station, count(*) AS archived FROM events GROUP BY 1) SELECT station, archived, CAST(archived AS BIGINT) AS in_windows FROM a""")
def archive_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log feeds the archive and the features, each with a checkpoint of its own."""
    root, path = new_path(spark, "fan"), _replay(spark, sf_dir)
    rows = as_readings(_stream(spark, sf_dir, path))
    kept = archive.with_partitions(rows.select(F.col("station").alias("station_id"), F.col("ts").cast("string").alias("timestamp"), "temperature"), name="station_id")
    _finished(archive.write_archive(kept, f"{root}/archive", f"{root}/archive-checkpoint"))
    windows = _updated(spark, features.window_features(as_readings(_stream(spark, sf_dir, path)), BY_STATION, "1 hour", fill="skip"), ["station", "window_start", "window_end"])
    counted = windows.groupBy("station").agg(F.sum("measurement_count").alias("in_windows"))
    return archive.read_archive(spark, f"{root}/archive").groupBy("station").agg(F.count("*").alias("archived")).join(counted, "station")


@query("""WITH m AS (SELECT regr_slope(value, k) AS b, regr_intercept(value, k) AS a FROM (SELECT value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))
SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN round(a + b * CAST(json_extract_string(props, '$.k') AS DOUBLE), 4) END AS prediction, CASE WHEN event_id % 13 = 0 THEN 'a feature is missing' END AS error FROM events, m""")
def stream_trained_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model is fitted on the table, kept in the registry, taken from there by its name, and scores the table as a stream."""
    root = new_path(spark, "models")
    t = readings(spark, sf_dir)
    fit = Pipeline(stages=[models.assembler(["humidity"]), LinearRegression(labelCol="temperature", solver="normal")]).fit(t.select("humidity", "temperature"))
    registry.save(spark, root, "line", "1", fit, ["humidity"], {"r2": float(fit.stages[-1].summary.r2)})
    found, about = registry.latest(spark, root, "line")
    s = as_readings(_events(spark, sf_dir)).select("event_id", F.when(F.col("event_id") % 13 != 0, F.col("humidity")).alias("humidity"))
    return rounded(_appended(spark, models.predictions(found, s, about["features"])).select("event_id", "prediction", "error"), places=4)
