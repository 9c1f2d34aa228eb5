"""Streams equal batch; late rows, duplicates, restarts."""

import datetime as dt
import json
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregate
from tidemark.operators import windows as W
from tidemark.plans import catalog
from tidemark.sources import archive, log
from tidemark.spec import SeriesSpec
from tidemark.streaming import accuracy, features, monitor, stateful

from .test_catalog import canonical

SCHEMA = "k string, t timestamp, i long, v double"
SPEC = SeriesSpec(("k",), "t", ("i",), ("v",))
T0 = dt.datetime(2024, 1, 1)


def write(spark, path, rows, name):
    lines = [json.dumps({"k": k, "t": (T0 + dt.timedelta(seconds=s)).isoformat() + "Z", "i": i, "v": v}) for k, s, i, v in rows]
    path.mkdir(exist_ok=True)
    (path / f"{name}.json").write_text("\n".join(lines) + "\n")
    time.sleep(0.05)  # files are read in the order of their times


def stream(spark, path):
    return log.read_stream(spark, str(path), SCHEMA, files_per_batch=1)


def run(query):
    try:
        assert query.awaitTermination(120)
        return query
    finally:
        query.stop()


ROWS = [("ab"[i % 2], 30 * i, i, float(i * i % 11) if i % 6 else None) for i in range(60)]


@pytest.fixture
def source(spark, tmp_path):
    for part in range(3):
        write(spark, tmp_path / "in", ROWS[part * 20 : part * 20 + 20], part)
    return tmp_path


def as_text(rows):
    return sorted(str([(round(x, 9) if isinstance(x, float) else x) for x in r]) for r in rows)


def test_update_mode_ends_as_batch(spark, source):
    got = []
    out = features.window_features(stream(spark, source / "in"), SPEC, "5 minutes", "1 minute", fill="skip")
    run(features.upsert_sink(out, str(source / "cp"), lambda df, n: got.extend((n, *r) for r in df.collect())))
    versions = spark.createDataFrame(got, "version long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema))
    latest = features.latest_versions(versions, ["k", "window_start", "window_end"], "version").drop("version")
    batch = aggregate.window_stats(spark.read.schema(SCHEMA).json(str(source / "in")), SPEC, "5 minutes", "1 minute")
    assert as_text(latest.select(*batch.columns).collect()) == as_text(batch.collect())


def test_append_mode_holds_back_open_windows_and_restart_adds_nothing_twice(spark, source):
    def once():
        run(features.file_sink(features.window_features(stream(spark, source / "in"), SPEC, "5 minutes", fill="skip"), str(source / "out"), str(source / "cp")))
        return spark.read.parquet(str(source / "out"))

    batch = aggregate.window_stats(spark.read.schema(SCHEMA).json(str(source / "in")), SPEC, "5 minutes")
    first = once()
    n = first.count()
    assert 0 < n < batch.count()
    write(spark, source / "in", [("a", 7200, 1000, 1.0), ("b", 7200, 1001, 1.0)], "late")
    second = once()
    assert second.count() >= n and second.groupBy("k", "window_start").count().where("count > 1").isEmpty()
    assert as_text(second.where(F.col("window_start") < F.lit(T0 + dt.timedelta(hours=1))).select(*batch.columns).collect()) == as_text(batch.collect())


def test_late_rows_are_dropped_and_reported(spark, source):
    watch = monitor.ProgressMonitor()
    spark.streams.addListener(watch)
    try:
        write(spark, source / "in", [("a", 36_000, 2000, 1.0)], "x1")
        write(spark, source / "in", [("a", 36_001, 2001, 1.0)], "x2")
        write(spark, source / "in", [("a", 0, 2002, 99.0)], "x3")
        q = features.upsert_sink(features.window_features(stream(spark, source / "in"), SPEC, "5 minutes"), str(source / "cp"), lambda df, n: df.count(), name="late")
        run(q)
        dropped = sum(s.numRowsDroppedByWatermark for p in q.recentProgress for s in p.stateOperators)
        assert dropped >= 1
        time.sleep(1)
        assert watch.frame(spark).where("query = 'late'").agg(F.sum("dropped_by_watermark")).first()[0] >= 1
    finally:
        spark.streams.removeListener(watch)


def test_dedup(spark, source):
    write(spark, source / "in", ROWS[:40], "again")
    out = features.dedup(stream(spark, source / "in"), SPEC, "2 hours")
    run(features.file_sink(out, str(source / "out"), str(source / "cp")))
    assert spark.read.parquet(str(source / "out")).count() == len(ROWS)


def test_stateful_changes_equal_row_windows(spark, source):
    out = stateful.changes(stream(spark, source / "in"), "k", "t", "v", k=3)
    run(features.file_sink(out, str(source / "out"), str(source / "cp")))
    batch = spark.read.schema(SCHEMA).json(str(source / "in"))
    batch = W.difference(W.trend(W.rate_of_change(batch, SPEC, ["v"]), SPEC, "v", 3), SPEC, "v")
    want = batch.select("k", "t", "v", "v_rate", "v_trend", "v_change")
    got = spark.read.parquet(str(source / "out")).where("not late_for_state").select("k", "t", "v", "rate", "trend", "change")
    assert as_text(got.collect()) == as_text(want.collect())


def test_stateful_marks_rows_older_than_the_state(spark, tmp_path):
    write(spark, tmp_path / "in", [("a", 100, 1, 1.0), ("a", 200, 2, 2.0)], 1)
    write(spark, tmp_path / "in", [("a", 150, 3, 9.0), ("a", 300, 4, 4.0)], 2)
    run(features.file_sink(stateful.changes(stream(spark, tmp_path / "in"), "k", "t", "v"), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = {r["v"]: (r["late_for_state"], r["change"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1.0: (False, None), 2.0: (False, 1.0), 9.0: (True, None), 4.0: (False, 2.0)}


def changes_of(spark, folder, **options):
    q = run(features.file_sink(stateful.changes(stream(spark, folder / "in"), "k", "t", "v", k=3, ties=["i"], **options), str(folder / "out"), str(folder / "cp")))
    return q, spark.read.parquet(str(folder / "out"))


def test_calls_of_stateful_changes_do_not_grow_with_the_keys(spark, tmp_path):
    """600 keys share 256 buckets, whose state is one row each, and every key keeps its own values over two batches."""
    rows = [(f"k{j}", 600 * i + j, 1000 * i + j, None if (i + j) % 5 == 0 else float(i * j % 7)) for i in range(6) for j in range(600)]
    for n in range(2):
        write(spark, tmp_path / "in", rows[1800 * n : 1800 * n + 1800], n)
    q, got = changes_of(spark, tmp_path)
    assert 0 < max(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators) <= 256
    batch = spark.read.schema(SCHEMA).json(str(tmp_path / "in"))
    batch = W.difference(W.trend(W.rate_of_change(batch, SPEC, ["v"]), SPEC, "v", 3), SPEC, "v")
    assert as_text(got.select("k", "t", "v", "rate", "trend", "change").collect()) == as_text(batch.select("k", "t", "v", "v_rate", "v_trend", "v_change").collect())
    assert got.where("late_for_state").isEmpty()


@pytest.mark.parametrize("buckets", [1, 256])
def test_stateful_keys_of_a_bucket_end_one_by_one(spark, tmp_path, buckets):
    """By a timer without rows, over a restart, and beside rows of other keys."""
    write(spark, tmp_path / "in", [("a", 0, 1, 1.0), ("c", 4500, 2, 2.0)], 1)
    q, _ = changes_of(spark, tmp_path, idle_ms=3_600_000, buckets=buckets)
    assert q.recentProgress[-1].stateOperators[0].numRowsTotal == 1  # c; a is gone
    write(spark, tmp_path / "in", [("a", 4600, 3, 5.0), ("c", 4600, 4, 6.0)], 2)
    write(spark, tmp_path / "in", [("c", 9000, 5, 7.0)], 3)
    write(spark, tmp_path / "in", [("c", 9001, 6, 9.0)], 4)  # a ends beside it
    write(spark, tmp_path / "in", [("a", 9002, 7, 3.0), ("c", 9002, 8, 3.0)], 5)
    _, got = changes_of(spark, tmp_path, idle_ms=3_600_000, buckets=buckets)
    assert [(r["k"], r["v"], r["change"], r["rate"]) for r in got.orderBy("k", "t").collect()] == [
        ("a", 1.0, None, 0.0), ("a", 5.0, None, 0.0), ("a", 3.0, None, 0.0),
        ("c", 2.0, None, 0.0), ("c", 6.0, 4.0, 0.04), ("c", 7.0, 1.0, 1 / 4400), ("c", 9.0, 2.0, 2.0), ("c", 3.0, -6.0, -6.0),
    ]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_stateful_keys_and_ties_keep_their_values(spark, tmp_path, kind):
    """A null key beside keys beyond 2 ** 53, ties beyond it beside a null tie, and rows without a time."""
    big = 2**60 + 1
    for n in range(2):
        write(spark, tmp_path / "in", [(k, 10 * n, i, v + n) for k in (None, big, big + 1) for i, v in ((None, 8.0), (big + 1, 4.0), (big, 1.0))], n)
    (tmp_path / "in" / "2.json").write_text("".join(json.dumps({"k": k, "t": None, "i": 1, "v": 1.0}) + "\n" for k in (big, 5)))
    s = log.read_stream(spark, str(tmp_path / "in"), SCHEMA.replace("k string", f"k {kind}"), files_per_batch=1)
    run(features.file_sink(stateful.changes(s, "k", "t", "v", ties=["i"]), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.schema["k"].dataType == s.schema["k"].dataType
    as_key = str if kind == "string" else int
    for k in (None, as_key(big), as_key(big + 1)):
        own = got.where(F.col("k").eqNullSafe(F.lit(k)) & ~F.col("late_for_state"))
        assert sorted((r["v"], -99 if r["change"] is None else r["change"]) for r in own.collect()) == [(1.0, -99), (2.0, -6.0), (4.0, 3.0), (5.0, 3.0), (8.0, 4.0), (9.0, 4.0)]
    assert sorted((r["k"], r["t"], r["v"], r["change"]) for r in got.where("late_for_state").collect()) == sorted((as_key(k), None, 1.0, None) for k in (big, 5))


def test_online_accuracy_stream_equals_batch(spark, tmp_path):
    write(spark, tmp_path / "p", [("a", 600 * i, i, float(i)) for i in range(12)], 1)
    write(spark, tmp_path / "a", [("a", 600 * i + 60, i, float(i) + 1) for i in range(12)], 1)

    def sides(read):
        p = read(tmp_path / "p").select("k", F.col("t").alias("target_ts"), F.col("v").alias("predicted"))
        a = read(tmp_path / "a").select("k", F.col("t").alias("ts"), F.col("v").alias("actual"))
        return accuracy.matched(p, a, "k", tolerance="2 minutes")

    run(features.file_sink(sides(lambda x: stream(spark, x)), str(tmp_path / "out"), str(tmp_path / "cp")))
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = sides(lambda x: spark.read.schema(SCHEMA).json(str(x)))
    assert as_text(got.select(*batch.columns).collect()) == as_text(batch.collect())
    m = accuracy.running_metrics(got, "k")
    assert m.agg(F.max("mae")).first()[0] == 1.0
    base = spark.createDataFrame([("a", 0.5)], "k string, baseline_mae double")
    assert accuracy.drift(m, base, "k").where("drifted").count() == m.count()


def test_archive_and_features_from_one_source_with_restart(spark, tmp_path):
    def record(i):
        return json.dumps({"station_id": "s", "station_name": "North / Pole", "timestamp": f"2025-12-13T0{i}:00:00+00:00", "temperature": float(i)})

    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text(record(1) + "\n" + record(2) + "\n")

    def once():
        s = log.read_stream(spark, str(src), log.OBSERVATION)
        run(archive.write_archive(archive.with_partitions(s), str(tmp_path / "arch"), str(tmp_path / "cp1")))
        spec = SeriesSpec(("station_id",), "at", (), ("temperature",))
        from tidemark.functions import scalars as S

        timed = s.withColumn("at", S.any_iso_timestamp(F.col("timestamp")))
        run(features.upsert_sink(features.window_features(timed, spec, "1 hour"), str(tmp_path / "cp2"), lambda df, n: df.count()))
        return archive.read_archive(spark, str(tmp_path / "arch"))

    assert once().count() == 2
    (src / "2.json").write_text(record(3) + "\n")
    got = once()
    assert got.count() == 3 and got.select("station").distinct().first()[0] == "North___Pole"


@pytest.fixture(scope="module")
def unordered(spark, data, tmp_path_factory):
    """Events in twelve files that each span the whole time, and replayed in twelve: three batches."""
    d = str(tmp_path_factory.mktemp("unordered"))
    spark.read.parquet(f"{data}/events.parquet").repartition(12, "event_id").write.option("maxRecordsPerFile", 0).parquet(f"{d}/events.parquet")
    conf = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield d
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["stream_window_stats", "stream_changes", "stream_dedup", "stream_online_accuracy"])
def test_streams_over_unordered_files_equal_the_table(spark, unordered, name):
    c = duckdb.connect()
    c.execute(f"create view events as select * from read_parquet('{unordered}/events.parquet/*.parquet')")
    want = c.execute(catalog.oracle_sql()[name])
    names = sorted(x[0] for x in want.description)
    at = [[x[0] for x in want.description].index(n) for n in names]
    got = sorted(canonical([r[n] for n in names]) for r in catalog.queries()[name](spark, unordered).collect())
    assert got == sorted(canonical([r[i] for i in at]) for r in want.fetchall())


def test_raw_topic_to_feature_topic(spark, tmp_path):
    """Lines of the declared raw schema, with nulls, a broken line, a repeated poll and a bad time, through a stream."""
    day = "2025-12-13T09:%02d:00+00:00"
    rows = [{"station_id": "KMSN", "station_name": "Madison", "timestamp": day % m, "temperature": 1.0 * m, "humidity": 50.0, "wind_speed": None, "wind_direction": 350 + m, "sea_level_pressure": None if m else 1000.0, "precipitation_last_hour": m} for m in (0, 1, 2)]
    lines = [*map(json.dumps, rows), json.dumps(rows[0]), "{broken", json.dumps(rows[1] | {"timestamp": "never"})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines) + "\n")
    got = []
    raw = log.read_stream(spark, str(tmp_path / "in"), "value string", "text")
    out = features.weather_records(raw, "5 minutes", distinct=True)
    run(features.upsert_sink(out, str(tmp_path / "cp"), lambda df, n: got.extend(df.collect())))
    assert [r["key"] for r in got] == ["KMSN"]
    v = json.loads(got[0]["value"])
    assert (v["measurement_count"], v["temperature_mean"], v["precipitation_max"], v["wind_speed_max"]) == (3, 1.0, 2.0, 0.0)
    assert v["pressure_min"] == 1000.0 and v["pressure_max"] == 1013.25 and v["window_start"] == "2025-12-13 09:00:00"


def test_monitor_reads_the_lag_of_a_source():
    from types import SimpleNamespace as N

    assert monitor.behind(N(metrics={"maxOffsetsBehindLatest": "12"}, latestOffset=None, endOffset=None)) == 12
    assert monitor.behind(N(metrics={}, latestOffset='{"t": {"0": 15, "1": 7}}', endOffset='{"t": {"0": 10}}')) == 12
    assert monitor.behind(N(metrics=None, latestOffset=None, endOffset='{"logOffset": 3}')) is None
