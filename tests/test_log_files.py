"""The log as a data source: offsets, restarts, trimmed and renewed logs, bounds."""

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from tidemark.sources import log_files
from tidemark.streaming import features


def append(path, partition, first, lines):
    folder = path / f"partition={partition}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{first:020d}.log").write_text("".join(f"{x}\n" for x in lines))


def once(spark, path, folder, **options):
    """Reads what is there in as many batches as it takes, stops, and gives all rows so far."""
    log_files.register(spark)
    sizes = []

    def write(df, n):
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
        sizes.append(spark.read.parquet(f"{folder}/out/batch={n}").count())

    s = spark.readStream.format("tidemark_log").option("path", f"file://{path}").options(**options).load()
    q = s.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/cp").trigger(processingTime="100 milliseconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = spark.read.schema("partition int, offset long, value string").parquet(*[f"{folder}/out/{d}" for d in os.listdir(f"{folder}/out")])
    return sorted((r["partition"], r["offset"], r["value"]) for r in rows.collect()), sizes


def test_restart_and_trimmed_segments(spark, tmp_path):
    log = tmp_path / "log"
    append(log, 0, 0, ["a0", "a1", "a2"])
    append(log, 1, 5, ["b5"])
    first, _ = once(spark, log, tmp_path)
    assert first == [(0, 0, "a0"), (0, 1, "a1"), (0, 2, "a2"), (1, 5, "b5")]
    # While the query is down, records come, and those of partition 0 that follow directly are trimmed.
    append(log, 0, 5, ["a5", "a6"])
    append(log, 1, 6, ["b6"])
    append(log, 2, 0, ["c0"])
    (log / "partition=0" / f"{0:020d}.log").unlink()
    second, _ = once(spark, log, tmp_path)
    assert second == sorted([*first, (0, 5, "a5"), (0, 6, "a6"), (1, 6, "b6"), (2, 0, "c0")])
    again, _ = once(spark, log, tmp_path)
    assert again == second


def test_a_log_made_anew_is_read_from_its_begin(spark, tmp_path):
    log = tmp_path / "log"
    append(log, 0, 0, ["old"] * 9)
    once(spark, log, tmp_path)
    shutil.rmtree(log)
    append(log, 0, 0, ["new0", "new1"])
    got, _ = once(spark, log, tmp_path)
    assert [r for r in got if r[2].startswith("new")] == [(0, 0, "new0"), (0, 1, "new1")] and len(got) == 11


def test_an_unfinished_batch_is_read_again_as_it_was(spark, tmp_path):
    log_files.register(spark)
    log = tmp_path / "log"
    append(log, 0, 0, ["a0", "a1"])

    def fail(df, n):
        raise RuntimeError("sink is away")

    s = spark.readStream.format("tidemark_log").option("path", str(log)).load()
    q = s.writeStream.foreachBatch(fail).option("checkpointLocation", f"{tmp_path}/cp").start()
    with pytest.raises(Exception, match="sink is away"):
        q.awaitTermination(60)
    append(log, 0, 2, ["a2"])
    got, sizes = once(spark, log, tmp_path)
    assert got == [(0, 0, "a0"), (0, 1, "a1"), (0, 2, "a2")] and sizes == [2, 1]


def test_bounds_on_records_hold_after_a_restart_too(spark, tmp_path):
    log = tmp_path / "log"
    append(log, 0, 0, [str(i) for i in range(10)])
    append(log, 0, 10, [str(i) for i in range(10, 17)])
    options = {"maxRecords": "4", "progress": str(tmp_path / "progress")}
    got, sizes = once(spark, log, tmp_path, **options)
    assert [int(r[2]) for r in got] == list(range(17)) and max(sizes) <= 4 and sum(sizes) == 17
    append(log, 0, 17, [str(i) for i in range(17, 30)])
    got, sizes = once(spark, log, tmp_path, **options)
    assert [int(r[2]) for r in got] == list(range(30)) and max(sizes) <= 4


def test_a_batch_waits_for_records_or_seconds(tmp_path):
    log = tmp_path / "log"
    append(log, 0, 0, ["x"] * 3)
    r = log_files._StreamReader(str(log), 100, 5, 0.3, None)
    start = r.initialOffset()
    assert r.latestOffset() == start
    append(log, 0, 3, ["x"] * 2)
    assert r.latestOffset() == {"0": 5}
    r.partitions(start, {"0": 5})
    append(log, 0, 5, ["x"])
    assert r.latestOffset() == {"0": 5}
    time.sleep(0.4)
    assert r.latestOffset() == {"0": 6}


def test_progress_that_is_a_batch_behind_does_not_stop_the_query(spark, tmp_path):
    log = tmp_path / "log"
    append(log, 0, 0, [str(i) for i in range(10)])
    options = {"maxRecords": "4", "progress": str(tmp_path / "progress")}
    once(spark, log, tmp_path, **options)
    (tmp_path / "progress").write_text('{"0": 6}')
    append(log, 0, 10, [str(i) for i in range(10, 20)])
    got, sizes = once(spark, log, tmp_path, **options)
    assert [int(r[2]) for r in got] == list(range(20)) and max(sizes) <= 4


@pytest.mark.parametrize("start,end,want", [
    ({0: 12}, {0: 17}, [(10, 2, 3), (15, 0, 2)]),
    ({0: 3}, {0: 17}, [(10, 0, 5), (15, 0, 2)]),  # trimmed
    ({0: 99}, {0: 17}, [(10, 0, 5), (15, 0, 2)]),  # behind the end
    ({0: 17}, {0: 17}, []),
    ({}, {0: 11}, [(10, 0, 1)]),  # a new partition
    ({0: 12}, {0: 40}, [(10, 2, 3), (15, 0, 5)]),  # trimmed at the end: what is there
])
def test_starts_are_checked_against_what_is_there(start, end, want):
    segments = {0: [(10, "f", 15), (15, "g", 20)]}
    assert [(p.first, p.skip, p.take) for p in log_files.pieces(segments, start, end)] == want


def test_written_and_read_as_a_table(spark, tmp_path):
    log_files.register(spark)
    path = f"file://{tmp_path}/log"
    df = spark.range(1000).select(F.concat(F.lit("é "), F.col("id")).alias("value")).repartition(3)
    for _ in range(2):
        df.write.format("tidemark_log").option("path", path).option("segmentRecords", "130").mode("append").save()
    got = spark.read.format("tidemark_log").option("path", path).load()
    assert got.count() == 2000 and got.select("value").distinct().count() == 1000
    by = got.groupBy("partition").agg(F.count("*").alias("n"), F.max("offset").alias("last"), F.count_distinct("offset").alias("d")).collect()
    assert all(r["n"] == r["last"] + 1 == r["d"] for r in by) and len(by) == 3
    with pytest.raises(Exception, match="line feed"):
        spark.createDataFrame([("a\nb",)], "value string").write.format("tidemark_log").option("path", path).mode("append").save()
    assert spark.read.format("tidemark_log").option("path", path).load().count() == 2000
    assert spark.read.format("tidemark_log").option("path", f"{tmp_path}/none").load().count() == 0


def test_with_the_file_sink(spark, tmp_path):
    log_files.register(spark)
    append(tmp_path / "log", 0, 0, ["1", "2"])
    s = spark.readStream.format("tidemark_log").option("path", str(tmp_path / "log")).load()
    q = features.file_sink(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
