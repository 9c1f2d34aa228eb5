"""What the physical plans must and must not hold."""

from pyspark.sql import functions as F

from tidemark.operators import align, serving
from tidemark.operators import windows as W
from tidemark.plans import catalog
from tidemark.plans.base import BY_USER, readings
from tidemark.sources import archive


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_exchange_for_a_chain_of_row_windows(spark, data):
    df = readings(spark, data)
    df = W.rate_of_change(df, BY_USER, ["temperature"])
    df = W.trend(df, BY_USER, "temperature")
    df = W.rolling(W.lags(df, BY_USER, ["temperature"], [1, 7]), BY_USER, ["temperature"], [7])
    assert plan(df).count("Exchange hashpartitioning") == 1


def test_window_stats_aggregate_before_the_shuffle(spark, data):
    p = plan(catalog.queries()["sliding_window_stats"](spark, data))
    assert p.count("Exchange") == 1 and "partial_avg" in p and "Python" not in p


def test_only_needed_columns_are_read(spark, data):
    p = plan(catalog.queries()["throughput"](spark, data))
    assert "ReadSchema: struct<ts:timestamp_ntz>" in p


def test_filters_reach_the_scan(spark, data):
    assert "EqualTo(event_type,purchase)" in plan(catalog.queries()["asof_latest"](spark, data))


def test_no_single_partition_window(spark, data):
    for name in ("global_chronological_split", "last_n_per_partition", "anomaly_iqr"):
        p = plan(catalog.queries()[name](spark, data))
        assert not any("Window" in line and "SinglePartition" in line for line in p.splitlines()), name


def test_top_k_and_group_limit(spark, data):
    assert "TakeOrderedAndProject" in plan(catalog.queries()["recent_topk"](spark, data))
    assert "WindowGroupLimit" in plan(catalog.queries()["last_n_per_partition"](spark, data))


def test_lookup_broadcasts_only_a_checked_size(spark):
    dim = spark.range(10).withColumnRenamed("id", "k").withColumn("name", F.lit("x"))
    assert "broadcast" in align.small(dim)._jdf.queryExecution().logical().toString().lower() or "ResolvedHint" in align.small(dim)._jdf.queryExecution().logical().toString()
    assert align.small(dim, most=5) is dim


def test_latest_needs_no_sort_of_rows(spark, data):
    p = plan(catalog.queries()["latest_per_key"](spark, data))
    assert "Window" not in p and "partial_max_by" in p


def test_archive_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([("a", "A b", "2025-12-13T09:50:00+00:00", 1.0), ("b", "C/d", None, 2.0)], "station_id string, station_name string, timestamp string, temperature double")
    archive.with_partitions(df).write.partitionBy("event_date", "station").json(str(tmp_path / "x"))
    got = archive.read_archive(spark, str(tmp_path / "x")).where("event_date = date'2025-12-13' and station = 'A_b'")
    assert got.count() == 1 and "PartitionFilters: [" in plan(got) and "station" in plan(got).split("PartitionFilters")[1].split("]")[0]
    assert serving.latest(got, ["station"], ["timestamp"]).count() == 1
