"""Quantile sketches against exact ranks."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import sketches
from tidemark.streaming import features

from .test_streaming import run, stream, write


def exact_rank(values, x):
    """The share of values up to x, as an interval where values are equal."""
    v = np.sort(values)
    return np.searchsorted(v, x, "left") / len(v), np.searchsorted(v, x, "right") / len(v)


def within(values, x, p, bound):
    low, high = exact_rank(values, x)
    return low - bound <= p <= high + bound


def test_merged_windows_stay_within_the_rank_error(spark):
    rng = np.random.default_rng(1)
    start = dt.datetime(2024, 1, 1)
    rows = [("ab"[i % 2], start + dt.timedelta(minutes=int(rng.integers(0, 60 * 24 * 5))), float(v) if rng.random() < 0.95 else None) for i, v in enumerate(np.r_[rng.lognormal(0, 2, 30_000), np.round(rng.normal(0, 3, 30_000))])]
    df = spark.createDataFrame(rows, "k string, t timestamp, v double").repartition(7)
    daily = sketches.window_sketches(df, ["k"], "t", "v", "1 day").persist()
    assert daily.count() == 10
    ps = [0.01, 0.25, 0.5, 0.9, 0.99]
    names = [f"p{i}" for i in range(5)]
    for span, some in (("all", daily), ("two days", daily.where("window_start >= '2024-01-02' and window_end <= '2024-01-04'"))):
        days = (1, 2) if span == "two days" else range(5)
        for r in sketches.summary(sketches.merged(some, ["k"]), ["k"], ps, names).collect():
            own = np.array([v for k, t, v in rows if k == r["k"] and v is not None and (t - start).days in days])
            assert (r["n"], r["least"], r["most"]) == (len(own), own.min(), own.max())
            # Five quantiles, two keys and two spans: twice the bound of a single one.
            assert all(within(own, r[c], p, 2 * sketches.rank_error(200)) for p, c in zip(ps, names, strict=True))
    total = sketches.summary(sketches.merged(daily.withColumn("all", F.lit(1)), ["all"]), ["all"], [0.5], ["p50"]).first()
    own = np.array([v for _, _, v in rows if v is not None])
    assert total["n"] == len(own) and within(own, total["p50"], 0.5, 2 * sketches.rank_error(200))
    daily.unpersist()


def test_larger_sketches_are_closer(spark):
    df = spark.range(200_000).select(F.lit(1).alias("k"), F.lit(dt.datetime(2024, 1, 1)).alias("t"), F.xxhash64("id").cast("double").alias("v"))
    own = np.array([r["v"] for r in df.collect()])
    for k in (50, 200, 2000):
        s = sketches.summary(sketches.window_sketches(df, ["k"], "t", "v", "1 day", k), ["k"], [0.5], ["p"]).first()
        assert within(own, s["p"], 0.5, 2 * sketches.rank_error(k))


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), None), (1, dt.datetime(2024, 1, 2), 5.0)], "k int, t timestamp, v double")
    got = sketches.summary(sketches.window_sketches(df, ["k"], "t", "v", "1 day").orderBy("window_start"), ["k"], [0.5], ["p"]).collect()
    assert sorted((r["n"], r["least"], r["p"]) for r in got if r["n"]) == [(1, 5.0, 5.0)]
    assert sum(r["n"] or 0 for r in got) == 1
    assert sketches.merged(sketches.window_sketches(df.where("false"), ["k"], "t", "v", "1 day"), ["k"]).count() == 0


def test_sketches_of_a_stream_merge_with_those_of_a_table(spark, tmp_path):
    rows = [("a", 60 * i, i, float(i)) for i in range(240)]
    for n in range(3):
        write(spark, tmp_path / "in", rows[80 * n : 80 * n + 80], n)
    write(spark, tmp_path / "in", [("end", 90_000, 0, 0.0)], "z")
    live = stream(spark, tmp_path / "in").withColumn("t", F.col("t").cast("timestamp")).withWatermark("t", "10 minutes")
    out = sketches.window_sketches(live, ["k"], "t", "v", "1 hour")
    run(features.file_sink(out, str(tmp_path / "out"), str(tmp_path / "cp")))
    stored = spark.read.parquet(str(tmp_path / "out"))
    batch = spark.createDataFrame([("a", dt.datetime(2023, 12, 31), -1.0)], "k string, t timestamp, v double")
    both = stored.unionByName(sketches.window_sketches(batch, ["k"], "t", "v", "1 hour"))
    r = sketches.summary(sketches.merged(both, ["k"]), ["k"], [0.5], ["p50"]).where("k = 'a'").first()
    assert (r["n"], r["least"], r["most"]) == (241, -1.0, 239.0) and abs(r["p50"] - 119) <= 241 * 2 * sketches.rank_error(200)
