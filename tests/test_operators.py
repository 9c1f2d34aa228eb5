"""Hand-computed small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import aggregate, align, anomaly, clean, evaluate, ranks, serving
from tidemark.operators import windows as W
from tidemark.sources.shared import stored
from tidemark.spec import SeriesSpec

SPEC = SeriesSpec(("k",), "t", ("i",), ("v",))
T0 = dt.datetime(2024, 1, 1)


def series(spark, values, key="a", step=60):
    rows = [(key, T0 + dt.timedelta(seconds=step * i), i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, t timestamp, i long, v double")


def column(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_rate_first_row_null_before_and_no_time(spark):
    df = series(spark, [1.0, 7.0, None, 4.0])
    assert column(W.rate_of_change(df, SPEC, ["v"]), "v_rate") == [0.0, 0.1, 0.0, 0.0]
    same = series(spark, [1.0, 7.0], step=0)
    assert column(W.rate_of_change(same, SPEC, ["v"]), "v_rate") == [0.0, 0.0]


def test_trend(spark):
    df = series(spark, [1.0, 1.0, 1.0, 5.0, 0.0, 0.0])
    assert column(W.trend(df, SPEC, "v", 2), "v_trend") == [0, 0, 0, 1, 1, -1]


def test_supervised_needs_full_frame_and_target(spark):
    got = W.supervised(series(spark, [float(i) for i in range(10)]), SPEC, "v").orderBy("i").collect()
    assert [r["i"] for r in got] == [7, 8]
    assert got[0]["v_roll_mean"] == 4.0 and got[0]["target"] == 8.0 and got[0]["v_lag_7"] == 0.0


def test_sequences_count_and_content(spark):
    got = W.sequences(series(spark, [float(i) for i in range(8)]), SPEC, ["v"], "v", 3, 2).orderBy("i").collect()
    assert len(got) == 8 - 3 - 2 + 1
    assert got[0]["x"] == [[0.0], [1.0], [2.0]] and got[0]["y"] == [3.0, 4.0]
    assert W.sequences(series(spark, [1.0]), SPEC, ["v"], "v", 3, 2).count() == 0


def test_rolling_excludes_own_row(spark):
    got = W.rolling(series(spark, [1.0, 2.0, 9.0]), SPEC, ["v"], [2], until=-1)
    assert column(got, "v_roll_2_mean") == [None, 1.0, 1.5]


def test_directional_accuracy_single_row(spark):
    df = series(spark, [1.0]).withColumn("p", F.lit(1.0))
    assert W.directional_accuracy(df, ["k"], ["t"], "v", "p").first()["directional_accuracy"] == 0.0


def test_global_split_matches_plain_split(spark):
    df = spark.range(1000).withColumn("t", (F.col("id") * 7919 % 1009))
    got = W.global_split(df, ["t", "id"], 4, stored)
    n = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert n == {"train": 700, "val": 150, "test": 150}
    assert got.where("split = 'train'").agg(F.max("t")).first()[0] <= got.where("split = 'test'").agg(F.min("t")).first()[0]
    assert W.global_index(df.limit(0), ["t"], 4, stored).count() == 0


def test_slices_equal_one_window(spark):
    df = series(spark, [float(i % 7) for i in range(400)], step=300)

    def f(d, s):
        from pyspark.sql import Window

        w = Window.partitionBy(*s.keys).orderBy(F.unix_micros("t")).rangeBetween(-3_600_000_000, 0)
        return d.withColumn("m", F.avg("v").over(w))

    assert column(W.in_slices(df, SPEC, 7200, 3600, f), "m") == column(f(df, SPEC), "m")


def test_fill_modes_and_unknown(spark):
    df = spark.createDataFrame([(None, None)], "temperature double, pressure double")
    assert tuple(clean.fill_constants(df).first()) == (0.0, 1013.25)
    assert tuple(clean.fill_constants(df, mode="skip").first()) == (None, None)
    with pytest.raises(ValueError):
        clean.fill_constants(df, mode="other")


def test_fill_both_ways(spark):
    df = series(spark, [None, 2.0, None, 3.0, None])
    assert column(clean.forward_backward_fill(df, SPEC, ["v"]), "v") == [2.0, 2.0, 2.0, 3.0, 3.0]
    assert column(clean.forward_backward_fill(df, SPEC, ["v"], backward=False), "v") == [None, 2.0, 2.0, 3.0, 3.0]


def test_median_impute_all_null_stays_null(spark):
    df = spark.createDataFrame([("a", None), ("b", 1.0), ("b", None)], "k string, v double")
    assert sorted(map(str, [r["v"] for r in clean.median_impute(df, ["v"], by=["k"]).collect()])) == ["1.0", "1.0", "None"]


def test_sparse_columns_and_mapping(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 1)], "a int, b int")
    assert clean.drop_sparse(df).columns == ["a"]
    assert clean.map_feature_set(["dew"], ["humidity"], {"humidity": ["rh", "dew"]}) == {"humidity": "dew"}
    with pytest.raises(ValueError):
        clean.map_feature_set([], ["humidity"], {})


def test_timestamps_of_three_forms_and_none(spark):
    texts = ["2025-12-13T09:50:00+00:00", "2025-12-13T09:50:00.123456", "2025-12-13T09:50:00", "rubbish", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(S.any_iso_timestamp(F.col("t")).cast("string").alias("x"))
    assert [r["x"] for r in got.collect()] == ["2025-12-13 09:50:00", "2025-12-13 09:50:00.123456", "2025-12-13 09:50:00", None, None]


def test_window_stats_single_value_has_no_deviation(spark):
    got = aggregate.window_stats(series(spark, [3.0]), SPEC, "5 minutes").first()
    assert got["v_mean"] == 3.0 and got["v_std"] is None and got["measurement_count"] == 1


def test_panes_equal_plain_windows(spark):
    df = series(spark, [float(i * i % 17) if i % 5 else None for i in range(100)], step=37)
    a = aggregate.window_stats(df, SPEC, "10 minutes", "2 minutes").orderBy("window_start").collect()
    b = aggregate.pane_window_stats(df, SPEC, "10 minutes", "2 minutes").orderBy("window_start").collect()
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for c in ("v_mean", "v_std", "v_min", "v_max", "measurement_count"):
            assert x[c] == y[c] or abs(x[c] - y[c]) < 1e-9


def test_circular_mean_of_north_and_of_opposites(spark):
    df = spark.createDataFrame([("n", 350.0), ("n", 10.0), ("o", 0.0), ("o", 180.0), ("z", None)], "k string, d double")
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(aggregate.circular_mean("d").alias("m")).collect()}
    assert got == {"n": 0.0, "o": None, "z": None}


def test_regression_constant_actual_and_zero_actual(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, -1.0)], "y_true double, y_pred double")
    got = evaluate.regression(df).first()
    assert got["mape"] == 0.0 and got["mae"] == 1.0 and got["std_error"] == 1.0 and got["r2"] < -1e5
    assert evaluate.regression(df, strict_r2=True).first()["r2"] == 0.0


def test_asof_ties_and_before_first(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9)], "i long, k string, t long")
    right = spark.createDataFrame([("a", 5, 50.0), ("a", 3, 30.0)], "k string, t long, x double")
    got = align.asof_latest(left, right, ["k"], "t", ["x"], "i")
    assert {r["i"]: r["x"] for r in got.collect()} == {1: 50.0, 2: None, 3: None}


def test_latest_and_last_n(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, o long, v string")
    assert {r["k"]: r["v"] for r in serving.latest(df, ["k"], ["o"]).collect()} == {"a": "z", "b": None}
    assert serving.last_n(df, ["k"], ["o"], 2).count() == 3


def test_anomaly_reasons(spark):
    df = series(spark, [1.0, 2.0, 1.0, 2.0, 1.0, 2.0, 100.0, -100.0])
    got = anomaly.zscore(df, SPEC, "v", limit=2.0).orderBy("i").collect()
    assert got[6]["is_anomaly"] and got[6]["reasons"] == ["v above recent range"] and got[0]["reasons"] == []


def test_duplicate_and_loss_rate_of_nothing(spark):
    none = spark.createDataFrame([], "k string")
    assert aggregate.duplicate_rate(none, ["k"]).first()["duplicate_rate"] == 0.0
    assert aggregate.loss_rate(none, none, ["k"]).first()["loss_rate"] == 0.0


def test_percentiles_running_totals_and_previous_rows(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 7.0, rng.uniform(0, 9), float(rng.randrange(4))]), i) for i in range(700)] + [("c", None, 1000), ("d", 2.5, 1001)]
    df = spark.createDataFrame(rows, "k string, v double, i long").repartition(5)
    want = {(r["k"], r["q"][0], r["q"][1]) for r in df.where("v is not null").groupBy("k").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.9))).alias("q")).collect()}
    got = {(r["k"], r["p0"], r["p1"]) for r in ranks.percentiles(df, ["v"], [0.25, 0.9], ["k"]).collect()}
    assert {(k, round(a, 9), round(b, 9)) for k, a, b in got} == {(k, round(a, 9), round(b, 9)) for k, a, b in want}
    assert clean.medians(df.limit(0), ["v"]).first()["median_v"] is None
    for parts in (1, 7):
        last, total = {}, {}
        expected = {}
        for k, v, i in sorted(rows, key=lambda r: r[2]):
            expected[i] = (last.get(k), total.get(k, 0))
            last[k], total[k] = v, total.get(k, 0) + i
        back = {r["i"]: r["v_before"] for r in ranks.previous(df, ["k"], ["i"], ["v"], parts).collect()}
        sums = {r["i"]: (r["n_before"], r["n_all"]) for r in ranks.running(df.withColumn("n", F.col("i")), ["k"], "i", ["n"], parts).collect()}
        assert back == {i: b for i, (b, _) in expected.items()}
        assert sums == {i: (expected[i][1], total[k]) for k, _, i in rows}


def test_ranking_against_all_pairs(spark):
    rows = [(i, (i * 7) % 5, int((i * i) % 3 == 1)) for i in range(60)] + [(99, None, 1), (100, 1, None)]
    df = spark.createDataFrame(rows, "i long, s long, y int")
    got = evaluate.ranking(df, F.col("y"), F.col("s")).first()
    known = [(s, y) for _, s, y in rows if s is not None and y is not None]
    pos, neg = [s for s, y in known if y], [s for s, y in known if not y]
    assert abs(got["roc_auc"] - sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)) < 1e-12
    ap = sum(sum(1 for q in pos if q >= p) / sum(1 for q, _ in known if q >= p) for p in pos) / len(pos)
    assert abs(got["average_precision"] - ap) < 1e-12
    assert evaluate.ranking(df.where("y = 1"), F.col("y"), F.col("s")).first()["roc_auc"] is None


def test_constant_fill_knows_raw_names_and_refuses_unknown_ones(spark):
    raw = spark.createDataFrame([("a", None, None)], "station_id string, sea_level_pressure double, precipitation_last_hour double")
    assert tuple(clean.fill_constants(raw).first())[1:] == (1013.25, 0.0)
    with pytest.raises(ValueError, match="pressure"):
        clean.fill_constants(raw, {"pressure": 1.0})
    assert clean.fill_constants(raw, {"pressure": 1.0}, absent="ignore").first()["sea_level_pressure"] is None
