"""Ranges of long series against plain windows and plain Python."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import align, anomaly, clean, ranges
from tidemark.operators import windows as W
from tidemark.plans import catalog
from tidemark.spec import SeriesSpec

SPEC = SeriesSpec(("k",), "t", ("i",))


@pytest.fixture(scope="module")
def rows(spark):
    """One hot key, some short ones, a null key, equal times, null times and null values."""
    rng = random.Random(1)
    out = []
    for i in range(900):
        k = "hot" if i % 3 else rng.choice(["a", "b", None, "zz", f"k{i}"])
        out.append((k, rng.choice([None, *range(40)]) if i % 5 == 0 else rng.randrange(200), i, float(rng.randrange(50)) if rng.random() < 0.7 else None))
    return spark.createDataFrame(out, "k string, t int, i int, v double").repartition(5)


def canonical(df):
    return sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("parts", [1, 7, 150])
def test_windows_by_rows_equal_plain_windows(rows, parts):
    """150 ranges of 6 rows: windows of 8 rows reach over several of them."""

    def f(df, s):
        df = W.rolling(df, s, ["v"], [3, 8])
        df = W.lags(df, s, ["v"], [1, 5])
        w = s.rows()
        return df.withColumns({"next": F.lead("v", 7).over(w), "n": F.count("*").over(w.rowsBetween(-8, 7))})

    got = ranges.by_rows(rows, SPEC, 8, 7, f, parts)
    assert canonical(got) == canonical(f(rows, SPEC))


@pytest.mark.parametrize("parts", [4, 60])
def test_sequences_trend_and_zscore_by_rows(rows, parts):
    cases = [
        (0, 7, lambda df, s: W.sequences(df, s, ["v"], "v", 5, 3)),
        (10, 0, lambda df, s: W.trend(df, s, "v", 5)),
        (20, 0, lambda df, s: anomaly.zscore(df, s, "v", 20)),
        (7, 1, lambda df, s: W.supervised(df, s, "v")),
    ]
    for before, after, f in cases:
        assert canonical(ranges.by_rows(rows, SPEC, before, after, f, parts)) == canonical(f(rows, SPEC))


@pytest.mark.parametrize("parts", [1, 6, 120])
@pytest.mark.parametrize("backward", [True, False])
def test_fill_equals_plain_fill(rows, parts, backward):
    gaps = rows.withColumns({"w": F.when(F.col("i") % 50 == 0, F.col("i")), "none": F.lit(None).cast("long")})
    got = ranges.fill(gaps, SPEC, ["v", "w", "none"], backward, parts)
    assert canonical(got) == canonical(clean.forward_backward_fill(gaps, SPEC, ["v", "w", "none"], backward))


def test_no_range_holds_the_hot_key(spark):
    df = spark.range(100_000).select(F.lit("one").alias("k"), F.col("id").cast("int").alias("t"), F.lit(0).alias("i"), F.rand(1).alias("v"))
    seen = {}

    def f(t, s):
        assert s.keys == ("k", "_part")
        seen["most"] = t.groupBy("_part").count().agg(F.max("count")).first()[0]
        return W.rolling(t, s, ["v"], [30])

    got = ranges.by_rows(df, SPEC, 29, 0, f, 20).agg(F.count("*"), F.round(F.sum("v_roll_30_mean"), 6)).first()
    assert seen["most"] < 100_000 / 20 * 3 + 29
    assert got == W.rolling(df, SPEC, ["v"], [30]).agg(F.count("*"), F.round(F.sum("v_roll_30_mean"), 6)).first()


def test_no_window_of_a_key_in_the_plan(rows):
    p = ranges.by_rows(rows, SPEC, 8, 0, lambda df, s: W.rolling(df, s, ["v"], [3]), 8)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in p.splitlines() if "hashpartitioning(k#" in line]
    assert dealt and all("_part" in line for line in dealt)


def test_empty_and_clashing_columns(spark, rows):
    none = rows.where("false")
    assert ranges.by_rows(none, SPEC, 3, 3, lambda df, s: W.rolling(df, s, ["v"], [3]), 4).count() == 0
    assert ranges.fill(none, SPEC, ["v"]).count() == 0
    with pytest.raises(ValueError):
        ranges.fill(rows.withColumn("_part", F.lit(1)), SPEC, ["v"])


def brute(left, right, tolerance=None):
    out = []
    for lk, lt, li in left:
        best = None
        for rk, rt, tie, v in right:
            if rk is None or rk != lk or rt is None or lt is None or rt > lt or tolerance is not None and rt < lt - tolerance:
                continue
            place = (rt, tie is not None, tie or 0)
            if best is None or place > best[0]:
                best = (place, v)
        out.append((lk, lt, li, None if best is None else best[1]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts,tolerance", [(None, 3), (None, None), (1, None), (9, 3), (64, None)])
def test_asof_equals_brute_force_with_ties(spark, parts, tolerance):
    rng = random.Random(2)
    keys = ["hot", "hot", "hot", "a", None, "b"]
    left = [(rng.choice(keys), rng.choice([None, *range(60)]), i) for i in range(300)]
    right = [(rng.choice(keys), rng.choice([None, *range(0, 60, 4)]), None if i % 17 == 0 else i, rng.choice([None, float(i)])) for i in range(200)]
    seen, unique = set(), []
    for r in right:  # a null tie once for each key and time
        if r[2] is not None or (r[0], r[1]) not in seen:
            unique.append(r)
        if r[2] is None:
            seen.add((r[0], r[1]))
    lf = spark.createDataFrame(left, "k string, t int, i int").repartition(4)
    rf = spark.createDataFrame(unique, "k string, t int, tie int, v double").repartition(3)
    got = align.asof_latest(lf, rf, ["k"], "t", ["v"], "i", ["tie"], tolerance, parts)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(left, unique, tolerance)


@pytest.mark.parametrize("parts", [None, 5])
def test_asof_gives_one_answer_for_any_order_of_rows(spark, parts):
    left = spark.createDataFrame([(1, 10)], "k int, t int")
    values = [(1, 10, float(i)) for i in range(20)]
    answers = set()
    for order in (values, values[::-1], sorted(values, key=lambda r: -r[2] % 7)):
        right = spark.createDataFrame(order, "k int, t int, v double")
        answers.add(align.asof_latest(left, right, ["k"], "t", ["v"], parts=parts).first()["v"])
        assert align.asof_latest(left, right, ["k"], "t", ["v"], right_ties=["v"], parts=parts).first()["v"] == 19.0
    assert len(answers) == 1


def test_asof_many_equal_rows_are_dealt_apart(spark):
    """50,000 left rows at one time of one key: ranges cut through them."""
    left = spark.range(50_000).select(F.lit(1).alias("k"), F.lit(5).alias("t"), "id")
    right = spark.createDataFrame([(1, 1, 1.0), (1, 5, 2.0), (1, 6, 3.0)], "k int, t int, v double")
    got = align.asof_latest(left, right, ["k"], "t", ["v"], parts=16)
    assert got.groupBy("v").count().collect() == [(2.0, 50_000)]
    p = got._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in p.splitlines() if "hashpartitioning" in line and "_last" not in line]
    assert any("hashpartitioning(_part" in line for line in dealt)
    with pytest.raises(ValueError):
        align.asof_latest(left, right.withColumn("id", F.lit(1)), ["k"], "t", ["id"])


def test_asof_of_nothing(spark):
    left = spark.createDataFrame([], "k int, t int")
    right = spark.createDataFrame([(1, 1, 1.0)], "k int, t int, v double")
    for parts in (None, 4):
        assert align.asof_latest(left, right, ["k"], "t", ["v"], parts=parts).count() == 0
        assert align.asof_latest(right.drop("v"), right.limit(0), ["k"], "t", ["v"], parts=parts).first()["v"] is None


@pytest.mark.parametrize("query", ["whole_series_fill", "daily_order_fill", "forward_backward_fill"])
def test_no_fill_adds_up_to_the_end_for_each_row(spark, data, query):
    """A frame that ends with the last row is gone through anew for each of its rows, a square of them."""
    if query == "forward_backward_fill":
        df = clean.forward_backward_fill(spark.range(9).selectExpr("'a' as k", "id as t", "id as i", "1 as v"), SPEC, ["v"])
    else:
        df = catalog.queries()[query](spark, data)
    assert "unboundedfollowing" not in df._jdf.queryExecution().executedPlan().toString().lower()


def test_fill_of_rows_at_one_place_takes_one_order(spark):
    """Rows that are equal in time and ties: what is known of one is the only thing known to all."""
    df = spark.createDataFrame([("a", 1, 1, None), ("a", 1, 1, 5.0), ("a", 1, 1, None), ("b", None, None, 2.0), ("b", 3, 1, None)], "k string, t int, i int, v double")
    for got in (clean.forward_backward_fill(df, SPEC, ["v"]), ranges.fill(df, SPEC, ["v"], parts=3)):
        assert sorted((r["k"], r["v"]) for r in got.collect()) == [("a", 5.0)] * 3 + [("b", 2.0)] * 2


def test_trailing_means_equal_plain_range_windows(spark):
    """Several keys and a null one, equal times, times on the borders of panes, null times and values, silences."""
    rng = random.Random(5)
    times = [None, -3600, -1, 0, 59, 60, 61, 120, 600, *[rng.randrange(-300, 4000) for _ in range(300)]]
    out = [(rng.choice(["a", "b", None]), None if t is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t), i, None if i % 5 == 0 else float(rng.randrange(100))) for i, t in enumerate(times + times)]
    df = spark.createDataFrame(out, "k string, t timestamp, i int, v double")
    w = Window.partitionBy("k").orderBy(F.unix_micros("t")).rangeBetween(-60_000_000, 0)
    want = df.withColumns({"trailing_mean": F.avg("v").over(w), "trailing_count": F.count("*").over(w)})
    assert canonical(W.trailing(df, SPEC, "v", 60)) == canonical(want)


def test_hour_stats_are_running_sums(spark, data):
    """A frame with two ends is added up anew for each row; one that begins with the first row is not."""
    plan = catalog.queries()["sliced_hour_stats"](spark, data)._jdf.queryExecution().executedPlan().toString()
    frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]+),", plan)
    assert frames and set(frames) == {"unboundedpreceding$()"}
