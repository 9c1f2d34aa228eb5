"""The fit from sums against a plain one, and its errors on days it has not seen."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.forecast import models, seasonal
from tidemark.forecast.seasonal import Seasonality

START = dt.date(2018, 1, 1)


def made(n=1000, noise=2.0, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for k, slope in (("a", 0.02), ("b", -0.03), (None, 0.0)):
        i = np.arange(n)
        y = 100 + slope * i + 0.05 * np.maximum(0, i - 400) + 15 * np.sin(2 * np.pi * i / 365.25) + 5 * np.cos(2 * np.pi * i / 7) + rng.normal(0, noise, n)
        out += [(k, START + dt.timedelta(days=int(d)), float(v)) for d, v in zip(i, y, strict=True)]
    return out


@pytest.fixture(scope="module")
def daily(spark):
    return spark.createDataFrame(made(), "k string, ds date, y double").repartition(6)


def plain(rows, s, horizon):
    """One series in memory."""
    days = np.array([(d - dt.date(1970, 1, 1)).days for d, _ in rows], dtype=float)
    y = np.array([v for _, v in rows])
    z = np.log(np.maximum(y, 1e-9)) if s.multiplicative else y
    start, span = days.min(), days.max() - days.min()
    x = s.design(days, np.full(len(days), start), np.full(len(days), span))
    beta = np.linalg.lstsq(x.T @ x + s.penalty(), x.T @ z, rcond=None)[0]
    every = np.r_[days, days.max() + np.arange(1, horizon + 1)]
    hat = s.design(every, np.full(len(every), start), np.full(len(every), span)) @ beta
    return {int(d): v for d, v in zip(every, np.exp(hat) if s.multiplicative else hat, strict=True)}


@pytest.mark.parametrize("s", [Seasonality(), Seasonality(multiplicative=True, hinge_ridge=5.0, yearly=3)])
def test_sums_give_the_plain_fit(spark, daily, s):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = seasonal.forecast(daily, ["k"], 20, s).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = made()
    assert len(got) == len(rows) + 60
    for k in ("a", "b", None):
        want = plain([(d, v) for key, d, v in rows if key == k], s, 20)
        own = {(r["ds"] - dt.date(1970, 1, 1)).days: r for r in got if r["k"] == k}
        assert own.keys() == want.keys() and all(abs(own[d]["yhat"] - v) < 1e-5 for d, v in want.items())
        assert all(r["yhat_lower"] < r["yhat"] < r["yhat_upper"] for r in own.values())


def test_one_series_of_many_pieces(spark):
    """Half a million rows of one series: no task sees more than its share, and the fit is that of the model they were
    made with."""
    df = spark.range(500_000).select(F.lit(1).alias("k"), F.date_from_unix_date((F.col("id") % 5000).cast("int")).alias("ds"), (10 + 3 * F.sin(F.lit(2 * np.pi / 7) * (F.col("id") % 5000)) + F.randn(1)).alias("y"))
    s = Seasonality(yearly=1, weekly=1, changepoints=2)
    series = seasonal._series(df, ["k"], s)
    m = seasonal.fitted(series, ["k"], s).first()
    assert m["n"] == 500_000 and abs(m["sigma"] - 1) < 0.01 and abs(m["beta"][-2] - 3) < 0.02 and abs(m["beta"][0] - 10) < 0.1


def test_errors_of_unseen_days_and_their_intervals(daily):
    got = {r["k"]: r for r in seasonal.held_out_errors(daily, ["k"]).collect()}
    assert got.keys() == {"a", "b", None}
    for r in got.values():
        assert r["n"] == 100 and r["rmse"] < 4 and r["mae"] <= r["rmse"] and 0.55 <= r["coverage"] <= 1 and r["hinge_ridge"] in (0.1, 1.0, 10.0)


def test_nothing_short_and_repeated_days(spark):
    schema = "k string, ds date, y double"
    assert seasonal.forecast(spark.createDataFrame([], schema), ["k"], 5).count() == 0
    odd = spark.createDataFrame([("a", START, 1.0), ("a", START, 3.0), ("a", None, 1.0), ("b", START, None), ("c", START, 5.0)], schema)
    got = seasonal.forecast(odd, ["k"], 2).collect()
    assert sorted(r["k"] for r in got) == ["a"] * 4 + ["c"] * 3
    assert all(abs(r["yhat"] - 2) < 1e-6 for r in got if r["k"] == "a" and r["y"] is not None)


def test_models_seasonal_is_this_one(daily):
    got = models.build("seasonal", daily, ["k"], 3)
    assert got.columns == ["k", "ds", "y", "yhat", "yhat_lower", "yhat_upper"] and got.where("y is null").count() == 9
