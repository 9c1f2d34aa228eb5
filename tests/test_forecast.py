import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.forecast import frames, models, registry, scoring
from tidemark.operators import evaluate
from tidemark.operators import windows as W
from tidemark.sources.shared import stored
from tidemark.spec import SeriesSpec

SPEC = SeriesSpec(("k",), "ds")


@pytest.fixture(scope="module")
def daily(spark):
    rng = np.random.default_rng(1)
    rows = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), 50 + 20 * math.sin(2 * math.pi * i / 365.25) + 0.01 * i + float(rng.normal(0, 1))) for k in ("a", "b") for i in range(500)]
    return spark.createDataFrame(rows, "k string, ds date, y double").cache()


def mae(df, y, p):
    return evaluate.regression(df, actual=y, predicted=p).first()["mae"]


def test_steps_beat_persistence(daily):
    m = models.build("steps", 7, 3)
    frame = m.frame(daily, SPEC, ["y"], "y")
    split = W.chronological_split(frame, SPEC)
    m.fit(split.where("split = 'train'"))
    out = m.transform(split.where("split = 'test'")).withColumns({"y1": F.col("y")[2], "p1": F.col("predictions")[2], "last": F.col("x")[6][0]})
    assert mae(out, "y1", "p1") < mae(out, "y1", "last")


def test_tuning_on_a_second_data_set_lowers_its_errors(spark):
    """Daily swings of the new set go the other way; after tuning the forecaster follows them and still knows the old."""
    rng = np.random.default_rng(2)
    start = dt.date(2021, 1, 1)
    rows = [(k, start + dt.timedelta(days=i), (1 if k == "old" else -1) * 10 * math.sin(2 * math.pi * i / (7 if k == "old" else 5)) + float(rng.normal(0, 0.5))) for k, n in (("old", 400), ("new", 150)) for i in range(n)]
    m = models.StepRegression(7, 2)
    frame = m.frame(spark.createDataFrame(rows, "k string, ds date, y double"), SPEC, ["y"], "y")
    split = stored(W.chronological_split(frame, SPEC))
    learn = split.where("split = 'train'")
    old, new = learn.where("k = 'old'"), learn.where("k = 'new'")
    base = m.fit(old)

    def error(model, k):
        out = model.transform(split.where((F.col("k") == k) & (F.col("split") == "test"))).withColumns({"y0": F.col("y")[0], "p0": F.col("predictions")[0]})
        return mae(out, "y0", "p0")

    tuned = models.fine_tuned(base, old, new)
    assert error(tuned, "new") < 0.7 * error(base, "new") and error(tuned, "old") < 5


def test_enhanced_features_fill_and_interact(spark, daily):
    df = daily.withColumns({"low": F.col("y") - 5, "wind": F.when(F.dayofmonth("ds") % 9 != 0, 3.0), "rain": F.lit(0.5), "odd": F.when(F.dayofyear("ds") == 3, 1.0)})
    frame, made = models.enhanced_features(df, SPEC, "y", ["odd"], {"high": "y", "low": "low", "wind": "wind", "precip": "rain"}, fill=True)
    assert {"temp_range", "wind_temp", "log_precip", "y_lag_21", "y_roll_30_mean"} <= set(made)
    assert not any(c.startswith("odd_") for c in made)  # hardly ever known
    assert frame.count() == df.count() and frame.where(" or ".join(f"{c} is null" for c in made)).isEmpty()


def test_rows_without_a_feature_keep_their_place(spark, daily):
    df = daily.withColumn("f", F.when(F.dayofmonth("ds") > 3, F.col("y"))).where("ds < '2020-03-01'")
    model = models.boosted(["f"], "y", trees=2, depth=2).fit(df)
    out = models.predictions(model, df, ["f"])
    assert out.count() == df.count() and out.where("(f is null) <> (prediction is null) or (f is null) <> (error is not null)").isEmpty()


def test_boosted_without_leaks_and_registry(spark, daily, tmp_path):
    frame, made = models.enhanced_features(daily, SPEC, "y")
    assert {"y_lag_30", "y_roll_30_std", "y_pct_6", "month_sin", "is_winter"} <= set(made)
    split = stored(W.chronological_split(frame, SPEC).withColumn("check", F.col("split") == "val"))
    model = models.boosted(made, "y", validation="check", trees=15, depth=4).fit(split.where("split <> 'test'"))
    out = model.transform(split.where("split = 'test'"))
    mean = split.where("split = 'train'").agg(F.avg("y")).first()[0]
    assert mae(out, "y", "prediction") < 0.5 * mae(out.withColumn("mean", F.lit(mean)), "y", "mean")
    top = models.importances(model, made, 5)
    assert len(top) == 5 and top[0][1] >= top[-1][1]
    registry.save(spark, str(tmp_path), "boosted", "1", model, made, {"mae": 1.0}, trained_at=dt.datetime(2024, 1, 1))
    registry.save(spark, str(tmp_path), "boosted", "2", model, made, {"mae": 0.9}, trained_at=dt.datetime(2024, 1, 2))
    found, meta = registry.latest(spark, str(tmp_path), "boosted")
    assert meta["version"] == "2" and found.transform(out.drop("prediction", "features")).count() == out.count()
    with pytest.raises(LookupError):
        registry.latest(spark, str(tmp_path), "none")


def test_seasonal_follows_the_year(daily):
    past = daily.where("ds < date'2021-04-01'")
    out = models.build("seasonal", past, ["k"], 30)
    ahead = out.where("y is null").drop("y").join(daily, ["k", "ds"])
    assert ahead.count() == 60 and mae(ahead, "y", "yhat") < 4
    assert models.seasonal(past, ["k"], 5, multiplicative=True).where("yhat <= 0").isEmpty()
    with pytest.raises(ValueError):
        models.build("other")


def test_scores_keep_errors_with_their_rows(spark):
    class Double:
        def predict(self, x):
            if (x < 0).any():
                raise RuntimeError("negative")
            return np.hstack([x * 2, x * 3])

    df = spark.createDataFrame([(1, 1.0), (2, -1.0), (3, None)], "i long, v double").coalesce(1)
    got = {r["i"]: (r["predictions"], r["error"]) for r in scoring.score(df, Double, ["v"]).collect()}
    assert got[1] == ([2.0, 3.0], None) and got[2][1] == "RuntimeError: negative" and "missing" in got[3][1]
    assert scoring.short_term(spark.createDataFrame([([1.0, 2.0, 3.0],)], "predictions array<double>"), hours=2).first()["predictions"] == [1.0, 2.0]


def test_calendar_and_payload(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 2, 28))], "k string, ds date")
    assert [str(r["ds"]) for r in frames.future_calendar(df, "ds", ["k"], 2).collect()] == ["2024-02-29", "2024-03-01"]


def test_scoring_a_stream(spark, tmp_path):
    from tidemark.streaming import features

    class Plus:
        def predict(self, x):
            return x + 1

    spark.createDataFrame([("a", 1.0)], "k string, v double").write.json(str(tmp_path / "in"))
    s = spark.readStream.schema("k string, v double").json(str(tmp_path / "in"))
    q = features.file_sink(scoring.score(s, Plus, ["v"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).first()["predictions"] == [2.0]
