"""The recurrent forecaster: its gradient, its independence of tasks, and what it learns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.forecast import models, recurrent
from tidemark.forecast.recurrent import Recurrent
from tidemark.operators import evaluate
from tidemark.operators import windows as W
from tidemark.sources.shared import stored
from tidemark.spec import SeriesSpec

SPEC = SeriesSpec(("k",), "t")


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(1)
    shapes = recurrent._shapes(2, 3, 2)
    theta = rng.normal(0, 0.5, sum(int(np.prod(s)) for s in shapes))
    x, y = rng.normal(size=(5, 4, 2)), rng.normal(size=(5, 2))
    _, g = recurrent.loss_and_gradient(theta, shapes, x, y)
    for i in range(len(theta)):
        d = np.zeros_like(theta)
        d[i] = 1e-6
        slope = (recurrent.loss_and_gradient(theta + d, shapes, x, y)[0] - recurrent.loss_and_gradient(theta - d, shapes, x, y)[0]) / 2e-6
        assert abs(slope - g[i]) < 1e-5 * max(1, abs(g[i]))


def test_minimiser_finds_the_valley():
    def rosenbrock(v):
        a, b = v
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    theta, values = recurrent.minimised(rosenbrock, np.array([-1.2, 1.0]), 200, 1e-12)
    assert np.allclose(theta, 1, atol=1e-3) and values == sorted(values, reverse=True)


def curved(n, k, scale=1.0, shift=0.0, twist=2.0, seed=1):
    """A series whose next value is no linear function of the last ones."""
    rng, v, out = np.random.default_rng(seed), 0.3, []
    for t in range(n):
        v = 1.5 * math.sin(twist * v) * (-1 if v > 0 else 1) + 0.1 * float(rng.normal())
        out.append((k, t, scale * v + shift))
    return out


def rmse(out):
    z = out.select(F.posexplode(F.arrays_zip("y", "predictions")).alias("s", "z")).where("s = 0").select(F.col("z.y").alias("a"), F.col("z.predictions").alias("p"))
    return evaluate.regression(z, actual="a", predicted="p").first()["rmse"]


@pytest.fixture(scope="module")
def split(spark):
    df = spark.createDataFrame(curved(1500, "base"), "k string, t int, y double")
    return stored(W.chronological_split(df, SPEC))


@pytest.fixture(scope="module")
def base(split):
    m = Recurrent(("y",), "y", 3, 1, hidden=8).scaled_by(split.where("split = 'train'"))
    return m.fit(stored(m.frame(split.where("split = 'train'"), SPEC).select("x", "y")), 60)


def test_it_beats_linear_steps_held_out(split, base):
    linear = models.StepRegression(3, 1)
    linear.fit(linear.frame(split.where("split = 'train'"), SPEC, ["y"], "y"))
    test = split.where("split = 'test'")
    ours, theirs = rmse(base.transform(base.frame(test, SPEC))), rmse(linear.transform(linear.frame(test, SPEC, ["y"], "y")))
    assert ours < 0.6 * theirs and list(base.losses) == sorted(base.losses, reverse=True)


def test_weights_do_not_depend_on_how_rows_are_dealt(split):
    m = Recurrent(("y",), "y", 3, 1, hidden=4, fan_in=2).scaled_by(split)
    frame = stored(m.frame(split, SPEC).select("x", "y"))
    one, many = m.fit(frame.coalesce(1), 6), m.fit(frame.repartition(7), 6)
    assert np.allclose(one.theta, many.theta, atol=1e-6)


def test_tuned_beats_the_base_and_training_from_zero(spark, base):
    """Few rows of the same kind of series in other units, under other names."""
    rows = spark.createDataFrame(curved(700, "new", 40.0, 1000.0, 2.2, 5), "k string, t int, reading double")
    few, test = stored(rows.where("t < 60")), stored(rows.where("t >= 300"))
    tuned = base.tuned(few, SPEC, {"y": "reading"}, 12)
    assert tuned.features == ("reading",) and tuned.scalers["reading"] != base.scalers["y"]
    fresh = Recurrent(("reading",), "reading", 3, 1, hidden=8).scaled_by(few)
    fresh = fresh.fit(stored(fresh.frame(few, SPEC).select("x", "y")), 12)
    named = test.withColumnRenamed("reading", "y")
    of_base = rmse(base.transform(base.frame(named, SPEC)))
    of_tuned, of_fresh = rmse(tuned.transform(tuned.frame(test, SPEC))), rmse(fresh.transform(fresh.frame(test, SPEC)))
    assert of_tuned < of_base and of_tuned < of_fresh


def test_samples_with_nulls_go_and_nothing_gives_nothing(spark, base):
    df = spark.createDataFrame([("a", i, None if i == 5 else float(i)) for i in range(12)], "k string, t int, y double")
    assert base.frame(df, SPEC).count() == 5
    assert base.transform(base.frame(df.limit(0), SPEC)).count() == 0
    with pytest.raises(ValueError):
        Recurrent(("y", "t"), "y", 3, 1, theta=(0.0,), scalers={"y": (0, 1), "t": (0, 1)}).fit(df)


def test_scalers_go_there_and_back(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, None)], "a double, b double, c double").withColumn("d", F.array("a", "a"))
    by = evaluate.scalers(df, ["a", "b", "c"])
    assert by == {"a": (2.0, 1.0), "b": (5.0, 1.0), "c": (0.0, 1.0)}
    z = evaluate.scaled(df, by)
    assert [r["a"] for r in z.collect()] == [-1.0, 1.0]
    back = evaluate.unscaled(z.withColumn("d", F.array("a", "a")), by, {"a": "a", "b": "b", "c": "c", "d": "a"})
    assert back.collect() == df.collect()
