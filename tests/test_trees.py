"""Boosting with penalties: against plain numpy, Spark's own trees, and its formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.forecast import models, trees
from tidemark.operators import evaluate
from tidemark.sources.shared import stored


def made(n=1500, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 2, (n, 3))
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0.5) * 2 + 0.3 * rng.normal(size=n)
    return x, y


@pytest.fixture(scope="module")
def data(spark):
    x, y = made()
    rows = [(*map(float, a), float(b), i % 5 == 3, i % 5 == 4) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return stored(spark.createDataFrame(rows, "a double, b double, c double, y double, check boolean, test boolean").repartition(4))


def rmse(df):
    return evaluate.regression(df, actual="y", predicted="prediction").first()["rmse"]


def test_formulas():
    g = np.array([-5.0, -0.5, 0.0, 3.0])
    assert trees.leaf(g, np.full(4, 4.0), 1.0, 1.0).tolist() == [0.8, 0.0, 0.0, -0.4]
    assert trees.gain(g, np.full(4, 4.0), 1.0, 1.0).tolist() == [16 / 5, 0.0, 0.0, 4 / 5]


@pytest.mark.parametrize("l1,l2", [(0.0, 0.0), (0.0, 50.0), (200.0, 1.0)])
def test_one_split_is_the_best_of_all(data, l1, l2):
    """Depth 1 against every cut of every feature."""
    m = trees.Boosted(["a", "b", "c"], trees=1, depth=1, l1=l1, l2=l2, bins=16).fit(data, "y")
    rows = data.select("a", "b", "c", "y").toPandas()
    r, best = m.base - rows["y"].to_numpy(), (-1.0, None)
    b = m._binned(rows[["a", "b", "c"]].to_numpy())
    for f in range(3):
        for cut in range(17):
            left = b[:, f] <= cut
            if left.any() and not left.all():
                sums = [(r[s].sum(), float(s.sum())) for s in (left, ~left)]
                value = sum(trees.gain(np.array(g), h, l1, l2) for g, h in sums) - trees.gain(np.array(r.sum()), float(len(r)), l1, l2)
                best = max(best, (float(value), (f, cut, [float(trees.leaf(np.array(g), h, l1, l2)) for g, h in sums])))
    f, cut, values = best[1]
    t = m.grown[0]
    assert (t.feature[0], t.cut[0]) == (f, cut) and np.allclose(t.value[1:3], values)


def test_held_out_error_is_at_most_that_of_the_other_trees(data):
    learn = data.where("not test")
    ours = trees.Boosted(["a", "b", "c"], trees=25, depth=3, rate=0.3, l2=1.0, patience=5).fit(learn, "y", "check")
    theirs = models.boosted(["a", "b", "c"], "y", validation="check", trees=25, depth=3, rate=0.3).fit(learn)
    test = data.where("test")
    assert rmse(ours.transform(test)) <= 1.02 * rmse(models.predictions(theirs, test, ["a", "b", "c"]))
    assert rmse(ours.transform(test)) < 0.5
    names = [f for f, _ in ours.importances()]
    assert names[-1] == "c" and abs(sum(v for _, v in ours.importances()) - 1) < 1e-9 and len(ours.importances(2)) == 2


def test_it_stops_once_the_error_no_longer_falls(spark):
    rng = np.random.default_rng(2)
    rows = [(float(v), float(w), i % 2 == 0) for i, (v, w) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "x double, y double, check boolean")
    m = trees.Boosted(["x"], trees=30, depth=3, rate=0.5, patience=2).fit(df, "y", "check")
    assert len(m.errors) < 30 and len(m.grown) <= int(np.argmin(m.errors)) + 1


def test_nulls_ties_and_nothing(spark):
    df = spark.createDataFrame([(None, 10.0, 1), (float("nan"), 10.0, 1), (1.0, 0.0, 1), (1.0, 2.0, 1), (5.0, None, 1)] * 5, "x double, y double, k int")
    m = trees.Boosted(["x", "k"], trees=30, depth=2, rate=0.5, l2=0.0).fit(df, "y")
    got = {(r["x"] if r["x"] == r["x"] else None): round(r["prediction"], 2) for r in m.transform(df).collect()}
    assert got == {None: 10.0, 1.0: 1.0, 5.0: 1.0}
    none = trees.Boosted(["x"], trees=2, depth=2).fit(df.limit(0), "y")
    assert none.transform(df).select("prediction").distinct().collect()[0][0] == 0.0
    flat = trees.Boosted(["k"], trees=2, depth=2).fit(df, "y").transform(df.where(F.col("y").isNotNull()))
    assert abs(flat.first()["prediction"] - 5.5) < 1e-9
