"""Isolation forest: planted outliers, a forest of its own rows alone, odd values."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import isolation


def table(spark, n=3000, planted=12):
    """Three metrics of which two go together; planted rows have usual values that don't go together, or far ones."""
    rng = np.random.default_rng(1)
    a = rng.normal(0, 1, n)
    x = np.stack([a, a + rng.normal(0, 0.1, n), rng.gamma(2, 1, n)], axis=1)
    x[:planted] = np.stack([rng.uniform(5, 6, planted), -rng.uniform(5, 6, planted), rng.uniform(15, 20, planted)], axis=1)
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double").repartition(5)


def test_planted_outliers_come_first(spark):
    top = isolation.scores(table(spark), "id", ["a", "b", "c"]).orderBy(F.desc("isolation")).limit(12).collect()
    assert {r["id"] for r in top} == set(range(12)) and top[-1]["isolation"] > 0.65


def test_scores_follow_the_rows_alone(spark):
    df = table(spark, 800)
    one = {r["id"]: r["isolation"] for r in isolation.scores(df.coalesce(1), "id", ["a", "b"], 20, 64).collect()}
    two = {r["id"]: r["isolation"] for r in isolation.scores(df.repartition(9), "id", ["a", "b"], 20, 64).collect()}
    assert one == two and 0.3 < np.mean(list(one.values())) < 0.6


def test_trees_are_bounded_and_walk_as_they_grew(spark):
    rows = isolation.forest(table(spark), "id", ["a", "b", "c"], 10, 64).collect()
    assert len(rows) == 10 and max(len(r["feature"]) for r in rows) <= 4 * 64
    x = np.random.default_rng(2).normal(size=(40, 3))
    feature, cut, left, depth = isolation.grow(x, np.random.default_rng(3))
    counts = np.zeros(len(feature))
    for v in x:
        at = 0
        while feature[at] >= 0:
            at = left[at] + (v[feature[at]] >= cut[at])
        counts[at] += 1
    assert counts.sum() == 40 and all((f < 0) or c == 0 for f, c in zip(feature, counts, strict=True))
    assert isolation.average_path(np.array([1, 2, 3])).round(6).tolist() == [0.0, 1.0, 1.207392]


def test_odd_values(spark):
    odd = spark.createDataFrame([(1, None), (2, float("nan")), (3, float("inf")), (None, 1.0), (4, 1.0), (4, 1.0)], "id long, a double")
    got = [(r["id"], r["isolation"]) for r in isolation.scores(odd, "id", ["a"], 5, 8).collect()]
    assert [s for i, s in got if i in (1, 2, 3)] == [None] * 3 and len({s for i, s in got if i in (4, None)}) == 1
    assert isolation.scores(odd.limit(0), "id", ["a"], 5, 8).count() == 0
    none = isolation.scores(odd.where("id < 4"), "id", ["a"], 5, 8).collect()
    assert all(r["isolation"] is None for r in none)
