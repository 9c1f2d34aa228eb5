"""Isolation forest: rows that few random cuts part from the others.

Each tree is grown in a task of its own on a bounded sample (``sample`` rows, chosen by a hash of the row's id, so that
the forest depends on the rows alone). Trees are flat arrays of numbers, ``trees`` times at most 2 * ``sample`` of them,
whatever the table's size; they are what is sent to all tasks, which walk all rows of a batch down a tree at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "tree int, feature array<int>, cut array<double>, left array<int>, depth array<double>"


def average_path(n: np.ndarray) -> np.ndarray:
    """Expected depth of an unsuccessful search among n rows: what a leaf of n rows stands for."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    many = n > 2
    out[many] = 2 * (np.log(n[many] - 1) + np.euler_gamma) - 2 * (n[many] - 1) / n[many]
    return out


def grow(x: np.ndarray, rng: np.random.Generator) -> tuple[list[int], list[float], list[int], list[float]]:
    """feature (-1 for a leaf), cut, left child (the right one follows it), depth of a leaf with its remainder."""
    most = int(np.ceil(np.log2(max(2, len(x)))))
    feature, cut, left, depth = [-1], [0.0], [0], [0.0]
    open_nodes = [(0, np.arange(len(x)), 0)]
    while open_nodes:
        node, rows, d = open_nodes.pop()
        own = x[rows]
        low, high = (own.min(axis=0), own.max(axis=0)) if len(rows) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        some = np.flatnonzero(high > low)
        if d >= most or not len(some):
            depth[node] = d + float(average_path(np.array([len(rows)]))[0])
            continue
        f = int(rng.choice(some))
        at = float(rng.uniform(low[f], high[f]))
        feature[node], cut[node], left[node] = f, at, len(feature)
        goes = own[:, f] < at
        for part in (rows[goes], rows[~goes]):
            open_nodes.append((len(feature), part, d + 1))
            feature, cut, left, depth = [*feature, -1], [*cut, 0.0], [*left, 0], [*depth, 0.0]
    return feature, cut, left, depth


def forest(df: DataFrame, key: str, columns: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 1) -> DataFrame:
    """One row a tree. Rows with a null or a number that is not finite in one of the columns are not learned from."""
    whole = df.select(F.xxhash64(key, *columns, F.lit(seed)).alias("_h"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    whole = whole.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    chosen = whole.orderBy("_h").limit(trees * sample).withColumn("tree", F.pmod(F.xxhash64("_h"), F.lit(trees)).cast("int"))

    def grown(tree: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(tree[0])])
        feature, cut, left, depth = grow(np.stack(rows.sort_values("_h")["x"].to_list()), rng)
        return pd.DataFrame({"tree": [tree[0]], "feature": [feature], "cut": [cut], "left": [left], "depth": [depth]})

    return chosen.groupBy("tree").applyInPandas(grown, NODES)


def scores(df: DataFrame, key: str, columns: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 1) -> DataFrame:
    """The rows with ``isolation``, from 0 to 1: about 0.5 for rows among many, towards 1 for rows that stand alone.

    Null for rows that lack one of the numbers, and where there is no tree. Equal rows score the same.
    """
    made = forest(df, key, columns, trees, sample, seed).orderBy("tree").collect()  # bounded by trees and sample
    flat = [tuple(np.array(r[c]) for c in ("feature", "cut", "left", "depth")) for r in made]
    n = df.select(*columns).dropna().limit(trees * sample).count() / max(1, trees)
    usual = float(average_path(np.array([max(2.0, n)]))[0])
    shared = df.sparkSession.sparkContext.broadcast(flat)

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        x = np.stack([v.to_numpy(dtype=float, na_value=np.nan) for v in values], axis=1)
        known = np.isfinite(x).all(axis=1)
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for feature, cut, left, depth in shared.value:
            at = np.zeros(len(x), dtype=np.int64)
            inner = known.copy()
            while True:
                inner &= feature[at] >= 0
                if not inner.any():
                    break
                i = rows[inner]
                at[i] = left[at[i]] + (x[i, feature[at[i]]] >= cut[at[i]])
            total += depth[at]
        out = pd.Series(2.0 ** (-total / (max(1, len(shared.value)) * usual)))
        return out.where(known & (len(shared.value) > 0))

    return df.withColumn("isolation", score(*[F.col(c).cast("double") for c in columns]))
