"""Second-order boosting with L1 and L2 penalties on leaves.

Features are cut into at most ``bins`` bins by their quantiles once, and the binned rows are written down. A level of a
tree is one Spark job: a task walks its rows through the trees so far, and adds up gradients and curvatures by node,
feature and bin; the histograms of tasks are added up in between, and the driver gets at most ``fan_in`` of them, whose
size depends on nodes, features and bins alone. It chooses the splits, and gives each leaf
``-shrunk(G, l1) / (H + l2)``, where shrunk moves the gradient's sum towards 0 by l1.

Rows flagged as validation take no part in the histograms; their error is added up in the same pass, and boosting stops
once it has not fallen for ``patience`` trees. A null or NaN has a bin of its own, below all others.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored


def shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def leaf(g: np.ndarray, h: np.ndarray, l1: float, l2: float) -> np.ndarray:
    return -shrunk(g, l1) / (h + l2)


def gain(g: np.ndarray, h: np.ndarray, l1: float, l2: float) -> np.ndarray:
    return shrunk(g, l1) ** 2 / (h + l2)


@dataclass
class Tree:
    """Nodes in levels: node i has children 2 i + 1 and 2 i + 2. feature -1 is a leaf; bins up to ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def places(self, binned: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(binned), dtype=np.int64), np.arange(len(binned))
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return at
            i = rows[inner]
            at[i] = 2 * at[i] + 1 + (binned[i, self.feature[at[i]]] > self.cut[at[i]])


@dataclass
class Boosted:
    features: Sequence[str]
    trees: int = 100
    depth: int = 4
    rate: float = 0.1
    l1: float = 0.0
    l2: float = 1.0
    bins: int = 64
    least: float = 1.0
    patience: int = 10
    fan_in: int = 16
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    grown: list[Tree] = field(default_factory=list)
    errors: list[float] = field(default_factory=list)
    gains: np.ndarray | None = None

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape, dtype=np.int16)
        for j, e in enumerate(self.edges):
            known = ~np.isnan(x[:, j])
            out[known, j] = 1 + np.searchsorted(e, x[known, j], "left")
        return out

    def _values(self, binned: np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
        out = np.full(len(binned), self.base)
        for t in trees:
            out += self.rate * t.value[t.places(binned)]
        return out

    def fit(self, df: DataFrame, target: str, validation: str | None = None) -> Boosted:
        """Rows without a target go. ``validation`` names a boolean column."""
        held = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
        rows = df.where(F.col(target).isNotNull()).select(F.array(*[F.col(f).cast("double") for f in self.features]).alias("x"), F.col(target).cast("double").alias("y"), held.alias("held"))
        learn = rows.where("not held")
        shares = [i / self.bins for i in range(1, self.bins)]
        cuts = learn.agg(F.avg("y").alias("mean"), *[F.percentile_approx(F.nanvl(F.col("x")[j], F.lit(None)), shares, 10_000).alias(f"q{j}") for j in range(len(self.features))]).first()
        self.base, self.grown, self.errors, self.gains = cuts["mean"] or 0.0, [], [], np.zeros(len(self.features))
        self.edges = [np.unique(np.array(cuts[f"q{j}"] or [], dtype=float)) for j in range(len(self.features))]
        frame = self._stored(rows)
        best = (np.inf, 0)
        for i in range(self.trees):
            error = self._grow(frame, validation is not None)
            if validation:
                self.errors.append(error)
                best = min(best, (error, i))
                if i - best[1] >= self.patience:
                    break
        if validation:
            self.grown = self.grown[: max(1, best[1])]  # errors[i] is that of i trees
        return self

    def _stored(self, rows: DataFrame) -> DataFrame:
        model = self

        def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    x = np.array([[np.nan if v is None else v for v in r] for r in b["x"]], dtype=float)
                    yield pd.DataFrame({"bins": [r.tobytes() for r in model._binned(x)], "y": b["y"], "held": b["held"]})

        return stored(rows.mapInPandas(binned, "bins binary, y double, held boolean"))

    def _level(self, frame: DataFrame, tree: Tree, nodes: np.ndarray) -> np.ndarray:
        """Of open nodes: gradient and curvature by node, feature and bin; then the squared error and the number of
        validation rows."""
        model, trees, k, size = self, list(self.grown), len(self.features), self.bins + 2
        slots = np.full(len(tree.feature), -1)
        slots[nodes] = np.arange(len(nodes))

        def here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            g, h, tail = np.zeros(len(nodes) * k * size), np.zeros(len(nodes) * k * size), np.zeros(2)
            for b in batches:
                if not len(b):
                    continue
                binned = np.frombuffer(b"".join(b["bins"]), dtype=np.int16).reshape(len(b), k)
                residual, held = model._values(binned, trees) - b["y"].to_numpy(), b["held"].to_numpy(dtype=bool)
                tail += [float((residual[held] ** 2).sum()), held.sum()]
                slot = slots[tree.places(binned)]
                own = (slot >= 0) & ~held
                at = ((slot[own, None] * k + np.arange(k)) * size + binned[own]).ravel()
                g += np.bincount(at, np.repeat(residual[own], k), len(g))
                h += np.bincount(at, minlength=len(h))
            yield pd.DataFrame({"lot": [TaskContext.get().partitionId() % model.fan_in], "sums": [np.r_[g, h, tail]]})

        def added(parts: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"sums": [np.sum(np.stack(parts["sums"].to_list()), axis=0)]})

        got = frame.mapInPandas(here, "lot int, sums array<double>").groupBy("lot").applyInPandas(added, "sums array<double>").collect()
        return np.sum([r["sums"] for r in got], axis=0) if got else np.zeros(2 * len(nodes) * k * size + 2)

    def _grow(self, frame: DataFrame, validate: bool) -> float:
        """One tree more; gives the validation error before it."""
        count, k, size = 2 ** (self.depth + 1) - 1, len(self.features), self.bins + 2
        tree = Tree(np.full(count, -1), np.zeros(count, dtype=np.int64), np.zeros(count))
        nodes, error = np.array([0]), np.inf
        for level in range(self.depth):
            sums = self._level(frame, tree, nodes)
            if level == 0 and validate and sums[-1]:
                error = float(np.sqrt(sums[-2] / sums[-1]))
            g, h = sums[:-2].reshape(2, len(nodes), k, size)
            following = []
            for i, node in enumerate(nodes):
                total_g, total_h = g[i, 0].sum(), h[i, 0].sum()
                tree.value[node] = leaf(total_g, total_h, self.l1, self.l2) if total_h else 0.0
                left_g, left_h = np.cumsum(g[i], axis=1)[:, :-1], np.cumsum(h[i], axis=1)[:, :-1]
                right_g, right_h = total_g - left_g, total_h - left_h
                with np.errstate(invalid="ignore", divide="ignore"):  # sides without rows, which are left out below
                    better = gain(left_g, left_h, self.l1, self.l2) + gain(right_g, right_h, self.l1, self.l2) - gain(total_g, total_h, self.l1, self.l2)
                better[(left_h < self.least) | (right_h < self.least)] = -np.inf
                f, cut = np.unravel_index(np.argmax(better), better.shape)
                if better[f, cut] <= 1e-9:
                    continue
                tree.feature[node], tree.cut[node] = f, cut
                self.gains[f] += better[f, cut]
                for child, cg, ch in ((2 * node + 1, left_g[f, cut], left_h[f, cut]), (2 * node + 2, right_g[f, cut], right_h[f, cut])):
                    tree.value[child] = leaf(cg, ch, self.l1, self.l2)
                    following.append(child)
            nodes = np.array(following)
            if not len(nodes):
                break
        self.grown.append(tree)
        return error

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Every row with its prediction."""
        model = self

        @F.pandas_udf("double")
        def told(*columns: pd.Series) -> pd.Series:
            x = np.stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns], axis=1)
            return pd.Series(model._values(model._binned(x), model.grown))

        return df.withColumn(out, told(*[F.col(f).cast("double") for f in self.features]))

    def importances(self, k: int | None = None) -> list[tuple[str, float]]:
        """(feature, share of the gain), the largest first."""
        total = self.gains.sum() or 1.0
        pairs = sorted(((f, float(g / total)) for f, g in zip(self.features, self.gains, strict=True)), key=lambda x: (-x[1], x[0]))
        return pairs[:k] if k else pairs
