"""A recurrent sequence forecaster, trained over all tasks at once.

The model is one gated recurrent cell in numpy and a linear layer from its last state to all steps of the horizon. Every
evaluation of the loss is one Spark job over stored frames: a task runs forwards and backwards over its rows in batches
and adds up loss and gradient, the sums of tasks are added up in between (``fan_in`` at a time) and the driver gets at
most ``fan_in`` rows of as many numbers as there are weights. The driver takes a quasi-Newton step (L-BFGS) with them,
so few passes are needed and the result does not depend on how rows are dealt, but for rounding.

Inputs and targets are standardised by the training rows' means and deviations, which are part of the model, and its
output is scaled back. A tuned model takes over the weights of a base model, gets scalers of its own rows, reads its
features from the columns that a mapping names, and moves the weights by few passes.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate
from ..operators import windows as W
from ..spec import SeriesSpec


def _shapes(features: int, hidden: int, horizon: int) -> list[tuple[int, ...]]:
    """Gates (update, reset) and candidate from input, state and bias; the layer behind them."""
    return [(features, 3 * hidden), (hidden, 2 * hidden), (hidden, hidden), (3 * hidden,), (hidden, horizon), (horizon,)]


def _parts(theta: np.ndarray, shapes: Sequence[tuple[int, ...]]) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes:
        n = int(np.prod(s))
        out.append(theta[at : at + n].reshape(s))
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(theta: np.ndarray, shapes: Sequence[tuple[int, ...]], x: np.ndarray) -> tuple[np.ndarray, list]:
    """x: rows, steps, features. Predictions, and what the way back needs."""
    wx, wg, wc, b, wo, bo = _parts(theta, shapes)
    h = np.zeros((len(x), wc.shape[0]))
    k, trace = wc.shape[0], []
    for t in range(x.shape[1]):
        a = x[:, t] @ wx + b
        g = _sigmoid(a[:, : 2 * k] + h @ wg)
        z, r = g[:, :k], g[:, k:]
        c = np.tanh(a[:, 2 * k :] + (r * h) @ wc)
        trace.append((h, z, r, c))
        h = z * h + (1 - z) * c
    trace.append(h)
    return h @ wo + bo, trace


def loss_and_gradient(theta: np.ndarray, shapes: Sequence[tuple[int, ...]], x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Half the sum of squared errors over the rows."""
    wx, wg, wc, b, wo, bo = _parts(theta, shapes)
    told, trace = _forward(theta, shapes, x)
    e, k = told - y, wc.shape[0]
    gwx, gwg, gwc, gb = np.zeros_like(wx), np.zeros_like(wg), np.zeros_like(wc), np.zeros_like(b)
    gwo, gbo, dh = trace[-1].T @ e, e.sum(axis=0), e @ wo.T
    for t in range(x.shape[1] - 1, -1, -1):
        h, z, r, c = trace[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        back = dc @ wc.T
        dr = back * h * r * (1 - r)
        da = np.hstack([dz, dr, dc])
        gwx += x[:, t].T @ da
        gb += da.sum(axis=0)
        gwg += h.T @ da[:, : 2 * k]
        gwc += (r * h).T @ dc
        dh = dh * z + back * r + da[:, : 2 * k] @ wg.T
    return 0.5 * float((e * e).sum()), np.concatenate([g.ravel() for g in (gwx, gwg, gwc, gb, gwo, gbo)])


@dataclass(frozen=True)
class Recurrent:
    """features: columns in the order of the input. scalers: mean and deviation of each feature and of ``target``."""

    features: tuple[str, ...]
    target: str
    lookback: int
    horizon: int
    hidden: int = 12
    decay: float = 1e-4
    seed: int = 1
    fan_in: int = 16
    theta: tuple[float, ...] = ()
    scalers: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    losses: tuple[float, ...] = ()

    def shapes(self) -> list[tuple[int, ...]]:
        return _shapes(len(self.features), self.hidden, self.horizon)

    def frame(self, df: DataFrame, spec: SeriesSpec) -> DataFrame:
        """x and y of each sample, in their own units; samples with a null go."""
        t = W.sequences(df, spec, self.features, self.target, self.lookback, self.horizon)
        return t.where(~F.exists(F.flatten("x"), lambda v: v.isNull()) & ~F.exists("y", lambda v: v.isNull()) & (F.size("y") == self.horizon))

    def _scaled(self, batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x = np.array([np.stack(v) for v in batch["x"]], dtype=float).reshape(len(batch), self.lookback, len(self.features))
        mu, sd = (np.array([self.scalers[f][i] for f in self.features]) for i in (0, 1))
        y = np.stack(batch["y"].to_list()).astype(float)
        return (x - mu) / sd, (y - self.scalers[self.target][0]) / self.scalers[self.target][1]

    def _evaluated(self, frame: DataFrame, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss and gradient over all rows of the frame, with the penalty of weights."""
        model, size = self, len(theta)

        def here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            total = np.zeros(size + 2)
            for b in batches:
                if len(b):
                    x, y = model._scaled(b)
                    loss, gradient = loss_and_gradient(theta, model.shapes(), x, y)
                    total += np.r_[gradient, loss, len(b)]
            yield pd.DataFrame({"lot": [TaskContext.get().partitionId() % model.fan_in], "sums": [total]})

        def added(parts: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"sums": [np.sum(np.stack(parts["sums"].to_list()), axis=0)]})

        schema = "sums array<double>"
        rows = frame.select("x", "y").mapInPandas(here, f"lot int, {schema}").groupBy("lot").applyInPandas(added, schema).collect()
        total = np.sum([r["sums"] for r in rows], axis=0) if rows else np.zeros(size + 2)
        n = max(1.0, total[-1])
        return total[-2] / n + 0.5 * self.decay * float(theta @ theta), total[:size] / n + self.decay * theta

    def scaled_by(self, df: DataFrame) -> Recurrent:
        """The same model with scalers of these rows; a constant column has deviation 1."""
        columns = list(dict.fromkeys([*self.features, self.target]))
        return replace(self, scalers=evaluate.scalers(df, columns))

    def fit(self, frame: DataFrame, passes: int = 60, tolerance: float = 1e-4) -> Recurrent:
        """From the weights it has, or small random ones. ``frame`` should be a stored table: each pass reads it. Ends
        early once a step lowers the loss by less than that share."""
        shapes = self.shapes()
        rng = np.random.default_rng(self.seed)
        size = sum(int(np.prod(s)) for s in shapes)
        theta = np.array(self.theta) if self.theta else np.concatenate([(rng.normal(0, 1 / np.sqrt(max(1, s[0])), s) if len(s) == 2 else np.zeros(s)).ravel() for s in shapes])
        if len(theta) != size:
            raise ValueError(f"{len(theta)} weights for {size} places")
        theta, losses = minimised(lambda v: self._evaluated(frame, v), theta, passes, tolerance)
        return replace(self, theta=tuple(theta.tolist()), losses=tuple(losses))

    def tuned(self, df: DataFrame, spec: SeriesSpec, mapping: Mapping[str, str] | None = None, passes: int = 10, rows: DataFrame | None = None) -> Recurrent:
        """A model of a second data set that starts from this one's weights. ``mapping`` names the column of ``df`` for
        each feature and the target. ``rows``: what the scalers are taken from, else df."""
        from ..sources.shared import stored

        names = dict(mapping or {})
        new = replace(self, features=tuple(names.get(f, f) for f in self.features), target=names.get(self.target, self.target))
        new = new.scaled_by(rows if rows is not None else df)
        return new.fit(stored(new.frame(df, spec).select("x", "y")), passes)

    def transform(self, frame: DataFrame) -> DataFrame:
        """``predictions`` beside each sample, in the units of the target."""
        model, theta = self, np.array(self.theta)
        mu, sd = self.scalers[self.target]

        @F.pandas_udf("array<double>")
        def told(x: pd.Series) -> pd.Series:
            batch = pd.DataFrame({"x": x, "y": [np.zeros(model.horizon)] * len(x)})
            out, _ = _forward(theta, model.shapes(), model._scaled(batch)[0])
            return pd.Series(list(out * sd + mu))

        return frame.withColumn("predictions", told("x"))


def minimised(f, theta: np.ndarray, passes: int, tolerance: float, memory: int = 10) -> tuple[np.ndarray, list[float]]:
    """L-BFGS with a backtracking line search; f gives value and gradient and is called at most ``passes`` times."""
    value, gradient = f(theta)
    calls, values = 1, [value]
    steps: list[np.ndarray] = []
    turns: list[np.ndarray] = []
    while calls < passes and np.linalg.norm(gradient) > 1e-9:
        q, alphas = gradient.copy(), []
        for s, y in zip(reversed(steps), reversed(turns), strict=True):
            alphas.append((s @ q) / (y @ s))
            q -= alphas[-1] * y
        q *= (steps[-1] @ turns[-1]) / (turns[-1] @ turns[-1]) if steps else 1 / max(1.0, np.linalg.norm(gradient))
        for s, y, a in zip(steps, turns, reversed(alphas), strict=True):
            q += (a - (y @ q) / (y @ s)) * s
        slope, length = -(gradient @ q), 1.0
        if slope >= 0:
            q, slope, steps, turns = gradient.copy(), -(gradient @ gradient), [], []
        while calls < passes:
            new = theta - length * q
            new_value, new_gradient = f(new)
            calls += 1
            if new_value <= value + 1e-4 * length * slope:
                break
            length *= 0.5
        else:
            break
        s, y = new - theta, new_gradient - gradient
        if s @ y > 1e-12:
            steps, turns = [*steps, s][-memory:], [*turns, y][-memory:]
        done = value - new_value <= tolerance * abs(value)
        theta, value, gradient = new, new_value, new_gradient
        values.append(value)
        if done:
            break
    return theta, values
