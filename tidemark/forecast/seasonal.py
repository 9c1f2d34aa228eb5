"""Seasonal forecasts of series of any length, from sums.

A trend with hinges and Fourier terms is fitted by ridge regression. Rows are dealt by range of key and day; a task adds
up X'X and X'y of the pieces of series that it holds, which is one row of about a thousand numbers for each piece, and
only the small system of a series is solved in one place. Hinges are shrunk by a penalty of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.align import small


@dataclass(frozen=True)
class Seasonality:
    """yearly, weekly: Fourier orders. changepoints: hinges in the first four fifths of the series. ridge, hinge_ridge:
    penalties of Fourier terms and of hinges; level and slope are free. level: share that the intervals should cover."""

    yearly: int = 6
    weekly: int = 3
    changepoints: int = 10
    ridge: float = 1.0
    hinge_ridge: float = 1.0
    multiplicative: bool = False
    level: float = 0.8

    def hinges(self) -> list[float]:
        return np.linspace(0, 0.8, self.changepoints + 1)[1:].tolist()

    def waves(self) -> list[tuple[int, float]]:
        return [(k, 365.25) for k in range(1, self.yearly + 1)] + [(k, 7.0) for k in range(1, self.weekly + 1)]

    def penalty(self) -> np.ndarray:
        return np.diag([0.0, 0.0, *[self.hinge_ridge] * self.changepoints, *[self.ridge] * 2 * len(self.waves())])

    def design(self, days: np.ndarray, start: np.ndarray, span: np.ndarray) -> np.ndarray:
        t = (days - start) / np.maximum(1, span)
        cols = [np.ones_like(t), t, *[np.maximum(0, t - c) for c in self.hinges()]]
        cols += [f(2 * np.pi * k * days / p) for k, p in self.waves() for f in (np.sin, np.cos)]
        return np.stack(cols, axis=1)

    def value(self, days: Column, start: Column, span: Column, beta: Column) -> Column:
        """The same design times ``beta``, as an expression."""
        t = (days - start) / F.greatest(F.lit(1.0), span)
        terms = [F.lit(1.0), t, *[F.greatest(F.lit(0.0), t - c) for c in self.hinges()]]
        terms += [f(F.lit(2 * np.pi * k) * days / p) for k, p in self.waves() for f in (F.sin, F.cos)]
        out = F.lit(0.0)
        for i, x in enumerate(terms):
            out = out + beta[i] * x
        return out


def _days(column: str) -> Column:
    return F.unix_date(column).cast("double")


def _named(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def _series(df: DataFrame, keys: Sequence[str], s: Seasonality) -> DataFrame:
    """keys, ds, y, z (what is fitted), start, span; rows without a day or a value go."""
    t = df.select(*keys, "ds", F.col("y").cast("double").alias("y")).dropna(subset=["ds", "y"])
    z = F.log(F.greatest(F.col("y"), F.lit(1e-9))) if s.multiplicative else F.col("y")
    bounds = t.groupBy(F.struct(*keys).alias("_key")).agg(F.min(_days("ds")).alias("start"), (F.max(_days("ds")) - F.min(_days("ds"))).alias("span"))
    placed = t.withColumn("_key", F.struct(*keys)).join(small(bounds), "_key").drop("_key")
    return placed.withColumn("z", z)


def fitted(series: DataFrame, keys: Sequence[str], s: Seasonality, horizon: int = 0) -> DataFrame:
    """keys, start, span, n, sigma, beta, ahead: one row a series. ``series`` as from ``_series``; ``ahead`` holds day,
    value and half the interval's width for ``horizon`` days, with what the coefficients leave open."""
    keys, size = list(keys), len(s.penalty())

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = total = None
        for b in batches:
            own = pd.MultiIndex.from_frame(b[keys]).factorize()[0] if keys else np.zeros(len(b), dtype=int)
            starts = np.r_[0, np.flatnonzero(np.diff(own)) + 1, len(b)]
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                if i == j:
                    continue
                part = b.iloc[i:j]
                here = tuple(None if pd.isna(v) else v for v in part[keys].iloc[0])
                x, z = s.design(part["days"].to_numpy(), part["start"].to_numpy(), part["span"].to_numpy()), part["z"].to_numpy()
                new = np.r_[(x.T @ x).ravel(), x.T @ z, z @ z, len(z), part["start"].iloc[0], part["span"].iloc[0]]
                if key is not None and here == key:
                    total[:-2] += new[:-2]
                    continue
                if key is not None:
                    yield row(key, total)
                key, total = here, new
        if key is not None:
            yield row(key, total)

    def row(key: tuple, total: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] for k, v in zip(keys, key, strict=True)}, "sums": [total]})

    def solve(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.stack(parts["sums"].to_list())
        start, span = total[0, -2:]
        total = total[:, :-2].sum(axis=0)
        a, b, zz, n = total[: size * size].reshape(size, size), total[size * size : -2], total[-2], total[-1]
        whole = a + s.penalty()
        beta = np.linalg.lstsq(whole, b, rcond=None)[0]
        inverse = np.linalg.pinv(whole)
        free = max(1.0, n - np.trace(inverse @ a))
        sigma = float(np.sqrt(max(0.0, zz - 2 * beta @ b + beta @ a @ beta) / free))
        days = start + span + np.arange(1, horizon + 1)
        x = s.design(days, np.full(horizon, start), np.full(horizon, span))
        width = NormalDist().inv_cdf(0.5 + s.level / 2) * sigma * np.sqrt(1 + np.einsum("ij,jk,ik->i", x, inverse, x))
        ahead = [{"day": int(d), "z": float(v), "w": float(w)} for d, v, w in zip(days, x @ beta, width, strict=True)]
        return pd.DataFrame({**{k: parts[k].iloc[:1] for k in keys}, "start": [start], "span": [span], "n": [int(n)], "sigma": [sigma], "beta": [beta], "ahead": [ahead]}, index=parts.index[:1])

    types = _named(series, keys)
    comma = f"{types}, " if types else ""
    rows = series.select(*keys, _days("ds").alias("days"), "z", "start", "span").repartitionByRange(*keys, "days").sortWithinPartitions(*keys, "days")
    made = rows.mapInPandas(sums, f"{comma}sums array<double>")
    return made.groupBy(*keys).applyInPandas(solve, f"{comma}start double, span double, n long, sigma double, beta array<double>, ahead array<struct<day: int, z: double, w: double>>")


def _told(z: Column, w: Column, s: Seasonality) -> list[Column]:
    out = {"yhat": z, "yhat_lower": z - w, "yhat_upper": z + w}
    return [(F.exp(v) if s.multiplicative else v).alias(c) for c, v in out.items()]


def predicted(series: DataFrame, models: DataFrame, keys: Sequence[str], s: Seasonality) -> DataFrame:
    """keys, ds, y, yhat, yhat_lower, yhat_upper for the rows of a series."""
    m = models.select(F.struct(*keys).alias("_key"), F.col("start").alias("_start"), F.col("span").alias("_span"), "sigma", "beta")
    t = series.withColumn("_key", F.struct(*keys)).join(small(m), "_key")
    z = s.value(_days("ds"), F.col("_start"), F.col("_span"), F.col("beta"))
    t = t.withColumns({"_z": z, "_w": F.lit(NormalDist().inv_cdf(0.5 + s.level / 2)) * F.col("sigma")})
    return t.select(*series.columns, *_told(F.col("_z"), F.col("_w"), s))


def forecast(df: DataFrame, keys: Sequence[str], horizon: int, s: Seasonality | None = None) -> DataFrame:
    """df: keys, ds date, y. keys, ds, y (null ahead of the data), yhat, yhat_lower, yhat_upper for history and horizon.
    Several rows of one day count as they are; null keys are keys like any others; an empty table gives no rows."""
    from ..sources.shared import stored

    s = s or Seasonality()
    series = _series(df, keys, s)
    models = stored(fitted(series, keys, s, horizon))
    past = predicted(series, models, keys, s).select(*keys, "ds", "y", "yhat", "yhat_lower", "yhat_upper")
    return past.unionByName(_ahead(models, keys, s).withColumn("y", F.lit(None).cast("double")))


def _ahead(models: DataFrame, keys: Sequence[str], s: Seasonality) -> DataFrame:
    """keys, ds, yhat, yhat_lower, yhat_upper of the days behind each series."""
    a = models.select(*keys, F.explode("ahead").alias("a"))
    return a.select(*keys, F.date_from_unix_date("a.day").alias("ds"), *_told(F.col("a.z"), F.col("a.w"), s))


def held_out_errors(df: DataFrame, keys: Sequence[str], s: Seasonality | None = None, ridges: Sequence[float] = (0.1, 1.0, 10.0)) -> DataFrame:
    """keys, hinge_ridge, validation_rmse, mae, rmse, mape, coverage, n: fitted on the first 80 % of each series' time, the
    penalty of hinges chosen by the next 10 %, and errors of the last 10 % with the share that the intervals cover."""
    from ..sources.shared import stored

    s = s or Seasonality()
    share = (_days("ds") - F.col("start")) / F.greatest(F.lit(1.0), F.col("span"))
    split = stored(_series(df, keys, s).withColumn("split", F.when(share < 0.8, "train").when(share < 0.9, "val").otherwise("test")).drop("start", "span"))
    unseen = split.where("split <> 'train'").withColumn("_at", F.struct(*keys, "ds"))
    longest = split.groupBy(*keys).agg(F.date_diff(F.max("ds"), F.max(F.when(F.col("split") == "train", F.col("ds")))).alias("d")).agg(F.max("d")).first()[0] or 0
    out = None
    for ridge in ridges:
        own = replace(s, hinge_ridge=ridge)
        train = _series(split.where("split = 'train'").select(*keys, "ds", "y"), keys, own)
        ahead = _ahead(fitted(train, keys, own, longest), keys, own).withColumn("_at", F.struct(*keys, "ds")).drop(*keys, "ds")
        told = unseen.join(ahead, "_at").drop("_at")
        e = F.col("yhat") - F.col("y")
        test, val = F.col("split") == "test", F.col("split") == "val"
        errors = told.groupBy(*keys).agg(
            F.sqrt(F.avg(F.when(val, e * e))).alias("validation_rmse"),
            F.avg(F.when(test, F.abs(e))).alias("mae"),
            F.sqrt(F.avg(F.when(test, e * e))).alias("rmse"),
            (F.avg(F.when(test & (F.abs("y") > 1e-6), F.abs(e / F.col("y")))) * 100).alias("mape"),
            F.avg(F.when(test, F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper")).cast("double"))).alias("coverage"),
            F.count_if(test).alias("n"),
        ).withColumn("hinge_ridge", F.lit(float(ridge)))
        out = errors if out is None else out.unionByName(errors)
    rest = F.struct(*[F.col(c) for c in ("hinge_ridge", "validation_rmse", "mae", "rmse", "mape", "coverage", "n")])
    best = out.groupBy(*keys).agg(F.min_by(rest, F.struct(F.coalesce("validation_rmse", F.lit(float("inf"))), "hinge_ridge")).alias("_b"))
    return best.select(*keys, "_b.*")
