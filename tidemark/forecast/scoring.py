"""Batch and streaming scoring in tasks, with errors kept beside the rows they belong to."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cap_horizon


class Scorer(Protocol):
    """Loaded once in each worker; scores a matrix of rows by features into one row of steps each."""

    def predict(self, x: np.ndarray) -> np.ndarray: ...


def score(df: DataFrame, load: Callable[[], Scorer], features: list[str]) -> DataFrame:
    """Adds predictions and error. A batch that fails is scored row by row, so that only bad rows carry an error."""
    names = sorted(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            x = b[names].to_numpy(dtype=float)
            try:
                if not np.isfinite(x).all():
                    raise ValueError("a feature is missing")
                out, errors = [list(map(float, p)) for p in np.atleast_2d(model.predict(x))], [None] * len(b)
            except Exception:  # whatever the model raises belongs to some row
                out, errors = [], []
                for i in range(len(x)):
                    try:
                        if not np.isfinite(x[i]).all():
                            raise ValueError("a feature is missing")
                        out.append(list(map(float, np.ravel(model.predict(x[i : i + 1])))))
                        errors.append(None)
                    except Exception as e:
                        out.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
            yield b.assign(predictions=out, error=errors)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], "predictions array<double>, error string"])
    return df.mapInPandas(run, schema)


def short_term(df: DataFrame, predictions: str = "predictions", hours: int = 6, most: int = 24) -> DataFrame:
    return cap_horizon(df.withColumn("_h", F.lit(hours)), predictions, "_h", most).drop("_h")


def long_term(df: DataFrame, predictions: str = "predictions", hours: int = 168, most: int = 168) -> DataFrame:
    return short_term(df, predictions, hours, most)
