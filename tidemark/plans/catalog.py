"""The registered queries of the time-series engine and their SQL."""

from __future__ import annotations

from . import aggregates, cleaning, files, forecasts, joins, models, rows, streams  # noqa: F401  each registers its queries
from .base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
