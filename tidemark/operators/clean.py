"""Cleaning and projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import SeriesSpec
from .ranges import known_values
from .ranks import percentiles

#: The constants that stand for missing readings.
DEFAULTS = {"temperature": 0.0, "humidity": 0.0, "wind_speed": 0.0, "wind_direction": 0.0, "precipitation": 0.0, "pressure": 1013.25}
#: The same under the names of raw observations, for frames that have not been renamed.
RAW_DEFAULTS = {"precipitation_last_hour": DEFAULTS["precipitation"], "sea_level_pressure": DEFAULTS["pressure"]}


def fill_constants(df: DataFrame, defaults: Mapping[str, float] | None = None, mode: str = "constant", absent: str = "raise") -> DataFrame:
    """``mode="skip"`` leaves nulls, so that means ignore them. Without ``defaults`` every reading that is there has its
    own, under its raw name or ours; of given ones, each must name a column unless ``absent="ignore"``."""
    if mode not in ("constant", "skip"):
        raise ValueError(f"mode is constant or skip, not {mode}")
    if absent not in ("raise", "ignore"):
        raise ValueError(f"absent is raise or ignore, not {absent}")
    unknown = sorted(set(defaults or ()) - set(df.columns))
    if unknown and absent == "raise":
        raise ValueError(f"no columns for the defaults of {unknown}")
    present = {c: v for c, v in (DEFAULTS | RAW_DEFAULTS if defaults is None else defaults).items() if c in df.columns}
    return df.fillna(present) if mode == "constant" and present else df


def drop_null(df: DataFrame, critical: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(critical))


def medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """One row, or one for each key with any value. Exact ones come from counts by value in ranges, so no task holds all
    values of a key; the approximate form needs one pass and keeps a bounded sketch."""
    if approximate:
        return df.groupBy(*by).agg(*[F.percentile_approx(c, F.lit(0.5), F.lit(10_000)).alias(f"median_{c}") for c in columns])
    long = percentiles(df, columns, [0.5], by)
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("column") == c, F.col("p0"))).alias(f"median_{c}") for c in columns])


def median_impute(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Nulls become the median of all rows or of the key's."""
    m = medians(df, columns, by, approximate)
    joined = df.join(m, list(by), "left") if by else df.crossJoin(F.broadcast(m))  # without keys m is one row
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"median_{c}")) for c in columns}).select(*df.columns)


def midpoint(value: Column, low: Column, high: Column) -> Column:
    return F.coalesce(value, (low + high) / 2)


def forward_backward_fill(df: DataFrame, spec: SeriesSpec, columns: Sequence[str], backward: bool = True) -> DataFrame:
    """Last known value, then, unless ``backward`` is off, the next one. Filling backward reads the future."""
    return known_values(df, Window.partitionBy(*spec.keys), spec.order(), columns, backward)


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column, from one pass: rows, non_null, null_fraction, least, most."""
    one = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)], *[F.min(F.col(c).cast("double")).alias(f"lo_{i}") for i, c in enumerate(columns)], *[F.max(F.col(c).cast("double")).alias(f"hi_{i}") for i, c in enumerate(columns)])
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{i}").alias("non_null"), F.col(f"lo_{i}").alias("least"), F.col(f"hi_{i}").alias("most")) for i, c in enumerate(columns)])
    return one.select("rows", F.inline(each)).withColumn("null_fraction", F.try_divide(F.col("rows") - F.col("non_null"), F.col("rows")))


def drop_sparse(df: DataFrame, most_missing: float = 0.5) -> DataFrame:
    """Without the columns of which at least that share is null; one pass decides for all columns."""
    share = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if share[c] is None or share[c] < most_missing])


def wanted(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Keeps the columns of ``names`` that exist, under their new names."""
    return df.select(*[F.col(a).alias(b) for a, b in names.items() if a in df.columns])


def first_present(df: DataFrame, candidates: Sequence[str], default: float) -> Column:
    """The first candidate that exists and is not null, else the default."""
    return F.coalesce(*[F.col(c) for c in candidates if c in df.columns], F.lit(default))


def adapt_features(df: DataFrame, features: Sequence[str], defaults: Mapping[str, float], carried: Sequence[str] = ()) -> DataFrame:
    """Window statistics under the names that models expect: feat, feat_mean or feat_avg, else a default."""
    made = [first_present(df, [f, f"{f}_mean", f"{f}_avg"], defaults.get(f, 0.0)).alias(f) for f in features]
    extra = [F.col(f"{f}_{s}") for f in features for s in ("std", "min", "max") if f"{f}_{s}" in df.columns]
    return df.select(*carried, *made, *extra)


def map_feature_set(have: Sequence[str], want: Sequence[str], fallback: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """wanted -> existing name, by name first and then by the list of stand-ins; raises if one has none."""
    out = {}
    for w in want:
        found = next((c for c in [w, *fallback.get(w, ())] if c in have), None)
        if found is None:
            raise ValueError(f"no column for feature {w}")
        out[w] = found
    return out
