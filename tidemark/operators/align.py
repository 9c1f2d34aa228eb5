"""Set operations and joins between series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranges

#: A side up to this many rows may be broadcast; above it Spark shuffles both sides.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint, but only after a count that stops at ``most`` has shown the side to be small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def union_history(parts: Sequence[DataFrame], order: Sequence[str] = ()) -> DataFrame:
    """All parts on top of each other by column name, missing columns null, sorted if asked."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy(*order) if order else out


def union_distinct(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """The keys of all parts, each once; every part is made distinct before the shuffle by the partial aggregate."""
    return union_history([p.select(key) for p in parts]).distinct()


def semi_align(actual: DataFrame, predicted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Actual rows that have a prediction, each beside it."""
    return actual.join(predicted, list(keys), "inner")


def lookup(df: DataFrame, dim: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Attributes of a dimension, or defaults for keys it lacks."""
    names = list(defaults)
    joined = df.join(small(dim.select(key, *names)), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def asof_latest(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], ties: str | None = None, right_ties: Sequence[str] = (), tolerance: str | float | None = None, parts: int | None = None) -> DataFrame:
    """Each left row with the values of the last right row at or before its time.

    Both sides are put into one series, right before left at equal times, and the last known value is carried on: no
    range join. Of right rows at one time, the last by ``right_ties`` counts (nulls come first), and of rows that are
    equal in these too, one by their values alone, so that the order of rows never matters. ``tolerance``, an interval
    or a number, leaves out right rows that are older than that. A null time or key matches nothing. Left columns keep
    their names, and no value may have one of them.

    ``ties``, a column that tells left rows of one time apart, is what such rows are dealt by; without it all their plain
    columns are. It changes no result. Without ``parts``, rows are shuffled once, by key, and a key is one task. With it, both sides are dealt into that
    many ranges of key and time, and one row a range carries the last right row over the border: for few or hot keys.
    """
    if clash := set(left.columns) & set(values):
        raise ValueError(f"both sides have {sorted(clash)}")
    k = [f"_k{i}" for i in range(len(keys))]
    place = [f"_r{i}" for i in range(len(right_ties))]
    of = [F.col(c).alias(a) for c, a in zip(keys, k, strict=True)]
    known = right.dropna(subset=[time, *keys])
    value = F.struct(F.col(time).alias("_time"), *values)
    r = known.select(*of, F.col(time).alias("_t"), F.lit(0).alias("_side"), *[F.col(c).alias(a) for c, a in zip(right_ties, place, strict=True)], F.xxhash64(*values).alias("_salt"), value.alias("_v"))
    plain = [ties] if ties else [c for c, kind in left.dtypes if not kind.startswith(("map", "struct", "array", "variant"))]
    rows = left.select(*of, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.xxhash64(*plain).alias("_salt"), F.struct(*left.columns).alias("_row"))
    both = rows.unionByName(r, allowMissingColumns=True)
    order = ["_t", "_side", *place, "_salt"]
    if parts is None:
        w = Window.partitionBy(*k).orderBy(*order, "_v").rowsBetween(Window.unboundedPreceding, 0)
        carried = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    else:
        carried = ranges.carry_last(both, k, order, "_v", parts)
    near = F.lit(True)
    if tolerance is not None:
        near = F.col("_v._time") >= F.col("_t") - (F.expr(f"interval {tolerance}") if isinstance(tolerance, str) else F.lit(tolerance))
    return carried.where("_side = 1").select("_row.*", *[F.when(near, F.col(f"_v.{v}")).alias(v) for v in values])


def forecast_vs_actual(forecasts: DataFrame, actuals: DataFrame, key: str) -> DataFrame:
    """forecasts: key, target_ts, predicted. actuals: key, ts, actual. One row for each forecast that came due."""
    return forecasts.join(actuals, (forecasts[key] == actuals[key]) & (F.col("target_ts") == F.col("ts"))).select(forecasts[key], "target_ts", "predicted", "actual", (F.col("predicted") - F.col("actual")).alias("error"))
