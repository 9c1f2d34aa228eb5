"""Order statistics of any size: a range partitioning, totals of each range, and running totals within it.

No window spans a whole key: a key with very many rows lies in many ranges, and only one row a range and key is put in
order to carry sums, or the last row, over the border. Null keys are keys like any others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .align import small


def _dealt(df: DataFrame, by: Sequence[str], order: Sequence[str], parts: int | None) -> DataFrame:
    """Rows as dealt by range, written down, with ``_part`` and ``_key``."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = df.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id())
    return stored(t.withColumn("_key", F.struct(*by) if by else F.lit(0)))


def running(df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str], parts: int | None = None) -> DataFrame:
    """Adds ``{c}_before`` and ``{c}_all`` for each of ``sums``: its total over the rows of the key that stand before,
    and over all of them. ``order`` is unique within a key."""
    dealt = _dealt(df, by, [order], parts)
    here = dealt.groupBy("_part", "_key").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}_base") for c in sums]
    base = here.select("_part", "_key", *carried, *[F.sum(f"_{c}").over(Window.partitionBy("_key")).alias(f"{c}_all") for c in sums])
    within = Window.partitionBy("_part", "_key").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(small(base), ["_part", "_key"])
    placed = placed.withColumns({f"{c}_before": F.col(f"_{c}_base") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums})
    return placed.drop("_part", "_key", *[f"_{c}_base" for c in sums])


def previous(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], parts: int | None = None) -> DataFrame:
    """Adds ``{c}_before``: the value of the row before in the key's order, null for its first row."""
    dealt = _dealt(df, by, order, parts)
    row = F.struct(*columns)
    last = dealt.groupBy("_part", "_key").agg(F.max_by(row, F.struct(*order)).alias("_last"))
    border = last.select("_part", "_key", F.lag("_last").over(Window.partitionBy("_key").orderBy("_part")).alias("_border"))
    before = F.lag(row).over(Window.partitionBy("_part", "_key").orderBy(*order))
    t = dealt.join(small(border), ["_part", "_key"]).withColumn("_before", F.coalesce(before, "_border"))
    return t.select(*df.columns, *[F.col(f"_before.{c}").alias(f"{c}_before") for c in columns])


def percentiles(df: DataFrame, columns: Sequence[str], ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by, column, p0, p1, ...: exact, between two values in proportion; nulls are left out, as are keys with nothing else.

    Equal values are counted before they are dealt, so that a frequent value is one row.
    """
    each = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    counts = df.select(*by, each).where("value is not null").groupBy(*by, "column", "value").agg(F.count("*").alias("n"))
    placed = running(counts, [*by, "column"], "value", ["n"])

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("n_before") + F.col("n") > place, F.col("value")))

    out = []
    for i, p in enumerate(ps):
        place = (F.col("n_all") - 1) * F.lit(float(p))
        low, high, share = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        out.append((low + (high - low) * share).alias(f"p{i}"))
    return placed.groupBy(*by, "column").agg(*out)
