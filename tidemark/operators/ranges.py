"""Series of any length: rows are dealt by range of key and time, and what a range needs from others is brought to it.

A range holds the rows of many short series or a piece of a long one, so no task ever holds a long key. Only the first
and the last key of a range can go on in another one; the tables that carry rows or values over borders have at most
two rows a range, which is the bound of what is broadcast here. Rows that are equal in key, time and ties stay together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.shared import stored
from ..spec import SeriesSpec

_OWN = ("_part", "_key", "_halo")


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """The rows as dealt by range, written down, with ``_part`` and ``_key``."""
    if clash := [c for c in df.columns if c in _OWN]:
        raise ValueError(f"columns {clash} are used here")
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id())
    return stored(t.withColumn("_key", F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))))


def edges(rows: DataFrame, **values: Column) -> DataFrame:
    """_part, _key, and aggregates of the rows, for the first and the last key of each range: at most two rows a range."""
    ends = rows.groupBy("_part").agg(F.min("_key").alias("_lo"), F.max("_key").alias("_hi"))
    some = rows.join(F.broadcast(ends), "_part").where(F.col("_key").eqNullSafe(F.col("_lo")) | F.col("_key").eqNullSafe(F.col("_hi")))
    return some.groupBy("_part", "_key").agg(*[v.alias(c) for c, v in values.items()])


def _beside(rows: DataFrame, table: DataFrame, how: str = "left") -> DataFrame:
    """Rows with the columns of a table of edges."""
    t = table.withColumnsRenamed({"_part": "_edge_part", "_key": "_edge_key"})
    return rows.join(F.broadcast(t), (F.col("_part") == F.col("_edge_part")) & F.col("_key").eqNullSafe(F.col("_edge_key")), how).drop("_edge_part", "_edge_key")


def _reach(sizes: DataFrame, n: int, forward: bool) -> DataFrame:
    """_part, _key, _to: the other ranges of the key that need some of the rows here, each with the number of rows
    between. ``forward``: ranges that stand later and need the last rows of this one; else the earlier ones."""
    w = Window.partitionBy("_key").orderBy(F.col("_part") if forward else F.col("_part").desc())
    until = F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = sizes.withColumn("_until", until).withColumn("_from", F.col("_until") - F.col("_n"))
    others = F.collect_list(F.struct(F.col("_part").alias("part"), F.col("_from").alias("start"))).over(w.rowsBetween(1, n))
    t = t.withColumn("_others", others)
    near = F.filter("_others", lambda x: x["start"] - F.col("_until") < n)
    to = F.transform(near, lambda x: F.struct(x["part"].alias("part"), (x["start"] - F.col("_until")).alias("gap")))
    return t.select("_part", "_key", to.alias("_to")).where(F.size("_to") > 0)


def by_rows(df: DataFrame, spec: SeriesSpec, before: int, after: int, f: Callable[[DataFrame, SeriesSpec], DataFrame], parts: int | None = None) -> DataFrame:
    """``f`` on series of any length, where f looks back ``before`` rows and ahead ``after`` rows at most.

    Each range gets copies of the last ``before`` rows of the key that stand before it, be they in one range or in
    several, and of the first ``after`` rows behind it. What f makes of the copies is dropped. f takes the rows and
    a spec whose key is the series and the range.
    """
    rows = dealt(df, spec.keys, [spec.time, *spec.ties], parts)
    sizes = edges(rows, _n=F.count("*"))
    out = rows.withColumn("_halo", F.lit(False))
    for n, forward in ((before, True), (after, False)):
        if n:
            order = [c.desc() if forward else c.asc() for c in spec.order()]
            some = _beside(rows, _reach(sizes, n, forward), "inner")
            some = some.withColumn("_i", F.row_number().over(Window.partitionBy("_part", "_key").orderBy(*order))).where(F.col("_i") <= n)
            some = some.withColumn("_to", F.explode("_to")).where(F.col("_i") + F.col("_to.gap") <= n)
            out = out.unionByName(some.withColumns({"_part": F.col("_to.part"), "_halo": F.lit(True)}).drop("_i", "_to"))
    made = f(out.drop("_key"), SeriesSpec((*spec.keys, "_part"), spec.time, spec.ties, spec.metrics))
    return made.where("not _halo").drop("_halo", "_part")


def known_values(df: DataFrame, group: WindowSpec, order: Sequence[Column], columns: Sequence[str], backward: bool = True, past: Sequence[str] = (), future: Sequence[str] = ()) -> DataFrame:
    """Each of ``columns`` becomes its last known value in the group, else that of its column in ``past``, and, unless
    ``backward`` is off, else the next known value and that of its column in ``future``.

    The next values are the last ones of the rows from back to front, for a frame that runs to the end of the group is
    added up anew for each of its rows, a square of them. Places are numbered first, so that rows that are equal in
    the order stand in one order both ways.
    """
    t = df.withColumn("_place", F.row_number().over(group.orderBy(*order)))
    known = {c: [F.last(c, ignorenulls=True).over(group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), *map(F.col, past[i : i + 1])] for i, c in enumerate(columns)}
    t = t.withColumns({f"_known_{i}": F.coalesce(*known[c]) for i, c in enumerate(columns)})
    if backward:
        back = group.orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, 0)
        t = t.withColumns({f"_known_{i}": F.coalesce(f"_known_{i}", F.last(c, ignorenulls=True).over(back), *future[i : i + 1]) for i, c in enumerate(columns)})
    return t.withColumns({c: F.col(f"_known_{i}") for i, c in enumerate(columns)}).drop("_place", *[f"_known_{i}" for i in range(len(columns))])


def fill(df: DataFrame, spec: SeriesSpec, columns: Sequence[str], backward: bool = True, parts: int | None = None) -> DataFrame:
    """The last known value and, unless ``backward`` is off, else the next one, however far it is away: the last and first
    known values of each range go over the borders."""
    rows = dealt(df, spec.keys, [spec.time, *spec.ties], parts)
    at = F.struct(*spec.order())
    known = {c: F.when(F.col(c).isNotNull(), at) for c in columns}
    ends = edges(rows, **{f"_last_{i}": F.max_by(c, known[c]) for i, c in enumerate(columns)}, **{f"_first_{i}": F.min_by(c, known[c]) for i, c in enumerate(columns)})
    over, reverse = [Window.partitionBy("_key").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_part"), F.desc("_part"))]
    carried = ends.select("_part", "_key", *[F.last(f"_last_{i}", ignorenulls=True).over(over).alias(f"_past_{i}") for i in range(len(columns))], *[F.last(f"_first_{i}", ignorenulls=True).over(reverse).alias(f"_next_{i}") for i in range(len(columns))])
    filled = known_values(_beside(rows, carried), Window.partitionBy("_part", "_key"), spec.order(), columns, backward, [f"_past_{i}" for i in range(len(columns))], [f"_next_{i}" for i in range(len(columns))])
    return filled.select(*df.columns)


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, parts: int | None = None) -> DataFrame:
    """``value`` becomes the last one that is not null, up to and with the row itself; of values at one place of the order,
    the greatest."""
    rows = dealt(df, keys, order, parts)
    ends = edges(rows, _last=F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order, value))))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_part", "_key", F.last("_last", ignorenulls=True).over(earlier).alias("_past"))
    here = Window.partitionBy("_part", "_key").orderBy(*order, value).rowsBetween(Window.unboundedPreceding, 0)
    return _beside(rows, carried).withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(here), "_past")).select(*df.columns)
