"""Row windows over series: changes, trends, lags, rolling statistics, sequences, splits.

Every function takes one SeriesSpec, so that all windows of a call share one exchange and one sort. A series that is
too long for one task goes through ``ranges.by_rows``, which cuts it by range and copies as many rows as a window looks
back or ahead, or through ``in_slices``, which does so by time; means over a time of any length are ``trailing``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import SeriesSpec
from .align import small
from .ranks import previous


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def rate_of_change(df: DataFrame, spec: SeriesSpec, metrics: Sequence[str]) -> DataFrame:
    """Change per second against the row before; 0 for the first row, after a null, and where no time has passed."""
    w = spec.rows()
    dt = (_micros(spec.time) - F.lag(_micros(spec.time)).over(w)) / 1e6
    return df.withColumns({f"{m}_rate": F.coalesce(F.try_divide(F.col(m) - F.lag(m).over(w), dt), F.lit(0.0)) for m in metrics})


def trend(df: DataFrame, spec: SeriesSpec, metric: str, k: int = 5) -> DataFrame:
    """1, -1 or 0: the mean of the last k + 1 rows against that mean k rows ago; 0 while there is none."""
    with_mean = df.withColumn("_mean", F.avg(metric).over(spec.last_rows(k + 1)))
    before = F.lag("_mean", k).over(spec.rows())
    sign = F.when(F.col("_mean") > before, 1).when(F.col("_mean") < before, -1).otherwise(0)
    return with_mean.withColumn(f"{metric}_trend", sign.cast("long")).drop("_mean")


def difference(df: DataFrame, spec: SeriesSpec, metric: str) -> DataFrame:
    return df.withColumn(f"{metric}_change", F.col(metric) - F.lag(metric).over(spec.rows()))


def lags(df: DataFrame, spec: SeriesSpec, metrics: Sequence[str], steps: Sequence[int]) -> DataFrame:
    w = spec.rows()
    return df.withColumns({f"{m}_lag_{n}": F.lag(m, n).over(w) for m in metrics for n in steps})


def rolling(df: DataFrame, spec: SeriesSpec, metrics: Sequence[str], widths: Sequence[int], strict: bool = False, until: int = 0) -> DataFrame:
    """Mean, sample deviation, min and max over the last rows. ``strict``: null until all are there and known.

    ``until=-1`` ends the frame at the row before, so that a target on the same row can't leak into it.
    """
    cols = {}
    for m in metrics:
        for n in widths:
            w = spec.rows().rowsBetween(until - n + 1, until)
            full = F.count(m).over(w) == n
            for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
                value = f(m).over(w)
                cols[f"{m}_roll_{n}_{name}"] = F.when(full, value) if strict else value
    return df.withColumns(cols)


def diff_and_pct(df: DataFrame, spec: SeriesSpec, metric: str, steps: Sequence[int] = (1, 7), pct: int = 7) -> DataFrame:
    """A base of zero or null makes a null percentage."""
    w = spec.rows()
    cols = {f"{metric}_diff_{n}": F.col(metric) - F.lag(metric, n).over(w) for n in steps}
    cols[f"{metric}_pct_{pct}"] = F.try_divide(F.col(metric), F.lag(metric, pct).over(w)) - 1
    return df.withColumns(cols)


def supervised(df: DataFrame, spec: SeriesSpec, metric: str, lag_steps: Sequence[int] = (1, 3, 7), width: int = 7) -> DataFrame:
    """Lags, strict rolling mean and deviation, and the next row as target; complete cases only."""
    t = lags(df, spec, [metric], lag_steps)
    w = spec.last_rows(width)
    full = F.count(metric).over(w) == width
    t = t.withColumns({f"{metric}_roll_mean": F.when(full, F.avg(metric).over(w)), f"{metric}_roll_std": F.when(full, F.stddev_samp(metric).over(w)), "target": F.lead(metric, 1).over(spec.rows())})
    return t.dropna(subset=[*[f"{metric}_lag_{n}" for n in lag_steps], f"{metric}_roll_mean", f"{metric}_roll_std", "target"])


def sequences(df: DataFrame, spec: SeriesSpec, features: Sequence[str], target: str, lookback: int, horizon: int) -> DataFrame:
    """Sample i: features of rows i .. i+L-1 and targets of rows i+L .. i+L+H-1, where all of them exist."""
    x = F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(spec.rows().rowsBetween(0, lookback - 1))
    y = F.collect_list(F.col(target).cast("double")).over(spec.rows().rowsBetween(lookback, lookback + horizon - 1))
    return df.withColumns({"x": x, "y": y}).where((F.size("x") == lookback) & (F.size("y") == horizon))


def tiled(df: DataFrame, features: Sequence[str], lookback: int) -> DataFrame:
    """The current row repeated, for models that need a history where there is none."""
    return df.withColumn("x", F.array_repeat(F.array(*[F.col(f).cast("double") for f in features]), lookback))


def directional_accuracy(df: DataFrame, by: Sequence[str], order: Sequence[str], actual: str, predicted: str) -> DataFrame:
    """Percent of steps on which both rise or both don't; 0 for fewer than two rows."""
    t = previous(df.select(*dict.fromkeys([*by, *order, actual, predicted])), by, order, [actual, predicted])
    up = (F.col(actual) > F.col(f"{actual}_before")) == (F.col(predicted) > F.col(f"{predicted}_before"))
    return t.withColumn("_same", up.cast("double")).groupBy(*by).agg((F.coalesce(F.avg("_same"), F.lit(0.0)) * 100).alias("directional_accuracy"))


def chronological_split(df: DataFrame, spec: SeriesSpec, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Each series in time order: floor(n * ratio) cut points, no shuffling."""
    sizes = df.groupBy(F.struct(*spec.keys).alias("_key")).agg(F.count("*").alias("_n"))
    t = df.withColumn("_key", F.struct(*spec.keys)).join(small(sizes), "_key")
    i = F.row_number().over(spec.rows()) - 1
    a, b = F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(train + validation))
    return t.withColumn("split", F.when(i < a, "train").when(i < b, "val").otherwise("test")).select(*df.columns, "split")


def global_index(df: DataFrame, order: Sequence[str], parts: int, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Adds ``index``, the place of each row in the order of all rows, without a window that has no partition.

    Rows are dealt by range and ``store`` keeps them as dealt (a checkpoint or a written table). Only one count for
    each of the ``parts`` ranges is gathered.
    """
    dealt = store(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, start = 0, {}
    for p in sorted(sizes):
        start[p] = before
        before += sizes[p]
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    if not start:
        return df.withColumn("index", F.lit(0).cast("long"))
    offsets = F.create_map(*[F.lit(x) for pair in start.items() for x in pair])
    return dealt.withColumn("index", (local + offsets[F.col("_part")]).cast("long")).drop("_part")


def global_split(df: DataFrame, order: Sequence[str], parts: int, store: Callable[[DataFrame], DataFrame], train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """``chronological_split`` of one series of any length."""
    t = global_index(df, order, parts, store)
    n = t.agg(F.count("*").alias("_n"))
    i = F.col("index")
    split = F.when(i < F.floor(F.col("_n") * train), "train").when(i < F.floor(F.col("_n") * (train + validation)), "val").otherwise("test")
    return t.crossJoin(F.broadcast(n)).withColumn("split", split).drop("_n", "index")


def in_slices(df: DataFrame, spec: SeriesSpec, seconds: int, reach_seconds: int, f: Callable[[DataFrame, SeriesSpec], DataFrame]) -> DataFrame:
    """``f`` on slices of each series, so that a hot key spreads over tasks.

    Each row also goes to the following slice if that one's windows may reach it (``reach_seconds`` back); what ``f``
    makes of such copies is dropped. Right for windows that look back no further than that time.
    """
    t = _micros(spec.time)
    own, last = F.floor(t / (seconds * 1_000_000)), F.floor((t + reach_seconds * 1_000_000) / (seconds * 1_000_000))
    copies = df.withColumn("_own", own).withColumn("_slice", F.explode(F.sequence(own, last)))
    sliced = SeriesSpec((*spec.keys, "_slice"), spec.time, spec.ties, spec.metrics)
    return f(copies, sliced).where("_slice = _own").drop("_own", "_slice")


def trailing(df: DataFrame, spec: SeriesSpec, metric: str, seconds: int) -> DataFrame:
    """``trailing_mean`` of the known values and ``trailing_count`` of the rows over the last ``seconds``, up to and with
    all rows of the row's own time; rows without a time are one group.

    Each series is cut into panes of that length, so a window is the end of one pane and the beginning of the next. Both
    are running sums, one from behind and one from the front, that begin anew in each pane: work grows with the rows,
    however many of them a window holds, and nothing is taken away from a sum.
    """
    width = seconds * 1_000_000
    t = df.withColumn("_at", _micros(spec.time)).withColumn("_own", F.col("_at") - F.pmod("_at", F.lit(width)))
    t = t.withColumn("_pane", F.explode(F.when(F.col("_own").isNull(), F.array("_own")).otherwise(F.array("_own", F.col("_own") + width))))
    group, own = Window.partitionBy(*spec.keys, "_pane"), F.col("_pane").eqNullSafe(F.col("_own"))
    parts = [(own, group.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)), (~own, group.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, width))]
    value = F.col(metric).cast("double")
    for i, (side, w) in enumerate(parts):
        t = t.withColumns({f"_sum_{i}": F.coalesce(F.sum(F.when(side, value)).over(w), F.lit(0.0)), f"_known_{i}": F.count(F.when(side, value)).over(w), f"_rows_{i}": F.count_if(side).over(w)})
    t = t.withColumns({"trailing_mean": F.try_divide(F.col("_sum_0") + F.col("_sum_1"), F.col("_known_0") + F.col("_known_1")), "trailing_count": F.col("_rows_0") + F.col("_rows_1")})
    return t.where(own).select(*df.columns, "trailing_mean", "trailing_count")
