"""Keyed rows of a stream in the order of event time, whatever order they arrive in.

Keys are dealt into a fixed number of buckets by their hash, so that a micro-batch makes as many calls as there are
buckets, however many keys it holds. Rows wait in a list state of their bucket until the watermark has passed them; a
timer then hands all rows of a key that are due to ``step``, in the order of time and ties, together with the state that
the last call left for that key. Rows are put into the list state batch by batch as they come; what a call holds is the
rows of one bucket within the watermark's delay and one micro-batch, and the last states of its keys. These are one list
state with an entry a key, read and written at once, for a call of the state costs far more than an entry; a timer also
ends the entries of keys that have been silent for ``idle_ms`` of event time. Rows older than the watermark are dropped by
Spark and counted in the query's progress.

The state lives in RocksDB, which the session has to name before the query starts: see ``rocksdb``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegralType, StructField, StructType

State = tuple[Any, ...] | None
Columns = Mapping[str, Sequence[Any]]
Step = Callable[[State, Columns], tuple[tuple[Any, ...], Columns]]

#: Python turns names that begin with an underscore into others on the way to a stateful operator.
KEY, TIME, MICROS, BUCKET = "tidemark_key", "tidemark_time", "tidemark_micros", "tidemark_bucket"
#: Rows of one entry of the list state.
CHUNK = 1000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _plain(values: pd.Series) -> list[Any]:
    return values.astype(object).where(values.notna(), None).tolist()


class _InOrder(StatefulProcessor):
    def __init__(self, kept: Sequence[StructField], whole: Sequence[str], ties: Sequence[str], step: Step, state: str, idle_ms: int, out: Sequence[str]):
        self.kept, self.whole, self.ties, self.step, self.idle_ms, self.out = list(kept), list(whole), list(ties), step, idle_ms, list(out)
        self.names = [f.name for f in kept]
        self.state_schema = StructType([next(f for f in kept if f.name == KEY), *StructType.fromDDL(f"ms long, {state}").fields])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([StructField(f.name, ArrayType(f.dataType)) for f in self.kept]))
        self.last = handle.getListState("last", self.state_schema)

    def _wait(self, columns: Columns) -> list[tuple[Any, ...]]:
        return [tuple(columns[c][i : i + CHUNK] for c in self.names) for i in range(0, len(columns[MICROS]), CHUNK)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        oldest = None
        for batch in rows:
            columns = {c: _plain(batch[c]) for c in self.names}
            for c in self.whole:
                columns[c] = [None if gone else v for v, gone in zip(columns[c], batch[f"{c}_missing"], strict=True)]
            self.waiting.appendList(self._wait(columns))
            least = min(columns[MICROS])
            oldest = least if oldest is None else min(oldest, least)
        if oldest is not None:
            self.handle.registerTimer(oldest // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        rows: dict[str, list[Any]] = {c: [] for c in self.names}
        for chunk in self.waiting.get():
            for c, values in zip(self.names, chunk, strict=True):
                rows[c].extend(values)
        last = {k: state for k, *state in self.last.get()}
        micros = rows[MICROS]
        due: dict[Any, list[int]] = {}
        for i, (k, at) in enumerate(zip(rows[KEY], micros, strict=True)):
            if at < mark * 1000:
                due.setdefault(k, []).append(i)
        rest = [i for i, at in enumerate(micros) if at >= mark * 1000]
        if due:
            if rest:
                self.waiting.put(self._wait({c: [v[i] for i in rest] for c, v in rows.items()}))
                self.handle.registerTimer(min(micros[i] for i in rest) // 1000 + 1)
            else:
                self.waiting.clear()
            yield self._stepped(rows, due, last)
        still = {rows[KEY][i] for i in rest}
        kept = {k: v for k, v in last.items() if v[0] + self.idle_ms > mark or k in still}
        if due or len(kept) < len(last):
            if kept:
                self.last.put([(k, *v) for k, v in kept.items()])
            else:
                self.last.clear()
        ends = [v[0] + self.idle_ms for v in kept.values() if v[0] + self.idle_ms > mark]
        if ends:
            self.handle.registerTimer(min(ends))

    def _stepped(self, rows: dict[str, list[Any]], due: dict[Any, list[int]], last: dict[Any, list[Any]]) -> pd.DataFrame:
        """The rows that are due, key by key, in their order, with what ``step`` makes of them; ``last`` follows."""
        made: dict[str, list[Any]] = {c: [] for c in self.out}
        order = [rows[MICROS], *[[(v is not None, 0 if v is None else v) for v in rows[c]] for c in self.ties]]
        for k, places in due.items():
            places.sort(key=lambda i: tuple(o[i] for o in order))
            own = {c: [v[i] for i in places] for c, v in rows.items()}
            state, added = self.step(tuple(last[k][1:]) if k in last else None, own)
            last[k] = [own[MICROS][-1] // 1000, *state]
            for c, v in made.items():
                v.extend(added[c] if c in added else own[c])
        return pd.DataFrame({c: pd.array(v, dtype="Int64") if c in self.whole else pd.Series(v, dtype=object) for c, v in made.items()})

    def close(self) -> None:
        pass


def dealt(rows: DataFrame, kept: Sequence[str], buckets: int) -> tuple[DataFrame, dict[str, StructField], list[str]]:
    """Rows of KEY, TIME and ``kept`` with their bucket and MICROS; their fields, and which are whole numbers."""
    df = rows.withColumns({MICROS: F.unix_micros(TIME), BUCKET: F.pmod(F.xxhash64(KEY), F.lit(buckets))})
    fields = {f.name: f for f in df.schema.fields}
    # A null among whole numbers would make them floating-point numbers on the way to the operator.
    whole = [c for c in [KEY, *kept] if isinstance(fields[c].dataType, IntegralType)]
    df = df.withColumns({f"{c}_missing": F.col(c).isNull() for c in whole}).withColumns({c: F.coalesce(c, F.lit(0).cast(fields[c].dataType)) for c in whole})
    return df, fields, whole


def in_order(stream: DataFrame, key: str, time: str, columns: Sequence[str], step: Step, state: str, made: str, ties: Sequence[str] = (), late: str = "10 minutes", idle_ms: int = 86_400_000, buckets: int = 256) -> DataFrame:
    """key, time, ties, columns and what ``step`` makes of them.

    ``step(state, rows)`` gets the state of a key (None at first; its fields are named by ``state``) and its rows in order,
    as columns of plain values with ``MICROS`` as their time, and returns the next state and the columns of ``made``. Rows
    without a time have no place in the order and are left out. ``buckets`` stays the same for the life of a checkpoint.
    """
    kept = list(dict.fromkeys([*ties, *columns]))
    df = stream.select(F.col(key).alias(KEY), F.col(time).cast("timestamp").alias(TIME), *kept).where(f"{TIME} is not null").withWatermark(TIME, late)
    df, fields, whole = dealt(df, kept, buckets)
    carried = [StructField(c, fields[c].dataType) for c in (KEY, MICROS, *kept)]
    out = StructType([*carried, *StructType.fromDDL(made).fields])
    t = df.groupBy(BUCKET).transformWithStateInPandas(_InOrder(carried, whole, ties, step, state, idle_ms, out.names), out, "Append", "EventTime")
    return t.select(F.col(KEY).alias(key), F.timestamp_micros(MICROS).alias(time), *kept, *out.names[len(carried) :])


# ---- rate of change, trend and difference


def _floats(values: Sequence[Any]) -> list[float]:
    return [math.nan if v is None else float(v) for v in values]


def _known(values: Sequence[float]) -> list[float | None]:
    return [None if v != v else v for v in values]


def _means(x: Sequence[float], k: int) -> list[float]:
    """Of the known ones of the last k + 1 values, added up in their order as a row window does."""
    out = []
    for i in range(len(x)):
        total, n = 0.0, 0
        for v in x[max(0, i - k) : i + 1]:
            if v == v:
                total, n = total + v, n + 1
        out.append(total / n if n else math.nan)
    return out


def _changes(metric: str, k: int) -> Step:
    def step(state: State, rows: Columns) -> tuple[tuple[Any, ...], Columns]:
        recent, seen, last = ([], 0, None) if state is None else (_floats(state[0]), state[1], state[2])
        old, x = len(recent), [*recent, *_floats(rows[metric])]
        mean = _means(x, k)
        rate, trend, change = [], [], []
        for i, micros in enumerate(rows[MICROS], old):
            moved = x[i] - x[i - 1] if i else math.nan
            seconds = 0.0 if last is None else (micros - last) / 1e6
            risen = mean[i] - mean[i - k] if i >= k else 0.0
            rate.append(moved / seconds if seconds and moved == moved else 0.0)
            trend.append(int(risen > 0) - int(risen < 0))
            change.append(moved)
            last = micros
        return (_known(x[-2 * k :]), seen + len(x) - old, last), {"rate": rate, "trend": trend, "change": _known(change)}

    return step


def ordered_changes(stream: DataFrame, key: str, time: str, metric: str, k: int = 5, ties: Sequence[str] = (), late: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """key, time, ties, metric, rate, trend, change: ``windows.rate_of_change``, ``trend`` and ``difference`` row by row,
    for any order of arrival within ``late``. State of a key is its last 2 k values and the time of the last row."""
    typed = stream.withColumn(metric, F.col(metric).cast("double"))
    return in_order(typed, key, time, [metric], _changes(metric, k), "recent array<double>, seen long, last long", "rate double, trend long, change double", ties, late, idle_ms)


# ---- drift


def _page_hinkley(value: str, delta: float, threshold: float, least: int) -> Step:
    def step(state: State, rows: Columns) -> tuple[tuple[Any, ...], Columns]:
        n, total, m, low = (0, 0.0, 0.0, 0.0) if state is None else state
        statistic, drifted = [], []
        for v in rows[value]:
            if v is None or v != v:
                statistic.append(None)
                drifted.append(False)
                continue
            n, total = n + 1, total + v
            m += v - total / n - delta
            low = min(low, m)
            statistic.append(m - low)
            drifted.append(m - low > threshold and n >= least)
            if drifted[-1]:
                n, total, m, low = 0, 0.0, 0.0, 0.0
        return (n, total, m, low), {"statistic": statistic, "drifted": drifted}

    return step


def page_hinkley(stream: DataFrame, key: str, time: str, value: str, delta: float, threshold: float, least: int = 30, ties: Sequence[str] = (), late: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """key, time, ties, value, statistic, drifted: the Page-Hinkley test of a rise of the mean, e.g. of absolute errors.

    The running sum of (value - mean so far - delta) is held against its lowest point; where it is more than
    ``threshold`` above, after ``least`` values, the row says ``drifted`` and the test begins anew. A rise of the mean by
    d is told after about threshold / (d - delta) rows. Nulls are passed on without a statistic.
    """
    typed = stream.withColumn(value, F.col(value).cast("double"))
    return in_order(typed, key, time, [value], _page_hinkley(value, delta, threshold, least), "n long, total double, m double, low double", "statistic double, drifted boolean", ties, late, idle_ms)
