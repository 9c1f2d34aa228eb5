"""Rate of change, trend and difference on a stream, where row windows are not allowed: keyed state does it.

Keys are dealt into a fixed number of buckets by their hash, so that a micro-batch makes as many calls as there are
buckets, however many keys it holds; a call works on all its rows at once. State of a bucket has an entry a key: its last
values, no more than the trend looks back, the time of its last row and the time at which it ends. Rows of a batch are
sorted by time and ``ties``. A row older than the state of its key, or without a time, is passed on with
``late_for_state`` and changes nothing. State of a key that is silent for ``idle_ms`` of event time goes. What a call holds
is the rows of one bucket in one micro-batch and the states of its keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .ordered import BUCKET, KEY, MICROS, TIME, dealt

#: Of a row without a time, and of a key without a row.
NEVER = np.iinfo(np.int64).min


def _moved(code: np.ndarray, micros: np.ndarray, x: np.ndarray, last: np.ndarray, recent: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rate, trend and change of rows that lie key by key in order; ``last`` and ``recent``, by key, follow the rows.

    Each key's rows are laid behind its 2 k values before them, so that every look back stays with the key. A row that was
    never there counts as one without a value.
    """
    first = np.flatnonzero(np.diff(code, prepend=-1))
    end = np.append(first[1:], len(code))
    touched, back = code[first], 2 * k
    rank = np.repeat(np.arange(len(first)), end - first)
    at = np.arange(len(code)) + back * (rank + 1)
    line = np.empty(len(code) + back * len(first))
    line[at] = x
    line[(first + back * np.arange(len(first)))[:, None] + np.arange(back)] = recent[touched]
    total, n = np.zeros(len(line) - k), np.zeros(len(line) - k)
    with np.errstate(all="ignore"):
        for lag in range(k, -1, -1):  # added up in their order, as a row window does
            v = line[k - lag : len(line) - lag]
            total, n = total + np.where(np.isnan(v), 0.0, v), n + ~np.isnan(v)
        mean = total / n  # of none: no number
        risen = mean[at - k] - mean[at - back]
        before = line[at - 1]
        known = ~np.isnan(x) & ~np.isnan(before)
        change = x - before
        earlier = np.append(NEVER, micros[:-1])
        earlier[first] = last[touched]
        seconds = np.where(earlier == NEVER, 0, micros - earlier) / 1e6
        rate = np.where(known & (seconds != 0), change / seconds, 0.0)
    recent[touched] = line[(end + back * np.arange(len(first)))[:, None] + np.arange(back)]
    last[touched] = micros[end - 1]
    return rate, np.where(risen > 0, 1, np.where(risen < 0, -1, 0)), change


def changes(stream: DataFrame, key: str, time: str, metric: str, k: int = 5, ties: Sequence[str] = (), late: str = "10 minutes", idle_ms: int = 86_400_000, buckets: int = 256) -> DataFrame:
    """key, time, metric, rate, trend, change, late_for_state: E1 to E3 of one metric, row by row. ``buckets`` stays the
    same for the life of a checkpoint."""
    kept = list(dict.fromkeys([*ties, metric]))
    typed = stream.withColumn(metric, F.col(metric).cast("double"))
    df = typed.select(F.col(key).alias(KEY), F.col(time).cast("timestamp").alias(TIME), *kept).withWatermark(TIME, late)
    df, fields, whole = dealt(df, kept, buckets)
    df = df.withColumn(MICROS, F.coalesce(MICROS, F.lit(int(NEVER))))
    key_type = fields[KEY].dataType.simpleString()
    names = [KEY, MICROS, "metric", "rate", "trend", "change", "late_for_state"]
    order = [MICROS, *[by for c in ties for by in ([f"{c}_missing", c] if c in whole else [c])]]

    def keys_of(values: Any) -> pd.Series:
        return pd.Series(values, dtype="Int64" if KEY in whole else object)

    def update(group: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, last, ends, recent = state.get if state.exists else ([], [], [], [])
        mark, made, old = state.getCurrentWatermarkMs(), [], len(keys)
        keys = keys_of(keys)
        last, ends, recent = np.array(last, np.int64), np.array(ends, np.int64), np.array(recent, np.float64).reshape(-1, 2 * k)
        if not state.hasTimedOut:
            t = pd.concat(list(batches), ignore_index=True)
            own = keys_of(t[KEY])
            if KEY in whole:
                own = own.mask(t[f"{KEY}_missing"])
            code, keys = pd.factorize(pd.concat([keys, own], ignore_index=True), use_na_sentinel=False)
            code, keys, more = code[old:], keys_of(keys), len(keys) - old
            last, ends = [np.append(v, np.full(more, NEVER)) for v in (last, ends)]
            recent = np.vstack([recent, np.full((more, 2 * k), np.nan)])
            t = t.assign(code=code, own=own)
            passed = (t[MICROS] == NEVER) | (t[MICROS] < last[code])
            rows = t[~passed].sort_values(["code", *order], kind="stable")
            if len(rows):
                rate, trend, change = _moved(*[rows[c].to_numpy() for c in ("code", MICROS, metric)], last, recent, k)
                made.append(rows.assign(rate=rate, trend=pd.array(trend, "Int64"), change=change, late=False))
            if passed.any():
                made.append(t[passed].assign(rate=np.nan, trend=pd.array([None] * int(passed.sum()), "Int64"), change=np.nan, late=True))
            seen = np.unique(code)
            ends[seen] = np.maximum(last[seen] // 1000, mark) + idle_ms
        stays = (ends >= mark) & (last != NEVER)
        if stays.any():
            keys, last, ends, recent = [v[stays] for v in (keys, last, ends, recent)]
            state.update((keys.astype(object).where(keys.notna(), None).tolist(), last.tolist(), ends.tolist(), recent.ravel().tolist()))
            state.setTimeoutTimestamp(int(ends.min()))
        elif state.exists:
            state.remove()
        for rows in made:
            yield rows[["own", MICROS, metric, "rate", "trend", "change", "late"]].set_axis(names, axis=1)

    out = f"{KEY} {key_type}, {MICROS} long, metric double, rate double, trend long, change double, late_for_state boolean"
    kept_state = f"keys array<{key_type}>, last array<long>, ends array<long>, recent array<double>"
    t = df.groupBy(BUCKET).applyInPandasWithState(update, out, kept_state, "append", GroupStateTimeout.EventTimeTimeout)
    return t.select(F.col(KEY).alias(key), F.when(F.col(MICROS) != int(NEVER), F.timestamp_micros(MICROS)).alias(time), F.col("metric").alias(metric), "rate", "trend", "change", "late_for_state")
