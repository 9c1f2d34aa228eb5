"""Event-time order, keyed state in RocksDB, and drift."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import windows as W
from tidemark.streaming import features, ordered

from .test_streaming import SCHEMA, SPEC, as_text, run, stream, write


def finished(spark, df, folder):
    with ordered.rocksdb(spark):
        q = run(features.file_sink(df, str(folder / "out"), str(folder / "cp")))
    return q, spark.read.schema(df.schema).parquet(str(folder / "out"))


END = ("end", 500_000, 10**6, 0.0)


def wanted(spark, rows, k=3):
    batch = spark.createDataFrame([(key, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), i, v) for key, s, i, v in rows], SCHEMA)
    batch = W.difference(W.trend(W.rate_of_change(batch, SPEC, ["v"]), SPEC, "v", k), SPEC, "v")
    return as_text(batch.select("k", "t", "i", "v", "v_rate", "v_trend", "v_change").collect())


def test_any_order_of_arrival_within_the_delay_equals_row_windows(spark, tmp_path):
    """Each file holds rows up to nine minutes older than rows that came before; some times are equal, some values null."""
    rng = random.Random(1)
    rows = [(rng.choice("ab"), 45 * (i // 2), i, None if i % 7 == 0 else float(rng.randrange(9))) for i in range(160)]
    by_file = sorted(rows, key=lambda r: r[1] + rng.randrange(0, 500))
    for n in range(4):
        write(spark, tmp_path / "in", by_file[40 * n : 40 * n + 40], n)
    write(spark, tmp_path / "in", [END], "z")
    out = ordered.ordered_changes(stream(spark, tmp_path / "in"), "k", "t", "v", k=3, ties=["i"])
    _, got = finished(spark, out, tmp_path)
    assert as_text(got.collect()) == wanted(spark, rows)


def test_restart_goes_on_where_it_stopped(spark, tmp_path):
    rows = [("a", 30 * i, i, float(i * i % 11)) for i in range(100)]
    (tmp_path / "in").mkdir()
    df = ordered.ordered_changes(stream(spark, tmp_path / "in"), "k", "t", "v", k=3, ties=["i"])
    for n in range(4):
        write(spark, tmp_path / "in", rows[25 * n : 25 * n + 25], n)
        _, got = finished(spark, df, tmp_path)
        waiting = 10 * 60 / 30
        assert abs(got.count() - max(0, 25 * (n + 1) - waiting)) <= 1
    write(spark, tmp_path / "in", [END], "z")
    _, got = finished(spark, df, tmp_path)
    assert as_text(got.collect()) == wanted(spark, rows)


def state_rows(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", name).load(str(folder / "cp")).count()


def test_state_ends_by_timer_and_late_rows_are_dropped(spark, tmp_path):
    write(spark, tmp_path / "in", [("a", 0, 1, 1.0), ("a", 60, 2, 2.0)], 1)
    write(spark, tmp_path / "in", [("b", 3000, 3, 5.0)], 2)
    write(spark, tmp_path / "in", [("b", 3001, 5, 6.0)], 3)
    write(spark, tmp_path / "in", [("a", 30, 4, 99.0)], 4)  # older than the watermark of the batch before
    df = ordered.ordered_changes(stream(spark, tmp_path / "in"), "k", "t", "v", ties=["i"], idle_ms=3_600_000)
    q, got = finished(spark, df, tmp_path)
    assert {r["i"] for r in got.collect()} == {1, 2}
    assert sum(s.numRowsDroppedByWatermark for p in q.recentProgress for s in p.stateOperators) == 1
    with ordered.rocksdb(spark):
        assert state_rows(spark, tmp_path, "last") == 1  # a; b still waits
    write(spark, tmp_path / "in", [("b", 6000, 6, 7.0)], 5)  # the last row of a is 99 minutes old
    finished(spark, df, tmp_path)
    with ordered.rocksdb(spark):
        assert state_rows(spark, tmp_path, "last") == 1  # b; a is gone
    write(spark, tmp_path / "in", [("a", 6100, 7, 9.0), END], 6)
    _, got = finished(spark, df, tmp_path)
    assert {r["i"]: r["change"] for r in got.where("k = 'a'").collect()} == {1: None, 2: 1.0, 7: None}


def test_whole_numbers_and_nulls_keep_their_values(spark, tmp_path):
    """Ties beyond 2 ** 53 beside a null tie, and a row without a time."""
    big = 2**60 + 1
    rows = [("a", 0, big, 1.0), ("a", 0, None, 2.0), ("a", 5, big + 2, None)]
    write(spark, tmp_path / "in", [*rows, END], 1)
    (tmp_path / "in" / "2.json").write_text('{"k": "a", "t": null, "i": 1, "v": 1.0}\n')
    out = ordered.ordered_changes(stream(spark, tmp_path / "in"), "k", "t", "v", k=2, ties=["i"])
    _, got = finished(spark, out, tmp_path)
    assert [(r["i"], r["v"], r["change"]) for r in got.where("k = 'a'").orderBy("t", F.asc_nulls_first("i")).collect()] == [(None, 2.0, None), (big, 1.0, -1.0), (big + 2, None, None)]


def page_hinkley(values, delta, threshold, least):
    """Row by row, as it is defined."""
    out, n, total, m, low = [], 0, 0.0, 0.0, 0.0
    for x in values:
        if x is None:
            out.append((None, False))
            continue
        n, total = n + 1, total + x
        m += x - total / n - delta
        low = min(low, m)
        alarm = m - low > threshold and n >= least
        out.append((m - low, alarm))
        if alarm:
            n, total, m, low = 0, 0.0, 0.0, 0.0
    return out


def stepped(values, size, *options):
    step, state, out = ordered._page_hinkley("v", *options), None, []
    for i in range(0, len(values), size):
        state, rows = step(state, pd.DataFrame({"v": pd.Series(values[i : i + size], dtype=object)}))
        out += list(zip(rows["statistic"], rows["drifted"], strict=True))
    return [(None if s is None else float(s), bool(d)) for s, d in out]


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_page_hinkley_does_not_depend_on_batches(size):
    rng = np.random.default_rng(1)
    values = [None if rng.random() < 0.1 else float(v) for v in rng.normal(5, 3, 400)]
    want = page_hinkley(values, 0.1, 15.0, 5)
    assert stepped(values, size, 0.1, 15.0, 5) == want and sum(d for _, d in want) > 2


def test_planted_shift_is_found_and_noise_is_not():
    """Errors of mean 1 and deviation 1; from row 500 on, mean 3. Delta 0.5, threshold 25: told within 25 / 1.5 rows and
    as many again for the noise; of 300 runs without a shift over 1000 rows, at most 1 in 100 says so."""
    delays, false = [], 0
    for seed in range(300):
        rng = np.random.default_rng(seed)
        x = np.abs(rng.normal(0, 1.25, 1000)).tolist()
        false += any(d for _, d in stepped(x, 1000, 0.5, 25.0, 30))
        y = [*x[:500], *(np.array(x[500:]) + 2).tolist()]
        told = [i for i, (_, d) in enumerate(stepped(y, 1000, 0.5, 25.0, 30)) if d]
        if told and told[0] >= 500:
            delays.append(told[0] - 499)
    assert false <= 3 and len(delays) >= 297
    assert max(delays) <= 2 * math.ceil(25 / 1.5)


def test_drift_on_a_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, 30 * i, i, rng.random() + (4 if k == "a" and i >= 60 else 0)) for i in range(120) for k in "ab"]
    for n in range(3):
        write(spark, tmp_path / "in", rows[80 * n : 80 * n + 80], n)
    write(spark, tmp_path / "in", [END], "z")
    df = ordered.page_hinkley(stream(spark, tmp_path / "in"), "k", "t", "v", 0.2, 10.0, 10, ties=["i"])
    _, got = finished(spark, df, tmp_path)
    told = got.where("drifted and k <> 'end'").orderBy("t").collect()
    assert {r["k"] for r in told} == {"a"} and 60 <= told[0]["i"] <= 66
    for k in "ab":
        own = got.where(F.col("k") == k).orderBy("i").collect()
        want = page_hinkley([v for key, _, _, v in rows if key == k], 0.2, 10.0, 10)
        assert [(round(r["statistic"], 9), r["drifted"]) for r in own] == [(round(s, 9), d) for s, d in want]


def test_calls_do_not_grow_with_the_keys(spark, tmp_path):
    """Keys share their buckets' calls, and each keeps its own values."""
    rows = [(f"k{j}", 60 * i + j, 100 * i + j, float(i * j % 7)) for i in range(3) for j in range(40)]
    write(spark, tmp_path / "in", [*rows, END], 1)
    df = ordered.ordered_changes(stream(spark, tmp_path / "in"), "k", "t", "v", k=3, ties=["i"])
    assert ordered.BUCKET in df._jdf.queryExecution().analyzed().toString()
    _, got = finished(spark, df, tmp_path)
    assert as_text(got.collect()) == wanted(spark, rows)
