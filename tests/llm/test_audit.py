import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import filter_audit, registry


def against_sql(spark, data, name, *tables):
    got = registry.queries()[name](spark, data)
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    rel = c.execute(registry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(rel.fetchall(), key=repr)


def test_audit_against_sql(spark, data):
    against_sql(spark, data, "op11_filter_audit", "documents", "labels")


def brute(rows, filters):
    """rows: part, mask as a set of letters, good, toxic. Every order is run over every document."""
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        removed_by = dict.fromkeys(filters, 0)
        for order in map("".join, itertools.permutations(sorted(filters))):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed_by[f] += len(gone)
                failing = sum(f in r[1] for r in own)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return out


@pytest.mark.parametrize("filters", ["ABC", "ZBA", "Q"])
def test_audit_equals_running_every_order(spark, filters):
    n = 2 ** len(filters)
    rows = [(p, m, (m * 7 + i) % 3 % 2, (m + i) % 2) for i, p in enumerate(["x", "", "y"]) for m in range(n) for _ in range((m * m + i) % 4)]
    got = filter_audit.audit(spark.createDataFrame(rows, "part string, mask int, good int, toxic int"), filters).collect()
    want = brute([(p, {f for i, f in enumerate(filters) if m >> i & 1}, g, t) for p, m, g, t in rows], filters)
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in got} == want and len(got) == len(want)


def test_intervals_cover_every_order_once():
    orders = filter_audit.orders("ABCDE")
    assert [filter_audit.rank(o) for o in orders] == list(range(120))
    for mask in range(1, 32):
        step_of = {}
        for m, step, start, end in filter_audit.intervals("ABCDE"):
            if m == mask:
                for i in range(start, end):
                    assert i not in step_of
                    step_of[i] = step
        assert step_of == {i: min(o.index(f) for k, f in enumerate("ABCDE") if mask >> k & 1) + 1 for i, o in enumerate(orders)}


def test_masks_of_odd_rows(spark, odd, nothing, labels, no_labels):
    docs = odd.withColumn("lang", F.when(F.col("doc_id") == 8, None).otherwise("en")).withColumn("words", F.lit(1))
    got = filter_audit.masks(docs, labels)
    assert got.count() == odd.count() and got.where("part = ''").count() == 1
    # 4 copies nothing smaller but 3 (null is empty); equal ids are no copies of each other, nor are null ids.
    assert got.where("mask & 16 > 0").count() == 1
    assert filter_audit.masks(docs, no_labels).agg(F.sum("good") + F.sum("toxic")).first()[0] == 0
    out = filter_audit.filter_audit(docs, labels)
    assert out.count() == 2 * 120 * 5 and out.where("kept < 0 or removed < 0 or redundant < 0").count() == 0
    assert filter_audit.filter_audit(nothing.withColumn("lang", F.lit("x")), no_labels).count() == 0


def test_mask_limits(spark, no_labels):
    words = [f"w{i}" for i in range(100)]
    rows = [
        (1, " ".join(words)),  # passes all
        (2, " ".join(words[:99])),  # A
        (3, " ".join(words[:80] + words[:20])),  # 80 of 100 distinct: passes
        (4, " ".join(words[:79] + words[:21])),  # B
        (5, " ".join(words).replace("w0 ", "# ")),  # D
        (6, "AB" + " ".join(words[:100])[2:]),
        (7, " ".join(words)),  # E
        (8, "A" * 10 + "é" * 90),  # 10 of 100 code points: A only
        (9, "A" * 11 + "é" * 89),  # A and C
        (0, "W" + " ".join(words)[1:]),
    ]
    docs = spark.createDataFrame([(i, t, str(i)) for i, t in rows], "doc_id long, text string, lang string")
    got = {r["part"]: r["mask"] for r in filter_audit.masks(docs, no_labels).collect()}
    assert got == {"1": 0, "2": 1, "3": 0, "4": 2, "5": 8, "6": 0, "7": 16, "8": 1, "9": 5, "0": 0}
