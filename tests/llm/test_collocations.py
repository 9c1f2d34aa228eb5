import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations

from .test_audit import against_sql


def test_collocations_against_sql(spark, data):
    against_sql(spark, data, "op12_collocations", "documents")


def brute(rows, least, most):
    counts, out = {}, []
    for lang, text in rows:
        c = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text or ""):
            w = [x.encode() for x in re.findall(r"[^\x20\x09]+", re.sub("[A-Z]", lambda m: m[0].lower(), piece))]
            for k in (1, 2, 3):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, c in counts.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * f >= 50 * a for q, f in candidates.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, b" ".join(p), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:most], 1)]
    return sorted(out)


def texts():
    rng = np.random.default_rng(3)
    words = ["a", "B", "the", "é", "Éa", "x-y", "10", "\x00", " ", "日本", "of", "q" * 50]
    p = 1 / np.arange(1, len(words) + 1)
    ends = [" ", " ", " ", " ", "  ", "\t", ", ", "\n", ". ", "\r\n", "\x0b"]
    made = ["".join(str(rng.choice(words, p=p / p.sum())) + str(rng.choice(ends)) for _ in range(rng.integers(0, 60))) for _ in range(60)]
    langs = ["en", "de", None, "und", ""]
    return [(langs[i % 5], t) for i, t in enumerate([*made, *made[:20], "", "  ", "...", None, "of the a " * 3000])]


@pytest.mark.parametrize("options", [{"most": 2000}, {"most": 3, "bits": 3, "most_tokens": 50, "shards": 4, "most_bits": 1 << 16}])
def test_collocations_equal_brute_force(spark, options):
    rows = texts()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5).withColumns({"word": F.lit(1), "id": F.lit("x"), "n": F.lit(None)})
    got = collocations.collocations(docs, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, options["most"])


def test_collocations_of_nothing(spark, nothing):
    docs = nothing.withColumn("lang", F.lit("en"))
    assert collocations.collocations(docs).count() == 0
    few = spark.createDataFrame([("en", None), ("en", "")], "lang string, text string")
    assert collocations.collocations(few).count() == 0


def test_merged_stripes_do_not_depend_on_rows(spark):
    """Stripes of a prefix from many tasks, in any order and size of batches."""
    rng = np.random.default_rng(4)
    rows, want = [], Counter()
    for _ in range(300):
        a, b = (int(x) for x in rng.integers(-2, 3, 2))
        nexts = sorted({int(x) for x in rng.integers(0, 40, 9)})
        counts = [int(x) for x in rng.integers(1, 9, len(nexts))]
        rows.append((a, b, 0, nexts, counts))
        want.update({(a, b, x): n for x, n in zip(nexts, counts, strict=True)})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = collocations.merge_stripes(spark.createDataFrame(rows, collocations.STRIPES), 20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    totals = Counter()
    for (a, b, _), n in want.items():
        totals[a, b] += n
    assert {(r["a"], r["b"]): r["total"] for r in got} == {k: n for k, n in totals.items() if n >= 20}
    assert {(r["a"], r["b"], x): n for r in got for x, n in zip(r["nexts"], r["counts"], strict=True)} == {k: n for k, n in want.items() if n >= 20 and k[2] and totals[k[:2]] >= 20}


def test_long_texts_come_in_parts():
    text = "aa bb, cc\tdd " * 1000 + "e" * 5000
    whole = [t for part in collocations.tokens(text) for t in part]
    assert [t for part in collocations.tokens(text, 64) for t in part] == whole
    a, b, c = (np.array(x) for x in ([3, 1, 3, 1], [1, 1, 1, 2], [0, 5, 0, 5]))
    for below in (6, 1 << 40):
        assert [x.tolist() for x in collocations._counted(a, b, c, below)] == [[1, 1, 3], [1, 2, 1], [5, 5, 0], [1, 1, 2]]
