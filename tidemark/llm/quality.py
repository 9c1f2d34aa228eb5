"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every whole text becomes a row of statistics in one pass. The trees learn from about ``sample`` labelled rows of
the training folds (by the hash of their id; all if there are fewer), binned into histograms, with logistic loss. A forest is
five flat arrays (feature, threshold, left, right, value), and all rows of a batch walk a tree together.

Defined results: a null text counts as empty and is scored like any text. Labels that are null, or that contradict each
other for an id, teach nothing. Without labels, or with one class only, every score is the class's smoothed share
(0.5 without labels). Repeated rows and null ids get a score each; a null id is in no fold and so not held out. The
forest depends on the rows alone, not on how they are dealt or ordered. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder

SYMBOLS = [ord(c) for c in ".,!?;:|%$&*#=<>{}[]()/\\_-+@~^\"'"]


def statistics(text: str | None) -> np.ndarray:
    text = text or ""
    code = np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4"), 0x300)
    n = max(1, len(code))
    c = np.bincount(code, minlength=0x301)
    upper = c[65:91].sum() + c[0xC0:0xDF].sum() - c[0xD7]
    lower = c[97:123].sum() + c[0xDF:0x100].sum() - c[0xF7]
    share = c[c > 0] / n
    words = text.split()
    k = max(1, len(words))
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    often = Counter(words)
    top = [x for _, x in often.most_common(3)] + [0, 0, 0]
    same = sum(map(str.__eq__, words, words[1:]))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    long = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines)) if lines else np.zeros(1, dtype=np.int64)
    line_often = Counter(lines)
    return np.array(
        [np.log1p(len(code)), np.log1p(len(words)), upper / max(1, upper + lower), (upper + lower) / n, c[48:58].sum() / n, (c[9:14].sum() + c[32]) / n, c[0x80:0x300].sum() / n, c[0x300] / n, *(c[SYMBOLS[:12]] / n), c[SYMBOLS].sum() / n, float(-(share * np.log(share)).sum()) if len(share) else 0.0,
         size.mean(), size.std(), size.max(), (size <= 3).mean(), (size == 1).mean(), len(often) / k, len(often) / k**0.8, top[0] / k, sum(top[:3]) / k, same / k, pairs / k,
         len(lines), long.mean(), long.std() / max(1.0, long.mean()), (long < 30).mean(), len(line_often) / m, max(line_often.values(), default=0) / m, sum(x.rstrip()[-1:] in ".!?" for x in lines) / m, c[46] / k, c[44] / k],
        dtype=np.float64)


WIDTH = len(statistics(""))


@dataclass
class Forest:
    """All trees in five arrays; roots[t] is where tree t begins, and a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.start)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 4.0, ridge: float = 1.0) -> Forest:
    """Second-order boosting; a split's gain comes from histograms of gradients over the bins."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, 0), (threshold, np.inf), (left, len(left)), (right, len(right)), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) + np.arange(x.shape[1]) * bins
        total = np.full(len(y), start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, p * (1 - p)
            roots.append(node())
            level = [(roots[-1], np.arange(len(y)))]
            for d in range(depth + 1):
                below = []
                for at, rows in level:
                    sg, sh = g[rows].sum(), h[rows].sum()
                    value[at] = rate * sg / (sh + ridge)
                    flat = binned[rows].ravel()
                    if d == depth or len(rows) < 2 * least:
                        total[rows] += value[at]
                        continue
                    size = bins * x.shape[1]
                    gl = np.cumsum(np.bincount(flat, np.repeat(g[rows], x.shape[1]), size).reshape(-1, bins), axis=1)
                    hl = np.cumsum(np.bincount(flat, np.repeat(h[rows], x.shape[1]), size).reshape(-1, bins), axis=1)
                    gain = gl**2 / (hl + ridge) + (sg - gl) ** 2 / (sh - hl + ridge) - sg**2 / (sh + ridge)
                    gain[(hl < 0.05) | (sh - hl < 0.05)] = -1
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[f, b] <= 1e-6 or b >= len(cuts[f]):
                        total[rows] += value[at]
                        continue
                    go = binned[rows, f] - f * bins <= b
                    feature[at], threshold[at], left[at], right[at] = int(f), float(cuts[f][b]), node(), node()
                    below += [(left[at], rows[go]), (right[at], rows[~go])]
                level = below
    return Forest(np.array(feature, dtype=np.int64), np.array(threshold), np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(value), np.array(roots, dtype=np.int64), depth, start)


def known_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(doc_id, label): ids whose labels are 0 or 1 and agree."""
    t = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    return t.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")


def bounded_sample(rows: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` rows, all if there are fewer: those whose id hashes below a share of the range."""
    share = sample / max(1, rows.count())
    return rows if share >= 1 else rows.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 4, held_out: int = 2, sample: int = 20_000) -> Forest:
    """Learns from about ``sample`` labelled documents of the training folds, all if there are fewer."""
    known = known_labels(labels, "doc_id", label_col).where(remainder("doc_id", folds) != held_out)
    chosen = bounded_sample(known, sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(x=[statistics(t) for t in b["text"]])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = base.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.xxhash64("text").alias("text_hash"), "text")
    got = rows.mapInPandas(run, "doc_id long, label int, text_hash long, x array<double>").toPandas()
    got = got.sort_values(["doc_id", "text_hash"], kind="stable", ignore_index=True)  # sums follow one order
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, WIDTH))
    return train(x, got["label"].to_numpy(dtype=np.float64))


def score_of(forest: Forest, docs: DataFrame):
    """A function of a text column; statistics and trees in one pass, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.stack([statistics(t) for t in text])) if len(text) else np.zeros(0))

    return score


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2, cut: float = 0.7, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    score = score_of(trained(docs, labels, id_col, text_col, folds=folds, held_out=held_out, **options), docs)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), score(F.col(text_col)).alias("score"))
    return out.select("doc_id", F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their own columns; null ids stay."""
    score = score_of(trained(docs, labels, id_col, text_col, **options), docs)
    return docs.where(F.col(id_col).isNull() | (score(F.col(text_col)) >= cut))
