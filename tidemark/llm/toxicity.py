"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of two hashed rows, one of the word and one of its first letters. Filters of several
widths slide over the whole text, the largest value of each is pooled, and a logistic layer reads the pool. The
network learns by Adam from about ``sample`` labelled documents of the training folds, long ones whole; the first
dimension of the embeddings starts at the log-odds of their words. Three networks learn from different four fifths of the
sample and are averaged. Thresholds are calibrated for each language on the parts that a network has not seen: a score
of 0.5 stands at the threshold. A language with few toxic
labels there has its own threshold drawn towards the common one. The language is guessed from the text's own function
words, never read from a column. Sample, parts and order of learning follow from ids and texts alone, so the same rows
make the same network however they are dealt or ordered; scores are rounded to six places.

Defined results: a null text counts as empty and is scored like any text. Labels that are null or contradict each other
for an id teach nothing. Without labels of both classes every score is the smoothed share of the class (0 without
labels). Repeated rows and null ids get a score each; a null id is in no fold and so not held out. Every document is
scored whole. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, stored
from .quality import bounded_sample, known_labels

BITS, PREFIX, WIDTHS, FILTERS, DIMS = 18, 5, (1, 2, 3), 12, 8
BUCKETS = 1 << BITS
PAD = 0  # rows of the embeddings that stay zero: padding and words too rare to learn
TO_SPACE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

#: Common function words of four languages.
FUNCTION_WORDS = {
    "en": "the of and to is that for it with as was are by this be from at he she they not have",
    "fr": "le les des et une qui dans du est pour sur au pas ce cette nous vous il elle avec",
    "de": "der die das und den von zu mit ist auf ein eine nicht sich für dem im auch wird",
    "es": "el los las y por con para se del al una como más pero sus lo su es era",
}
LANGUAGES = ["", *FUNCTION_WORDS]


def _bucket(word: bytes) -> int:
    return zlib.crc32(word) % (BUCKETS - 1) + 1


def word_ids(text: str | None) -> np.ndarray:
    """Two rows for each word: its bucket and its prefix's."""
    words = (text or "").lower().encode("utf-8", "replace").translate(TO_SPACE).split()
    crc = zlib.crc32
    both = np.array([[crc(w) for w in words], [crc(b"^" + w[:PREFIX]) for w in words]], dtype=np.int64).reshape(2, -1)
    return (both % (BUCKETS - 1) + 1).astype(np.int32)


def _language_table() -> np.ndarray:
    table = np.zeros(BUCKETS, dtype=np.int8)
    for k, words in enumerate(FUNCTION_WORDS.values(), 1):
        for w in words.split():
            table[_bucket(w.encode())] = k
    return table


_LANGUAGE = _language_table()


def language(ids: np.ndarray) -> int:
    """0 if no function word is known, else the index in LANGUAGES."""
    seen = np.bincount(_LANGUAGE[ids[0]], minlength=len(LANGUAGES))[1:]
    return int(seen.argmax()) + 1 if seen.any() else 0


def joined(docs: list[np.ndarray], more: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents in a row with padding behind each; where each begins; and its length with the padding. Where
    ``more`` says that a document goes on in the next window, there is no padding."""
    gap = np.full((2, max(WIDTHS)), PAD, dtype=np.int32)
    parts, room = [], []
    for i, d in enumerate(docs):
        own = [d] if more is not None and more[i] else [d, gap]
        parts += own
        room.append(sum(x.shape[1] for x in own))
    room = np.array(room)
    return np.concatenate(parts, axis=1), np.cumsum(room) - room, room


def _maxima(z: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The largest value of each column between each start and end (exclusive)."""
    both = np.stack([starts, ends], axis=1).ravel()
    return np.maximum.reduceat(z, both[:-1] if both[-1] == len(z) else both, axis=0)[::2]


@dataclass
class Network:
    words: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, DIMS), dtype=np.float32))
    prefixes: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, DIMS), dtype=np.float32))
    kernels: list[np.ndarray] = field(default_factory=list)  # of each width: (width, DIMS, FILTERS)
    biases: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32))
    shift: float = -30.0
    cuts: dict[int, float] = field(default_factory=dict)  # by index in LANGUAGES; -1 is common to all

    def pooled(self, ids: np.ndarray, starts: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(documents, filters) maxima before the rectifier, all values of each width, and the embeddings. No filter
        reaches from one document into the next."""
        e = np.add(self.words[ids[0]], self.prefixes[ids[1]], dtype=np.float32)
        best, maps = [], []
        for k in self.kernels:
            n = len(e) - len(k) + 1
            z = e[:n] @ k[0]
            for j in range(1, len(k)):
                z += e[j : j + n] @ k[j]
            best.append(_maxima(z, starts, starts + room - len(k) + 1))
            maps.append(z)
        return np.concatenate(best, axis=1), maps, e

    def raw(self, docs: list[np.ndarray], limit: int = 200_000, window: int = 50_000) -> np.ndarray:
        """Logits; long texts are pooled window by window, overlapping by the widest filter."""
        if not self.kernels:
            return np.full(len(docs), self.shift)
        pieces, owner, more = [], [], []
        for i, d in enumerate(docs):
            for at in range(0, max(1, d.shape[1]), window):
                pieces.append(d[:, at : at + window + max(WIDTHS)])
                owner.append(i)
                more.append(at + window + max(WIDTHS) < d.shape[1])
        pool = np.full((len(docs), len(self.biases)), -np.inf, dtype=np.float32)
        at = 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + pieces[end].shape[1] <= limit):
                size += pieces[end].shape[1]
                end += 1
            np.maximum.at(pool, owner[at:end], self.pooled(*joined(pieces[at:end], more[at:end]))[0])
            at = end
        return np.maximum(pool + self.biases, 0) @ self.out + self.shift

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        return calibrated(_probability(self.raw(docs)), docs, self.cuts)


def _probability(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))


def calibrated(p: np.ndarray, docs: list[np.ndarray], cuts: dict[int, float]) -> np.ndarray:
    """0.5 at the threshold of each document's language."""
    cut = np.array([cuts.get(language(d), cuts.get(-1, 0.5)) for d in docs])
    return np.where(p < cut, 0.5 * p / cut, 0.5 + 0.5 * (p - cut) / (1 - cut))


def _log_odds(docs: list[np.ndarray], y: np.ndarray, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each bucket, less for rare ones and 0 below two documents; and the documents of each."""
    seen = np.zeros((2, BUCKETS))
    for d, t in zip(docs, y, strict=True):
        seen[int(t), np.unique(d[row])] += 1
    rate = (seen + 0.5) / (np.array([(y == 0).sum(), (y == 1).sum()])[:, None] + 1)
    total = seen.sum(axis=0)
    return np.log(rate[1] / rate[0]) * (total >= 2) * total / (total + 6), total


def train(docs: list[np.ndarray], y: np.ndarray, draw: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 5, drawn: float = 10.0) -> Network:
    """draw: a whole number for each document; a fifth of them stand aside for the thresholds. A language's threshold
    weighs its toxic documents there against ``drawn`` for the common one."""
    net, rng = Network(), np.random.default_rng(seed)
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
    if not len(y) or y.sum() in (0, len(y)):
        net.shift = float(np.log(share / (1 - share))) if len(y) else -30.0
        return net
    fit = (draw % 5 != 0) | (y.sum() < 20)
    for table, row in ((net.words, 0), (net.prefixes, 1)):
        odds, seen = _log_odds([d for d, f in zip(docs, fit, strict=True) if f], y[fit], row)
        table[:] = rng.standard_normal(table.shape, dtype=np.float32)
        table *= np.float32(0.05) * (seen >= 2)[:, None]
        table[:, 0] = np.clip(odds, -4, 4) / 4
        table[PAD] = 0
    net.kernels = [rng.normal(0, 0.1, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for k in net.kernels:
        k[0, 0, :] += 1.0
    net.biases[:] = -0.2 - 0.1 * rng.random(len(net.biases))
    net.out[:] = 0.3
    net.shift = -1.0
    dense = [net.biases, net.out, *net.kernels]
    m, v = [np.zeros_like(a) for a in dense], [np.zeros_like(a) for a in dense]
    ms, step = np.zeros(2), 0
    weight = np.where(y == 1, min(4.0, (len(y) - y.sum()) / max(1, y.sum())), 1.0)
    pool_of = np.flatnonzero(fit)
    for _ in range(epochs):
        order = rng.permutation(pool_of)
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            ids, starts, room = joined([docs[i] for i in pick])
            best, maps, e = net.pooled(ids, starts, room)
            active = best + net.biases
            hidden = np.maximum(active, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.shift, -30, 30)))
            dz = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
            dh = dz[:, None] * net.out[None, :] * (active > 0)
            grads = [dh.sum(axis=0), hidden.T @ dz + 1e-4 * net.out]
            de_at, de = [], []
            for w, k in enumerate(net.kernels):
                z, own = maps[w], slice(w * FILTERS, (w + 1) * FILTERS)
                where = np.stack([s + z[s : s + n - len(k) + 1].argmax(axis=0) for s, n in zip(starts, room, strict=True)])
                g, dk = dh[:, own], np.zeros_like(k)
                for j in range(len(k)):
                    dk[j] = np.einsum("nfd,nf->df", e[where + j], g)
                    de_at.append((where + j).ravel())
                    de.append((g[:, :, None] * k[j].T[None, :, :]).reshape(-1, DIMS))
                grads.append(dk + 1e-4 * k)
            step += 1
            for a, g, m1, v1 in zip(dense, grads, m, v, strict=True):
                m1 *= 0.9
                m1 += 0.1 * g
                v1 *= 0.999
                v1 += 0.001 * g * g
                a -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.999**step)) + 1e-8)
            ms = 0.9 * ms + 0.1 * np.array([dz.sum(), 0])
            net.shift -= rate * float(np.sign(ms[0])) * min(1.0, abs(float(ms[0])) * 10)
            rows_at, gradient = np.concatenate(de_at), np.concatenate(de)
            for table, row in ((net.words, 0), (net.prefixes, 1)):
                b = ids[row, rows_at]
                np.subtract.at(table, b[b != PAD], rate * 20 * gradient[b != PAD])
    net.words, net.prefixes = net.words.astype(np.float16), net.prefixes.astype(np.float16)  # half the memory wherever it goes
    hold = np.flatnonzero(~fit)
    hold = hold if len(hold) else np.arange(len(y))
    net.cuts = thresholds(_probability(net.raw([docs[i] for i in hold])), y[hold], np.array([language(docs[i]) for i in hold]), drawn)
    return net


def thresholds(p: np.ndarray, y: np.ndarray, said: np.ndarray, drawn: float) -> dict[int, float]:
    """The common threshold at -1 and those of the languages that have toxic documents, drawn towards it."""
    cuts = {-1: _cut(p, y)}
    for k in range(len(LANGUAGES)):
        own = said == k
        known = y[own].sum()
        if known:
            near = [np.log(c / (1 - c)) for c in (_cut(p[own], y[own]), cuts[-1])]
            cuts[k] = float(1 / (1 + np.exp(-(known * near[0] + drawn * near[1]) / (known + drawn))))
    return cuts


def _cut(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1, in the middle of its gap."""
    order = np.argsort(-p)
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(1.0, y.sum()))
    ties = np.r_[p[order][1:] == p[order][:-1], False]
    best = int(np.where(ties, -1, f1).argmax())
    following = p[order][best + 1] if best + 1 < len(y) else 0.0
    return float(np.clip((p[order][best] + following) / 2, 0.02, 0.98))


@dataclass
class Ensemble:
    """Networks that learned from different four fifths, each calibrated on what it has not seen. Their mean logit is the
    raw score; thresholds come from all documents that stood aside once."""

    networks: list[Network]
    cuts: dict[int, float]

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        mean = np.mean([n.raw(docs) for n in self.networks], axis=0)
        return calibrated(_probability(mean), docs, self.cuts)


def trained(docs: list[np.ndarray], y: np.ndarray, draw: np.ndarray, networks: int = 3, drawn: float = 10.0) -> Ensemble | Network:
    """``networks`` (5 at most) of ``train``, with other fifths aside and other starts. Without both classes, one constant."""
    if not len(y) or y.sum() in (0, len(y)):
        return train(docs, y, draw)
    made, aside, told = [], [], []
    for k in range(networks):
        made.append(train(docs, y, draw + k, seed=5 + k, drawn=drawn))
        hold = np.flatnonzero((draw + k) % 5 == 0) if y.sum() >= 20 else np.arange(len(y))
        aside.append(hold)
        told.append(_probability(made[-1].raw([docs[i] for i in hold])) if len(hold) else np.zeros(0))
    hold = np.concatenate(aside)
    if not len(hold):
        return Ensemble(made, made[0].cuts)
    return Ensemble(made, thresholds(np.concatenate(told), y[hold], np.array([language(docs[i]) for i in hold]), drawn))


def learning_rows(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held_out: int, sample: int, sample_words: int, least: int = 20) -> pd.DataFrame:
    """docs: doc_id, text. label, draw, ids of about ``sample`` labelled documents and ``sample_words`` words, fewer
    documents where they are longer; in order of id and text."""
    known = known_labels(labels, "doc_id", label_col).where(remainder("doc_id", folds) != held_out)
    chosen = bounded_sample(known.where("label = 1"), sample // 3).unionByName(bounded_sample(known.where("label = 0"), sample - sample // 3))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(ids=[word_ids(t).ravel() for t in b["text"]])

    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.xxhash64("doc_id", F.lit("aside")).alias("draw"), F.xxhash64("text").alias("text_hash"), "text")
    rows = stored(rows.mapInPandas(hashed, "doc_id long, label int, draw long, text_hash long, ids array<int>"), "learning_rows")
    words = rows.agg(F.sum(F.size("ids") / 2)).first()[0] or 0
    if words > sample_words:
        # At least ``least`` documents of each class stay, however long they are.
        rows = rows.withColumn("place", F.pmod(F.xxhash64("doc_id", F.lit("words")), F.lit(1 << 30)))
        inside = F.col("place") < int(sample_words / words * (1 << 30))
        first = [rows.where(F.col("label") == c).orderBy("place", "doc_id", "text_hash").limit(least).where(~inside) for c in (0, 1)]
        rows = rows.where(inside).unionByName(first[0]).unionByName(first[1]).drop("place")
    return rows.toPandas().sort_values(["doc_id", "text_hash"], kind="stable", ignore_index=True)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out: int = 0, sample: int = 6000, sample_words: int = 4_000_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    got = learning_rows(base, labels, label_col, folds, held_out, sample, sample_words)
    ids, label, draw = [np.array(i, dtype=np.int32).reshape(2, -1) for i in got.pop("ids")], got["label"].to_numpy(dtype=np.float64), got["draw"].to_numpy(dtype=np.int64)
    del got  # the driver holds the sample once
    net = trained(ids, label, draw)
    del ids
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = [shared.value.score([word_ids(t) for t in b["text"].iloc[i : i + 256]]) for i in range(0, len(b), 256)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": np.concatenate(s).round(6) if s else np.zeros(0)})

    out = base.mapInPandas(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
