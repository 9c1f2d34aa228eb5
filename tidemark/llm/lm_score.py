"""Language-model scores from a log-frequency Bloom filter.

Documents are packed into slabs of some megabytes of text. A slab hashes its words and word pairs, makes them distinct
and sends them, with their training counts, to the segments that the first bits of the hashes name. A segment adds the
counts up and builds its own part of the filter: a count c becomes the level 1 + floor(log2 c), and an n-gram enters
once for each level from 1 to its own, so the first probe tells seen once from unseen. The part is made of shards, and a
shard has as many bits as its entries need, so that the filter is a function of the n-grams alone. The segment then
probes it for every n-gram that it was asked for, level after level until one is missing, and sends a byte a piece back
to the slab, which takes the middle of the last level as the count; pair and word probabilities are interpolated. No
part of the filter leaves its task, and there are more segments where the corpus is larger, so every level is there at
every size.

A slab sends at most ``fan`` rows. Where there are more segments than that, its rows go to ``fan`` coarse ranges of
hashes first; there, rows of as many slabs as a range has segments are merged, equal n-grams added up, and dealt out by
the next bits. Answers come back by the same way. Rows between the stages thus grow with the corpus, not its square.

The base score needs exact counts of words; they come back with the levels. A word asks once a slab: no key is hot.

Words are known by 64-bit hashes: two of a billion words meet with a chance of about 0.03 in the whole corpus.

Defined results: a null or blank text is the end token alone. Null ids are in no fold and so train. Repeated rows count
as often as they stand there. An empty table gives no rows; without training tokens every count is zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, stored

END = np.uint64(xxhash.xxh64_intdigest(b" end "))  # no word holds a space
PROBES = 4
LEAST = 1  # level
SHARD = 20
SHARD_SHIFT = np.uint64(64 - SHARD)


def token_hashes(text: str | bytes | None) -> np.ndarray:
    raw = text if isinstance(text, bytes) else (text or "").encode("utf-8", "replace")
    words = raw.lower().split()  # ASCII rules: A-Z and six spaces
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    return np.r_[h, END]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


def pair_hashes(tokens: np.ndarray) -> np.ndarray:
    """Pairs of neighbours of one document or of several on end; the first word follows an end."""
    before = np.r_[END, tokens[:-1]]
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + mixed(tokens))


def middle(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level: 1 for 1, 2.5 for 2 (two and three), 5.5 for 3."""
    return (2.0 ** (level - 1) + 2.0**level - 1) / 2


def level_of(n: np.ndarray) -> np.ndarray:
    return np.frexp(n.astype(np.float64))[1].astype(np.int64)


class LogFilter:
    """A part of the filter, from its n-grams and their counts; a byte holds a bit while the part is in use.

    The first SHARD bits of a hash name its shard, and a shard has as many bits as its own entries need. Where an entry
    stands thus depends on the n-grams of its shard alone, not on how many shards a part holds or on how the corpus is
    dealt, and so do false answers.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray, bits_per_entry: int = 10):
        top = level_of(n)
        entries = np.maximum(top - LEAST + 1, 0)
        self.shards, at = np.unique(key >> SHARD_SHIFT, return_inverse=True)
        self.size = np.maximum(64, np.bincount(at, entries, len(self.shards)).astype(np.int64) * bits_per_entry).astype(np.uint64)
        self.start = np.cumsum(self.size) - self.size
        self.bits = int(self.size.sum())
        self.held = np.zeros(self.bits, dtype=bool)
        for level in range(LEAST, int(top.max(initial=0)) + 1):
            for place in self.places(key[top >= level], at[top >= level], level):
                self.held[place] = True

    def places(self, key: np.ndarray, shard: np.ndarray, level: int) -> Iterator[np.ndarray]:
        h = mixed(key + np.uint64(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF))
        step = (h >> np.uint64(32)) | np.uint64(1)
        start, size = self.start[shard], self.size[shard]
        for probe in range(PROBES):
            yield start + (h + np.uint64(probe) * step) % size

    def found(self, key: np.ndarray) -> np.ndarray:
        """The highest level without a gap below it, from repeated probes; ``LEAST - 1`` if there is none."""
        out = np.full(len(key), LEAST - 1, dtype=np.int64)
        shard = np.searchsorted(self.shards, key >> SHARD_SHIFT)
        known = shard < len(self.shards)
        known[known] = self.shards[shard[known]] == key[known] >> SHARD_SHIFT
        left, level = np.flatnonzero(known), LEAST
        while len(left):
            hit = np.ones(len(left), dtype=bool)
            for at in self.places(key[left], shard[left], level):
                hit &= self.held[at]
            left = left[hit]
            out[left] = level
            level += 1
        return out


def segment_starts(key: np.ndarray, segments: int) -> np.ndarray:
    """Where each segment begins in sorted hashes, and their end; segments are a power of two of 2 and more."""
    first = np.arange(1, segments, dtype=np.uint64) << np.uint64(65 - segments.bit_length())
    return np.r_[0, np.searchsorted(key, first), len(key)]


ASKED = "slab long, segment int, word binary, word_n binary, pair binary, pair_n binary"
KINDS = (("word", ("word_n", "word_level")), ("pair", ("pair_level",)))
SLAB = "ids binary, none binary, held binary, size binary, text binary"


def slabs(base: DataFrame, most: int = 6_000_000) -> DataFrame:
    """base: doc_id, held_out, text. One row for documents of ``most`` bytes together: slab and the fields of SLAB."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = pa.Codec("zstd")
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[bytes] = []
        size = 0

        def flush() -> pd.DataFrame:
            ids, none, out = (np.concatenate(x).tobytes() for x in zip(*held, strict=True))
            row = {"ids": ids, "none": none, "held": out, "size": np.array([len(t) for t in texts], dtype=np.int64).tobytes(), "text": codec.compress(b"".join(texts), asbytes=True)}
            held.clear()
            texts.clear()
            return pd.DataFrame({k: [v] for k, v in row.items()})

        for b in batches:
            ids, none, out = b["id"].to_numpy(dtype=np.int64), b["none"].to_numpy(dtype=bool), b["held_out"].to_numpy(dtype=bool)
            at = 0
            for i, text in enumerate(b["text"]):
                texts.append((text or "").encode("utf-8", "replace"))
                size += len(texts[-1]) + 1
                if size >= most or i == len(b) - 1:
                    held.append((ids[at : i + 1], none[at : i + 1], out[at : i + 1]))
                    at = i + 1
                if size >= most:
                    yield flush()
                    size = 0
        if texts:
            yield flush()

    rows = base.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), "held_out", "text")
    return rows.mapInPandas(run, SLAB).select(F.monotonically_increasing_id().alias("slab"), "*")


class Slab:
    """The documents of a slab and their distinct n-grams, in order of hash."""

    def __init__(self, size: bytes, text: bytes):
        length = np.frombuffer(size, dtype=np.int64)
        raw = pa.Codec("zstd").decompress(text, decompressed_size=int(length.sum()), asbytes=True) if length.sum() else b""
        end = np.cumsum(length)
        docs = [token_hashes(raw[e - n : e]) for n, e in zip(length.tolist(), end.tolist(), strict=True)]
        self.size = np.array([len(d) for d in docs])
        self.starts = np.cumsum(self.size) - self.size
        tokens = np.concatenate(docs)
        self.words, self.word_at = np.unique(tokens, return_inverse=True)
        self.pairs, self.pair_at = np.unique(pair_hashes(tokens), return_inverse=True)


def asked(packed: DataFrame, segments: int) -> DataFrame:
    """slab, segment, and the slab's words and pairs of that segment with their counts in training documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for slab, held, size, text in zip(b["slab"], b["held"], b["size"], b["text"], strict=True):
                s = Slab(size, text)
                trains = np.repeat(~np.frombuffer(held, dtype=bool), s.size)
                row: dict[str, list] = {}
                for name, key, at in (("word", s.words, s.word_at), ("pair", s.pairs, s.pair_at)):
                    n = np.bincount(at[trains], minlength=len(key)).astype(np.uint32)
                    cut = segment_starts(key, segments)
                    for field, values in ((name, key), (f"{name}_n", n)):
                        row[field] = [values[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
                out = pd.DataFrame({"slab": slab, "segment": np.arange(segments, dtype=np.int32), **row})
                yield out[(out["word"].str.len() + out["pair"].str.len()) > 0]

    return packed.select("slab", "held", "size", "text").mapInPandas(run, ASKED)


def answered(rows: DataFrame, bits_per_entry: int = 10) -> DataFrame:
    """For each row of ``asked`` slab, segment, exact counts of its words, levels of its words and of its pairs. A row
    without a slab has the segment's training tokens, distinct words, and tokens of pairs that stand again."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        keys, counts, backs, cuts = zip(*merged(t).values(), strict=True)
        f = LogFilter(np.concatenate(keys), np.concatenate(counts), bits_per_entry)
        exact = counts[0][backs[0]]
        word, pair = (f.found(k).astype(np.uint8)[b] for k, b in zip(keys, backs, strict=True))
        columns = {"word_n": (exact, cuts[0]), "word_level": (word, cuts[0]), "pair_level": (pair, cuts[1])}
        out = pd.DataFrame({"slab": t["slab"].astype("Int64"), "segment": t["segment"], **{k: [v[i:j].tobytes() for i, j in zip(c[:-1], c[1:], strict=True)] for k, (v, c) in columns.items()}})
        again = counts[1][counts[1] > LEAST]
        sums = pd.DataFrame({"slab": pd.array([None], dtype="Int64"), "segment": t["segment"].iloc[:1].to_numpy(), "total": counts[0].sum(), "distinct": (counts[0] > 0).sum(), "again": again.sum()})
        return pd.concat([out, sums], ignore_index=True).astype({"total": "Int64", "distinct": "Int64", "again": "Int64"}).replace({np.nan: None})

    return rows.groupBy("segment").applyInPandas(run, "slab long, segment int, word_n binary, word_level binary, pair_level binary, total long, distinct long, again long")


def merged(t: pd.DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For words and pairs of rows of ``asked``: distinct keys in order, their counts added up, the place of every
    row's keys among them, and where each row begins in those places."""
    out = {}
    for name, _ in KINDS:
        keys, counts = b"".join(t[name]), b"".join(t[f"{name}_n"])  # a slab's counts have four bytes, those of a block eight
        key, back = np.unique(np.frombuffer(keys, dtype=np.uint64), return_inverse=True)
        n = np.bincount(back, weights=np.frombuffer(counts, dtype=np.int64 if len(counts) == len(keys) else np.uint32), minlength=len(key)).astype(np.int64)
        out[name] = key, n, back, np.r_[0, np.cumsum(t[name].str.len().to_numpy() // 8)].astype(np.int64)
    return out


def dealt_on(rows: DataFrame, fan: int, segments: int) -> DataFrame:
    """rows: slab, segment (one of ``fan``), block and the fields of ``asked``. The same fields for the rows that each
    block of a coarse segment sends to its own segments; ``slab`` is the block there."""
    each = segments // fan

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("slab")
        coarse = int(t["segment"].iloc[0])
        row: dict[str, list] = {}
        for name, (key, n, _, _) in merged(t).items():
            edge = (np.arange(1, each, dtype=np.uint64) + np.uint64(coarse * each)) << np.uint64(65 - segments.bit_length())
            cut = np.r_[0, np.searchsorted(key, edge), len(key)]
            for field, values in ((name, key), (f"{name}_n", n)):
                row[field] = [values[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
        out = pd.DataFrame({"slab": t["block"].iloc[0], "segment": np.arange(coarse * each, (coarse + 1) * each, dtype=np.int32), **row})
        return out[(out["word"].str.len() + out["pair"].str.len()) > 0]

    return rows.groupBy("segment", "block").applyInPandas(run, ASKED)


def handed_back(rows: DataFrame, answers: DataFrame, fan: int, segments: int) -> DataFrame:
    """The answers of ``answered`` to the blocks of ``dealt_on``, as answers to the slabs in them."""
    each = segments // fan

    def run(t: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        t, answer = t.sort_values("slab"), answer.sort_values("fine")
        out: dict[str, list] = {"slab": t["slab"], "segment": t["segment"]}
        of = merged(t)
        for name, fields in KINDS:
            _, _, back, cut = of[name]
            for field in fields:
                values = np.frombuffer(b"".join(answer[field]), dtype=np.int64 if field == "word_n" else np.uint8)[back]
                out[field] = [values[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
        return pd.DataFrame(out)

    replies = answers.where("slab is not null").select(F.floor(F.col("segment") / each).cast("int").alias("segment"), F.col("slab").alias("block"), F.col("segment").alias("fine"), "word_n", "word_level", "pair_level")
    return rows.groupBy("segment", "block").cogroup(replies.groupBy("segment", "block")).applyInPandas(run, "slab long, segment int, word_n binary, word_level binary, pair_level binary")


def ranges_of(slabs: int, partitions: int) -> int:
    """Some segments for each partition, so that partitions fill evenly, and more where the corpus is large, so that a
    segment has the n-grams of about four slabs at most. A power of two; a segment holds whole shards of the filter, so
    the number never changes a result."""
    return min(1 << SHARD, 1 << (max(2, 4 * partitions, slabs // 4) - 1).bit_length())


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_out: int = 2, weight: float | None = None, bits_per_entry: int = 10, fan: int = 4096) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    ``weight`` of the pairs against the words: by default the share of pairs that would still be in the filter with one
    of their places left out, which is what an unseen text may expect. ``fan``, a power of two of 2 and more: the rows
    that a slab sends at most; results do not depend on it.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = base.withColumn("held_out", F.coalesce(remainder("doc_id", folds) == held_out, F.lit(False)))
    packed = stored(slabs(base), "slabs")
    count = packed.count()
    segments = ranges_of(count, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = asked(packed, min(fan, segments))
    if segments <= fan:
        answers = replies = stored(answered(rows, bits_per_entry), "answers")
    else:
        blocks = -(-count * fan // segments)
        rows = stored(rows.withColumn("block", F.pmod(F.xxhash64("slab"), F.lit(blocks))), "asked")
        answers = stored(answered(dealt_on(rows, fan, segments), bits_per_entry), "answers")
        replies = handed_back(rows, answers, fan, segments)
    total, distinct, again = answers.where("slab is null").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("total", "distinct", "again")]).first()
    if weight is None:
        weight = min(0.9, max(0.01, again / max(1, total)))
    room = float(total + distinct + 1)

    def run(slab: pd.DataFrame, answer: pd.DataFrame) -> pd.DataFrame:
        of = slab.iloc[0]
        s = Slab(of["size"], of["text"])
        answer = answer.sort_values("segment")
        exact = np.frombuffer(b"".join(answer["word_n"]), dtype=np.int64)
        level = {k: np.frombuffer(b"".join(answer[f"{k}_level"]), dtype=np.uint8).astype(np.float64) for k in ("word", "pair")}
        word_count, pair_count = (np.where(level[k] >= LEAST, middle(level[k]), 0.0) for k in ("word", "pair"))
        before = np.r_[np.searchsorted(s.words, END), s.word_at[:-1]]  # a document's first word follows an end
        p1 = (word_count[s.word_at] + 1) / room
        p2 = np.minimum(pair_count[s.pair_at] / (word_count[before] + 1), 1.0)
        score = np.add.reduceat(np.log10(weight * p2 + (1 - weight) * p1), s.starts)
        base_score = np.add.reduceat(np.log10((exact + 1) / room)[s.word_at], s.starts)
        n_known = np.add.reduceat((exact > 0)[s.word_at].astype(np.int64), s.starts)
        return pd.DataFrame({"id": np.frombuffer(of["ids"], dtype=np.int64), "none": np.frombuffer(of["none"], dtype=bool), "held_out": np.frombuffer(of["held"], dtype=bool), "n_tokens": s.size, "n_known": n_known, "base_score": base_score, "score": score})

    replies = replies.where("slab is not null").select("slab", "segment", "word_n", "word_level", "pair_level")
    out = packed.groupBy("slab").cogroup(replies.groupBy("slab")).applyInPandas(run, "id long, none boolean, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
