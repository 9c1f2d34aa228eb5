"""Best-fit packing with certified bin counts.

Texts become ids by a public tokenizer, end with one more id, and only those longer than a sequence are cut. Full
pieces are sequences of their own. The other pieces, one a document, are dealt into partitions by a row number, so
repeated rows part ways. A partition holds some thousands of pieces and never less than ``part_bins`` sequences of
tokens, and is packed by best-fit decreasing. Dual-feasible functions give a lower bound on its bins. A partition
that meets its bound keeps all but its emptiest bin; one with a gap also gives up its emptiest bins, in proportion to
the gap, but half its bins at most. What was given up is exchanged: it is dealt into fewer partitions and packed
again, until one is left. Each turn settles at least half of the tokens of a partition of several bins, and a turn
has fewer partitions than the one before, so the turns end whatever the lengths are.

Defined results: a null or empty text is the end id alone. Repeated rows and null ids are packed like any others. An
empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

VOCABULARY = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """A tokenizer file of the kind "lower case, split, byte-level BPE with word ends".

    No pre-token of such a file spans white space. Latin text is cut at white space, and each piece is looked up in a
    table of at most ``remembered`` entries (or the pieces of one text); a new piece is split into pre-tokens, which
    the file's own BPE model encodes, and which have a table of that size too. Any other text goes through the whole
    tokenizer.
    """

    def __init__(self, path: str, remembered: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.model, self.remembered = Tokenizer.from_file(path), None, remembered
        self.between_spaces: dict[str, bytes] = {}
        self.pre_tokens: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x.get("type") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        norms = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if steps == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"] and spec["pre_tokenizer"]["pretokenizers"][0]["invert"]:
            self.model = self.tokenizer.model
            self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
            # Latin characters for which lower-casing and composing are the same one by one, and no special token.
            self.plain = regex.compile(r"[\t\n\r -~\xA1-\xAC\xAE-įı-ɏ]*+").fullmatch
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.bytes_shown = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _learn(self, between: list[str]) -> None:
        table, known, tokenize = self.between_spaces, self.pre_tokens, self.model.tokenize
        for full in (table, known):
            if len(full) > self.remembered:
                full.clear()
        for x in between:
            if x in table:
                continue
            ids = []
            for word in self.split(x):
                own = known.get(word)
                if own is None:
                    shown = word.encode().decode("latin-1").translate(self.bytes_shown)
                    own = known[word] = np.array([t.id for t in tokenize(shown)], dtype="<u4").tobytes()
                ids.append(own)
            table[x] = b"".join(ids)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.model is None or "<|" in text or not self.plain(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        between = text.lower().split()
        try:
            return b"".join(map(self.between_spaces.__getitem__, between))
        except KeyError:
            self._learn(between)
            return b"".join(map(self.between_spaces.__getitem__, between))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut at ``capacity``."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = tokenizer(path)
        for b in batches:
            out = []
            for row, text in enumerate(b["text"]):
                ids = tok.ids(text) + end
                out += [(row, at // (4 * capacity), at // 4, (min(len(ids), at + 4 * capacity) - at) // 4, zlib.crc32(ids[at : at + 4 * capacity])) for at in range(0, len(ids), 4 * capacity)]
            t = pd.DataFrame(out, columns=["row", "piece", "start", "length", "ids_crc32"])
            yield t.assign(doc_id=b["doc_id"].to_numpy()[t["row"]] if len(b) else [])[["doc_id", "piece", "start", "length", "ids_crc32"]]

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(run, PIECES)


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Bins that no packing can do without: the best of two families of dual-feasible functions."""
    x, n = lengths.astype(np.int64), counts.astype(np.int64)
    best = -(-int((x * n).sum()) // capacity)
    for k in range(1, 21):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, k * x, (scaled // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    for least in range(1, capacity // 2 + 1, max(1, capacity // 128)):
        value = np.where(x > capacity - least, capacity, np.where(x < least, 0, x))
        best = max(best, -(-int((value * n).sum()) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """The bin of each item, and the bins' free room."""
    bins, room, open_, mask = np.empty(len(lengths), dtype=np.int64), [], [[] for _ in range(capacity + 1)], 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = mask >> size  # bit r: some bin has r tokens of room
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            b = open_[r].pop()
            if not open_[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        r -= size
        bins[i], room[b] = b, r
        if not open_[r]:
            mask |= 1 << r
        open_[r].append(b)
    return bins, room


def _pack_round(items: DataFrame, capacity: int, last: bool, turn: int) -> DataFrame:
    """items with part; adds sequence_id, offset and given_up."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["length", "row"], ascending=[False, True], kind="stable", ignore_index=True)
        lengths = t["length"].to_numpy()
        bins, room = best_fit_decreasing(lengths, capacity)
        sizes, counts = np.unique(lengths, return_counts=True)
        gap = len(room) - lower_bound(sizes, counts, capacity)
        emptiest = np.argsort(-np.array(room), kind="stable")[: max(1, min(4 * gap + 1, len(room) // 2))]
        given = np.zeros(len(room), dtype=bool)
        given[[b for b in emptiest if room[b] > 0]] = not last
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        offset = np.empty(len(t), dtype=np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        part = int(t["part"].iloc[0])
        return t.assign(sequence_id=(turn << 56) | (part << 24) | bins, offset=offset, given_up=given[bins])

    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, part long, sequence_id long, offset long, given_up boolean"
    return items.groupBy("part").applyInPandas(run, schema)


def pack(cut: DataFrame, capacity: int = 4096, part_rows: int = 4096, part_bins: int = 64) -> DataFrame:
    """cut: the columns of ``pieces``. Adds sequence_id and offset.

    A partition has about ``part_rows`` pieces, or ``part_bins * capacity`` tokens where that many pieces are shorter;
    a piece has a token at least, so no partition is much larger than ``part_bins * capacity`` pieces.
    """
    cut = stored(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    waiting = cut.where(F.col("length") < capacity)
    parts, turn, done = None, 0, full
    while True:
        rows, tokens = waiting.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if not rows:
            break
        needed = max(1, -(-min(rows * part_bins * capacity, tokens * part_rows) // (part_rows * part_bins * capacity)))
        parts = needed if parts is None else min(needed, parts - 1)
        last = parts == 1
        dealt = waiting.withColumn("part", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)))
        packed_ = stored(_pack_round(dealt, capacity, last, turn), "packed")
        done = done.unionByName(packed_.where("not given_up").drop("part", "given_up"))
        if last:
            break
        waiting, turn = packed_.where("given_up").select(*cut.columns), turn + 1
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packed(docs: DataFrame, capacity: int = 4096, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, capacity=capacity, **options), capacity)
