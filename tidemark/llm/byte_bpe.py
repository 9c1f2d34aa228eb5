"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks of ``chunk`` characters that overlap; most texts are one chunk. Tasks pre-tokenise the chunks
side by side. The pattern looks at nothing before a pre-token and at no more than ``LOOK`` characters behind it, so
two neighbours that both end a pre-token at one place of their overlap agree on all that follows: there the text is
cut again. The pieces between such places are pre-tokenised, each pre-token is encoded by itself (a bounded table
remembers the frequent ones), and the ids of a document are joined in order. Where an overlap has no such place, a
pre-token spans all of it; only the chunks up to the next such place are put together, and a text is in one task only
if it is one pre-token. Decoding joins the raw bytes of the ids.

Defined results: a null text counts as empty and has no ids. Every row is encoded on its own, repeated rows and null
ids too. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, stored

RANKS = "byte_bpe_multi_50k.tiktoken"
_ENCODINGS: dict[tuple[str, str], tiktoken.Encoding] = {}
_BYTES: dict[str, dict[int, bytes]] = {}
_PIECES: dict[tuple[str, str], PieceEncoder] = {}
ROWS = 500  # documents that a task holds as ids at once
LOOK = 8  # characters behind a pre-token that may decide where it ends


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """One encoder for each worker process."""
    if (path, pattern) not in _ENCODINGS:
        _ENCODINGS[path, pattern] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})
    return _ENCODINGS[path, pattern]


class PieceEncoder:
    """Encodes text pre-token by pre-token; a table of at most ``remembered`` of them (or those of one text)."""

    def __init__(self, path: str, pattern: str, remembered: int = 300_000):
        self.encode, self.split, self.remembered = encoding(path, pattern).encode_ordinary, regex.compile(pattern), remembered
        self.table: dict[str, bytes] = {}

    def pre_tokens(self, text: str) -> list[str]:
        return self.split.findall(text) if not self.split.groups else [m[0] for m in self.split.finditer(text)]

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        words, table = self.pre_tokens(text), self.table
        try:
            return b"".join(map(table.__getitem__, words))
        except KeyError:
            if len(table) > self.remembered:
                table.clear()
            for w in words:
                if w not in table:
                    table[w] = np.array(self.encode(w), dtype="<u4").tobytes()
            return b"".join(map(table.__getitem__, words))

    def ends(self, text: str) -> np.ndarray:
        """Where pre-tokens end, but for places that text behind the chunk could still move."""
        at = np.cumsum(np.fromiter(map(len, self.pre_tokens(text)), dtype=np.int64))
        return at[at <= len(text) - LOOK]


def piece_encoder(path: str, pattern: str) -> PieceEncoder:
    """One for each worker process."""
    if (path, pattern) not in _PIECES:
        _PIECES[path, pattern] = PieceEncoder(path, pattern)
    return _PIECES[path, pattern]


def _encode_pieces(texts: DataFrame, columns: str, path: str, pattern: str) -> DataFrame:
    """columns and text; the text becomes its ids."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = piece_encoder(path, pattern)
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                b = whole.iloc[at : at + ROWS]
                yield b[names].assign(ids=[own.ids(t) for t in b["text"]])

    return texts.select(*names, "text").mapInPandas(run, f"{columns}, ids binary")


def _encode_long(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    cut = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("chunks", F.ceil(F.char_length("text") / chunk).cast("int"))
    cut = cut.select("row", "doc_id", "chunks", "text", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("k"))
    cut = cut.select("row", "doc_id", "chunks", "k", F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("text"))

    def pretokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = piece_encoder(path, pattern)
        for b in batches:
            ends = [own.ends(t) for t in b["text"]]
            at = b["k"].to_numpy() * chunk
            heads, tails = ([p[near(p)] + a for p, a in zip(ends, at, strict=True)] for near in (lambda p: p < overlap, lambda p: p > chunk))
            yield b[["row", "k"]].assign(heads=heads, tails=tails)

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = stored(cut.repartition(n, "row", "k"), "chunks")
    # Only the few places of a chunk meet in the order of their text, never the chunks themselves.
    ends = chunks.select("row", "k", "text").mapInPandas(pretokenise, "row long, k int, heads array<long>, tails array<long>")
    in_order = Window.partitionBy("row").orderBy("k")
    places = stored(ends, "ends").withColumn("end", F.array_min(F.array_intersect("tails", F.lead("heads").over(in_order))))
    places = places.withColumn("begin", F.lag("end").over(in_order))
    places = places.withColumn("stretch", F.count("begin").over(in_order)).withColumn("alone", F.count("*").over(Window.partitionBy("row", "stretch")) == 1)
    placed = chunks.join(few(stored(places.select("row", "k", "begin", "end", "stretch", "alone"), "places")), ["row", "k"])
    start, first = F.col("k") * chunk, F.coalesce("begin", F.col("k") * chunk)
    own = placed.withColumn("text", F.substring("text", (first - start + 1).cast("int"), F.coalesce(F.col("end") - first, F.when(F.col("k") < F.col("chunks") - 1, start + chunk - first).otherwise(F.char_length("text"))).cast("int")))
    alone = own.where("alone").select("row", "doc_id", "stretch", "text")
    together = own.where("not alone").groupBy("row", "stretch").agg(F.first("doc_id").alias("doc_id"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "").alias("text"))
    pieces = _encode_pieces(alone.unionByName(together), "row long, doc_id long, stretch long", path, pattern)
    ids = F.sort_array(F.collect_list(F.struct("stretch", "ids")))
    # By way of hexadecimal text, which Spark joins in one go.
    whole = F.unhex(F.array_join(F.transform(ids, lambda x: F.hex(x["ids"])), ""))
    return pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), whole.alias("ids")).select("doc_id", "ids")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str = public_tokenizers.PATTERN, chunk: int = 32_768, overlap: int = 1024) -> DataFrame:
    """doc_id, ids: the ids as little-endian unsigned 32-bit integers."""
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be shorter than the chunk")
    path = ranks or public_tokenizers.path(RANKS)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short, long = base.where(F.char_length("text") <= chunk), base.where(F.char_length("text") > chunk)
    return _encode_pieces(short, "doc_id long", path, pattern).unionByName(_encode_long(long, path, pattern, chunk, overlap))


def decode(encoded: DataFrame, ranks: str | None = None) -> DataFrame:
    """Adds decoded: the raw bytes of the ids, joined."""
    path = ranks or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _BYTES:
            _BYTES[path] = {i: b for b, i in ranks_of(path).items()}
        table = _BYTES[path]
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                b = whole.iloc[at : at + ROWS]
                yield b.assign(decoded=[b"".join(map(table.__getitem__, np.frombuffer(i, dtype="<u4").tolist())) for i in b["ids"]])

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = decode(encode(docs, **options), options.get("ranks"))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
