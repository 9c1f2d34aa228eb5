"""What the operators share: the folder that all executors see, written tables, filters, and components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only where no cluster names a shared folder (tests, one machine).
_OWN_FOLDER: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN_FOLDER:
            _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
        base = _OWN_FOLDER[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, lost executors cost nothing.

    ``by`` names a column of few values; a filter on it then reads that part alone. ``options`` go to the writer.
    """
    path = shared_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int = 200_000) -> DataFrame:
    """Marked for a broadcast if it has at most that many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus`` (the folds of the labelled operators)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def _probes(key: Column, bits: int, hashes: int = 3) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(bits)) for k in range(hashes)]


def bloom_words(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """The Bloom filter of a column as ``bits / 64`` words; tasks OR them before anything is sent."""
    at = keys.select(F.explode(F.array(*_probes(F.col(key), bits))).alias("at"))
    one = at.groupBy((F.col("at") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set"))
    words = np.zeros(bits // 64, dtype=np.int64)
    got = one.toPandas()
    words[got["word"].to_numpy(dtype=np.int64)] = got["set"].to_numpy(dtype=np.int64)
    return words


def passing(rows: DataFrame, key: Column, words: np.ndarray, bits: int, passes: bool = True) -> DataFrame:
    """Rows whose key may be in the filter or, with ``passes`` off, the others; a null key is among the others."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def probe(h0: pd.Series, h1: pd.Series, h2: pd.Series) -> pd.Series:
        w = shared.value
        hit = np.ones(len(h0), dtype=bool)
        for h in (h0, h1, h2):
            a = h.to_numpy(dtype=np.int64)
            hit &= (w[a >> 6] >> (a & 63)) & 1 == 1
        return pd.Series(hit)

    found = key.isNotNull() & probe(*_probes(key, bits))
    return rows.where(found if passes else ~found)


def bits_for(keys: int, most_bits: int, each: int = 12) -> int:
    """Bits of a filter of that many keys, a power of two; 0 if it would need more than ``most_bits``."""
    bits = 1 << max(16, (keys * each - 1).bit_length())
    return bits if bits <= most_bits else 0


def parted(rows: DataFrame, key: Column, keys: DataFrame, name: str, most_bits: int = 1 << 28) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in ``keys``, all others). Only the first need a shuffle to meet ``keys``. The filter is
    as large as ``keys`` needs; where that is more than ``most_bits``, which is all that is ever gathered and
    broadcast, all rows are in the first part, and a join does without it."""
    bits = bits_for(keys.count(), most_bits)
    if not bits:
        return rows, rows.limit(0)
    words = bloom_words(keys, name, bits)
    return passing(rows, key, words, bits), passing(rows, key, words, bits, passes=False)


def without(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """The rows whose key is not in ``keys``. Rows with a null key stay."""
    keys = stored(keys.select(F.col(name).alias("__tidemark_key")), "keys")
    some, rest = parted(rows, key, keys, "__tidemark_key")
    return rest.unionByName(some.join(keys, key == F.col("__tidemark_key"), "left_anti"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    ``edges`` has two long columns a and b. Alternates the large-star and small-star steps of Kiveris et al.
    (2014), which end after O(log n) rounds; each is two joins on plain shuffles, so a hub is split by adaptive
    skew handling. Every round is written to the shared folder. Null or equal ends are dropped.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = stored(e, "edges")
    before = None
    for _ in range(rounds):
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(small_least, "hi")
        small = joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(small_least.select("hi", F.col("m").alias("lo")))
        e = stored(small.where("hi <> lo").distinct(), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components: no end after {rounds} rounds")
    out = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return out.unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
