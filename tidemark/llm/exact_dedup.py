"""Exact dedup by a log-structured merge index.

1. *Memtables.* Every task keeps a table digest -> ids in memory. At ``memtable_rows`` documents it flushes a run:
   entries sorted by digest, each with its smallest id and its ids. The file of a run carries a Bloom filter of its
   digests, so that a lookup of few digests (``lookup``) skips the runs that cannot hold them.
2. *Compaction.* All runs are merged by digest; the smallest id and the sum of counts stay. A run holds a digest
   once, so a text that fills a third of the corpus arrives as one row a run.
3. *Filter.* The compacted digests with more than one document fill a Bloom filter, sized by their number. Entries and
   texts that it does not hold are single and are not shuffled again. It is the only thing broadcast; where it would
   need more than ``filter_bits`` bits there is none: that costs shuffle, never rows.
4. *Byte verification.* Documents that pass the filter and the index are grouped by digest and by their bytes; copies
   in one partition are one text before they are shuffled. A digest with one byte string is confirmed; the documents of
   a colliding digest are told apart by their bytes.

Defined results: a null text counts as empty, and all empty texts are one group. Equal ids (repeated rows) count as
separate documents of a group; rows that carry the smallest id are all kept. An empty table gives no rows. Columns
other than the two that are named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parted, stored, without

SPACES = r"[\x20\x09-\x0D]+"
RUN_SCHEMA = "run long, digest long, sha string, min_id long, n long, ids array<long>"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digest(sha: Column) -> Column:
    """The index key: the first 60 bits of the hexadecimal SHA-256."""
    return F.conv(F.substring(sha, 1, 15), 16, 10).cast("long")


def flush_runs(docs: DataFrame, memtable_rows: int) -> DataFrame:
    """docs: id, digest, sha. Sorted runs, one row for a digest and run."""

    def memtables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seq, waiting, rows = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pd.DataFrame:
            t = pd.concat(waiting).sort_values(["digest", "id"], kind="stable")
            d, ids = t["digest"].to_numpy(), t["id"].to_numpy()
            starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            return pd.DataFrame({"run": (part << 32) | seq, "digest": d[starts], "sha": t["sha"].to_numpy()[starts], "min_id": ids[starts], "n": np.diff(np.r_[starts, len(d)]), "ids": np.split(ids, starts[1:])})

        for batch in batches:
            while len(batch):
                take = batch.iloc[: memtable_rows - rows]
                waiting.append(take)
                rows, batch = rows + len(take), batch.iloc[len(take) :]
                if rows == memtable_rows:
                    yield flush()
                    seq, waiting, rows = seq + 1, [], 0
        if rows:
            yield flush()

    return docs.mapInPandas(memtables, RUN_SCHEMA)


def compact(runs: DataFrame) -> DataFrame:
    """One entry for a digest: keep_id, group_size."""
    return runs.groupBy("digest").agg(F.min("min_id").alias("keep_id"), F.sum("n").alias("group_size"))


def lookup(runs: DataFrame, digests: list[int]) -> DataFrame:
    """The entries of a few digests; files whose filter holds none of them are not read."""
    return runs.where(F.col("digest").isin(digests))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = 65_536, filter_bits: int = 1 << 28, key=digest) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``key`` maps the hexadecimal SHA-256 to the long under which the index files a text; only its collisions
    depend on it. Documents with a null id have no place in the index and form a group of their own each.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm"))
    base = base.withColumn("sha", F.sha2("norm", 256)).withColumn("digest", key(F.col("sha")))
    filed = base.where("id is not null")
    filters = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(memtable_rows)}
    runs = stored(flush_runs(filed.select("id", "digest", "sha"), memtable_rows), "runs", **filters)
    index = stored(compact(runs.select("digest", "min_id", "n")).where("group_size > 1"), "index")

    hits, _ = parted(filed, F.col("digest"), index, "digest", filter_bits)
    verified = hits.select("digest", "norm").distinct()
    several = verified.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1")
    collided = stored(several.select("digest"), "collided")

    # Entries of a digest that repeats meet the index in few columns, a row a run; then their ids follow, by run and
    # digest, which deals a hot digest out. All other entries are single documents.
    again, single = parted(runs, F.col("digest"), index, "digest", filter_bits)
    resolved = again.select("run", "digest", "min_id").join(index, "digest", "left").select("run", "digest", F.coalesce("keep_id", "min_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    placed = again.select("run", "digest", "sha", "ids").join(resolved, ["run", "digest"]).select("digest", "sha", "ids", "keep_id", "group_size")
    clean = placed.unionByName(single.select("digest", "sha", "ids", F.col("min_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")))
    collisions = not collided.isEmpty()
    if collisions:
        clean = clean.join(collided, "digest", "left_anti")
    out = clean.select(F.explode("ids").alias("id"), "sha", "keep_id", "group_size")
    if collisions:
        apart = filed.join(collided, "digest", "left_semi")
        same_bytes = apart.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        out = out.unionByName(apart.join(same_bytes, ["digest", "norm"]).select("id", "sha", "keep_id", "group_size"))
    lone = base.where("id is null").select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    out = out.unionByName(lone)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns. Repeated rows of a kept id all stay."""
    dropped = exact_duplicates(docs, id_col, text_col, **options).where("not kept").select("doc_id").distinct()
    return without(docs, F.col(id_col).cast("long"), dropped, "doc_id")
