"""Latest / last-N / per-key questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_n(df: DataFrame, partition: Sequence[str], offset: Sequence[str], n: int) -> DataFrame:
    """The last n rows of each partition. Spark keeps n rows of a partition in each task before the shuffle."""
    w = Window.partitionBy(*partition).orderBy(*[F.desc(c) for c in offset])
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def latest(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by one aggregate: each task sends one row a key, so no key is hot."""
    rest = [c for c in df.columns if c not in by]
    best = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*by, "_r.*").select(*df.columns)


def recent(df: DataFrame, time: Sequence[str], limit: int) -> DataFrame:
    """The true top-k by time."""
    return df.orderBy(*[F.desc(c) for c in time]).limit(limit)


def station_view(sources: dict[str, DataFrame], key: str, partition: str, offset: str, per_partition: int = 10) -> DataFrame:
    """For each key its newest records of each source, newest first, from the last records of each partition.

    sources: name -> rows of key, partition, offset and a payload text. What meets in a row is bounded by the limit.
    """
    tagged = [last_n(df.select(key, partition, offset, "payload"), [partition], [offset], per_partition).withColumn("_source", F.lit(name)) for name, df in sources.items()]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    lists = [F.transform(F.sort_array(F.collect_list(F.when(F.col("_source") == name, F.struct(offset, "payload"))), asc=False), lambda x: x["payload"]).alias(name) for name in sources]
    return both.groupBy(key).agg(*lists)


def serving_summary(features: DataFrame, predictions: DataFrame, key: str, flag: str) -> DataFrame:
    """One row: distinct keys over both, predictions, anomalies."""
    keys = features.select(key).distinct().unionByName(predictions.select(key).distinct()).distinct().agg(F.count("*").alias("stations"))
    counts = predictions.agg(F.count("*").alias("predictions"), F.count_if(F.col(flag)).alias("anomalies"))
    return keys.crossJoin(F.broadcast(counts))  # one row each
