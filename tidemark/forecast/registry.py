"""Versions of fitted models: the artefact beside a row of metadata."""

from __future__ import annotations

import datetime
import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, version string, trained_at timestamp, path string, features array<string>, hyperparameters string, metrics string"
REQUIRED = ("version", "features", "metrics")


def save(spark: SparkSession, root: str, name: str, version: str, model: PipelineModel, features: list[str], metrics: dict, hyperparameters: dict | None = None, trained_at: datetime.datetime | None = None) -> None:
    """A version that exists is an error: artefacts are never overwritten. The metadata row is written last."""
    path = f"{root}/artefacts/{name}/{version}"
    model.save(path)
    row = (name, version, trained_at or datetime.datetime.now(datetime.UTC).replace(tzinfo=None), path, sorted(features), json.dumps(hyperparameters or {}), json.dumps(metrics))
    spark.createDataFrame([row], SCHEMA).write.mode("append").parquet(f"{root}/metadata")


def versions(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{root}/metadata")


def latest(spark: SparkSession, root: str, name: str) -> tuple[PipelineModel, dict]:
    best = versions(spark, root).where(F.col("name") == name).groupBy("name").agg(F.max_by(F.struct("version", "path", "features", "metrics", "hyperparameters"), F.struct("trained_at", "version")).alias("m")).select("m.*").first()
    if best is None:
        raise LookupError(f"no version of {name}")
    found = best.asDict(recursive=True)
    missing = [k for k in REQUIRED if not found.get(k)]
    if missing:
        raise ValueError(f"metadata of {name} lacks {missing}")
    return PipelineModel.load(found["path"]), found
