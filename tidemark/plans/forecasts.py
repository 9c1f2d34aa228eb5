"""Queries that train and score models on the given tables; SQL has no twin for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..forecast import models, seasonal
from ..forecast.recurrent import Recurrent
from ..operators import evaluate
from ..operators import windows as W
from ..sources.shared import stored
from ..spec import SeriesSpec
from .base import query, rounded, table

DAILY = SeriesSpec(("o_orderpriority",), "ds")


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value by priority and day: five daily series over years."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("ds")).agg(F.sum("o_totalprice").alias("y"))


@query()
def boosted_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of boosted trees by split, on features of earlier days only."""
    frame, made = models.enhanced_features(_daily(spark, sf_dir), DAILY, "y")
    split = stored(W.chronological_split(frame, DAILY).withColumn("check", F.col("split") == "val"))  # read once a tree
    model = models.boosted(made, "y", validation="check", trees=20, depth=4).fit(split.where("split <> 'test'"))
    return evaluate.regression(models.predictions(model, split, made), ["split"], "y", "prediction")


@query()
def step_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a three-step forecast by step on the last 15 %, from the seven days before."""
    m = models.StepRegression(7, 3)
    split = W.chronological_split(m.frame(_daily(spark, sf_dir), DAILY, ["y"], "y"), DAILY)
    out = m.fit(split.where("split = 'train'")).transform(split.where("split = 'test'"))
    steps = out.select(F.posexplode(F.arrays_zip("y", "predictions")).alias("step", "z")).select("step", F.col("z.y").alias("y_true"), F.col("z.predictions").alias("y_pred"))
    return evaluate.regression(steps, ["step"])


@query()
def fine_tuned_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors on the last 15 % of one priority of a forecaster that has learned the others, before and after it is tuned."""
    m = models.StepRegression(7, 3)
    split = W.chronological_split(m.frame(_daily(spark, sf_dir), DAILY, ["y"], "y"), DAILY)
    learn = split.where("split = 'train'")
    new = F.col("o_orderpriority").startswith("1")
    tuned = models.fine_tuned(m.fit(learn.where(~new)), learn.where(~new), learn.where(new))
    test = split.where(new & (F.col("split") == "test"))
    out = [f.transform(test).select(F.lit(name).alias("model_name"), F.posexplode(F.arrays_zip("y", "predictions")).alias("step", "z")) for name, f in (("base", m), ("tuned", tuned))]
    return evaluate.comparison(out[0].unionByName(out[1]).select("model_name", F.col("z.y").alias("y_true"), F.col("z.predictions").alias("y_pred")))


@query()
def seasonal_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History and thirty days ahead of each series."""
    return rounded(models.seasonal(_daily(spark, sf_dir), ["o_orderpriority"], 30), ["yhat", "yhat_lower", "yhat_upper"], 2)


@query()
def seasonal_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the last tenth of each series, fitted on the first eight, and the share its intervals cover."""
    return rounded(seasonal.held_out_errors(_daily(spark, sf_dir), ["o_orderpriority"]), places=3)


def _errors(samples: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in samples.items():
        e = df.select(F.lit(name).alias("model_name"), F.posexplode(F.arrays_zip("y", "predictions")).alias("step", "z"))
        out = e if out is None else out.unionByName(e)
    return rounded(evaluate.comparison(out.select("model_name", F.col("z.y").alias("y_true"), F.col("z.predictions").alias("y_pred"))), places=3)


@query()
def recurrent_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors on the last 15 % of a recurrent forecaster of all series but one, of that one before and after tuning on its
    own rows, which come under another name."""
    m = Recurrent(("y",), "y", 7, 3, hidden=6)
    split = stored(W.chronological_split(_daily(spark, sf_dir), DAILY))
    new = F.col("o_orderpriority").startswith("1")
    train = split.where("split = 'train'")
    base = m.scaled_by(train.where(~new))
    base = base.fit(stored(base.frame(train.where(~new), DAILY).select("x", "y")), 25)
    own = train.where(new).withColumnRenamed("y", "value")
    tuned = base.tuned(own, DAILY, {"y": "value"}, 8)
    test = split.where("split = 'test'")
    return _errors({
        "others": base.transform(base.frame(test.where(~new), DAILY)),
        "base": base.transform(base.frame(test.where(new), DAILY)),
        "tuned": tuned.transform(tuned.frame(test.where(new).withColumnRenamed("y", "value"), DAILY)),
    })


@query()
def penalised_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``boosted_forecast`` with penalised leaves, stopped by the validation days."""
    frame, made = models.enhanced_features(_daily(spark, sf_dir), DAILY, "y")
    split = stored(W.chronological_split(frame, DAILY).withColumn("check", F.col("split") == "val"))
    m = models.build("penalised", made, trees=8, depth=3, rate=0.2, l1=1.0, l2=5.0, bins=32, patience=3).fit(split.where("split <> 'test'"), "y", "check")
    return rounded(evaluate.regression(m.transform(split), ["split"], "y", "prediction"), places=3)
