"""Model metrics over long tables of actual and predicted values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import running

EPSILON = 1e-6


def regression(df: DataFrame, by: Sequence[str] = (), actual: str = "y_true", predicted: str = "y_pred", strict_r2: bool = False) -> DataFrame:
    """mae, rmse, mse, mape, mean_error, std_error, r2, n for each group, in one aggregate.

    The absolute percentage leaves out actual values up to 1e-6 and is 0 if none is left. R² has 1e-6 in its
    denominator; ``strict_r2`` has none and gives 0 for constant actual values.
    """
    e = F.col(predicted) - F.col(actual)
    known = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    total = F.var_pop(actual) * F.count("*")
    r2 = F.when(total == 0, 0.0).otherwise(1 - F.try_divide(F.sum(e * e), total)) if strict_r2 else 1 - F.sum(e * e) / (total + EPSILON)
    mape = F.coalesce(F.avg(F.when(F.abs(F.col(actual)) > EPSILON, F.abs(e / F.col(actual)))), F.lit(0.0)) * 100
    return known.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e * e).alias("mse"), mape.alias("mape"), F.avg(e).alias("mean_error"), F.stddev_pop(e).alias("std_error"), r2.alias("r2"), F.count("*").alias("n"))


def comparison(df: DataFrame, model: str = "model_name", **options) -> DataFrame:
    """Models by their errors, best first."""
    return regression(df, [model], **options).orderBy("rmse", "mae", model)


def classification(df: DataFrame, actual: Column, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and the rates made of them; a rate of nothing is 0."""
    t = df.select(*by, actual.cast("boolean").alias("_a"), predicted.cast("boolean").alias("_p"))
    a, p = F.col("_a"), F.col("_p")
    c = t.groupBy(*by).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(~a & ~p).alias("tn"), F.count_if(a & ~p).alias("fn"))

    def rate(top: str, *parts: str) -> Column:
        total = sum((F.col(x) for x in parts[1:]), F.col(parts[0]))
        return F.coalesce(F.try_divide(F.col(top), total), F.lit(0.0))

    out = c.withColumns({"precision": rate("tp", "tp", "fp"), "recall": rate("tp", "tp", "fn"), "specificity": rate("tn", "tn", "fp"), "fpr": rate("fp", "fp", "tn"), "fnr": rate("fn", "fn", "tp")})
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def ranking(df: DataFrame, actual: Column, score: Column, by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC and average precision of a score against 0/1 labels, exact with ties; null without both classes.

    Rows are counted by score first; running counts over ranges of the score do the rest. Null labels or scores don't count.
    """
    t = df.select(*by, actual.cast("int").alias("_a"), score.cast("double").alias("_s")).where("_a in (0, 1) and _s is not null")
    counts = t.groupBy(*by, "_s").agg(F.sum("_a").alias("pos"), F.sum(1 - F.col("_a")).alias("neg"))
    r = running(counts, by, "_s", ["pos", "neg"])
    above = F.col("pos_all") - F.col("pos_before")
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    hits = F.sum(F.col("pos") * above / (above + F.col("neg_all") - F.col("neg_before")))
    both = F.max("pos_all") * F.max("neg_all")
    return r.groupBy(*by).agg(F.try_divide(wins, both).alias("roc_auc"), F.when(both > 0, F.try_divide(hits, F.max("pos_all"))).alias("average_precision"), F.max("pos_all").alias("positives"), F.max("neg_all").alias("negatives"))


def error_histogram(df: DataFrame, width: float, actual: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    bucket = F.floor((F.col(predicted) - F.col(actual)) / width)
    return df.groupBy(bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n")).withColumn("lower", F.col("bucket") * width)


def worst(df: DataFrame, k: int, ties: str, actual: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """The k rows of the largest absolute error."""
    t = df.withColumn("abs_error", F.abs(F.col(predicted) - F.col(actual)))
    return t.orderBy(F.desc("abs_error"), ties).limit(k)


def standardise(df: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """Population mean and deviation of the training rows, applied to all; a constant column becomes 0."""
    fit = df.where(train).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mu", F.avg), ("sd", F.stddev_pop))])
    joined = df.crossJoin(F.broadcast(fit))  # one row
    return joined.withColumns({f"{c}_z": F.coalesce(F.try_divide(F.col(c) - F.col(f"mu_{c}"), F.col(f"sd_{c}")), F.lit(0.0)) for c in columns}).drop(*[f"{n}_{c}" for c in columns for n in ("mu", "sd")])


def scalers(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column; 0 and 1 where nothing is known, deviation 1 of a constant."""
    got = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("mu", F.avg), ("sd", F.stddev_pop))]).first()
    return {c: (got[f"mu_{c}"] or 0.0, got[f"sd_{c}"] or 1.0) for c in columns}


def scaled(df: DataFrame, by: Mapping[str, tuple[float, float]]) -> DataFrame:
    """The columns in place, less their mean and over their deviation."""
    return df.withColumns({c: (F.col(c) - F.lit(mu)) / F.lit(sd) for c, (mu, sd) in by.items()})


def _back(mu: float, sd: float, v: Column) -> Column:
    return v * F.lit(sd) + F.lit(mu)


def unscaled(df: DataFrame, by: Mapping[str, tuple[float, float]], names: Mapping[str, str] | None = None) -> DataFrame:
    """The way back. ``names``: columns that are in the units of another one, such as a prediction in those of its target;
    arrays are scaled back element by element."""
    out = {}
    for column, of in (names or {c: c for c in by}).items():
        mu, sd = by[of]
        array = df.schema[column].dataType.simpleString().startswith("array")
        out[column] = F.transform(column, partial(_back, mu, sd)) if array else _back(mu, sd, F.col(column))
    return df.withColumns(out)
