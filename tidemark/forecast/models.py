"""Forecasters on Spark: boosted trees, direct multi-step regression, and builders of all kinds by name."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clean
from ..operators import windows as W
from ..spec import SeriesSpec
from .recurrent import Recurrent
from .seasonal import Seasonality, forecast
from .trees import Boosted


def assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    """Features in sorted order, whatever order they come in."""
    return VectorAssembler(inputCols=sorted(features), outputCol=out, handleInvalid="skip")


def boosted(features: Sequence[str], target: str = "target", validation: str | None = None, trees: int = 100, depth: int = 6, rate: float = 0.1, subsample: float = 0.8, seed: int = 42, **extra) -> Pipeline:
    """Squared-error boosting; with a validation flag column it stops once that error no longer falls."""
    gbt = GBTRegressor(featuresCol="features", labelCol=target, predictionCol="prediction", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed, **extra)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[assembler(features), gbt])


def importances(model: PipelineModel, features: Sequence[str], k: int | None = None) -> list[tuple[str, float]]:
    """(feature, importance), the largest first."""
    pairs = sorted(zip(sorted(features), model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))
    return pairs[:k] if k else pairs


def predictions(model: PipelineModel, df: DataFrame, features: Sequence[str], out: str = "prediction") -> DataFrame:
    """Every row of ``df`` with its prediction; one that lacks a feature has none, and ``error`` says so."""
    whole = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in features])
    scored = model.transform(df.where(whole)).select(*df.columns, out, F.lit(None).cast("string").alias("error"))
    return scored.unionByName(df.where(~whole).withColumns({out: F.lit(None).cast("double"), "error": F.lit("a feature is missing")}))


#: Rows that the features look back, and widths of rolling frames.
LAGS, WIDTHS = (1, 2, 3, 5, 7, 14, 21, 30), (3, 7, 14, 30)


def enhanced_features(df: DataFrame, spec: SeriesSpec, metric: str, others: Sequence[str] = (), weather: Mapping[str, str] | None = None, fill: bool = False, backward: bool = False, most_missing: float = 0.5) -> tuple[DataFrame, list[str]]:
    """Calendar, cyclic, season, lag, rolling, difference and interaction features of rows before the target's.

    Nothing on the target's own row takes part: rolling frames end one row earlier, differences are those of the lagged
    values, and so are the interactions of ``weather`` (columns named by high, low, wind and precip). Features of which
    ``most_missing`` or more is null are dropped. Rows with null features go or, with ``fill``, get the last known value
    of their series (then the next one, which reads the future, if ``backward``), and the median where there is none.
    """
    named = dict(weather or {})
    lagged = [metric, *[c for c in (*others, *named.values()) if c != metric]]
    t = W.lags(df, spec, list(dict.fromkeys(lagged)), LAGS)
    t = W.rolling(t, spec, [metric], WIDTHS, until=-1)
    lag = {n: F.col(f"{metric}_lag_{n}") for n in LAGS}
    t = t.withColumns({f"{metric}_diff_1": lag[1] - lag[2], f"{metric}_diff_6": lag[1] - lag[7], f"{metric}_pct_6": F.try_divide(lag[1], lag[7]) - 1})
    if named:
        t = t.withColumns(S.interactions(*[F.col(f"{named[k]}_lag_1") for k in ("high", "low", "wind", "precip")]))
    day = F.col(spec.time)
    cyc = {f"{n}_{w}": c for n, (v, p) in {"month": (F.month(day), 12), "doy": (F.dayofyear(day), 365.25), "week": (F.weekofyear(day), 52)}.items() for w, c in zip(("sin", "cos"), S.cyclic(v, p), strict=True)}
    t = t.withColumns(cyc | S.season_flags(day))
    made = [c for c in t.columns if c not in df.columns]
    kept = clean.drop_sparse(t.select(*made), most_missing).columns
    t = t.select(*df.columns, *kept)
    if not fill:
        return t.dropna(subset=kept), kept
    t = clean.forward_backward_fill(t.dropna(subset=[metric]), spec, kept, backward)
    return clean.median_impute(t, kept), kept


class StepRegression:
    """Direct multi-step forecasts: one regression for each step over a flattened sequence.

    The frame of sequences is cached while the steps are fitted, so it is built once.
    """

    def __init__(self, lookback: int, horizon: int, estimator: Callable[[], object] | None = None):
        self.lookback, self.horizon = lookback, horizon
        self.estimator = estimator or (lambda: LinearRegression(regParam=0.01))
        self.models: list = []

    def frame(self, df: DataFrame, spec: SeriesSpec, features: Sequence[str], target: str) -> DataFrame:
        t = W.sequences(df, spec, features, target, self.lookback, self.horizon)
        return t.withColumn("features", array_to_vector(F.flatten("x")))

    def fit(self, frame: DataFrame, weight: str | None = None) -> StepRegression:
        cached = frame.persist()
        try:
            self.models = []
            for h in range(self.horizon):
                e = self.estimator().setLabelCol(f"y{h}").setPredictionCol(f"p{h}").setFeaturesCol("features")
                e = e.setWeightCol(weight) if weight else e
                self.models.append(e.fit(cached.withColumn(f"y{h}", F.col("y")[h])))
        finally:
            cached.unpersist()
        return self

    def transform(self, frame: DataFrame) -> DataFrame:
        for m in self.models:
            frame = m.transform(frame)
        names = [f"p{h}" for h in range(self.horizon)]
        return frame.withColumn("predictions", F.array(*names)).drop(*names)


def fine_tuned(base: StepRegression, old: DataFrame, new: DataFrame, weight: float = 5.0) -> StepRegression:
    """Refit over both data sets, the new one weighing more; frames of one layout, features mapped beforehand."""
    both = old.select("features", "x", "y").withColumn("w", F.lit(1.0)).unionByName(new.select("features", "x", "y").withColumn("w", F.lit(float(weight))))
    return StepRegression(base.lookback, base.horizon, base.estimator).fit(both, "w")


def seasonal(df: DataFrame, keys: Sequence[str], horizon: int, ridge: float = 1.0, hinge_ridge: float | None = None, **options) -> DataFrame:
    """df: keys, ds date, y. ``seasonal.forecast`` with ``Seasonality`` by its options."""
    return forecast(df, keys, horizon, Seasonality(ridge=ridge, hinge_ridge=ridge if hinge_ridge is None else hinge_ridge, **options))


#: Builders by name.
BUILDERS: dict[str, Callable] = {"boosted": boosted, "steps": StepRegression, "seasonal": seasonal, "penalised": Boosted, "recurrent": Recurrent}


def build(name: str, *args, **kwargs):
    if name not in BUILDERS:
        raise ValueError(f"no model named {name}; there are {sorted(BUILDERS)}")
    return BUILDERS[name](*args, **kwargs)
