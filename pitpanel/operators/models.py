"""Gradient-boosted filters, rankers and sizers on feature tables, and distributed scoring."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.functions.columns import bucket_of
from pitpanel.operators.boosting import Boost, fit_replicates
from pitpanel.operators.checks import column_guard, purge_guard
from pitpanel.operators.resampling import rank_auc, rank_ic
from pitpanel.plans.ordered import exact_quantiles
from pitpanel.session import materialize

# Tree settings of the fitted models.
TREES = {"maxIter": 100, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8}
# Size buckets by prediction quartile.
SIZE_BUCKETS = (0.25, 0.5, 0.75, 1.0)


class FeaturePrep:
    """NULL handling fitted on training rows: a sentinel below every value plus an indicator.

    Trees in MLlib refuse NULL and NaN; the sentinel lets them split missing rows off.
    """

    def __init__(self, train: DataFrame, cols: list[str]):
        self.cols = list(cols)
        stats = train.agg(*[F.min(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(f"m_{c}")
                            for c in cols],
                          *[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"n_{c}")
                            for c in cols]).take(1)[0]
        self.fill = {c: (stats[f"m_{c}"] if stats[f"m_{c}"] is not None else 0.0) - 1.0 for c in cols}
        self.flags = [c for c in cols if stats[f"n_{c}"] > 0]

    def __call__(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        def gone(c):
            return F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
        ready = df.withColumns({
            **{f"_x_{c}": F.when(gone(c), F.lit(self.fill[c])).otherwise(F.col(c).cast("double")) for c in self.cols},
            **{f"_z_{c}": gone(c).cast("double") for c in self.flags}})
        names = [f"_x_{c}" for c in self.cols] + [f"_z_{c}" for c in self.flags]
        out = VectorAssembler(inputCols=names, outputCol="features").transform(ready)
        return out.drop(*names)

    def names(self) -> list[str]:
        return self.cols + [f"{c}_missing" for c in self.flags]


class Fitted:
    """A model with its feature preparation; columns are bound by name, never by position."""

    def __init__(self, prep: FeaturePrep, model, kind: str, cuts: list[float] | None = None):
        self.prep, self.model, self.kind, self.cuts = prep, model, kind, cuts

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        done = self.model.transform(self.prep(df))
        value = (vector_to_array("probability")[1] if self.kind == "filter" else F.col("prediction"))
        return done.withColumn(out, value).drop("features", "rawPrediction", "probability", "prediction")

    def bucket(self, df: DataFrame, out: str = "bucket") -> DataFrame:
        scored = self.score(df, "_p")
        return scored.withColumn(out, bucket_of("_p", [F.lit(c) for c in self.cuts], SIZE_BUCKETS)).drop("_p")

    def importance(self, top: int = 10) -> list[tuple[str, float]]:
        values = self.model.featureImportances.toArray()
        pairs = sorted(zip(self.prep.names(), values, strict=True), key=lambda x: (-x[1], x[0]))
        return [(n, float(v)) for n, v in pairs[:top]]


def _guarded(train: DataFrame, cols: list[str], val_start: int | None, hi: str, guard: bool) -> DataFrame:
    if guard:
        column_guard(cols)
    return train if val_start is None else purge_guard(train, hi, val_start)


def fit_filter(train: DataFrame, cols: list[str], y: str, val_start: int | None = None, hi: str = "hi",
               seed: int = 7, guard: bool = True, **over) -> Fitted:
    """Classifier of a positive outcome on purged training rows."""
    from pyspark.ml.classification import GBTClassifier
    rows = _guarded(train, cols, val_start, hi, guard).withColumn("_y", (F.col(y) > 0).cast("double"))
    prep = FeaturePrep(rows, cols)
    gbt = GBTClassifier(labelCol="_y", featuresCol="features", seed=seed, **{**TREES, **over})
    return Fitted(prep, gbt.fit(prep(rows).select("features", "_y")), "filter")


def fit_ranker(train: DataFrame, cols: list[str], y: str, val_start: int | None = None, hi: str = "hi",
               seed: int = 7, guard: bool = True, **over) -> Fitted:
    from pyspark.ml.regression import GBTRegressor
    rows = _guarded(train, cols, val_start, hi, guard).withColumn("_y", F.col(y).cast("double"))
    prep = FeaturePrep(rows, cols)
    gbt = GBTRegressor(labelCol="_y", featuresCol="features", seed=seed, **{**TREES, **over})
    return Fitted(prep, gbt.fit(prep(rows).select("features", "_y")), "ranker")


def fit_sizer(train: DataFrame, cols: list[str], y: str, val_start: int | None = None, hi: str = "hi",
              seed: int = 7, guard: bool = True, **over) -> Fitted:
    """Ranker plus the exact quartiles of its training predictions."""
    m = fit_ranker(train, cols, y, val_start, hi, seed, guard, **over)
    q = exact_quantiles(m.score(train, "_p"), "_p", [0.25, 0.5, 0.75]).orderBy("prob").take(3)
    m.cuts = [r["quantile"] for r in q]
    return m


def score_external(df: DataFrame, cols: list[str], predict, out: str = "score") -> DataFrame:
    """Score with any model object: ``predict`` maps an iterator of pandas frames (columns in
    ``cols`` order, one Arrow batch each) to an iterator of arrays; load the model once inside."""
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for values in predict(b[cols] for b in batches):
            yield pd.Series(values)
    return df.withColumn(out, run(F.struct(*[F.col(c).cast("double").alias(c) for c in cols])))


def statistic_per_replicate(df: DataFrame, rep: str, values: list[str], fn) -> DataFrame:
    """Custom statistic of each replicate as a grouped-aggregate pandas UDF (replicates are
    bounded; use the built-in rank statistics for groups of any size)."""
    stat = F.pandas_udf(fn, "double")
    return df.groupBy(rep).agg(stat(*[F.col(v) for v in values]).alias("stat"))


def permutation_refit(train: DataFrame, valid: DataFrame, cols: list[str], y: str, permuted: DataFrame,
                      key: list[str], reps: int = 200, statistic=None, settings: Boost = Boost()) -> DataFrame:
    """Refit on permuted labels and evaluate on the validation rows, all replicates in one fit: ``(rep, stat)``.

    ``permuted`` has ``rep, key, y``. ``statistic`` maps a frame ``(rep, y, score)`` to ``(rep, stat)``; by
    default the rank correlation, or the area under the curve for ``settings.positive``. The number of jobs
    follows trees and depth, not replicates.
    """
    forest = fit_replicates(train, cols, permuted, key, y, reps, settings)
    scored = materialize(forest.score(valid, [y]))
    if statistic:
        return statistic(scored)
    if settings.positive:
        return rank_auc(scored, y, "score", ["rep"]).withColumnRenamed("auc", "stat")
    return rank_ic(scored, "score", y, ["rep"]).withColumnRenamed("ic", "stat")
