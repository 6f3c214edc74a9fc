"""Score alignment, grid selection and sizing utilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitpanel.params import DEFAULTS, Params


def score_alignment(labels: DataFrame, probs: DataFrame, scores: DataFrame, on: list[str]) -> DataFrame:
    return labels.join(probs, on).join(scores, on)


def threshold_grid(df: DataFrame, score: str, y: str, grid: list[float]) -> DataFrame:
    """Accepted count and mean outcome per threshold: ``(param, n_selected, metric, n_total)``.

    One pass: a row adds to the highest threshold it passes, and the sums cascade down over a
    table with one row per grid point.
    """
    cuts = sorted(grid)
    slot = F.lit(None).cast("double")
    for c in cuts:
        slot = F.when(F.col(score) >= c, F.lit(float(c))).otherwise(slot)
    per = df.select(slot.alias("param"), F.col(y).alias("_y")).groupBy("param").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_s"))
    points = df.sparkSession.createDataFrame([(float(c),) for c in cuts], "param double")
    w = W.partitionBy(F.lit(0)).orderBy(F.desc("param"))
    total = per.select(F.sum("_n")).scalar()
    full = points.join(per, "param", "left").select(
        "param", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("bigint").alias("n_selected"),
        F.sum("_s").over(w).alias("_sum")).withColumn("n_total", total)
    return full.select("param", "n_selected", F.try_divide("_sum", "n_selected").alias("metric"), "n_total")


def topk_grid(df: DataFrame, by: list[str], score: str, name: str, y: str, grid: list[int]) -> DataFrame:
    """The same for "best k per round", from one ranking cut at the largest k."""
    total = df.select(F.count(F.lit(1))).scalar()
    w = W.partitionBy(*by).orderBy(F.desc(score), name)
    ranked = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(grid))
    points = F.explode(F.filter(F.array(*[F.lit(int(k)) for k in sorted(grid)]), lambda k: k >= F.col("_r")))
    return (ranked.select(points.alias("param"), F.col(y).alias("_y")).groupBy("param")
            .agg(F.count(F.lit(1)).alias("n_selected"), F.avg("_y").alias("metric"))
            .withColumn("n_total", total))


def grid_select(points: DataFrame, fallback: float, p: Params = DEFAULTS) -> DataFrame:
    """Best selectable grid point: support of at least ``ceil(num * n / den)``, ties to the
    smaller parameter, the fallback when none is selectable. One row."""
    need = F.ceil(F.lit(p.support_num) * F.col("n_total") / F.lit(p.support_den))
    ok = (F.col("n_selected") >= need) & F.col("metric").isNotNull()
    best = F.max_by("param", F.when(ok, F.struct("metric", -F.col("param"))))
    return points.agg(F.coalesce(best.cast("double"), F.lit(float(fallback))).alias("selected"),
                      F.count_if(ok).alias("n_selectable"),
                      F.max(F.when(ok, F.col("metric"))).alias("best_metric"))


def utility_select(df: DataFrame, order: str, sortino: str, dd: str, dd0: float | str) -> DataFrame:
    """Utility ``sortino - 2*max(0,(dd-dd0)/max(dd0,.01))`` per option and the winning flag (ties
    to the smallest ``order``); one row per option."""
    base = F.col(dd0) if isinstance(dd0, str) else F.lit(dd0)
    u = F.col(sortino) - 2 * F.greatest(F.lit(0.0), (F.col(dd) - base) / F.greatest(base, F.lit(0.01)))
    rows = df.withColumn("utility", u)
    best = rows.select(F.max_by(order, F.struct("utility", -F.col(order)))).scalar()
    return rows.withColumn("_best", best).withColumn("selected", F.col(order) == F.col("_best")).drop("_best")
