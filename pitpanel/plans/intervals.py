"""Interval joins through equi-buckets, and interval statistics through sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.functions.columns import div
from pitpanel.plans.ordered import running, time_bucket


def interval_join(intervals: DataFrame, points: DataFrame, by: list[str], lo: str, hi: str,
                  ts: str, width_ms: int, residual: Column | None = None) -> DataFrame:
    """Points with ``lo <= ts <= hi`` (closed), joined on ``(by, time bucket)``.

    The interval side is exploded over the buckets it touches, so a hot entity spreads over
    its buckets and no pair is formed outside one bucket. ``by`` names are shared.
    """
    spread = intervals.filter(F.col(lo) <= F.col(hi)).withColumn(
        "_b", F.explode(F.sequence(div(lo, width_ms), div(hi, width_ms))))
    keyed = points.withColumn("_b", div(ts, width_ms))
    keep = (F.col(ts) >= F.col(lo)) & (F.col(ts) <= F.col(hi))
    if residual is not None:
        keep = keep & residual
    return spread.join(keyed, by + ["_b"]).filter(keep).drop("_b")


def overlap_pairs(df: DataFrame, lo: str, hi: str, width_ms: int) -> DataFrame:
    """One row ``(n, pairs)``: overlapping unordered pairs of closed intervals.

    ``C(n,2)`` minus the ordered-disjoint pairs; a pair is disjoint exactly when one ends
    before the other starts, so a running count of ends over the merged times is enough.
    """
    marks = df.select(F.explode(F.array(
        F.struct(F.col(lo).alias("x"), F.lit(1).alias("s"), F.lit(0).alias("e")),
        F.struct(F.col(hi).alias("x"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("m"))
    per_time = marks.groupBy(F.col("m.x").alias("x")).agg(
        F.sum("m.s").alias("s"), F.sum("m.e").alias("e"))
    swept = running(per_time, [], ["x"], time_bucket("x", width_ms),
                    {"ended": ("sum", F.col("e"))}, exclusive=True)
    return (swept.agg(F.sum("s").alias("n"),
                      F.coalesce(F.sum(F.col("s").cast("decimal(14,0)")
                                       * F.coalesce("ended", F.lit(0)).cast("decimal(14,0)")),
                                 F.lit(0)).alias("disjoint"))
            .select("n", (F.col("n").cast("decimal(18,0)") * (F.col("n") - 1).cast("decimal(18,0)") / 2
                          - F.col("disjoint")).cast("decimal(38,0)").alias("pairs")))


def concurrency(df: DataFrame, grid: DataFrame, lo: str, hi: str, t: str,
                width_ms: int) -> DataFrame:
    """Number of closed intervals covering each grid point: ``(t, open_n)``."""
    deltas = df.select(F.explode(F.array(
        F.struct(F.col(lo).alias("x"), F.lit(1).alias("d")),
        F.struct((F.col(hi) + 1).alias("x"), F.lit(-1).alias("d")))).alias("m")) \
        .select("m.x", "m.d", F.lit(0).alias("g"))
    points = grid.select(F.col(t).alias("x"), F.lit(0).alias("d"), F.lit(1).alias("g"))
    per_time = deltas.unionByName(points).groupBy("x").agg(
        F.sum("d").alias("d"), F.max("g").alias("g"))
    swept = running(per_time, [], ["x"], time_bucket("x", width_ms),
                    {"open_n": ("sum", F.col("d"))})
    return swept.filter("g = 1").select(F.col("x").alias(t), "open_n")
