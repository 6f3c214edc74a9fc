"""Breakout candidates and the context joined to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitpanel.params import DEFAULTS, Params


def breakout_candidates(universe: DataFrame, signals: DataFrame, p: Params = DEFAULTS,
                        open_intervals: DataFrame | None = None) -> DataFrame:
    """Universe members whose close leaves the prior channel at the boundary.

    With ``open_intervals`` ``(entity, boundary)`` (boundaries at which a position is open)
    those members are left out by an anti join.
    """
    cols = ["entity", "boundary", "close", "hh_entry", "ll_entry", "hh_exit", "ll_exit", "atr"]
    usable = signals.select(*cols).filter(
        (F.col("atr") > 0) & F.col("hh_entry").isNotNull() & (
            (F.col("close") > F.col("hh_entry")) | (F.col("close") < F.col("ll_entry"))))
    side = F.when(F.col("close") > F.col("hh_entry"), 1).otherwise(-1)
    out = universe.join(usable, ["entity", "boundary"])
    if open_intervals is not None:
        out = out.join(open_intervals, ["entity", "boundary"], "left_anti")
    return (out.withColumn("side", side.cast("bigint"))
            .withColumn("r_dist", F.lit(p.stop_mult) * F.col("atr"))
            .withColumnRenamed("boundary", "t"))


def skip_count(universe: DataFrame, signals: DataFrame) -> DataFrame:
    """Universe rows without usable inputs, per boundary."""
    usable = signals.filter((F.col("atr") > 0) & F.col("hh_entry").isNotNull()) \
        .select("entity", "boundary")
    return (universe.join(usable, ["entity", "boundary"], "left_anti")
            .groupBy("boundary").agg(F.count(F.lit(1)).alias("skipped")))


def round_context(cands: DataFrame) -> DataFrame:
    """Candidates of the same side in the same round; partial aggregate, then an equi-join."""
    sides = cands.groupBy("t", "side").agg(F.count(F.lit(1)).alias("round_side_count"))
    return cands.join(sides, ["t", "side"])


def breadth(universe: DataFrame, series: DataFrame) -> DataFrame:
    """Share of universe members above their short average; members without one not counted."""
    above = F.when(F.col("close") > F.col("sma_short"), 1.0).otherwise(0.0)
    return (universe.select("boundary", "entity")
            .join(series.filter("sma_short is not null")
                  .select("entity", "boundary", "close", "sma_short"), ["entity", "boundary"])
            .groupBy("boundary").agg(F.avg(above).alias("breadth")))


def context_join(df: DataFrame, ctx: DataFrame, t: str, cols: dict[str, str]) -> DataFrame:
    """Attach the context entity's columns at the same boundary; a missing bar is an error.

    The context side has one row per boundary (bounded by the calendar); the plan is left to
    adaptive execution, which broadcasts it when its measured size is small.
    """
    side = ctx.select(F.col("boundary").alias(t), F.lit(True).alias("_has"),
                      *[F.col(src).alias(dst) for dst, src in cols.items()])
    joined = df.join(side, t, "left")
    guard = F.when(F.col("_has").isNull(),
                   F.raise_error(F.concat(F.lit("no context bar at "), F.col(t).cast("string"))))
    first = next(iter(cols))
    return joined.withColumn(first, F.coalesce(
        guard.cast(joined.schema[first].dataType), F.col(first))).drop("_has")


def top_k_per_round(df: DataFrame, by: list[str], score: str, name: str, k: int) -> DataFrame:
    """Best ``k`` per round by score, ties by name, with an ``i of n`` text."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*by).orderBy(F.desc(score), name)
    top = df.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
    return top.join(sizes, by).withColumn(
        "label", F.concat_ws(" of ", F.col("rank").cast("string"), F.col("_n").cast("string"))
    ).drop("_n")
