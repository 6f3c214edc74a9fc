"""Eligibility, universes, round validity and the chronological partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitpanel.params import DAY, DEFAULTS, Params


def boundary_grid(spark: SparkSession, a: int, b: int, step: int) -> DataFrame:
    """All boundaries in ``[a, b]``; both ends must lie on the grid."""
    if a % step or b % step:
        raise ValueError("interval endpoints must be grid boundaries")
    return spark.range(a, b + 1, step).select(F.col("id").alias("boundary"))


def trailing_daily(cal: DataFrame, p: Params = DEFAULTS, by: str = "entity") -> DataFrame:
    """Median volume and completeness over the calendar days strictly before each day.

    Runs on a day spine (missing days count as zero bars) up to one day past the last one;
    a spine holds one row per day, so the frame and the exact median stay small.
    """
    spine = (cal.groupBy(by).agg(F.min("day").alias("d0"), F.max("day").alias("d1"))
             .select(by, F.explode(F.sequence(F.col("d0"), F.col("d1") + 1)).alias("day")))
    full = spine.join(cal, [by, "day"], "left")
    w = W.partitionBy(by).orderBy("day").rangeBetween(-p.trailing_days, -1)
    return full.select(
        by, "day",
        F.when(F.count("qvol").over(w) >= p.min_defined_days,
               F.percentile("qvol", F.lit(0.5)).over(w)).alias("liq_median"),
        (F.sum("bars_present").over(w) / F.lit(p.trailing_days * p.bars_per_day))
        .alias("completeness"))


def eligibility(metrics: DataFrame, extent: DataFrame, start: int, end: int,
                p: Params = DEFAULTS, by: str = "entity",
                point_in_time: bool = False, bars_by_day: DataFrame | None = None) -> DataFrame:
    """Eligible ``(boundary, entity, liq_median)`` rows in ``[start, end]``.

    Each daily metric row yields its own boundaries, so no boundary x entity product is ever
    formed. The default asks the entity's last bar of all history to be recent; with
    ``point_in_time`` the last day with bars before the boundary is used instead, taken from
    ``bars_by_day`` (the daily calendar).
    """
    step = p.coarse_ms
    if not point_in_time:
        src = metrics.join(extent.select(by, "first_ts", "last_ts"), by)
    else:
        seen = W.partitionBy(by).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
        lastday = (metrics.select(by, "day").join(
            bars_by_day.filter("bars_present > 0").select(by, "day", F.col("day").alias("_d")),
            [by, "day"], "left").select(by, "day", F.max("_d").over(seen).alias("_last")))
        src = (metrics.join(lastday, [by, "day"]).join(extent.select(by, "first_ts"), by)
               .withColumn("last_ts", (F.col("_last") + 1) * DAY - 1))
    pos = F.col("day") * DAY
    grid = F.explode(F.sequence(pos, pos + DAY - step, F.lit(step).cast("bigint")))
    ok = (src.filter((F.col("liq_median") >= p.min_liquidity)
                     & (F.col("completeness") >= p.min_completeness))
          .select(by, "liq_median", "first_ts", "last_ts", grid.alias("boundary")))
    return (ok.filter(F.col("boundary").between(start, end)
                      & (F.col("first_ts") <= F.col("boundary") - p.min_history_ms)
                      & (F.col("last_ts") >= F.col("boundary") - p.tradable_ms))
            .select("boundary", by, "liq_median"))


def universe_top_n(elig: DataFrame, n: int, by: str = "entity") -> DataFrame:
    """Rank by volume (ties by name), keep ``n``; ``n_eligible`` is the size after the cut."""
    w = W.partitionBy("boundary").orderBy(F.desc("liq_median"), by)
    top = elig.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= n)
    size = F.count(F.lit(1)).over(W.partitionBy("boundary"))
    return top.withColumn("n_eligible", size)


def round_validity(grid: DataFrame, elig: DataFrame, slots: DataFrame,
                   p: Params = DEFAULTS) -> DataFrame:
    """Valid when the context window that closes at the boundary is complete and enough
    entities are eligible. ``slots`` is the context entity's ``slot_counts``."""
    n = elig.groupBy("boundary").agg(F.count(F.lit(1)).alias("n_eligible"))
    ctx = slots.select((F.col("open_ts") + p.coarse_ms).alias("boundary"),
                       F.col("complete").alias("ctx_complete"))
    return (grid.join(n, "boundary", "left").join(ctx, "boundary", "left")
            .select("boundary", F.coalesce("n_eligible", F.lit(0)).cast("bigint").alias("n_eligible"),
                    F.coalesce("ctx_complete", F.lit(False)).alias("ctx_complete"))
            .withColumn("valid", F.col("ctx_complete") & (F.col("n_eligible") >= p.min_eligible)))


def valid_span(flags: DataFrame, freeze: int, p: Params = DEFAULTS) -> DataFrame:
    """First valid boundary whose forward window is mostly valid, and the last valid one
    before the freeze buffer: one row ``(start_ts, end_ts)``, NULL when none qualifies.

    One row per boundary, so the window is bounded by the calendar.
    """
    ahead = W.partitionBy(F.lit(0)).orderBy("boundary").rangeBetween(0, p.span_window_ms)
    share = flags.withColumn("_share", F.avg(F.col("valid").cast("int")).over(ahead))
    end = F.max(F.when(F.col("valid") & (F.col("boundary") <= freeze - p.span_buffer_ms),
                       F.col("boundary")))
    good = F.col("valid") & (F.col("_share") >= p.span_fraction)
    return (share.agg(F.min(F.when(good, F.col("boundary"))).alias("start_ts"),
                      end.alias("end_ts"))
            .select(F.when(F.col("start_ts") <= F.col("end_ts"), F.col("start_ts")).alias("start_ts"),
                    "end_ts"))


def require_span(span: DataFrame) -> tuple[int, int]:
    """Driver-side reading of the one-row span; raises when there is none."""
    row = span.take(1)
    if not row or row[0]["start_ts"] is None or row[0]["end_ts"] is None:
        raise RuntimeError("no boundary satisfies the validity rule")
    return row[0]["start_ts"], row[0]["end_ts"]


def chrono_partition(grid: DataFrame, step: int, p: Params = DEFAULTS) -> DataFrame:
    """Position and part of every boundary of a gap-free grid: train, validation, holdout."""
    first = grid.select(F.min("boundary")).scalar()
    n = grid.select(F.count(F.lit(1))).scalar()
    i = F.call_function("div", F.col("boundary") - F.col("_first"), F.lit(step).cast("bigint"))
    return (grid.withColumn("_first", first).withColumn("_n", n)
            .withColumn("i", i)
            .withColumn("part", F.when(F.col("i") < F.floor(F.lit(p.train_fraction) * F.col("_n")),
                                       "train")
                        .when(F.col("i") < F.floor(F.lit(p.validation_fraction) * F.col("_n")),
                              "validation").otherwise("holdout"))
            .drop("_first", "_n"))


def partition_edges(parts: DataFrame) -> DataFrame:
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("boundary").alias("start_ts"),
                                     F.max("boundary").alias("end_ts"))


