"""Ticks to fine bars, fine bars to complete coarse bars, daily calendars, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitpanel.functions.columns import day_of, floor_to, on_grid
from pitpanel.params import DEFAULTS, DAY, Params
from pitpanel.plans.ordered import previous, time_bucket


def ticks_to_bars(df: DataFrame, by: str, ts: str, value: str, tie: list[str],
                  step: int) -> DataFrame:
    """Irregular values to one bar per ``(by, step)``; every aggregate combines map-side."""
    order = F.struct(ts, *tie)
    return (df.groupBy(by, floor_to(ts, step).alias("_slot"))
            .agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"),
                 F.min(value).alias("low"), F.max_by(value, order).alias("close"),
                 F.count(F.lit(1)).alias("volume"), F.sum(value).alias("quote_volume"))
            .withColumnRenamed("_slot", ts))


def complete_bars(df: DataFrame, by: str = "entity", ts: str = "ts",
                  p: Params = DEFAULTS) -> DataFrame:
    """Coarse bars, kept only where every fine bar of the window exists."""
    slot = floor_to(ts, p.coarse_ms)
    return (df.groupBy(by, slot.alias("open_ts"))
            .agg(F.min_by("open", ts).alias("open"), F.max("high").alias("high"),
                 F.min("low").alias("low"), F.max_by("close", ts).alias("close"),
                 F.sum("volume").alias("volume"), F.sum("quote_volume").alias("quote_volume"),
                 F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") == p.bars_per_coarse).drop("_n")
            .withColumn("boundary", F.col("open_ts") + F.lit(p.coarse_ms)))


def slot_counts(df: DataFrame, by: str = "entity", ts: str = "ts",
                p: Params = DEFAULTS) -> DataFrame:
    """Fine bars present per coarse window."""
    return (df.groupBy(by, floor_to(ts, p.coarse_ms).alias("open_ts"))
            .agg(F.count(F.lit(1)).alias("slots"))
            .withColumn("complete", F.col("slots") == p.bars_per_coarse))


def daily_calendar(df: DataFrame, by: str = "entity", ts: str = "ts",
                   vol: str = "quote_volume", p: Params = DEFAULTS) -> DataFrame:
    """Per entity and day: bars present and traded volume (NULL below the minimum)."""
    return (df.groupBy(by, day_of(ts).alias("day"))
            .agg(F.count(vol).alias("bars_present"), F.sum(vol).alias("_v"))
            .withColumn("qvol", F.when(F.col("bars_present") >= p.daily_min_bars, F.col("_v")))
            .drop("_v"))


def extent(df: DataFrame, by: str = "entity", ts: str = "ts") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"),
                              F.max(ts).alias("last_ts"))


def missing_slots(df: DataFrame, by: str = "entity", ts: str = "ts",
                  step: int = DEFAULTS.fine_ms, bucket_ms: int = 30 * DAY) -> DataFrame:
    """Runs of missing slots between consecutive rows of an entity."""
    prev = previous(df.select(by, ts), [by], [ts], time_bucket(ts, bucket_ms),
                    {"_prev": F.col(ts)})
    gap = F.col(ts) - F.col("_prev")
    return prev.filter(gap > step).select(
        by, (F.col("_prev") + step).alias("gap_start"), (F.col(ts) - step).alias("gap_end"),
        F.call_function("div", gap - F.lit(step), F.lit(step).cast("bigint")).alias("slots_missing"))


def grid_violations(df: DataFrame, ts: str, step: int) -> DataFrame:
    return df.filter(~on_grid(ts, step))
