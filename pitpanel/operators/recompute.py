"""Recorded rounds, span and split, and the same fields computed anew from raw records by a plan of its own.

Both sides are long rows ``(key, field, value)`` for ``checks.partition_verify``: the key is a boundary for
fields of a round and 0 for fields of the whole partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitpanel.operators import universe
from pitpanel.params import DAY, DEFAULTS, Params

WHOLE = ["start_ts", "n_boundaries", "validation_start", "holdout_start"]


def _long(df: DataFrame, key: Column, fields: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("bigint").alias("value")) for f in fields])
    return df.select(key.alias("key"), F.explode(pairs).alias("_f")).select("key", "_f.field", "_f.value")


def partition_record(rounds: DataFrame, end: int, freeze: int, step: int, p: Params = DEFAULTS) -> DataFrame:
    """What a build of the partition writes down: validity of rounds, first boundary, size and edges of the split.

    ``end`` is the last boundary of the partition; it belongs to the holdout and isn't computed.
    """
    start = universe.valid_span(rounds, freeze, p).select("start_ts")
    inside = rounds.filter((F.col("boundary") >= start.scalar()) & (F.col("boundary") <= end)).select("boundary")
    edge = {part: F.min(F.when(F.col("part") == part, F.col("start_ts"))) for part in ("train", "validation", "holdout")}
    whole = universe.partition_edges(universe.chrono_partition(inside, step, p)).agg(
        edge["train"].alias("start_ts"), F.sum("n").alias("n_boundaries"),
        edge["validation"].alias("validation_start"), edge["holdout"].alias("holdout_start"))
    return _long(rounds, F.col("boundary"), ["valid"]).unionByName(_long(whole, F.lit(0).cast("bigint"), WHOLE))


def _eligible_counts(raw: DataFrame, start: int, end: int, p: Params, by: str, ts: str, vol: str) -> DataFrame:
    """Eligible entities per boundary: every day's totals are sent to the days whose trailing span holds it."""
    day = F.floor(F.col(ts) / DAY).cast("bigint")
    days = raw.groupBy(by, day.alias("day")).agg(
        F.count(vol).alias("bars"), F.sum(vol).alias("volume"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    lives = days.groupBy(by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("day").alias("last_day"))
    traded = F.when(F.col("bars") >= p.daily_min_bars, F.col("volume"))
    ahead = F.sequence(F.col("day") + 1, F.col("day") + p.trailing_days)
    trailing = (days.select(by, "bars", traded.alias("v"), F.explode(ahead).alias("day"))
                .groupBy(by, "day").agg(F.sum("bars").alias("bars"), F.count("v").alias("defined"),
                                        F.percentile("v", F.lit(0.5)).alias("median")))
    good = trailing.join(lives, by).filter(
        (F.col("day") <= F.col("last_day") + 1) & (F.col("defined") >= p.min_defined_days)
        & (F.col("median") >= p.min_liquidity)
        & (F.col("bars") / F.lit(p.trailing_days * p.bars_per_day) >= p.min_completeness))
    first = F.greatest(F.col("day") * DAY, F.lit(start).cast("bigint"), F.col("lo") + p.min_history_ms)
    last = F.least(F.col("day") * DAY + DAY - p.coarse_ms, F.lit(end).cast("bigint"), F.col("hi") + p.tradable_ms)
    step = F.lit(p.coarse_ms).cast("bigint")
    first = F.ceil(first / step) * step
    return (good.withColumn("_first", first).withColumn("_last", last).filter("_first <= _last")
            .select(F.explode(F.sequence("_first", "_last", step)).alias("boundary"))
            .groupBy("boundary").agg(F.count(F.lit(1)).alias("n_eligible")))


def partition_recompute(raw: DataFrame, context: str, start: int, end: int, step: int, p: Params = DEFAULTS,
                        by: str = "entity", ts: str = "ts", vol: str = "quote_volume") -> DataFrame:
    """The fields of ``partition_record`` from raw records alone.

    Trailing values are aggregates of copied day totals instead of windows, shares ahead are differences of
    running counts, edges of the split are arithmetic. Boundaries are multiples of ``step``, as are ``start``
    and ``end``; running counts order one row per boundary.
    """
    slots = (raw.filter(F.col(by) == context)
             .groupBy((F.col(ts) - F.pmod(F.col(ts), F.lit(p.coarse_ms)) + p.coarse_ms).alias("boundary"))
             .agg(F.count_distinct(ts).alias("slots")))
    grid = universe.boundary_grid(raw.sparkSession, start, end, step)
    counts = _eligible_counts(raw, start, end, p, by, ts, vol)
    valid = F.coalesce(F.col("slots") == p.bars_per_coarse, F.lit(False)) & (F.coalesce("n_eligible", F.lit(0)) >= p.min_eligible)
    rounds = grid.join(counts, "boundary", "left").join(slots, "boundary", "left").select("boundary", valid.alias("valid"))
    upto = W.partitionBy(F.lit(0)).orderBy("boundary")
    running = rounds.withColumn("upto", F.sum(F.col("valid").cast("bigint")).over(upto))
    reach = F.least(F.lit(end).cast("bigint"), F.col("boundary") + F.floor(F.lit(p.span_window_ms) / step) * step)
    ahead = running.filter("valid").withColumn("reach", reach.cast("bigint")).join(
        running.select(F.col("boundary").alias("reach"), F.col("upto").alias("then")), "reach")
    share = (F.col("then") - F.col("upto") + 1) / ((F.col("reach") - F.col("boundary")) / step + 1)
    first = ahead.filter(share >= p.span_fraction).agg(F.min("boundary").alias("start_ts"))
    n = F.floor((F.lit(end) - F.col("start_ts")) / step).cast("bigint") + 1
    edges = [F.col("start_ts") + F.floor(F.lit(f) * n).cast("bigint") * step for f in (p.train_fraction, p.validation_fraction)]
    whole = first.select("start_ts", n.alias("n_boundaries"), edges[0].alias("validation_start"), edges[1].alias("holdout_start"))
    return _long(rounds, F.col("boundary"), ["valid"]).unionByName(_long(whole, F.lit(0).cast("bigint"), WHOLE))
