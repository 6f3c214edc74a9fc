"""Independent outcomes of candidates, rate accrual and held episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitpanel.functions.columns import by_tier, clip_finite, entry_fill, exit_fill, floor_to, safe_div
from pitpanel.params import DAY, DEFAULTS, Params
from pitpanel.plans.asof import asof_join
from pitpanel.plans.extrema import first_crossing, pyramid
from pitpanel.plans.intervals import interval_join
from pitpanel.session import materialize

ID = ["entity", "t"]


def queued_exits(cands: DataFrame, signals: DataFrame, rounds: DataFrame,
                 p: Params = DEFAULTS) -> DataFrame:
    """Boundary and reason of the first queued (trailing or time) exit of each candidate.

    The next trailing boundary of either side is a backward window over an entity's bars; the
    time exit is the first valid boundary at or after the holding limit, looked up in the round
    grid (one row per boundary, so its window is bounded by the calendar).
    """
    ahead = W.partitionBy(F.lit(0)).orderBy("boundary").rowsBetween(0, W.unboundedFollowing)
    grid = rounds.select("boundary", "valid", F.first(
        F.when(F.col("valid"), F.col("boundary")), ignorenulls=True).over(ahead).alias("_time"))
    after = W.partitionBy("entity").orderBy("boundary").rowsBetween(1, W.unboundedFollowing)
    flagged = signals.join(grid.select("boundary", F.col("valid").alias("_v")), "boundary", "left")
    ok = F.col("_v") & F.col("ll_exit").isNotNull() & F.col("hh_exit").isNotNull()

    def nxt(cond):
        return F.first(F.when(ok & cond, F.col("boundary")), ignorenulls=True).over(after)
    trail = flagged.select(
        "entity", F.col("boundary").alias("t"),
        nxt(F.col("close") < F.col("ll_exit")).alias("_long"),
        nxt(F.col("close") > F.col("hh_exit")).alias("_short"))
    x = (cands.join(trail, ID, "left")
         .withColumn("_due", F.col("t") + p.max_hold * p.coarse_ms)
         .join(grid.select(F.col("boundary").alias("_due"), "_time"), "_due", "left"))
    hit = F.when(F.col("side") > 0, F.col("_long")).otherwise(F.col("_short"))
    trailing = hit.isNotNull() & (F.col("_time").isNull() | (hit <= F.col("_time")))
    return x.select(*cands.columns, F.least(hit, F.col("_time")).alias("queue_t"),
                    F.when(trailing, "trailing_exit").when(F.col("_time").isNotNull(), "time_exit")
                    .alias("queue_reason"))


def first_touch(cands: DataFrame, bars: DataFrame, signals: DataFrame, rounds: DataFrame,
                p: Params = DEFAULTS, fan: int = 16) -> DataFrame:
    """Entry, exit, reason and net result of each candidate on its own.

    Entry at the open of the bar at ``t`` (none: cancelled). Stop and target are live from the
    entry bar; in one bar the stop comes first. A queued exit fills at the open of the next
    existing bar, unless that open is already beyond the stop. The first bar that reaches a limit
    is searched in a pyramid of lows and highs with ``fan`` blocks per node, so a candidate that
    is never filled costs no more than any other, whatever is left of its series.
    """
    queued = queued_exits(cands.select("entity", "t", "side", "rank", "r_dist"), signals, rounds, p)
    o = bars.select("entity", F.col("ts").alias("t"), F.col("open").alias("_o"))
    entered = (queued.join(o, ID, "left")
               .withColumn("entry_fill", entry_fill("_o", "side", "rank", p))
               .withColumn("stop", F.col("entry_fill") - F.col("side") * F.col("r_dist"))
               .withColumn("target", F.col("entry_fill")
                           + F.col("side") * F.lit(p.target_mult) * F.col("r_dist")).drop("_o"))
    # exits queue on the coarse grid: the first bar of each window is all the lookup needs
    first_bars = bars.groupBy("entity", floor_to("ts", p.coarse_ms).alias("_win")).agg(
        F.min("ts").alias("fill_t"), F.min_by("open", "ts").alias("fill_open"))
    filled = asof_join(entered, first_bars, ["entity"], "queue_t", "_win", ["fill_t", "fill_open"],
                       inclusive=True, direction="forward", bucket_ms=30 * DAY)
    is_long = F.col("side") > 0
    held = filled.filter(F.col("entry_fill").isNotNull()).select(
        *ID, "side", "stop", "target", "fill_t", F.when(is_long, F.col("stop")).otherwise(F.col("target")).alias("_floor"),
        F.when(is_long, F.col("target")).otherwise(F.col("stop")).alias("_ceil"))
    held = materialize(held.withColumn("_lo", F.col("t")))
    tower = pyramid(bars, ["entity"], "ts", "low", "high", ["open"], p.fine_ms, fan)
    hit = first_crossing(held, tower, ID, "_lo", "_floor", "_ceil")
    low, high = F.col("hit.low"), F.col("hit.high")
    at_stop = F.when(is_long, low <= F.col("stop")).otherwise(high >= F.col("stop"))
    at_target = F.when(is_long, high >= F.col("target")).otherwise(low <= F.col("target"))
    touch = (held.join(hit, ID).filter(F.col("fill_t").isNull() | (F.col("hit.id") < F.col("fill_t")))
             .select(*ID, F.struct(F.col("hit.id").alias("ts"), F.col("hit.open").alias("open"), at_stop.alias("stop"),
                                   (at_stop & at_target).alias("both")).alias("_x")))
    ref = F.when(is_long, F.least("stop", F.col("_x.open"))).otherwise(
        F.greatest("stop", F.col("_x.open")))
    gap = F.when(is_long, F.col("fill_open") <= F.col("stop")).otherwise(
        F.col("fill_open") >= F.col("stop"))
    none, entered_, touched = F.lit(None), F.col("entry_fill").isNotNull(), F.col("_x").isNotNull()
    mult = p.stop_slip_mult
    reason = (F.when(~entered_, "cancelled")
              .when(touched, F.when(F.col("_x.stop"), "stop").otherwise("target"))
              .when(F.col("fill_t").isNotNull(), F.when(gap, "stop").otherwise(F.col("queue_reason")))
              .otherwise("still_open"))
    price = (F.when(touched & F.col("_x.stop"), exit_fill(ref, "side", "rank", mult, p))
             .when(touched, F.col("target"))
             .when(entered_ & F.col("fill_t").isNotNull(),
                   F.when(gap, exit_fill("fill_open", "side", "rank", mult, p))
                   .otherwise(exit_fill("fill_open", "side", "rank", 1.0, p))).otherwise(none))
    out = filled.join(touch, ID, "left").select(
        *ID, "side", "rank", "r_dist", "entry_fill", "stop", "target", reason.alias("reason"),
        F.when(touched, F.col("_x.ts")).when(entered_, F.col("fill_t")).alias("exit_t"),
        price.alias("exit_fill"), F.coalesce("_x.both", F.lit(False)).alias("ambiguous"))
    gross = F.col("side") * (F.col("exit_fill") - F.col("entry_fill"))
    fees = F.lit(p.fee) * (F.col("entry_fill") + F.col("exit_fill"))
    return out.withColumn("net_r", (gross - fees) / F.col("r_dist"))


def rate_marks(rates: DataFrame, bars: DataFrame) -> DataFrame:
    """``entity, ts, rate, mark``: each rate with the last close strictly before its time, or its
    bar's own open where there is no earlier close. One lookup per rate, whoever holds it."""
    closes = bars.select("entity", F.col("ts").alias("_bar"), F.col("close").alias("_close"))
    marked = asof_join(rates.select("entity", "ts", "rate"), closes, ["entity"], "ts", "_bar", ["_close"], bucket_ms=30 * DAY)
    opens = bars.select("entity", "ts", F.col("open").alias("_open"))
    return marked.join(opens, ["entity", "ts"], "left").select("entity", "ts", "rate", F.coalesce("_close", "_open").alias("mark"))


def rate_accrual(positions: DataFrame, rates: DataFrame, bars: DataFrame,
                 p: Params = DEFAULTS) -> DataFrame:
    """Paid rates of each position over ``(entry_t, exit_t]`` on the rate grid.

    An absent rate is counted, never filled. Marks come from ``rate_marks``, shared by all positions.
    """
    step = p.rate_ms
    first = floor_to(F.col("entry_t"), step) + step
    last = floor_to(F.col("exit_t"), step)
    grid = (positions.filter(first <= last).withColumn(
        "ts", F.explode(F.sequence(first, last, F.lit(step).cast("bigint")))))
    marked = grid.join(rate_marks(rates, bars), ["entity", "ts"], "left")
    paid = F.col("rate") * F.col("qty") * F.col("mark") * F.col("side")
    sums = marked.groupBy("entity", "t").agg(
        F.count("rate").alias("applied"), F.count_if(F.col("rate").isNull()).alias("missing"),
        F.coalesce(F.sum(paid), F.lit(0.0)).alias("paid"))
    zero = F.lit(0).cast("bigint")
    return positions.join(sums, ID, "left").select(
        *positions.columns, F.coalesce("applied", zero).alias("applied"),
        F.coalesce("missing", zero).alias("missing"), F.coalesce("paid", F.lit(0.0)).alias("paid"))


def episode_windows(labels: DataFrame, bars: DataFrame, end: int, p: Params = DEFAULTS,
                    bucket_ms: int = DAY, marks: DataFrame | None = None) -> DataFrame:
    """Fine bars of every executed label from the bar after ``t`` to one coarse bar past the
    exit; an episode without bars disappears.

    Labels with a ``rank`` get the ``half_spread, slip, fee`` of their cost tier; with ``marks``
    (of ``rate_marks``) bars at a rate time get its ``rate`` and ``mark``, others NULL.
    """
    spans = labels.filter("exit_t is not null").withColumns({
        "_lo": F.col("t") + p.fine_ms,
        "_hi": F.least(F.col("exit_t") + p.coarse_ms, F.lit(end))})
    if "rank" in labels.columns:
        spans = spans.withColumns({"half_spread": by_tier("rank", p.half_spread, p), "slip": by_tier("rank", p.slippage, p),
                                   "fee": F.lit(p.fee)})
    if marks is not None:
        bars = bars.join(marks, ["entity", "ts"], "left")
    return interval_join(spans, bars, ["entity"], "_lo", "_hi", "ts", bucket_ms).drop("_lo", "_hi")


def asof_defined(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str,
                 value: str, fallback: str, out: str) -> DataFrame:
    """Latest positive finite ``value`` at or before the time, else the fallback column."""
    good = right.filter((F.col(value) > 0) & (F.col(value) < float("inf"))).select(
        *by, right_ts, F.col(value).alias(out))
    hit = asof_join(left, good, by, left_ts, right_ts, [out], inclusive=True)
    return hit.withColumn(out, F.coalesce(out, fallback))


def episode_observations(labels: DataFrame, bars: DataFrame, signals: DataFrame,
                         exposure: DataFrame, p: Params = DEFAULTS,
                         bucket_ms: int = DAY) -> DataFrame:
    """Ten clipped state columns at each coarse boundary at which an episode is open.

    ``labels``: ``entity, t, side, r_dist, entry_fill, stop, target, exit_t, atr``. Bars reduce
    to one row per episode and coarse window before anything runs over an episode, whose
    windows are limited by the holding period.
    """
    spans = labels.filter("exit_t is not null").withColumn("_hi", F.col("exit_t") - 1)
    step = p.coarse_ms
    best = F.when(F.col("side") > 0, F.col("high")).otherwise(F.col("low"))
    worst = F.when(F.col("side") > 0, F.col("low")).otherwise(F.col("high"))
    move = F.col("side") * (best - F.col("entry_fill"))
    drop = F.col("side") * (worst - F.col("entry_fill"))
    keep = ["side", "r_dist", "entry_fill", "stop", "target", "exit_t", "atr"]
    per = (interval_join(spans.withColumn("_lo", F.col("t")), bars, ["entity"], "_lo", "_hi", "ts",
                         bucket_ms)
           .groupBy(*ID, *keep, (floor_to("ts", step) + step).alias("b"))
           .agg(F.max(move).alias("_m"), F.min(drop).alias("_d"), F.max_by("close", "ts").alias("mark"))
           .filter(F.col("b") <= F.col("exit_t")))
    w = W.partitionBy(*ID).orderBy("b").rowsBetween(W.unboundedPreceding, 0)
    state = per.withColumns({"_mfe": F.greatest(F.lit(0.0), F.max("_m").over(w)),
                             "_mae": F.least(F.lit(0.0), F.min("_d").over(w))})
    state = asof_defined(state, signals.select("entity", F.col("boundary").alias("_sb"),
                                               F.col("atr").alias("_a")),
                         ["entity"], "b", "_sb", "_a", "atr", "atr_now")
    frac = F.when(F.col("equity") > 0, F.col("gross_exposure") / F.col("equity")).otherwise(F.lit(5.0))
    expo = exposure.select(F.col("t").alias("_et"), frac.alias("_expo"))
    state = asof_join(state, expo, [], "b", "_et", ["_expo"], inclusive=True)
    r = F.col("r_dist")
    unreal = F.col("side") * (F.col("mark") - F.col("entry_fill")) / r
    held = F.call_function("div", F.col("b") - F.col("t"), F.lit(step).cast("bigint"))
    return state.select(
        *ID, F.col("b").alias("boundary"),
        clip_finite(unreal, -10.0, 10.0).alias("unrealized_r"),
        clip_finite(held / F.lit(float(p.max_hold)), 0.0, 1.0).alias("time_frac"),
        clip_finite(F.col("_mfe") / r, 0.0, 10.0).alias("mfe_r"),
        clip_finite(-F.col("_mae") / r, 0.0, 10.0).alias("mae_r"),
        clip_finite(F.coalesce(safe_div("atr_now", "atr"), F.lit(1.0)), 0.1, 10.0).alias("vol_ratio"),
        clip_finite(F.col("_mfe") / r - unreal, 0.0, 20.0).alias("giveback_r"),
        clip_finite(F.col("side") * (F.col("mark") - F.col("stop")) / r, 0.0, 10.0)
        .alias("dist_stop_r"),
        clip_finite(F.col("side") * (F.col("target") - F.col("mark")) / r, -10.0, 10.0)
        .alias("dist_target_r"),
        F.lit(1.0).alias("remaining_frac"),
        clip_finite(F.coalesce("_expo", F.lit(0.0)), 0.0, 5.0).alias("exposure_frac"))


