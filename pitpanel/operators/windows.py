"""Trailing-window indicators over completed coarse bars.

Bars are unique per ``(entity, boundary)`` on a fixed grid, so an entity holds at most
``time span / step`` of them (about 2,200 per year at four hours) whatever the data volume:
windows per entity are bounded by the calendar. Frames count bars, not hours.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitpanel.params import DEFAULTS, Params
from pitpanel.plans.sliding import trailing_quantile

BY, TS = "entity", "boundary"


def _w(by, ts):
    return W.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(ts)


def framed(agg: Column, value: Column, n: int, w, before: bool = False) -> Column:
    """``agg`` over the last ``n`` rows (strictly before the row with ``before``); NULL unless
    all ``n`` values are defined."""
    frame = w.rowsBetween(-n, -1) if before else w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, agg.over(frame))


def channel_prior(df: DataFrame, n: int, hi: str, lo: str, by=BY, ts=TS) -> DataFrame:
    w = _w(by, ts)
    return df.withColumns({
        hi: framed(F.max("high"), F.col("high"), n, w, before=True),
        lo: framed(F.min("low"), F.col("low"), n, w, before=True)})


def true_range(df: DataFrame, by=BY, ts=TS) -> DataFrame:
    prev = F.lag("close").over(_w(by, ts))
    return df.withColumn("tr", F.greatest(F.col("high") - F.col("low"),
                                          F.abs(F.col("high") - prev),
                                          F.abs(F.col("low") - prev)))


def wilder_atr(df: DataFrame, n: int, by=BY, ts=TS, out: str = "atr",
               chunk: int | None = None) -> DataFrame:
    """Smoothed true range ``a = (a*(n-1) + tr)/n`` seeded by the mean of the first ``n``.

    The recursion is affine, so it is solved per chunk of rows with window sums of
    ``tr * p^-j``; only one carry per chunk is folded, then every row is completed from its
    chunk's carry. Chunks are short enough that ``p^-j`` stays far from overflow.
    """
    keys = [by] if isinstance(by, str) else list(by)
    p, q = (n - 1) / n, 1.0 / n
    size = chunk or max(16, int(200 / math.log(n / (n - 1))))
    w = _w(by, ts)
    ranged = (true_range(df, by, ts)
              .withColumn("_i", F.row_number().over(w).cast("bigint") - 1)
              .withColumn("_seed", F.avg("tr").over(w.rowsBetween(-(n - 1), 0))))
    # the recursion starts at row n (0-based); the seed is the value at row n-1
    step = F.col("_i") - n
    ranged = (ranged.withColumn("_chunk", F.when(step >= 0, F.floor(step / size)))
              .withColumn("_j", F.when(step >= 0, F.pmod(step, F.lit(size)) + 1)))
    local = W.partitionBy(*keys, "_chunk").orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    ranged = ranged.withColumn(
        "_s", F.sum(F.lit(q) * F.col("tr") * F.pow(F.lit(p), -F.col("_j"))).over(local))
    ends = (ranged.filter("_chunk is not null").groupBy(*keys, "_chunk")
            .agg(F.max("_j").alias("len"), F.max_by("_s", "_j").alias("s")))
    seeds = ranged.filter(F.col("_i") == n - 1).select(*keys, F.col("_seed").alias("_a0"))
    folded = (ends.groupBy(*keys)
              .agg(F.array_sort(F.collect_list(F.struct("_chunk", "len", "s"))).alias("_c"))
              .join(seeds, keys)
              .select(*keys, F.explode(F.expr(f"""
                  aggregate(_c,
                    cast(array(struct(cast(0 as bigint) as _chunk, _a0 as _start))
                         as array<struct<_chunk:bigint,_start:double>>),
                    (acc, x) -> concat(acc, array(struct(x._chunk + 1 as _chunk,
                      pow({p!r}D, x.len) * (element_at(acc, -1)._start + x.s) as _start))))
                  """)).alias("_f"))
              .select(*keys, "_f._chunk", "_f._start"))
    smooth = (F.when(F.col("_i") == n - 1, F.col("_seed"))
              .when(F.col("_i") >= n, F.pow(F.lit(p), F.col("_j")) * (F.col("_start") + F.col("_s"))))
    return (ranged.join(folded, keys + ["_chunk"], "left")
            .withColumn(out, F.when(F.col("_i") >= 3 * n - 1, smooth))
            .drop("_i", "_seed", "_chunk", "_j", "_s", "_start", "tr"))


def log_returns(df: DataFrame, lags, by=BY, ts=TS) -> DataFrame:
    w, ln = _w(by, ts), F.ln("close")
    return df.withColumns({f"ret_{k}": ln - F.lag(ln, k).over(w) for k in lags})


def rolling_std(df: DataFrame, value: str, n: int, out: str, by=BY, ts=TS) -> DataFrame:
    return df.withColumn(out, framed(F.stddev_samp(value), F.col(value), n, _w(by, ts)))


def rolling_mean(df: DataFrame, value: str, n: int, out: str, by=BY, ts=TS) -> DataFrame:
    return df.withColumn(out, framed(F.avg(value), F.col(value), n, _w(by, ts)))


def signed_run(df: DataFrame, clip: int = 10, by=BY, ts=TS, hi="hh_entry", lo="ll_entry",
               out: str = "run") -> DataFrame:
    """Consecutive closes above (+) or below (-) the channel midpoint, clipped.

    Because the result is clipped, the last ``clip`` signs decide it: a bounded frame instead
    of islands over the whole history.
    """
    mid = (F.col(hi) + F.col(lo)) / 2.0
    sign = F.when(F.col("close") > mid, 1).when(F.col("close") < mid, -1).otherwise(0)
    signs = F.reverse(F.collect_list(sign).over(_w(by, ts).rowsBetween(-(clip - 1), 0)))
    breaks = F.transform(signs, lambda s: s != signs[0])
    first_break = F.array_position(breaks, True)
    length = F.when(first_break == 0, F.size(signs)).otherwise(first_break - 1)
    return df.withColumn(out, (signs[0] * length).cast("bigint"))


def regime(df: DataFrame, p: Params = DEFAULTS, by=BY, ts=TS) -> DataFrame:
    """Market state of each bar of a (context) series, with the reason columns."""
    w = _w(by, ts)
    base = (log_returns(df, (1,), by, ts)
            .withColumn("_n", F.row_number().over(w))
            .withColumn("sma_fast", framed(F.avg("close"), F.col("close"), p.sma_fast, w))
            .withColumn("sma_slow", framed(F.avg("close"), F.col("close"), p.sma_slow, w))
            .withColumn("rvol", framed(F.stddev_samp("ret_1"), F.col("ret_1"), p.vol_short, w)))
    base = trailing_quantile(base, "rvol", p.vol_history, p.vol_quantile, p.vol_short, "rvol_q", by, ts)
    short = F.col("_n") < p.sma_slow + 1
    state = (F.when(short, "stress")
             .when(F.col("rvol") > F.col("rvol_q"), "stress")
             .when((F.col("close") > F.col("sma_fast")) & (F.col("sma_fast") > F.col("sma_slow")),
                   "uptrend")
             .when((F.col("close") < F.col("sma_fast")) & (F.col("sma_fast") < F.col("sma_slow")),
                   "downtrend")
             .otherwise("sideways"))
    return (base.withColumn("regime", state).withColumn("insufficient_history", short)
            .drop("_n", "ret_1"))


def regime_at(grid: DataFrame, states: DataFrame, ts=TS) -> DataFrame:
    """State at every boundary of ``grid``; one without a bar is stress, flagged as too short a history."""
    known = states.select(ts, "regime", "insufficient_history")
    return (grid.select(ts).join(known, ts, "left")
            .withColumn("insufficient_history", F.coalesce("insufficient_history", F.lit(True)))
            .withColumn("regime", F.coalesce("regime", F.lit("stress"))))


# Size multiplier per state and side.
REGIME_MULTIPLIERS = {
    "stress": {1: 0.50, -1: 0.50},
    "uptrend": {1: 1.00, -1: 0.00},
    "downtrend": {1: 0.00, -1: 1.00},
    "sideways": {1: 0.50, -1: 0.50},
}
# Integer code per state in feature tables.
REGIME_CODES = {"uptrend": 0, "downtrend": 1, "sideways": 2, "stress": 3}


def regime_multiplier(state: Column, side: Column) -> Column:
    pairs = [F.lit(x) for s, m in REGIME_MULTIPLIERS.items() for d, v in m.items()
             for x in (f"{s}:{d}", v)]
    return F.element_at(F.create_map(*pairs), F.concat(state, F.lit(":"), side.cast("string")))


def signals(df: DataFrame, p: Params = DEFAULTS, by=BY, ts=TS) -> DataFrame:
    """Entry and exit channels and the smoothed range on every bar; one shuffle by entity."""
    w = _w(by, ts)
    cols = {}
    for name, n in (("entry", p.channel_entry), ("exit", p.channel_exit)):
        cols[f"hh_{name}"] = framed(F.max("high"), F.col("high"), n, w, before=True)
        cols[f"ll_{name}"] = framed(F.min("low"), F.col("low"), n, w, before=True)
    return wilder_atr(df.withColumns(cols), p.atr_n, by, ts)


def feature_series(sig: DataFrame, p: Params = DEFAULTS, by=BY, ts=TS) -> DataFrame:
    """Returns, volatilities, averages and run length on top of ``signals``."""
    w = _w(by, ts)
    out = log_returns(sig, sorted(set(p.return_lags) | {1}), by, ts)
    out = out.withColumns({
        "rvol_short": framed(F.stddev_samp("ret_1"), F.col("ret_1"), p.vol_short, w),
        "rvol_long": framed(F.stddev_samp("ret_1"), F.col("ret_1"), p.vol_long, w),
        "sma_short": framed(F.avg("close"), F.col("close"), p.vol_short, w),
        "sma_long": framed(F.avg("close"), F.col("close"), p.vol_long, w)})
    return signed_run(out, p.run_clip, by, ts)


def running_excursion(df: DataFrame, episode: list[str], ts: str, side: str, entry: str,
                      unit: str) -> DataFrame:
    """Best and worst move from entry so far, in units of the initial risk."""
    w = W.partitionBy(*episode).orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    best = F.when(F.col(side) > 0, F.col("high")).otherwise(F.col("low"))
    worst = F.when(F.col(side) > 0, F.col("low")).otherwise(F.col("high"))
    return df.withColumns({
        "mfe_r": F.greatest(F.lit(0.0), F.max(F.col(side) * (best - F.col(entry))).over(w))
        / F.col(unit),
        "mae_r": F.least(F.lit(0.0), F.min(F.col(side) * (worst - F.col(entry))).over(w))
        / F.col(unit)})


