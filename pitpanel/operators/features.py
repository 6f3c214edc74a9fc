"""As-of rate context and the 28-column feature projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitpanel.functions.columns import day_of, safe_div
from pitpanel.operators.candidates import context_join, round_context
from pitpanel.operators.windows import REGIME_CODES
from pitpanel.params import DAY, DEFAULTS, Params
from pitpanel.plans.asof import asof_join

# Canonical column order of the feature table.
FEATURES = [
    "F01_side", "F02_atr_pct", "F03_breakout_strength", "F04_channel_width", "F05_rank_frac",
    "F06_n_eligible", "F07_ret_1", "F08_ret_5", "F09_ret_20", "F10_ret_60", "F11_rvol_20",
    "F12_rvol_ratio", "F13_trend_sma20", "F14_trend_sma60", "F15_dist_opposite",
    "F16_breakout_run", "F17_ctx_ret_5", "F18_ctx_ret_20", "F19_ctx_ret_60", "F20_ctx_rvol_20",
    "F21_breadth_sma20", "F22_round_side_count", "F23_regime_code", "F24_log_liq",
    "F25_rate_last", "F26_rate_mean_3d", "F27_hour_slot", "F28_dow",
]


def trailing_rates(rates: DataFrame, by: str, ts: str, value: str, k: int, out: str) -> DataFrame:
    """Mean of the last ``k`` events (fewer at the start) on each event row.

    Numbering by bucketed counts keeps a busy entity out of one task: rows are cut into blocks
    of positions and each block receives the ``k - 1`` rows before it.
    """
    from pitpanel.plans.ordered import time_bucket, with_position
    block = max(50_000, 10 * k)
    placed = with_position(rates, [by], [ts], time_bucket(ts, 30 * DAY), "_i")
    blk = F.call_function("div", F.col("_i"), F.lit(block).cast("bigint"))
    own = F.pmod(F.col("_i"), F.lit(block))
    spread = placed.withColumn("_blk", F.explode(
        F.when(own >= block - (k - 1), F.array(blk, blk + 1)).otherwise(F.array(blk))))
    w = W.partitionBy(by, "_blk").orderBy("_i").rowsBetween(-(k - 1), 0)
    return (spread.withColumn(out, F.avg(value).over(w))
            .filter(F.col("_blk") == blk).drop("_i", "_blk"))


def asof_trailing_mean(left: DataFrame, right: DataFrame, by: list[str], left_ts: str,
                       right_ts: str, value: str, k: int, last: str, mean: str) -> DataFrame:
    """Last value and mean of the last ``k`` values strictly before the left time."""
    pre = trailing_rates(right, by[0], right_ts, value, k, mean).withColumn(last, F.col(value))
    return asof_join(left, pre, by, left_ts, right_ts, [last, mean])


def features_28(cands: DataFrame, series: DataFrame, ctx: DataFrame, regime: DataFrame,
                breadth: DataFrame, rates: DataFrame, p: Params = DEFAULTS,
                rate_k: int = 9) -> DataFrame:
    """Feature rows of candidates; everything joined is known at the decision time.

    ``cands`` carries the round columns (``rank, n_eligible, liq_median``); ``series`` is the
    output of ``feature_series``; ``ctx`` is its context-entity slice.
    """
    lags = p.return_lags
    own_cols = [f"ret_{k}" for k in lags] + ["rvol_short", "rvol_long", "sma_short", "sma_long", "run"]
    own = series.select("entity", F.col("boundary").alias("t"), *own_cols)
    x = round_context(cands).join(own, ["entity", "t"])
    state = regime.select("boundary", "regime")
    side_ctx = ctx.join(state, "boundary")
    x = context_join(x, side_ctx, "t", {
        "c5": f"ret_{lags[1]}", "c20": f"ret_{lags[2]}", "c60": f"ret_{lags[3]}",
        "cvol": "rvol_short", "state": "regime"})
    x = x.join(breadth.withColumnRenamed("boundary", "t"), "t", "left")
    x = asof_trailing_mean(x, rates, ["entity"], "t", "ts", "rate", rate_k, "rate_last", "rate_mean")
    side, atr, close = F.col("side"), F.col("atr"), F.col("close")
    breached = F.when(side > 0, F.col("hh_entry")).otherwise(F.col("ll_entry"))
    opposite = F.when(side > 0, F.col("ll_exit")).otherwise(F.col("hh_exit"))
    code = F.element_at(F.create_map(*[F.lit(v) for kv in REGIME_CODES.items() for v in kv]),
                        F.col("state"))
    slot = F.call_function("div", F.col("t"), F.lit(p.coarse_ms).cast("bigint"))
    per_day = max(1, DAY // p.coarse_ms)
    exprs = [
        side, atr / close, side * (close - breached) / atr,
        (F.col("hh_entry") - F.col("ll_entry")) / close,
        (F.col("rank") - 1) / F.greatest(F.lit(1), F.col("n_eligible")), F.col("n_eligible"),
        *[F.col(f"ret_{k}") for k in lags], F.col("rvol_short"),
        safe_div("rvol_short", "rvol_long"), (close - F.col("sma_short")) / atr,
        (close - F.col("sma_long")) / atr, side * (close - opposite) / atr,
        (side * F.col("run")).cast("double"), F.col("c5"), F.col("c20"), F.col("c60"),
        F.col("cvol"), F.col("breadth"), F.col("round_side_count"), code.cast("bigint"),
        F.log10("liq_median"), F.col("rate_last"), F.col("rate_mean"),
        F.pmod(slot, F.lit(per_day)), F.pmod(day_of("t") + 4, F.lit(7)),
    ]
    return x.select("entity", "t", *[e.alias(n) for e, n in zip(exprs, FEATURES, strict=True)])
