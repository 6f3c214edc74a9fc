"""Loss pauses, size limits, action filters, stage funnels and admission in rank order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitpanel.functions.columns import div
from pitpanel.params import DAY, DEFAULTS, Params
from pitpanel.plans.ordered import with_position, with_time_key_bucket


def pause_flags(df: DataFrame, by: list[str], t: str, equity: str, p: Params = DEFAULTS,
                day_ms: int = DAY) -> DataFrame:
    """Daily-loss and trailing-drawdown pauses as of each snapshot.

    Peaks of earlier days come from a per-day aggregate, the running peak of the current day
    from a window inside ``(by, day)``; no window spans an account's whole history of rows.
    """
    keyed = df.withColumn("_day", div(t, day_ms))
    peaks = keyed.groupBy(*by, "_day").agg(F.max(equity).alias("_peak"))
    past = W.partitionBy(*by).orderBy("_day").rangeBetween(-p.drawdown_days, -1)
    before = peaks.select(*by, "_day", F.max("_peak").over(past).alias("_before"))
    inside = W.partitionBy(*by, "_day").orderBy(t).rowsBetween(W.unboundedPreceding, 0)
    start = F.first(equity).over(inside)
    rows = (keyed.join(before, by + ["_day"])
            .withColumn("day_start", start)
            .withColumn("peak", F.greatest(F.max(equity).over(inside), F.col("_before"))))
    loss = (F.col("day_start") > 0) & (
        (F.col("day_start") - F.col(equity)) / F.col("day_start") >= p.daily_loss)
    down = (F.col("peak") > 0) & ((F.col("peak") - F.col(equity)) / F.col("peak") >= p.drawdown_limit)
    return (rows.withColumn("daily_loss", loss).withColumn("drawdown", down)
            .withColumn("paused", F.when(loss, "daily_loss_limit").when(down, "drawdown_limit"))
            .drop("_day", "_before"))


def size_limits(df: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Decision, allowed quantity and reason per request joined with its account state.

    Needs ``qty, price, stop_distance, side, data_complete, has_stop, paused, equity,
    gross_exposure, long_exposure, short_exposure, n_positions``.
    """
    zero = F.lit(0.0)
    used = F.when(F.col("side") > 0, F.col("long_exposure")).otherwise(F.col("short_exposure"))
    cap = F.least(
        F.col("qty"),
        F.try_divide(F.lit(p.max_risk) * F.col("equity"), F.col("stop_distance")),
        F.greatest(zero, F.lit(p.max_gross) * F.col("equity") - F.col("gross_exposure"))
        / F.col("price"),
        F.greatest(zero, F.lit(p.max_directional) * F.col("equity") - used) / F.col("price"))
    reason = (F.when(~F.col("data_complete"), "missing_data_fail_safe")
              .when(~F.col("has_stop") | (F.col("stop_distance") <= 0), "no_protective_stop")
              .when(F.col("paused").isNotNull(), F.col("paused"))
              .when(F.col("equity") <= 0, "non_positive_equity")
              .when(F.col("n_positions") >= p.max_positions, "max_positions")
              .when(F.col("_cap") * F.col("price") < p.min_notional, "insufficient_capacity"))
    out = df.withColumn("_cap", cap).withColumn("_reject", reason)
    fits = F.col("_cap") >= F.col("qty")
    return out.select(
        *df.columns,
        F.when(F.col("_reject").isNotNull(), "reject").when(fits, "approve")
        .otherwise("restrict").alias("decision"),
        F.when(F.col("_reject").isNotNull(), zero).when(fits, F.col("qty"))
        .otherwise(F.col("_cap")).alias("allowed_qty"),
        F.coalesce("_reject", F.when(fits, "ok").otherwise("restricted_to_fit_limits"))
        .alias("reason"))


# Management actions that can only lower risk, and those left in an emergency.
RISK_REDUCING = ["hold", "reduce_25", "reduce_50", "close", "tighten_stop", "move_stop_breakeven"]
EMERGENCY_ACTIONS = ["close", "reduce_25", "reduce_50", "hold"]


def risk_action_filter(df: DataFrame, action: str, emergency: str) -> DataFrame:
    a, stop = F.col(action), F.col(emergency)
    why = (F.when(stop & ~a.isin(EMERGENCY_ACTIONS), "emergency_pause")
           .when(~a.isin(RISK_REDUCING), "not_risk_reducing"))
    return df.withColumn("reason", why).withColumn("allowed", why.isNull())


def stage_funnel(df: DataFrame, top_k: int) -> DataFrame:
    """First stage that stops a candidate. Needs ``t, entity, is_open, accepted, score, bucket,
    regime_mult``; the rank counts only candidates without an open position."""
    # only the best k are ranked (cut before the shuffle); the rest of a busy round stays spread
    w = W.partitionBy("t").orderBy(F.desc("score"), "entity")
    best = (df.filter(~F.col("is_open")).select("t", "entity", "score")
            .withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= top_k)
            .select("t", "entity", "_rank"))
    mult = F.least("bucket", "regime_mult")
    ranked = df.join(best, ["t", "entity"], "left")
    stage = (F.when(F.col("is_open"), "already_open")
             .when(~F.col("accepted"), "filter_rejected")
             .when(F.col("_rank").isNull(), "rank_cut")
             .when(mult <= 0, "regime_blocked").otherwise("submitted"))
    return (ranked.withColumn("stage", stage)
            .withColumn("multiplier", F.when(F.col("stage") == "submitted", mult)).drop("_rank"))


def greedy_admit(df: DataFrame, by: list[str], order: list[str], size: str, cap: Column,
                 max_n: int, min_size: float = 0.0) -> DataFrame:
    """Admit rows of a round in order while count and capacity allow; a refused row consumes
    nothing. Rows that repeat an order key follow each other by size; one without a size is
    refused like one below ``min_size``.

    Each pass finds the next admitted row of every round with one partial aggregate, so there are
    at most ``max_n`` passes and no round is collected, whatever its size.
    """
    again = W.partitionBy(*by, *order).orderBy(F.col(size).asc_nulls_last())
    df = df.withColumn("_again", F.row_number().over(again))
    key = F.struct(*order, "_again")
    taken = df.groupBy(*by).agg(F.first(cap).alias("_cap")).select(
        *by, "_cap", F.array().cast(f"array<struct<k:{df.select(key).schema[0].dataType.simpleString()},"
                                    "s:double>>").alias("_adm"))
    for _ in range(max_n):
        used = F.aggregate("_adm", F.lit(0.0), lambda a, x: a + x["s"])
        last = F.try_element_at(F.col("_adm.k"), F.lit(-1))
        nxt = (df.join(taken, by).filter(
            (F.col(size) >= min_size) & (used + F.col(size) <= F.col("_cap"))
            & ((F.size("_adm") == 0) | (key > last)))
            .groupBy(*by).agg(F.min(F.struct(key.alias("k"), F.col(size).alias("s"))).alias("_nx")))
        taken = taken.join(nxt, by, "left").select(
            *by, "_cap", F.when(F.col("_nx").isNull(), F.col("_adm"))
            .otherwise(F.concat("_adm", F.array("_nx"))).alias("_adm"))
    rows = df.join(taken, by)
    earlier = F.filter("_adm", lambda x: x["k"] < key)
    fit = (F.when(F.col(size).isNull() | (F.col(size) < min_size), "min_notional")
           .when(F.array_contains("_adm.k", key), "admitted")
           .when(F.size(earlier) >= max_n, "max_positions").otherwise("capacity"))
    return rows.select(*by, *order, size, fit.alias("outcome"))


def stable_order(df: DataFrame, t: str, key: str, out: str = "seq") -> DataFrame:
    """Position of every row in the order ``(t, key)``, ``key`` a unique number within ``t``."""
    return with_position(with_time_key_bucket(df, t, key), [], [t, key], F.col("_tk"), out).drop("_tk")
