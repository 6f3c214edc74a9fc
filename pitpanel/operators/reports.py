"""Curve, trade and run metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitpanel.functions.columns import month_of
from pitpanel.params import DAY, DEFAULTS, Params
from pitpanel.plans.ordered import (exact_quantiles, previous, running, time_bucket, with_position,
                                    with_value_bucket)


# ---------------------------------------------------------------- curves
def curve_returns(df: DataFrame, by: list[str], t: str, equity: str,
                  bucket_ms: int = 30 * DAY) -> DataFrame:
    prev = previous(df, by, [t], time_bucket(t, bucket_ms), {"_prev": F.col(equity)})
    return prev.withColumn("ret", F.col(equity) / F.col("_prev") - 1).drop("_prev")


def max_drawdown(df: DataFrame, by: list[str], t: str, value: str, mode: str = "fraction",
                 bucket_ms: int = 30 * DAY) -> DataFrame:
    """fraction: ``max(1 - equity / running peak)``; cumulative: running sums of ``value``
    against a peak floored at zero, in absolute terms."""
    b = time_bucket(t, bucket_ms)
    if mode == "cumulative":
        df = running(df, by, [t], b, {"_level": ("sum", F.col(value))})
        peak = running(df, by, [t], b, {"_peak": ("max", F.col("_level"))})
        depth = F.greatest(F.col("_peak"), F.lit(0.0)) - F.col("_level")
    else:
        peak = running(df, by, [t], b, {"_peak": ("max", F.col(value))})
        depth = F.when(F.col("_peak") > 0, 1 - F.col(value) / F.col("_peak"))
    out = F.coalesce(F.max(depth), F.lit(0.0)).alias("max_drawdown")
    return peak.groupBy(*by).agg(out) if by else peak.agg(out)


def path_summary(df: DataFrame, by: list[str], t: str, value: str, bucket: Column) -> DataFrame:
    """Summaries of consecutive stretches of a path of increments: ``by, bucket, total, top``.

    ``top`` is the highest level inside a stretch, counted from its start. Two neighbours merge to
    ``(total + total', greatest(top, total + top'))``, so stretches may be summed up in any grouping.
    """
    inside = W.partitionBy(*by, "_bucket").orderBy(t).rowsBetween(W.unboundedPreceding, 0)
    level = df.withColumn("_bucket", bucket).withColumn("_in", F.sum(value).over(inside))
    return level.groupBy(*by, "_bucket").agg(F.sum(value).alias("total"), F.max("_in").alias("top"))


def drawdown_quantile(df: DataFrame, by: list[str], t: str, value: str, q: float = 0.95,
                      bucket_ms: int = 30 * DAY) -> DataFrame:
    """Exact quantile over a path's steps of how far its cumulative sum lies below its peak.

    The peak is floored at zero, as the path starts there. ``(by, t)`` is unique; steps without a value
    are left out, and a path without any has no row. Only the table of stretches is scanned per path.
    """
    steps = df.filter(F.col(value).isNotNull())
    bucket = time_bucket(t, bucket_ms)
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    base = path_summary(steps, by, t, value, bucket).withColumn("_base", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    peak = F.greatest(F.lit(0.0), F.max(F.col("_base") + F.col("top")).over(before))
    carried = base.withColumn("_peak", peak).select(*by, "_bucket", "_base", "_peak")
    inside = W.partitionBy(*by, "_bucket").orderBy(t).rowsBetween(W.unboundedPreceding, 0)
    level = (steps.withColumn("_bucket", bucket).join(carried, [*by, "_bucket"])
             .withColumn("_level", F.col("_base") + F.sum(value).over(inside)))
    depth = level.withColumn("_depth", F.greatest("_peak", F.max("_level").over(inside)) - F.col("_level"))
    return exact_quantiles(depth.select(*by, "_depth"), "_depth", [q], by).select(*by, F.col("quantile").alias("drawdown"))


def sortino_of(mean: Column, downside_sq: Column, periods: float = 1.0) -> Column:
    """Mean over downside deviation; without any downside 0 or a large constant."""
    dd = F.sqrt(downside_sq)
    return (F.when(dd == 0, F.when(mean <= 0, F.lit(0.0)).otherwise(F.lit(1e6)))
            .otherwise(mean / dd * F.lit(math.sqrt(periods))))


def downside(r: Column) -> Column:
    low = F.least(r, F.lit(0.0))
    return low * low


def sortino(df: DataFrame, by: list[str], r: str, periods: float = 1.0) -> DataFrame:
    return (df.filter(F.col(r).isNotNull()).groupBy(*by)
            .agg(F.avg(r).alias("_m"), F.avg(downside(F.col(r))).alias("_d"))
            .select(*by, sortino_of(F.col("_m"), F.col("_d"), periods).alias("sortino")))


def compounded(r: Column, part: Column) -> Column:
    """Product of ``1 + r`` over the rows of ``part``, less 1; 0 without rows.

    Sizes are summed as logarithms, so no partial product leaves the range of a double. A curve that
    crosses zero has factors below zero; their number gives the sign, and a factor of zero makes it zero.
    """
    factor = F.when(part, 1 + r)
    size = F.exp(F.coalesce(F.sum(F.ln(F.abs(factor))), F.lit(0.0)))
    signed = F.when(F.pmod(F.count_if(factor < 0), F.lit(2)) == 1, -size).otherwise(size)
    return F.when(F.count_if(factor == 0) > 0, F.lit(0.0)).otherwise(signed) - 1


def return_metrics(curve: DataFrame, by: list[str], t: str, equity: str,
                   p: Params = DEFAULTS, bucket_ms: int = 30 * DAY) -> DataFrame:
    """Net return, Sharpe, Sortino, Calmar, mean of the worst twentieth, product of halves."""
    rets = curve_returns(curve, by, t, equity, bucket_ms).filter("ret is not null")
    placed = with_position(rets, by, [t], time_bucket(t, bucket_ms), "_i")
    n = rets.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    half = F.call_function("div", F.col("_n"), F.lit(2).cast("bigint"))
    agg = (placed.join(n, by).groupBy(*by).agg(
        F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sd"),
        F.avg(downside(F.col("ret"))).alias("dsq"), F.first("_n").alias("n_returns"),
        compounded(F.col("ret"), F.col("_i") < half).alias("first_half"),
        compounded(F.col("ret"), F.col("_i") >= half).alias("second_half")))
    ends = curve.groupBy(*by).agg(F.min_by(equity, t).alias("e0"), F.max_by(equity, t).alias("e1"))
    dd = max_drawdown(curve, by, t, equity, bucket_ms=bucket_ms)
    tail = tail_mean(rets, by, "ret")
    net = F.col("e1") / F.col("e0") - 1
    zero = F.lit(0.0)
    return agg.join(ends, by).join(dd, by).join(tail, by).select(
        *by, "n_returns", net.alias("net_return"), "max_drawdown",
        F.when(F.col("sd") != 0, F.col("mean") / F.col("sd") * math.sqrt(p.periods_per_year))
        .otherwise(zero).alias("sharpe"),
        sortino_of(F.col("mean"), F.col("dsq"), p.periods_per_year).alias("sortino"),
        F.when(F.col("max_drawdown") != 0, net / F.col("max_drawdown")).otherwise(zero)
        .alias("calmar"),
        "tail_mean", "first_half", "second_half")


def tail_mean(df: DataFrame, by: list[str], value: str, parts: int = 20) -> DataFrame:
    """Mean of the lowest ``max(1, n div parts)`` values; duplicates collapse before ranking."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    cum = running(with_value_bucket(counts, value), by, [value], F.col("_vb"),
                  {"_cum": ("sum", F.col("_n"))})
    k = F.greatest(F.lit(1), F.call_function("div", F.col("_all"), F.lit(parts).cast("bigint")))
    take = F.least(F.col("_n"), F.greatest(F.lit(0), k - (F.col("_cum") - F.col("_n"))))
    return (cum.join(total, by).groupBy(*by)
            .agg((F.sum(F.col(value) * take) / F.sum(take)).alias("tail_mean")))


def trade_metrics(trades: DataFrame, ends: DataFrame, by: list[str], net: str,
                  top: int = 3) -> DataFrame:
    """Profit factor, mean net, and the net return without the largest gains.

    ``ends`` carries ``(by, e0, e1)``. The top gains come from a per-group limit, which Spark
    cuts before the shuffle.
    """
    x = F.col(net)
    agg = trades.groupBy(*by).agg(
        F.count(net).alias("n_trades"), F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)).alias("g"),
        F.coalesce(F.sum(F.when(x < 0, -x)), F.lit(0.0)).alias("l"), F.avg(x).alias("average_trade"))
    w = W.partitionBy(*by).orderBy(x.desc())
    best = (trades.filter(x > 0).select(*by, net).withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= top).groupBy(*by).agg(F.sum(net).alias("_top")))
    joined = ends.join(agg, by, "left").join(best, by, "left")
    return joined.select(
        *by, F.coalesce("n_trades", F.lit(0)).cast("bigint").alias("n_trades"),
        F.when(F.col("l") > 0, F.col("g") / F.col("l"))
        .otherwise(F.when(F.col("g") > 0, F.lit(1e6)).otherwise(F.lit(0.0))).alias("profit_factor"),
        F.coalesce("average_trade", F.lit(0.0)).alias("average_trade"),
        ((F.col("e1") - F.coalesce("_top", F.lit(0.0))) / F.col("e0") - 1)
        .alias("net_return_ex_top"))


def turnover_slippage(fills: DataFrame, rates: DataFrame, mean_equity: DataFrame, by: list[str],
                      pos: str) -> DataFrame:
    """Slippage estimate (fills whose position has a rate) and filled notional over equity."""
    notional = F.abs(F.coalesce("qty", F.lit(0.0))) * F.coalesce("price", F.lit(0.0))
    agg = (fills.join(rates.select(pos, "slip"), pos, "left").groupBy(*by)
           .agg(F.coalesce(F.sum(notional * F.col("slip")), F.lit(0.0)).alias("slippage"),
                F.sum(notional).alias("_notional")))
    return agg.join(mean_equity, by).select(
        *by, "slippage", (F.col("_notional") / F.col("mean_equity")).alias("turnover"))


def exposure_metrics(curve: DataFrame, by: list[str], equity="equity",
                     gross="gross_exposure") -> DataFrame:
    frac = F.when(F.col(equity) > 0, F.col(gross) / F.col(equity)).otherwise(F.lit(0.0))
    return curve.groupBy(*by).agg(
        F.avg(frac).alias("mean_exposure"),
        F.avg(F.when(F.col(gross) == 0, 1.0).otherwise(0.0)).alias("time_in_cash"))


def leaderboard(curve: DataFrame, events: DataFrame, by: list[str], t: str = "t",
                bucket_ms: int = 30 * DAY) -> DataFrame:
    """One row per account from its equity curve and its event ledger."""
    ends = curve.groupBy(*by).agg(F.min_by("equity", t).alias("starting_equity"),
                                  F.max_by("equity", t).alias("equity"))
    dd = max_drawdown(curve, by, t, "equity", bucket_ms=bucket_ms)
    kind, pnl = F.col("kind"), F.col("realized_pnl")
    closed = kind == "position_closed"
    ev = events.groupBy(*by).agg(
        F.count_if(closed).alias("trades"),
        F.avg(F.when(closed, F.when(pnl > 0, 1.0).otherwise(0.0))).alias("win_rate"),
        F.avg(F.when(closed & (pnl > 0), pnl)).alias("avg_winner"),
        F.avg(F.when(closed & (pnl <= 0), pnl)).alias("avg_loser"),
        F.coalesce(F.sum(F.when(kind.isin("fill_open", "fill_close"), F.col("fee"))), F.lit(0.0))
        .alias("fees"),
        F.coalesce(F.sum(F.when(kind == "rate", F.col("paid"))), F.lit(0.0)).alias("rates"),
        F.count_if(kind == "rejection").alias("rejections"))
    return ends.join(dd, by).join(ev, by, "left").select(
        *by, "equity", (F.col("equity") / F.col("starting_equity") - 1).alias("net_return"),
        "max_drawdown", F.coalesce("trades", F.lit(0)).cast("bigint").alias("trades"), "win_rate",
        "avg_winner", "avg_loser", "fees", "rates",
        F.coalesce("rejections", F.lit(0)).cast("bigint").alias("rejections"))


# ---------------------------------------------------------------- clusters and runs
def design_effect(df: DataFrame, y: str, cluster: str) -> DataFrame:
    """ICC(1) with unequal cluster sizes, design effect and effective sample size: one row.

    Two levels of partial sums; the between sum of squares uses the cluster means, the within
    sum is the total minus the between part.
    """
    g = df.groupBy(cluster).agg(F.count(y).cast("double").alias("m"), F.avg(y).alias("mu"),
                                F.var_pop(y).alias("v"))
    one = g.agg(F.count(F.lit(1)).alias("k"), F.sum("m").alias("n"),
                F.sum(F.col("m") * F.col("mu")).alias("s"),
                F.sum(F.col("m") * F.col("mu") * F.col("mu")).alias("s2"),
                F.sum(F.col("m") * F.col("v")).alias("ssw"),
                F.sum(F.col("m") * F.col("m")).alias("mm"))
    k, n = F.col("k"), F.col("n")
    msb = F.try_divide(F.col("s2") - F.col("s") * F.col("s") / n, k - 1)
    msw = F.try_divide(F.col("ssw"), n - k)
    m0 = F.try_divide(n - F.col("mm") / n, k - 1)
    den = msb + (m0 - 1) * msw
    icc = F.when((k < 2) | (n <= k), F.lit(0.0)).when(den > 0, (msb - msw) / den).otherwise(F.lit(0.0))
    out = one.withColumn("icc", icc).withColumn("mean_cluster_size", n / k)
    de = F.greatest(F.lit(1.0), 1 + (F.col("mean_cluster_size") - 1) * F.col("icc"))
    return out.select("icc", F.col("k").alias("n_clusters"), "mean_cluster_size",
                      de.alias("design_effect"), (n / de).alias("ess"))


def group_sizes(df: DataFrame, t: str) -> DataFrame:
    sizes = df.groupBy(t).agg(F.count(F.lit(1)).alias("n"))
    med = exact_quantiles(sizes, "n", [0.5]).select("quantile").scalar()
    return sizes.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_boundaries"),
                     F.avg("n").alias("mean_size"), F.max("n").alias("max_size")) \
        .withColumn("median_size", med)


def seed_summary(df: DataFrame, seed: str, value: str, baseline: float) -> DataFrame:
    """One row over per-seed results (one row per seed)."""
    x = F.col(value)
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75]).agg(
        F.map_from_entries(F.collect_list(F.struct("prob", "quantile")))).scalar()
    return df.agg(
        F.avg(x).alias("mean"), F.var_samp(x).alias("variance"),
        F.max_by(seed, x).alias("best_seed"), F.min_by(seed, x).alias("worst_seed"),
        F.count_if(x > baseline).alias("wins"),
        (F.lit(100.0) * F.count_if(x > baseline) / F.count(F.lit(1))).alias("win_pct")) \
        .withColumn("_q", q).withColumns({"median": F.col("_q")[F.lit(0.5)],
                                          "iqr": F.col("_q")[F.lit(0.75)] - F.col("_q")[F.lit(0.25)]}).drop("_q")


def seed_delta(new: DataFrame, old: DataFrame, seed: str, value: str) -> DataFrame:
    o = old.select(seed, F.col(value).alias("old_value"))
    return new.join(o, seed, "left").select(
        seed, "old_value", F.col(value).alias("new_value"),
        (F.col(value) - F.col("old_value")).alias("delta"))


def convergence_flag(df: DataFrame, by: list[str], i: str, r: str, w: int,
                     block: int = 100_000) -> DataFrame:
    """Moving-average diagnostic per run; NULL for runs shorter than ``w + 4``.

    ``i`` numbers the run's rows from 0. The average over the last ``w`` rows is a difference
    of bucketed running sums, so a run of any length spreads over blocks.
    """
    b = F.call_function("div", F.col(i), F.lit(block).cast("bigint"))
    cum = running(df.select(*by, i, r), by, [i], b, {"_s": ("sum", F.col(r))})
    back = cum.select(*by, (F.col(i) + w).alias(i), F.col("_s").alias("_s0"))
    ma = (cum.filter(F.col(i) >= w - 1).join(back, by + [i], "left")
          .select(*by, (F.col(i) - (w - 1)).alias("_k"),
                  ((F.col("_s") - F.coalesce("_s0", F.lit(0.0))) / w).alias("_ma")))
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
    sized = ma.join(n, by).filter(F.col("n_rows") >= w + 4).withColumn("_len", F.col("n_rows") - (w - 1))
    med = exact_quantiles(sized.filter(F.col("_k") >= F.floor(F.col("_len") * 0.75)), "_ma", [0.5], by)
    last = sized.filter(F.col("_k") == F.col("_len") - 1).select(*by, F.col("_ma").alias("final_ma"))
    return (n.join(last, by, "left")
            .join(med.select(*by, F.col("quantile").alias("tail_median")), by, "left")
            .withColumn("non_converged", F.col("final_ma") < F.col("tail_median")))


def action_histogram(decisions: DataFrame, events: DataFrame, by: list[str],
                     actions: list[str]) -> DataFrame:
    """Executed action counts per account and a reconciliation with the event ledger."""
    tight = F.col("action").isin("tighten_stop", "move_stop_breakeven")
    d = decisions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_decisions"),
        *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in actions],
        F.count_if(F.col("verdict") == "reject").alias("rejects"),
        F.count_distinct("t").alias("boundaries"), F.count_if(tight).alias("_t"))
    e = events.filter("kind = 'stop_tightened'").groupBy(*by).agg(F.count(F.lit(1)).alias("_e"))
    return d.join(e, by, "left").withColumn(
        "reconciled", F.col("_t") == F.coalesce("_e", F.lit(0))).drop("_t", "_e")


def accept_stats(df: DataFrame, score: str, y: str, cut: float,
                 by: list[str] | None = None) -> DataFrame:
    yes = F.col(score) >= cut
    return df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(yes).alias("n_accepted"),
        F.avg(F.when(yes, 1.0).otherwise(0.0)).alias("accept_rate"),
        F.avg(F.when(yes, F.col(y))).alias("accepted_mean"),
        F.avg(F.when(~yes, F.col(y))).alias("rejected_mean"))


def round_counts(df: DataFrame, valid: str = "valid") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(valid)).alias("valid"),
                  F.count_if(~F.col(valid)).alias("invalid"))


# ---------------------------------------------------------------- rate ledger
def rate_reconcile(events: DataFrame, positions: DataFrame) -> DataFrame:
    """Applied, missing and paid sums by symbol, side, sign, month and in total.

    ``events`` has ``kind in (rate, rate_missing), t, symbol, pos_id, paid``; ``positions``
    has ``pos_id, side``. One grouping-set pass.
    """
    paid = F.col("paid")
    applied = F.col("kind") == "rate"
    rows = (events.filter(F.col("kind").isin("rate", "rate_missing"))
            .join(positions.select("pos_id", "side"), "pos_id", "left")
            .select("symbol", "kind", "paid",
                    F.when(F.col("side") > 0, "long").when(F.col("side") < 0, "short").alias("side"),
                    F.when(applied, F.when(paid > 0, "positive").when(paid < 0, "negative")
                           .otherwise("zero")).alias("sign"),
                    F.when(applied, month_of("t")).alias("month")))
    sets = [[F.col("symbol")], [F.col("side")], [F.col("sign")], [F.col("month")], []]
    gid = F.grouping_id("symbol", "side", "sign", "month")
    agg = rows.groupingSets(sets, "symbol", "side", "sign", "month").agg(
        gid.alias("_g"), F.count_if(applied).alias("applied"),
        F.count_if(~applied).alias("missing"),
        F.coalesce(F.sum(F.when(applied, paid)), F.lit(0.0)).alias("paid"))
    # The grouping id leaves out exactly one of four columns
    level = (F.when(F.col("_g") == 7, "symbol").when(F.col("_g") == 11, "side")
             .when(F.col("_g") == 13, "sign").when(F.col("_g") == 14, "month").otherwise("total"))
    return agg.select(level.alias("level"),
                      F.coalesce("symbol", "side", "sign", "month").alias("key"),
                      "applied", "missing", "paid")


def rate_identity(events: DataFrame, positions: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Event sum against the per-position sum: one row with the verdict."""
    e = events.filter("kind = 'rate'").select(F.sum("paid")).scalar()
    return positions.agg(F.sum("rate_paid").alias("position_sum")).withColumn("event_sum", e) \
        .withColumn("reconciled", F.abs(F.col("event_sum") - F.col("position_sum")) < tol)


def activity_guard(totals: DataFrame, span_days: float, n_closed: Column) -> DataFrame:
    """Refuses an implausible all-zero rate total over a long active span. ``totals`` is the
    ``total`` row of ``rate_reconcile``."""
    crossings = F.col("applied") + F.col("missing")
    why = (F.when((F.lit(span_days) < 60) | (n_closed < 50), "below_threshold")
           .when(crossings == 0, "no_crossings").when(F.col("applied") == 0, "none_applied")
           .when(F.col("paid") == 0, "zero_total").otherwise("active"))
    return totals.withColumn("reason", why).withColumn(
        "ok", F.col("reason").isin("below_threshold", "active"))


def gap_report(rounds: DataFrame, labels: DataFrame, split: DataFrame,
               completeness_only: DataFrame) -> DataFrame:
    """Long table ``(section, key, n)``: invalid rounds by cause, exclusions due only to
    completeness, label exclusions and split classes."""
    cause = (F.when(F.col("valid"), "valid").when(~F.col("ctx_complete"), "context_incomplete")
             .otherwise("too_few_eligible"))
    parts = [rounds.select(F.lit("round").alias("section"), cause.alias("key")),
             labels.select(F.lit("label"), F.coalesce("exclusion", F.lit("labeled"))),
             split.select(F.lit("split"), "split"),
             completeness_only.select(F.lit("exclusion"), F.lit("completeness_only"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.groupBy("section", "key").agg(F.count(F.lit(1)).alias("n"))


