"""Trailing windows over bars, days and curves."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from pitpanel.operators import bars, reports, risk, universe, windows
from pitpanel.params import DAY
from queries.base import (COARSE, CONTEXT, CURVE, FEB, JAN, NATION_LINES, P, SERIES, SIGNALS, U, _prior,
                          _trail, coarse, curve, daily_cte, nation_lines, query, r6)

KEY = ["entity", "boundary"]


@query("channel_prior", f"""WITH {COARSE} SELECT entity, boundary,
  {_prior('max', 'high', 20)} AS hh, {_prior('min', 'low', 20)} AS ll FROM coarse""")
def _(spark, sf):
    return windows.channel_prior(coarse(spark, sf), 20, "hh", "ll").select(*KEY, "hh", "ll")


@query("true_range", f"""WITH RECURSIVE {SIGNALS} SELECT entity, boundary, round(tr, 6) AS tr
  FROM trs""")
def _(spark, sf):
    return windows.true_range(coarse(spark, sf)).select(*KEY, r6("tr", "tr"))


@query("wilder_atr", f"""WITH RECURSIVE {SIGNALS} SELECT entity, boundary, round(atr, 6) AS atr
  FROM sig""")
def _(spark, sf):
    return windows.wilder_atr(coarse(spark, sf), P.atr_n).select(*KEY, r6("atr", "atr"))


@query("log_returns", f"""WITH RECURSIVE {SERIES} SELECT entity, boundary,
  {', '.join(f'round(ret_{k}, 6) AS ret_{k}' for k in P.return_lags)} FROM series""")
def _(spark, sf):
    out = windows.log_returns(coarse(spark, sf), P.return_lags)
    return out.select(*KEY, *[r6(f"ret_{k}", f"ret_{k}") for k in P.return_lags])


@query("rolling_std", f"""WITH RECURSIVE {SERIES} SELECT entity, boundary,
  round(rvol_short, 6) AS rvol_short, round(rvol_long, 6) AS rvol_long FROM series""")
def _(spark, sf):
    r = windows.log_returns(coarse(spark, sf), (1,))
    out = windows.rolling_std(r, "ret_1", P.vol_short, "rvol_short")
    out = windows.rolling_std(out, "ret_1", P.vol_long, "rvol_long")
    return out.select(*KEY, r6("rvol_short", "rvol_short"), r6("rvol_long", "rvol_long"))


@query("rolling_mean", f"""WITH {COARSE} SELECT entity, boundary,
  round({_trail('avg', 'close', 20)}, 6) AS sma FROM coarse""")
def _(spark, sf):
    return windows.rolling_mean(coarse(spark, sf), "close", 20, "sma").select(*KEY, r6("sma", "sma"))


@query("signed_run", f"""WITH RECURSIVE {SERIES} SELECT entity, boundary, run FROM series""")
def _(spark, sf):
    b = windows.channel_prior(coarse(spark, sf), P.channel_entry, "hh_entry", "ll_entry")
    return windows.signed_run(b).select(*KEY, "run")


DAILY = f"{NATION_LINES}, {daily_cte('nlines', U)}"


def daily_metrics(spark, sf):
    return universe.trailing_daily(bars.daily_calendar(nation_lines(spark, sf), p=U), U)


@query("trailing_daily", f"""WITH {DAILY} SELECT entity, day, round(liq_median, 4) AS liq_median,
  round(completeness, 6) AS completeness FROM metrics""")
def _(spark, sf):
    return daily_metrics(spark, sf).select("entity", "day", r6("liq_median", "liq_median", 4),
                                           r6("completeness", "completeness"))


REGIME = SERIES + f""", rg AS (SELECT boundary, close, rn, rvol_short AS rvol,
  {_trail('avg', 'close', P.sma_fast)} AS sma_fast,
  {_trail('avg', 'close', P.sma_slow)} AS sma_slow,
  CASE WHEN count(rvol_short) OVER h >= {P.vol_short}
  THEN quantile_cont(rvol_short, {P.vol_quantile}) OVER h END AS rvol_q
  FROM series WHERE entity = '{CONTEXT}' WINDOW h AS (PARTITION BY entity ORDER BY boundary
  ROWS BETWEEN {P.vol_history - 1} PRECEDING AND CURRENT ROW)),
  regime AS (SELECT *, rn < {P.sma_slow + 1} AS insufficient_history,
  CASE WHEN rn < {P.sma_slow + 1} THEN 'stress' WHEN rvol > rvol_q THEN 'stress'
  WHEN close > sma_fast AND sma_fast > sma_slow THEN 'uptrend'
  WHEN close < sma_fast AND sma_fast < sma_slow THEN 'downtrend' ELSE 'sideways' END AS regime
  FROM rg)"""


def context_regime(spark, sf):
    return windows.regime(coarse(spark, sf).filter(F.col("entity") == CONTEXT), P)


@query("regime", f"""WITH RECURSIVE {REGIME} SELECT boundary, regime, insufficient_history,
  CASE regime WHEN 'downtrend' THEN 0.0 WHEN 'uptrend' THEN 1.0 ELSE 0.5 END::DOUBLE AS long_mult,
  CASE regime WHEN 'uptrend' THEN 0.0 WHEN 'downtrend' THEN 1.0 ELSE 0.5 END::DOUBLE AS short_mult
  FROM regime""")
def _(spark, sf):
    out = context_regime(spark, sf)
    mult = windows.regime_multiplier
    return out.select("boundary", "regime", "insufficient_history",
                      mult(F.col("regime"), F.lit(1)).alias("long_mult"),
                      mult(F.col("regime"), F.lit(-1)).alias("short_mult"))


@query("regime_at", f"""WITH RECURSIVE {REGIME}, grid AS (SELECT unnest(generate_series({JAN}, {FEB}, {P.coarse_ms})) AS boundary)
  SELECT boundary, coalesce(regime, 'stress') AS regime, coalesce(insufficient_history, true) AS insufficient_history
  FROM grid LEFT JOIN regime USING (boundary)""")
def _(spark, sf):
    grid = universe.boundary_grid(spark, JAN, FEB, P.coarse_ms)
    return windows.regime_at(grid, context_regime(spark, sf)).select("boundary", "regime", "insufficient_history")


@query("pause_flags", f"""WITH {CURVE}, d AS (SELECT *, t // {7 * DAY} AS day FROM curve),
  x AS (SELECT arm, t, equity, first_value(equity) OVER (PARTITION BY arm, day ORDER BY t) AS start_equity,
  max(equity) OVER (PARTITION BY arm, day ORDER BY t) AS peak_today,
  (SELECT max(e.equity) FROM d e WHERE e.arm = d.arm AND e.day BETWEEN d.day - 90 AND d.day - 1)
  AS peak_before FROM d)
  SELECT arm, t, coalesce(start_equity > 0 AND (start_equity - equity) / start_equity >= 0.003, false)
  AS daily_loss, (greatest(peak_today, peak_before) - equity) / greatest(peak_today, peak_before)
  >= 0.01 AS drawdown FROM x""")
def _(spark, sf):
    lim = replace(P, daily_loss=0.003, drawdown_limit=0.01)
    return risk.pause_flags(curve(spark, sf), ["arm"], "t", "equity", lim, day_ms=7 * DAY) \
        .select("arm", "t", "daily_loss", "drawdown")


@query("curve_returns", f"""WITH {CURVE} SELECT arm, t,
  round(equity / lag(equity) OVER (PARTITION BY arm ORDER BY t) - 1, 9) AS ret FROM curve""")
def _(spark, sf):
    return reports.curve_returns(curve(spark, sf), ["arm"], "t", "equity", bucket_ms=90 * DAY) \
        .select("arm", "t", r6("ret", "ret", 9))
