"""Universe, candidates, outcomes, features and episodes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from pitpanel.functions.columns import epoch_ms
from pitpanel.operators import bars, candidates, features, outcomes, universe, windows
from pitpanel.params import DAY, HOUR
from pitpanel.plans.asof import asof_join
from queries.base import (CANDS, CONTEXT, EU, EVENT_UNIVERSE, FEB, NATION_LINES, OUTCOMES,
                          RATES, SERIES, U, Panel, daily_cte, elig_cte, nation_lines, query,
                          r6, rates, rounds_cte, table)
from queries.window_queries import REGIME

Y95, Y01 = 9131 * DAY, 11627 * DAY      # 1995-01-01 and 2001-11-01
NATIONS = f"{NATION_LINES}, {daily_cte('nlines', U)}, {elig_cte(U, Y95, Y01)}"
NATION_CTX = "NATION_20"
SLOT = "(SELECT DISTINCT entity, ts FROM nlines)"


def _nations(spark, sf, **kw):
    lines = nation_lines(spark, sf)
    cal = bars.daily_calendar(lines, p=U)
    return lines, cal, universe.eligibility(universe.trailing_daily(cal, U), bars.extent(lines), Y95,
                                            Y01, U, **kw)


@query("eligibility", f"WITH {NATIONS} SELECT boundary, entity, round(liq_median, 4) AS liq_median FROM elig")
def _(spark, sf):
    return _nations(spark, sf)[2].select("boundary", "entity", r6("liq_median", "liq_median", 4))


@query("eligibility_point_in_time", f"""WITH {NATION_LINES}, {daily_cte('nlines', U)},
  {elig_cte(replace(U, tradable_ms=10**15), Y95, Y01)} SELECT boundary, entity,
  round(liq_median, 4) AS liq_median FROM elig e WHERE
  (SELECT (max(day) + 1) * {DAY} - 1 FROM cal c WHERE c.entity = e.entity
   AND c.day < e.boundary // {DAY}) >= boundary - {U.tradable_ms}""")
def _(spark, sf):
    lines = nation_lines(spark, sf)
    cal = bars.daily_calendar(lines, p=U)
    out = universe.eligibility(universe.trailing_daily(cal, U), bars.extent(lines), Y95, Y01, U,
                               point_in_time=True, bars_by_day=cal)
    return out.select("boundary", "entity", r6("liq_median", "liq_median", 4))


@query("universe_top_n", f"""WITH {NATIONS} SELECT boundary, entity, rank, n_eligible FROM uni""")
def _(spark, sf):
    return universe.universe_top_n(_nations(spark, sf)[2], U.top_n).select(
        "boundary", "entity", "rank", "n_eligible")


def nation_rounds(spark, sf):
    lines, _, elig = _nations(spark, sf)
    ctx = lines.filter(F.col("entity") == NATION_CTX).select("entity", "ts").distinct()
    grid = universe.boundary_grid(spark, Y95, Y01, DAY)
    return universe.round_validity(grid, elig, bars.slot_counts(ctx, p=U), U)


NATION_ROUNDS = f"{NATIONS}, slotsrc AS {SLOT}, {rounds_cte('slotsrc', NATION_CTX, U, Y95, Y01)}"


@query("round_validity", f"WITH {NATION_ROUNDS} SELECT boundary, n_eligible, ctx_complete, valid FROM rounds")
def _(spark, sf):
    return nation_rounds(spark, sf)


SPAN = replace(U, span_fraction=0.3)
FREEZE = 11_600 * DAY


@query("valid_span", f"""WITH {NATION_ROUNDS}, s AS (SELECT boundary, valid,
  avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END) OVER (ORDER BY boundary RANGE BETWEEN CURRENT ROW
  AND {SPAN.span_window_ms} FOLLOWING) AS share FROM rounds)
  SELECT min(CASE WHEN valid AND share >= {SPAN.span_fraction} THEN boundary END) AS start_ts,
  max(CASE WHEN valid AND boundary <= {FREEZE - SPAN.span_buffer_ms} THEN boundary END) AS end_ts
  FROM s""")
def _(spark, sf):
    return universe.valid_span(nation_rounds(spark, sf), FREEZE, SPAN)


@query("chrono_partition", f"""WITH {NATION_ROUNDS}, g AS (SELECT boundary,
  row_number() OVER (ORDER BY boundary) - 1 AS i, count(*) OVER () AS n FROM rounds),
  p AS (SELECT boundary, CASE WHEN i < floor(0.6 * n) THEN 'train' WHEN i < floor(0.8 * n)
  THEN 'validation' ELSE 'holdout' END AS part FROM g)
  SELECT part, count(*) AS n, min(boundary) AS start_ts, max(boundary) AS end_ts FROM p GROUP BY part""")
def _(spark, sf):
    parts = universe.chrono_partition(nation_rounds(spark, sf).select("boundary"), DAY, U)
    return universe.partition_edges(parts)


@query("breakout_candidates", f"""WITH RECURSIVE {CANDS} SELECT t, entity, side, close, hh_entry,
  ll_entry, round(atr, 6) AS atr, round(r_dist, 6) AS r_dist, rank, n_eligible FROM cands""")
def _(spark, sf):
    return Panel(spark, sf).cands.select("t", "entity", "side", "close", "hh_entry", "ll_entry",
                                         r6("atr", "atr"), r6("r_dist", "r_dist"), "rank", "n_eligible")


@query("candidate_skips", f"""WITH RECURSIVE {CANDS} SELECT uni.boundary, count(*) AS skipped FROM uni
  WHERE NOT EXISTS (SELECT 1 FROM sig WHERE sig.entity = uni.entity AND sig.boundary = uni.boundary
  AND atr > 0 AND hh_entry IS NOT NULL) GROUP BY 1""")
def _(spark, sf):
    x = Panel(spark, sf)
    return candidates.skip_count(x.universe, x.signals)


@query("round_context", f"""WITH RECURSIVE {CANDS} SELECT t, entity, rank, n_eligible,
  count(*) OVER (PARTITION BY t, side) AS round_side_count FROM cands""")
def _(spark, sf):
    return candidates.round_context(Panel(spark, sf).cands).select(
        "t", "entity", "rank", "n_eligible", "round_side_count")


def flagship(spark, sf, entity=None):
    # one all-in-one entity is too thin for rounds of several eligible members
    p = EU if entity is None else replace(EU, min_eligible=1)
    x = Panel(spark, sf, entity, p, ctx=entity or CONTEXT)
    return outcomes.first_touch(x.cands, x.fine, x.signals, x.rounds, p)


@query("first_touch", f"""WITH RECURSIVE {OUTCOMES} SELECT entity, t, side, rank,
  round(entry_fill, 6) AS entry_fill, round(stop, 6) AS stop, round(target, 6) AS target, reason,
  exit_t, round(exit_fill, 6) AS exit_fill, ambiguous, round(net_r, 6) AS net_r FROM results""")
def _(spark, sf):
    return flagship(spark, sf).select(
        "entity", "t", "side", "rank", r6("entry_fill", "entry_fill"), r6("stop", "stop"),
        r6("target", "target"), "reason", "exit_t", r6("exit_fill", "exit_fill"), "ambiguous",
        r6("net_r", "net_r"))


POSITIONS = """pos AS (SELECT entity, t, t AS entry_t, exit_t, side, 1.0 / r_dist AS qty FROM results
  WHERE exit_t IS NOT NULL)"""


def positions(x: Panel):
    return x.outcomes.filter("exit_t is not null").select(
        "entity", "t", F.col("t").alias("entry_t"), "exit_t", "side",
        (F.lit(1.0) / F.col("r_dist")).alias("qty"))


@query("rate_accrual", f"""WITH RECURSIVE {OUTCOMES}, {POSITIONS}, {RATES}, g AS (SELECT pos.*,
  unnest(generate_series(entry_t - entry_t % {EU.rate_ms} + {EU.rate_ms}, exit_t, {EU.rate_ms})) AS rt
  FROM pos), m AS (SELECT g.*, rate, coalesce((SELECT arg_max(close, f.ts) FROM fine f
  WHERE f.entity = g.entity AND f.ts < g.rt), b.open) AS mark FROM g
  LEFT JOIN rates r ON r.entity = g.entity AND r.ts = g.rt
  LEFT JOIN fine b ON b.entity = g.entity AND b.ts = g.rt)
  SELECT pos.entity, pos.t, count(rate) AS applied, count(rt) - count(rate) AS missing,
  round(coalesce(sum(rate * m.qty * mark * m.side), 0), 9) AS paid
  FROM pos LEFT JOIN m ON m.entity = pos.entity AND m.t = pos.t GROUP BY ALL""")
def _(spark, sf):
    x = Panel(spark, sf)
    return outcomes.rate_accrual(positions(x), rates(x), x.fine, EU).select(
        "entity", "t", "applied", "missing", r6("paid", "paid", 9))


# ---------------------------------------------------------------- as-of joins
USER_ERRORS = """er AS (SELECT user_id, epoch_us(ts) // 1000 AS ets, max(value) AS value FROM events
  WHERE event_type = 'error' GROUP BY 1, 2), ot AS (SELECT event_id, user_id,
  epoch_us(ts) // 1000 AS ts FROM events WHERE event_type <> 'error')"""


def user_errors(spark, sf):
    e = table(spark, sf, "events")
    err = (e.filter("event_type = 'error'").groupBy("user_id", epoch_ms("ts").alias("ets"))
           .agg(F.max("value").alias("value")))
    other = e.filter("event_type <> 'error'").select("event_id", "user_id", epoch_ms("ts").alias("ts"))
    return other, err


@query("asof_last", f"""WITH {USER_ERRORS} SELECT event_id, ot.user_id, value FROM ot
  ASOF LEFT JOIN er ON ot.user_id = er.user_id AND ot.ts > er.ets""")
def _(spark, sf):
    other, err = user_errors(spark, sf)
    return asof_join(other, err, ["user_id"], "ts", "ets", ["value"]).select(
        "event_id", "user_id", "value")


@query("asof_trailing_mean", f"""WITH {USER_ERRORS}, tr AS (SELECT user_id, ets, value,
  avg(value) OVER (PARTITION BY user_id ORDER BY ets ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)
  AS mean_9 FROM er) SELECT event_id, value AS last_value, round(mean_9, 6) AS mean_9 FROM ot
  ASOF LEFT JOIN tr ON ot.user_id = tr.user_id AND ot.ts > tr.ets""")
def _(spark, sf):
    other, err = user_errors(spark, sf)
    out = features.asof_trailing_mean(other, err, ["user_id"], "ts", "ets", "value", 9, "last_value",
                                      "mean_9")
    return out.select("event_id", "last_value", r6("mean_9", "mean_9"))


@query("asof_defined", f"""WITH RECURSIVE {CANDS}, d AS (SELECT entity, boundary, atr FROM sig WHERE atr > 0)
  SELECT fine.entity, ts, round(coalesce(d.atr, fine.close), 6) AS atr_now FROM fine
  ASOF LEFT JOIN d ON fine.entity = d.entity AND fine.ts >= d.boundary""")
def _(spark, sf):
    x = Panel(spark, sf)
    out = outcomes.asof_defined(x.fine, x.signals, ["entity"], "ts", "boundary", "atr", "close",
                                "atr_now")
    return out.select("entity", "ts", r6("atr_now", "atr_now"))


BREADTH = """br AS (SELECT uni.boundary, avg(CASE WHEN close > sma_short THEN 1.0 ELSE 0.0 END) AS breadth
  FROM uni JOIN series ON uni.entity = series.entity AND uni.boundary = series.boundary
  WHERE sma_short IS NOT NULL GROUP BY 1)"""


@query("breadth", f"""WITH RECURSIVE {SERIES}, {EVENT_UNIVERSE}, {BREADTH}
  SELECT boundary, round(breadth, 6) AS breadth FROM br""")
def _(spark, sf):
    x = Panel(spark, sf)
    ser = x.series
    return candidates.breadth(x.universe, ser).select("boundary", r6("breadth", "breadth"))


@query("context_join", f"""WITH RECURSIVE {SERIES} SELECT s.entity, s.boundary,
  round(c.ret_5, 6) AS ctx_ret_5, round(c.rvol_short, 6) AS ctx_rvol FROM series s
  JOIN series c ON c.boundary = s.boundary AND c.entity = '{CONTEXT}'""")
def _(spark, sf):
    x = Panel(spark, sf)
    ser = x.series
    ctx = ser.filter(F.col("entity") == CONTEXT)
    have = ser.join(ctx.select("boundary"), "boundary", "left_semi")
    out = candidates.context_join(have.select("entity", "boundary"), ctx, "boundary",
                                  {"ctx_ret_5": "ret_5", "ctx_rvol": "rvol_short"})
    return out.select("entity", "boundary", r6("ctx_ret_5", "ctx_ret_5"), r6("ctx_rvol", "ctx_rvol"))


FEATURE_SQL = """side AS F01_side, atr / close AS F02_atr_pct,
  side * (close - CASE WHEN side > 0 THEN hh_entry ELSE ll_entry END) / atr AS F03_breakout_strength,
  (hh_entry - ll_entry) / close AS F04_channel_width,
  (rank - 1) / greatest(1, n_eligible) AS F05_rank_frac, n_eligible AS F06_n_eligible,
  ret_1 AS F07_ret_1, ret_5 AS F08_ret_5, ret_10 AS F09_ret_20, ret_20 AS F10_ret_60,
  rvol_short AS F11_rvol_20, CASE WHEN rvol_long <> 0 THEN rvol_short / rvol_long END AS F12_rvol_ratio,
  (close - sma_short) / atr AS F13_trend_sma20, (close - sma_long) / atr AS F14_trend_sma60,
  side * (close - CASE WHEN side > 0 THEN ll_exit ELSE hh_exit END) / atr AS F15_dist_opposite,
  CAST(side * run AS DOUBLE) AS F16_breakout_run, c5 AS F17_ctx_ret_5, c20 AS F18_ctx_ret_20,
  c60 AS F19_ctx_ret_60, cvol AS F20_ctx_rvol_20, breadth AS F21_breadth_sma20,
  rsc AS F22_round_side_count, CASE state WHEN 'uptrend' THEN 0 WHEN 'downtrend' THEN 1
  WHEN 'sideways' THEN 2 ELSE 3 END AS F23_regime_code, log10(liq_median) AS F24_log_liq,
  rate_last AS F25_rate_last, rate_mean AS F26_rate_mean_3d""" + f""",
  (t // {EU.coarse_ms}) % 6 AS F27_hour_slot, (t // {DAY} + 4) % 7 AS F28_dow"""
FEATURE_INTS = {"F01_side", "F06_n_eligible", "F22_round_side_count", "F23_regime_code",
                "F27_hour_slot", "F28_dow"}
FEATURE_CTE = f"""{REGIME}, {EVENT_UNIVERSE}, {BREADTH}, {RATES},
  cf AS (SELECT uni.boundary AS t, uni.entity, liq_median, rank, n_eligible, s.* EXCLUDE (entity),
  CASE WHEN close > hh_entry THEN 1 ELSE -1 END AS side
  FROM uni JOIN series s ON uni.entity = s.entity AND uni.boundary = s.boundary
  WHERE atr > 0 AND hh_entry IS NOT NULL AND (close > hh_entry OR close < ll_entry)),
  rt AS (SELECT entity, ts AS rts, rate AS rate_last, avg(rate) OVER (PARTITION BY entity ORDER BY ts
  ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS rate_mean FROM rates),
  fx AS (SELECT cf.*, count(*) OVER (PARTITION BY cf.t, cf.side) AS rsc, c.ret_5 AS c5,
  c.ret_10 AS c20, c.ret_20 AS c60, c.rvol_short AS cvol, regime.regime AS state, br.breadth
  FROM cf JOIN series c ON c.boundary = cf.t AND c.entity = '{CONTEXT}'
  JOIN regime ON regime.boundary = cf.t LEFT JOIN br ON br.boundary = cf.t),
  fy AS (SELECT fx.*, rate_last, rate_mean FROM fx ASOF LEFT JOIN rt
  ON fx.entity = rt.entity AND fx.t > rt.rts),
  feats AS (SELECT entity, t, {FEATURE_SQL} FROM fy)"""


def feature_rows(spark, sf):
    x = Panel(spark, sf)
    ser = x.series
    ctx = ser.filter(F.col("entity") == CONTEXT)
    state = windows.regime(x.signals.filter(F.col("entity") == CONTEXT), EU)
    # the default raises on a candidate without a context bar; here those rounds are left out
    cands = x.cands.join(ctx.select(F.col("boundary").alias("t")), "t", "left_semi")
    return features.features_28(cands, ser, ctx, state, candidates.breadth(x.universe, ser),
                                rates(x), EU)


@query("features_28", f"WITH RECURSIVE {FEATURE_CTE} SELECT entity, t, " + ", ".join(
    f if f in FEATURE_INTS else f"round({f}, 6) AS {f}" for f in features.FEATURES) + " FROM feats")
def _(spark, sf):
    return feature_rows(spark, sf).select("entity", "t", *[
        f if f in FEATURE_INTS else r6(f, f) for f in features.FEATURES])


# ---------------------------------------------------------------- episodes
@query("episode_windows", f"""WITH RECURSIVE {OUTCOMES}, {RATES} SELECT r.entity, r.t, r.side, f.ts, f.close, q.rate,
  CASE WHEN q.rate IS NOT NULL THEN coalesce((SELECT arg_max(close, g.ts) FROM fine g WHERE g.entity = f.entity AND g.ts < f.ts), f.open)
  END AS mark, CASE WHEN rank <= {EU.tier1_top} THEN {EU.half_spread[0]} ELSE {EU.half_spread[1]} END::DOUBLE AS half_spread,
  CASE WHEN rank <= {EU.tier1_top} THEN {EU.slippage[0]} ELSE {EU.slippage[1]} END::DOUBLE AS slip, {EU.fee}::DOUBLE AS fee
  FROM results r JOIN fine f ON f.entity = r.entity AND f.ts >= r.t + {HOUR}
  AND f.ts <= least(r.exit_t + {EU.coarse_ms}, {FEB}) LEFT JOIN rates q ON q.entity = f.entity AND q.ts = f.ts
  WHERE r.exit_t IS NOT NULL""")
def _(spark, sf):
    x = Panel(spark, sf)
    marks = outcomes.rate_marks(rates(x), x.fine)
    return outcomes.episode_windows(x.outcomes.select("entity", "t", "side", "rank", "exit_t"), x.fine, FEB, EU, marks=marks) \
        .select("entity", "t", "side", "ts", "close", "rate", "mark", "half_spread", "slip", "fee")


def exposure(x: Panel):
    return x.fine.groupBy("ts").agg(F.sum("volume").alias("v")).select(
        F.col("ts").alias("t"), F.lit(100.0).alias("equity"),
        F.col("v").cast("double").alias("gross_exposure"))


@query("episode_observations", f"""WITH RECURSIVE {OUTCOMES},
  e AS (SELECT * FROM results WHERE exit_t IS NOT NULL),
  w AS (SELECT e.entity, e.t, f.ts - f.ts % {EU.coarse_ms} + {EU.coarse_ms} AS b,
  any_value(e.exit_t) AS exit_t FROM e JOIN fine f ON f.entity = e.entity AND f.ts >= e.t
  AND f.ts < e.exit_t GROUP BY 1, 2, 3 HAVING b <= any_value(e.exit_t)),
  s AS (SELECT e.*, w.b, max(side * (CASE WHEN side > 0 THEN f.high ELSE f.low END - entry_fill)) AS m,
  min(side * (CASE WHEN side > 0 THEN f.low ELSE f.high END - entry_fill)) AS d,
  arg_max(f.close, f.ts) AS mark FROM w JOIN e ON e.entity = w.entity AND e.t = w.t
  JOIN fine f ON f.entity = e.entity AND f.ts >= e.t AND f.ts < w.b GROUP BY ALL),
  da AS (SELECT entity, boundary, atr AS a FROM sig WHERE atr > 0),
  ex AS (SELECT ts AS ets, sum(volume) / 100.0 AS expo FROM fine GROUP BY 1),
  s2 AS (SELECT s.*, da.a FROM s ASOF LEFT JOIN da ON s.entity = da.entity AND s.b >= da.boundary),
  s3 AS (SELECT s2.*, ex.expo FROM s2 ASOF LEFT JOIN ex ON s2.b >= ex.ets)
  SELECT entity, t, b AS boundary,
  round(least(10, greatest(-10, side * (mark - entry_fill) / r_dist)), 6) AS unrealized_r,
  round(least(1, (b - t) // {EU.coarse_ms} / {float(EU.max_hold)}), 6) AS time_frac,
  round(least(10, greatest(0, m) / r_dist), 6) AS mfe_r,
  round(least(10, -least(0, d) / r_dist), 6) AS mae_r,
  round(least(10, greatest(0.1, coalesce(a, atr) / atr)), 6) AS vol_ratio,
  round(least(20, greatest(0, greatest(0, m) / r_dist - side * (mark - entry_fill) / r_dist)), 6)
  AS giveback_r,
  round(least(10, greatest(0, side * (mark - stop) / r_dist)), 6) AS dist_stop_r,
  round(least(10, greatest(-10, side * (target - mark) / r_dist)), 6) AS dist_target_r,
  1.0::DOUBLE AS remaining_frac, round(least(5, coalesce(expo, 0)), 6) AS exposure_frac FROM s3""")
def _(spark, sf):
    x = Panel(spark, sf)
    out = x.outcomes
    lab = out.join(x.cands.select("entity", "t", "atr"), ["entity", "t"])
    obs = outcomes.episode_observations(lab, x.fine, x.signals, exposure(x), EU)
    ids = ["entity", "t", "boundary"]
    return obs.select(*ids, *[r6(c, c) for c in obs.columns if c not in ids])


@query("running_excursion", f"""WITH RECURSIVE {OUTCOMES} SELECT r.entity, r.t, f.ts,
  round(greatest(0, max(side * (CASE WHEN side > 0 THEN high ELSE low END - entry_fill)) OVER w) / r_dist, 6)
  AS mfe_r, round(least(0, min(side * (CASE WHEN side > 0 THEN low ELSE high END - entry_fill)) OVER w)
  / r_dist, 6) AS mae_r FROM results r JOIN fine f ON f.entity = r.entity AND f.ts >= r.t + {HOUR}
  AND f.ts <= least(r.exit_t + {EU.coarse_ms}, {FEB}) WHERE r.exit_t IS NOT NULL
  WINDOW w AS (PARTITION BY r.entity, r.t ORDER BY f.ts)""")
def _(spark, sf):
    x = Panel(spark, sf)
    out = x.outcomes
    ep = outcomes.episode_windows(out.select("entity", "t", "side", "exit_t", "entry_fill", "r_dist"),
                                  x.fine, FEB, EU)
    run = windows.running_excursion(ep, ["entity", "t"], "ts", "side", "entry_fill", "r_dist")
    return run.select("entity", "t", "ts", r6("mfe_r", "mfe_r"), r6("mae_r", "mae_r"))


