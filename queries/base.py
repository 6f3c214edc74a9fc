"""Registry of (Spark query, DuckDB text) pairs and the driver tables seen as panels."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.functions.columns import epoch_ms
from pitpanel.operators import bars, candidates, outcomes, universe, windows
from pitpanel.params import DAY, DEFAULTS, HOUR, Params
from pitpanel.plans.ordered import running, time_bucket
from pitpanel.session import ensure_utc, materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# events as a panel: 1 h fine bars, 4 h coarse bars, shorter lookbacks than the defaults
P: Params = replace(
    DEFAULTS, fine_ms=HOUR, coarse_ms=4 * HOUR, bars_per_coarse=4, bars_per_day=24,
    channel_entry=2, channel_exit=2, atr_n=5, return_lags=(1, 5, 10, 20), vol_short=5,
    vol_long=10, sma_fast=6, sma_slow=18, vol_history=60, max_hold=12)
# lineitem as a daily panel: entity is the supplier's nation
U: Params = replace(
    DEFAULTS, fine_ms=DAY, coarse_ms=DAY, bars_per_coarse=1, bars_per_day=1, daily_min_bars=1,
    min_history_ms=90 * DAY, min_liquidity=20_000.0, min_defined_days=10, min_completeness=0.5,
    top_n=10, min_eligible=15)
CONTEXT = "view"


def query(key: str, sql: str | None = None):
    def keep(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = " ".join(sql.split())
        return fn
    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c, name: str, digits: int = 6):
    return F.round(c, digits).alias(name)


# ---------------------------------------------------------------- panels
def ticks(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("entity"), epoch_ms("ts").alias("ts"), "event_id", "user_id",
        "value")


def fine(spark, sf, entity: str | None = None) -> DataFrame:
    src = ticks(spark, sf)
    if entity is not None:
        src = src.withColumn("entity", F.lit(entity))
    return bars.ticks_to_bars(src, "entity", "ts", "value", ["event_id"], P.fine_ms)


def coarse(spark, sf, entity: str | None = None) -> DataFrame:
    return bars.complete_bars(fine(spark, sf, entity), p=P)


TICKS = """ticks AS (SELECT event_type AS entity, epoch_us(ts) // 1000 AS ts, event_id, user_id, value
  FROM events)"""
FINE = TICKS + f""", fine AS (SELECT entity, ts - ts % {HOUR} AS ts,
  arg_min(value, row(ticks.ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, row(ticks.ts, event_id)) AS close, count(*) AS volume,
  sum(value) AS quote_volume FROM ticks GROUP BY entity, ticks.ts - ticks.ts % {HOUR})"""
COARSE = FINE + f""", coarse AS (SELECT entity, fine.ts - fine.ts % {4 * HOUR} AS open_ts,
  fine.ts - fine.ts % {4 * HOUR} + {4 * HOUR} AS boundary,
  arg_min(open, fine.ts) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, fine.ts) AS close, CAST(sum(volume) AS BIGINT) AS volume,
  sum(quote_volume) AS quote_volume
  FROM fine GROUP BY entity, fine.ts - fine.ts % {4 * HOUR} HAVING count(*) = 4)"""


def nation_lines(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice")
    su = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    na = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return (li.join(su, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(F.broadcast(na), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(F.col("n_name").alias("entity"), epoch_ms("l_shipdate").alias("ts"),
                    F.col("l_extendedprice").alias("quote_volume")))


NATION_LINES = """nlines AS (SELECT n_name AS entity, epoch_us(l_shipdate) // 1000 AS ts,
  l_extendedprice AS quote_volume FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey)"""




def signals(spark, sf, entity: str | None = None) -> DataFrame:
    return windows.signals(coarse(spark, sf, entity), P)


def series(spark, sf) -> DataFrame:
    return windows.feature_series(signals(spark, sf), P)


def _prior(agg: str, c: str, n: int) -> str:
    frame = f"(PARTITION BY entity ORDER BY boundary ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({c}) OVER {frame} = {n} THEN {agg}({c}) OVER {frame} END"


def _trail(agg: str, c: str, n: int) -> str:
    frame = (f"(PARTITION BY entity ORDER BY boundary ROWS BETWEEN {n - 1} PRECEDING "
             "AND CURRENT ROW)")
    return f"CASE WHEN count({c}) OVER {frame} = {n} THEN {agg}({c}) OVER {frame} END"


SIGNALS = COARSE + f""", trs AS (SELECT *, row_number() OVER w AS rn,
  greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
  FROM coarse WINDOW w AS (PARTITION BY entity ORDER BY boundary)),
  atrs(entity, rn, a) AS (SELECT entity, CAST({P.atr_n} AS BIGINT), avg(tr) FROM trs
  WHERE rn <= {P.atr_n} GROUP BY entity HAVING count(*) = {P.atr_n}
  UNION ALL SELECT t.entity, t.rn, (r.a * {P.atr_n - 1} + t.tr) / {P.atr_n}
  FROM atrs r JOIN trs t ON t.entity = r.entity AND t.rn = r.rn + 1),
  sj AS (SELECT trs.*, CASE WHEN trs.rn >= {3 * P.atr_n} THEN atrs.a END AS atr
  FROM trs LEFT JOIN atrs ON trs.entity = atrs.entity AND trs.rn = atrs.rn),
  sig AS (SELECT *,
  {_prior('max', 'high', P.channel_entry)} AS hh_entry,
  {_prior('min', 'low', P.channel_entry)} AS ll_entry,
  {_prior('max', 'high', P.channel_exit)} AS hh_exit,
  {_prior('min', 'low', P.channel_exit)} AS ll_exit FROM sj)"""
SERIES = SIGNALS + f""", rets AS (SELECT *, {', '.join(
    f'ln(close) - lag(ln(close), {k}) OVER w AS ret_{k}' for k in P.return_lags)},
  CASE WHEN close > (hh_entry + ll_entry) / 2 THEN 1 WHEN close < (hh_entry + ll_entry) / 2
  THEN -1 ELSE 0 END AS sgn FROM sig WINDOW w AS (PARTITION BY entity ORDER BY boundary)),
  isl AS (SELECT *, rn - row_number() OVER (PARTITION BY entity, sgn ORDER BY boundary) AS grp
  FROM rets),
  series AS (SELECT *, {_trail('stddev_samp', 'ret_1', P.vol_short)} AS rvol_short,
  {_trail('stddev_samp', 'ret_1', P.vol_long)} AS rvol_long,
  {_trail('avg', 'close', P.vol_short)} AS sma_short,
  {_trail('avg', 'close', P.vol_long)} AS sma_long,
  CAST(sgn * least(10, row_number() OVER (PARTITION BY entity, sgn, grp ORDER BY boundary))
  AS BIGINT) AS run FROM isl)"""


# ---------------------------------------------------------------- equity curves
def order_flow(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    sign = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", -1.0)
    held = F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") / 100)
    return (o.groupBy(F.col("o_orderpriority").alias("arm"), epoch_ms("o_orderdate").alias("t"))
            .agg(F.coalesce(F.sum(sign * F.col("o_totalprice")) / 10000, F.lit(0.0)).alias("pnl"),
                 F.coalesce(F.sum(held), F.lit(0.0)).alias("gross_exposure")))


def curve(spark, sf) -> DataFrame:
    done = running(order_flow(spark, sf), ["arm"], ["t"], time_bucket("t", 90 * DAY),
                   {"c": ("sum", F.col("pnl"))})
    return done.select("arm", "t", r6(F.lit(20000.0) + F.col("c"), "equity"),
                       r6("gross_exposure", "gross_exposure"))


CURVE = """flow AS (SELECT o_orderpriority AS arm, epoch_us(o_orderdate) // 1000 AS t,
  coalesce(sum(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN -1.0 END * o_totalprice)
  / 10000, 0) AS pnl,
  coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice / 100 END), 0) AS gross_exposure
  FROM orders GROUP BY ALL),
  curve AS (SELECT arm, t, round(20000.0 + sum(pnl) OVER (PARTITION BY arm ORDER BY t), 6) AS equity,
  round(gross_exposure, 6) AS gross_exposure FROM flow)"""


# ---------------------------------------------------------------- universes and rounds
# events panel: universe of event types over three trailing days
EU: Params = replace(
    P, trailing_days=3, min_defined_days=2, daily_min_bars=12, min_liquidity=0.0,
    min_completeness=0.5, min_history_ms=1 * DAY, top_n=4, min_eligible=3, stop_mult=0.25)
JAN = 1_704_067_200_000
FEB = JAN + 30 * DAY


def daily_cte(src: str, p: Params) -> str:
    return f"""cal AS (SELECT entity, ts // {DAY} AS day, count(quote_volume) AS bars_present,
  CASE WHEN count(quote_volume) >= {p.daily_min_bars} THEN sum(quote_volume) END AS qvol
  FROM {src} GROUP BY 1, 2),
  spine AS (SELECT entity, unnest(generate_series(min(day), max(day) + 1)) AS day FROM cal
  GROUP BY entity),
  metrics AS (SELECT entity, day,
  CASE WHEN count(qvol) OVER w >= {p.min_defined_days} THEN quantile_cont(qvol, 0.5) OVER w END
  AS liq_median, sum(bars_present) OVER w / {float(p.trailing_days * p.bars_per_day)} AS completeness
  FROM spine LEFT JOIN cal USING (entity, day)
  WINDOW w AS (PARTITION BY entity ORDER BY day RANGE BETWEEN {p.trailing_days} PRECEDING
  AND 1 PRECEDING)),
  ext AS (SELECT entity, min(ts) AS first_ts, max(ts) AS last_ts FROM {src} GROUP BY 1)"""


def elig_cte(p: Params, start: int, end: int) -> str:
    return f"""el0 AS (SELECT entity, liq_median, first_ts, last_ts,
  unnest(generate_series(day * {DAY}, day * {DAY} + {DAY - p.coarse_ms}, {p.coarse_ms})) AS boundary
  FROM metrics JOIN ext USING (entity) WHERE liq_median >= {p.min_liquidity}
  AND completeness >= {p.min_completeness}),
  elig AS (SELECT boundary, entity, liq_median FROM el0 WHERE boundary BETWEEN {start} AND {end}
  AND first_ts <= boundary - {p.min_history_ms} AND last_ts >= boundary - {p.tradable_ms}),
  uni AS (SELECT *, count(*) OVER (PARTITION BY boundary) AS n_eligible FROM (SELECT *,
  row_number() OVER (PARTITION BY boundary ORDER BY liq_median DESC, entity) AS rank FROM elig)
  WHERE rank <= {p.top_n})"""


def rounds_cte(src: str, ctx: str, p: Params, start: int, end: int) -> str:
    return f"""grid AS (SELECT unnest(generate_series({start}, {end}, {p.coarse_ms})) AS boundary),
  ctxs AS (SELECT ts - ts % {p.coarse_ms} + {p.coarse_ms} AS boundary,
  count(*) = {p.bars_per_coarse} AS ctx_complete FROM {src} WHERE entity = '{ctx}' GROUP BY 1),
  rounds AS (SELECT boundary, count(elig.entity) AS n_eligible,
  coalesce(any_value(ctx_complete), false) AS ctx_complete,
  coalesce(any_value(ctx_complete), false) AND count(elig.entity) >= {p.min_eligible} AS valid
  FROM grid LEFT JOIN ctxs USING (boundary) LEFT JOIN elig USING (boundary) GROUP BY boundary)"""


class Panel:
    """The events panel with its universe. Tables that several branches read are written once."""

    def __init__(self, spark, sf, entity: str | None = None, p: Params = EU, ctx: str = CONTEXT):
        self.p, self.spark, self.ctx = p, spark, ctx
        self._raw = fine(spark, sf, entity)

    @cached_property
    def fine(self):
        return materialize(self._raw)

    @cached_property
    def signals(self):
        return materialize(windows.signals(bars.complete_bars(self.fine, p=self.p), self.p))

    @cached_property
    def series(self):
        return materialize(windows.feature_series(self.signals, self.p))

    @cached_property
    def elig(self):
        metrics = universe.trailing_daily(bars.daily_calendar(self.fine, p=self.p), self.p)
        return materialize(universe.eligibility(metrics, bars.extent(self.fine), JAN, FEB, self.p))

    @cached_property
    def universe(self):
        return universe.universe_top_n(self.elig, self.p.top_n)

    @cached_property
    def rounds(self):
        grid = universe.boundary_grid(self.spark, JAN, FEB, self.p.coarse_ms)
        slots = bars.slot_counts(self.fine.filter(F.col("entity") == self.ctx), p=self.p)
        return universe.round_validity(grid, self.elig, slots, self.p)

    @cached_property
    def cands(self):
        return materialize(candidates.breakout_candidates(self.universe, self.signals, self.p))

    @cached_property
    def outcomes(self):
        return materialize(outcomes.first_touch(self.cands, self.fine, self.signals, self.rounds,
                                                self.p))


EVENT_UNIVERSE = f"{daily_cte('fine', EU)}, {elig_cte(EU, JAN, FEB)}, " \
    f"{rounds_cte('fine', CONTEXT, EU, JAN, FEB)}"
CANDS = f"""{SIGNALS}, {EVENT_UNIVERSE}, cands AS (SELECT uni.boundary AS t, uni.entity, liq_median,
  rank, n_eligible, close, hh_entry, ll_entry, hh_exit, ll_exit, atr, {EU.stop_mult} * atr AS r_dist,
  CASE WHEN close > hh_entry THEN 1 ELSE -1 END AS side
  FROM uni JOIN sig ON uni.entity = sig.entity AND uni.boundary = sig.boundary
  WHERE atr > 0 AND hh_entry IS NOT NULL AND (close > hh_entry OR close < ll_entry))"""


def _cost(mult: float) -> str:
    hs, sl, k = EU.half_spread, EU.slippage, EU.tier1_top
    return (f"CASE WHEN rank <= {k} THEN {hs[0]} + {sl[0]} * {mult} "
            f"ELSE {hs[1]} + {sl[1]} * {mult} END")


OUTCOMES = CANDS + f""", vr AS (SELECT boundary FROM rounds WHERE valid),
  q0 AS (SELECT c.t, c.entity, c.side, c.rank, c.r_dist, c.atr, c.close,
  (SELECT min(s.boundary) FROM sig s JOIN vr ON vr.boundary = s.boundary WHERE s.entity = c.entity
   AND s.boundary > c.t AND s.ll_exit IS NOT NULL AND s.hh_exit IS NOT NULL AND
   ((c.side = 1 AND s.close < s.ll_exit) OR (c.side = -1 AND s.close > s.hh_exit))) AS tr,
  (SELECT min(boundary) FROM vr WHERE boundary >= c.t + {EU.max_hold * EU.coarse_ms}) AS tm
  FROM cands c),
  q1 AS (SELECT q0.*, least(tr, tm) AS queue_t, CASE WHEN tr IS NOT NULL AND (tm IS NULL OR tr <= tm)
  THEN 'trailing_exit' WHEN tm IS NOT NULL THEN 'time_exit' END AS queue_reason,
  b.open * (1 + side * ({_cost(1.0)})) AS entry_fill
  FROM q0 LEFT JOIN fine b ON b.entity = q0.entity AND b.ts = q0.t),
  q2 AS (SELECT *, entry_fill - side * r_dist AS stop,
  entry_fill + side * {EU.target_mult} * r_dist AS target,
  (SELECT min(f.ts) FROM fine f WHERE f.entity = q1.entity AND f.ts >= q1.queue_t) AS fill_t FROM q1),
  q3 AS (SELECT q2.*, fo.open AS fill_open,
  (SELECT min(f.ts) FROM fine f WHERE f.entity = q2.entity AND f.ts >= q2.t
   AND (q2.fill_t IS NULL OR f.ts < q2.fill_t)
   AND ((side = 1 AND (f.low <= stop OR f.high >= target))
     OR (side = -1 AND (f.high >= stop OR f.low <= target)))) AS hit_t
  FROM q2 LEFT JOIN fine fo ON fo.entity = q2.entity AND fo.ts = q2.fill_t),
  q4 AS (SELECT q3.*, h.open AS ho, CASE WHEN side = 1 THEN h.low <= stop ELSE h.high >= stop END
  AS hs, CASE WHEN side = 1 THEN h.high >= target ELSE h.low <= target END AS ht,
  CASE WHEN side = 1 THEN fill_open <= stop ELSE fill_open >= stop END AS gap
  FROM q3 LEFT JOIN fine h ON h.entity = q3.entity AND h.ts = q3.hit_t),
  outcomes AS (SELECT entity, t, side, rank, r_dist, atr, close, entry_fill, stop, target,
  CASE WHEN entry_fill IS NULL THEN 'cancelled' WHEN hit_t IS NOT NULL AND hs THEN 'stop'
  WHEN hit_t IS NOT NULL THEN 'target' WHEN fill_t IS NOT NULL AND gap THEN 'stop'
  WHEN fill_t IS NOT NULL THEN queue_reason ELSE 'still_open' END AS reason,
  CASE WHEN entry_fill IS NOT NULL THEN coalesce(hit_t, fill_t) END AS exit_t,
  CASE WHEN hit_t IS NOT NULL AND hs THEN (CASE WHEN side = 1 THEN least(stop, ho)
  ELSE greatest(stop, ho) END) * (1 - side * ({_cost(2.0)}))
  WHEN hit_t IS NOT NULL THEN target
  WHEN entry_fill IS NOT NULL AND fill_t IS NOT NULL AND gap THEN fill_open * (1 - side * ({_cost(2.0)}))
  WHEN entry_fill IS NOT NULL AND fill_t IS NOT NULL THEN fill_open * (1 - side * ({_cost(1.0)}))
  END AS exit_fill, coalesce(hs AND ht, false) AS ambiguous FROM q4),
  results AS (SELECT *, (side * (exit_fill - entry_fill) - {EU.fee} * (entry_fill + exit_fill))
  / r_dist AS net_r FROM outcomes)"""


def rates(panel: Panel) -> DataFrame:
    """Rate events on the eight-hour grid, taken from the bar at that time."""
    return panel.fine.filter(F.col("ts") % panel.p.rate_ms == 0).select(
        "entity", "ts", ((F.col("close") - F.col("open")) / 10000.0).alias("rate"))


RATES = f"""rates AS (SELECT entity, ts, (close - open) / 10000.0 AS rate FROM fine
  WHERE ts % {EU.rate_ms} = 0)"""
