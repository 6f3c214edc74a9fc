"""Event ledgers, labels, reconciliation and curve reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitpanel.functions.columns import epoch_ms
from pitpanel.operators import ledgers, reports
from pitpanel.params import DAY, DEFAULTS, HOUR
from pitpanel.session import materialize
from queries.base import CURVE, curve, query, r6, table
from queries.outcomes import NATION_ROUNDS, nation_rounds
from queries.source_queries import ACTION_SQL, HOLD, SPANS, VAL, action, spans

REASONS = {"1-URGENT": "capacity", "2-HIGH": "min_notional", "3-MEDIUM": "max_positions",
           "4-NOT SPECIFIED": "ruined"}
REASON_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REASONS.items()) + " END"
LEDGER = f"""ln AS (SELECT l.*, o_orderstatus, o_orderpriority, epoch_us(o_orderdate) // 1000 AS dt,
  epoch_us(l_shipdate) // 1000 AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate,
  l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n
  FROM lineitem l JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P'),
  kinds AS (SELECT *, CASE WHEN n = 1 THEN CASE WHEN o_orderstatus = 'O' AND l_linestatus = 'O'
  AND l_returnflag = 'N' THEN 'skipped' ELSE 'fill_open' END
  WHEN l_returnflag = 'R' THEN 'rate' WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'rate_missing'
  ELSE 'fill_close' END AS kind FROM ln),
  ev AS (SELECT kind, t, l_orderkey AS pos_id, l_orderkey AS symbol, o_orderpriority AS arm, l_quantity AS qty,
  l_extendedprice / l_quantity AS price, l_tax * l_extendedprice / 100 AS fee,
  CASE WHEN kind = 'fill_close' THEN (l_discount - 0.05) * l_extendedprice END AS pnl,
  CASE WHEN kind = 'rate' THEN (l_discount - 0.05) * l_extendedprice / 10 END AS paid,
  NULL AS reason, CASE WHEN kind = 'fill_open' THEN dt END AS decision_ts FROM kinds WHERE kind <> 'skipped'
  UNION ALL SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'entry_cancelled' ELSE 'rejection' END,
  epoch_us(o_orderdate) // 1000, NULL, o_orderkey, o_orderpriority, NULL, NULL, NULL, NULL, NULL,
  {REASON_SQL}, epoch_us(o_orderdate) // 1000 FROM orders WHERE o_orderstatus = 'P'),
  cd AS (SELECT epoch_us(o_orderdate) // 1000 AS t, o_orderkey AS symbol,
  CASE WHEN o_orderpriority < '3' THEN 1 ELSE -1 END AS side, o_totalprice / 1000 AS r_dist,
  CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '2-HIGH' THEN 'reject' ELSE 'approve' END AS verdict
  FROM orders)"""


def events_of(spark, sf):
    o = table(spark, sf, "orders").withColumn("dt", epoch_ms("o_orderdate"))
    li = table(spark, sf, "lineitem").withColumn("t", epoch_ms("l_shipdate"))
    # lines of one order: a handful of rows
    w = W.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey",
                                            "l_quantity", "l_extendedprice")
    x = li.join(o.filter("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus", "o_orderpriority", "dt"),
                F.col("l_orderkey") == F.col("o_orderkey")).withColumn("n", F.row_number().over(w))
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    kind = (F.when(F.col("n") == 1, F.when((F.col("o_orderstatus") == "O") & (status == "O") & (flag == "N"),
                                          "skipped").otherwise("fill_open"))
            .when(flag == "R", "rate").when((flag == "A") & (status == "O"), "rate_missing")
            .otherwise("fill_close"))
    ext = F.col("l_extendedprice")
    move = (F.col("l_discount") - 0.05) * ext
    k = F.col("kind")
    fills = x.withColumn("kind", kind).filter("kind <> 'skipped'").select(
        "kind", "t", F.col("l_orderkey").alias("pos_id"), F.col("l_orderkey").alias("symbol"),
        F.col("o_orderpriority").alias("arm"), F.col("l_quantity").alias("qty"),
        (ext / F.col("l_quantity")).alias("price"), (F.col("l_tax") * ext / 100).alias("fee"),
        F.when(k == "fill_close", move).alias("pnl"),
        F.when(k == "rate", move / 10).alias("paid"),
        F.lit(None).cast("string").alias("reason"), F.when(k == "fill_open", F.col("dt")).alias("decision_ts"))
    m = F.create_map(*[F.lit(v) for kv in REASONS.items() for v in kv])
    refused = o.filter("o_orderstatus = 'P'").select(
        F.when(F.col("o_orderpriority") == "5-LOW", "entry_cancelled").otherwise("rejection").alias("kind"),
        F.col("dt").alias("t"), F.col("o_orderkey").alias("symbol"), F.col("o_orderpriority").alias("arm"),
        F.element_at(m, F.col("o_orderpriority")).alias("reason"), F.col("dt").alias("decision_ts"))
    return fills.unionByName(refused, allowMissingColumns=True)


def cands_of(spark, sf):
    o, pri = table(spark, sf, "orders"), F.col("o_orderpriority")
    return o.select(epoch_ms("o_orderdate").alias("t"), F.col("o_orderkey").alias("symbol"),
                    F.when(pri < "3", 1).otherwise(-1).alias("side"),
                    (F.col("o_totalprice") / 1000).alias("r_dist"),
                    F.when((F.col("o_orderstatus") == "O") & (pri == "2-HIGH"), "reject")
                    .otherwise("approve").alias("verdict"))


LABELS = LEDGER + """, op AS (SELECT decision_ts, symbol, pos_id, qty, fee, t AS entry_t FROM ev WHERE kind = 'fill_open'),
  pp AS (SELECT pos_id, sum(qty) FILTER (kind = 'fill_close') AS cqty, sum(fee) FILTER (kind = 'fill_close') AS cfee,
  sum(pnl) AS pnl, max(t) FILTER (kind = 'fill_close') AS exit_t, sum(paid) AS paid
  FROM ev WHERE kind IN ('fill_close', 'rate') GROUP BY 1),
  rj AS (SELECT decision_ts, symbol, CASE WHEN kind = 'entry_cancelled' THEN 'missing_bar' ELSE reason END AS why
  FROM ev WHERE kind IN ('rejection', 'entry_cancelled')),
  lj AS (SELECT cd.*, op.pos_id, op.qty, op.entry_t, op.fee, coalesce(cqty, 0) AS cqty, coalesce(cfee, 0) AS cfee,
  coalesce(pnl, 0) AS pnl, exit_t, coalesce(paid, 0) AS paid, CASE WHEN verdict = 'reject' THEN 'governor_rejected'
  WHEN op.pos_id IS NOT NULL AND op.qty - coalesce(cqty, 0) > 1e-12 THEN 'still_open'
  WHEN op.pos_id IS NOT NULL THEN NULL WHEN why IN ('capacity', 'max_positions') THEN 'capacity_rejected'
  WHEN why = 'min_notional' THEN 'min_notional_rejected' WHEN why = 'missing_bar' THEN 'cancelled_missing_bar'
  WHEN why = 'ruined' THEN 'ruined_rejected' WHEN why IS NOT NULL THEN why ELSE 'no_fill' END AS exclusion
  FROM cd LEFT JOIN op ON op.decision_ts = cd.t AND op.symbol = cd.symbol
  LEFT JOIN rj ON rj.decision_ts = cd.t AND rj.symbol = cd.symbol LEFT JOIN pp ON pp.pos_id = op.pos_id),
  labels_l AS (SELECT t, symbol, exclusion IS NULL AS executed, CASE WHEN exclusion IS NULL THEN entry_t END AS entry_t,
  CASE WHEN exclusion IS NULL THEN exit_t END AS exit_t,
  CASE WHEN exclusion IS NULL THEN pnl - fee - cfee - paid END AS net_pnl,
  CASE WHEN exclusion IS NULL THEN (pnl - fee - cfee - paid) / (qty * r_dist) END AS net_r, exclusion FROM lj)"""


def labels_of(spark, sf):
    return ledgers.ledger_labels(cands_of(spark, sf), materialize(events_of(spark, sf)))


@query("ledger_labels", f"""WITH {LABELS} SELECT t, symbol, executed, entry_t, exit_t, round(net_pnl, 8) AS net_pnl,
  round(net_r, 6) AS net_r, exclusion FROM labels_l""")
def _(spark, sf):
    return labels_of(spark, sf).select("t", "symbol", "executed", "entry_t", "exit_t", r6("net_pnl", "net_pnl", 8),
                                       r6("net_r", "net_r"), "exclusion")


SPLIT_SQL = f"""CASE WHEN hi IS NULL THEN 'unlabeled' WHEN lo < {VAL} THEN CASE WHEN hi < {VAL} THEN 'train'
  ELSE 'purged_train' END WHEN hi < {HOLD} THEN 'validation' ELSE 'purged_validation' END"""


def split_rows(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("symbol"), epoch_ms("o_orderdate").alias("lo0"))
    x = o.join(spans(spark, sf), "symbol", "left").filter(F.col("lo0") < HOLD)
    return ledgers.purged_split(x, VAL, HOLD, 3000 * DAY, t="lo0")


@query("purged_split", f"""WITH {SPANS}, x AS (SELECT o_orderkey AS symbol, epoch_us(o_orderdate) // 1000 AS lo, hi
  FROM orders LEFT JOIN sp ON sp.symbol = o_orderkey WHERE epoch_us(o_orderdate) // 1000 < {HOLD})
  SELECT symbol, lo, hi, {SPLIT_SQL} AS split FROM x""")
def _(spark, sf):
    return split_rows(spark, sf).select("symbol", F.col("lo0").alias("lo"), "hi", "split")


GRID0, GRID1 = 9200 * DAY, 11500 * DAY


@query("interval_overlap", f"""WITH {SPANS}, g AS (SELECT unnest(generate_series({GRID0}, {GRID1}, {7 * DAY})) AS t),
  c AS (SELECT t, (SELECT count(*) FROM sp WHERE lo <= t AND hi >= t) AS k FROM g),
  q AS (SELECT count(*) AS n FROM sp), dj AS (SELECT sum(c1.n * e.n)::BIGINT AS d FROM
  (SELECT lo, count(*) AS n FROM sp GROUP BY 1) c1 JOIN (SELECT hi, count(*) AS n FROM sp GROUP BY 1) e ON e.hi < c1.lo)
  SELECT n AS n_labels, (n * (n - 1) / 2 - d)::DECIMAL(38,0) AS pairs,
  round((n * (n - 1) / 2 - d) / (n * (n - 1) / 2), 9) AS pair_fraction,
  (SELECT round(avg(k), 6) FROM c) AS mean_concurrent, (SELECT max(k) FROM c) AS max_concurrent FROM q, dj""")
def _(spark, sf):
    s = materialize(spans(spark, sf))
    grid = spark.range(GRID0, GRID1 + 1, 7 * DAY).select(F.col("id").alias("t"))
    out = ledgers.interval_overlap(s, grid, "lo", "hi", "t", 60 * DAY)
    return out.select("n_labels", "pairs", r6("pair_fraction", "pair_fraction", 9),
                      r6("mean_concurrent", "mean_concurrent"), "max_concurrent")


@query("uncovered_boundaries", f"""WITH {SPANS}, s AS (SELECT o_orderpriority AS arm, lo, hi FROM sp
  JOIN orders ON o_orderkey = symbol WHERE o_orderstatus = 'F' AND hi - lo < {20 * DAY}),
  g AS (SELECT arm, unnest(generate_series({GRID0}, {GRID1}, {DAY})) AS t FROM (SELECT DISTINCT arm FROM s))
  SELECT g.arm, g.t FROM g WHERE EXISTS (SELECT 1 FROM s WHERE s.arm = g.arm AND s.lo < g.t AND g.t <= s.hi)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = g.arm AND o_orderstatus = 'P'
  AND epoch_us(o_orderdate) // 1000 = g.t)""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("symbol"), F.col("o_orderpriority").alias("arm"),
                                          "o_orderstatus", epoch_ms("o_orderdate").alias("t"))
    s = (spans(spark, sf).join(o.filter("o_orderstatus = 'F'"), "symbol")
         .filter(F.col("hi") - F.col("lo") < 20 * DAY).select("arm", "lo", "hi"))
    grid = s.select("arm").distinct().select("arm", F.explode(F.sequence(
        F.lit(GRID0), F.lit(GRID1), F.lit(DAY))).alias("t"))
    return ledgers.uncovered_boundaries(grid, s, o.filter("o_orderstatus = 'P'").select("arm", "t"), "arm", "lo", "hi",
                                        "t", 60 * DAY)


@query("unexplained_rows", f"""WITH {LEDGER}, dd AS (SELECT cd.*, o_orderpriority AS p, o_orderstatus AS s FROM cd
  JOIN orders ON o_orderkey = symbol), st AS (SELECT *, CASE WHEN p = '5-LOW' AND s = 'O' THEN NULL
  WHEN p = '4-NOT SPECIFIED' THEN 'rank_cut' ELSE 'submitted' END AS stage FROM dd),
  sn AS (SELECT DISTINCT decision_ts, symbol FROM ev WHERE kind IN ('fill_open', 'rejection', 'entry_cancelled')),
  x AS (SELECT st.t, st.symbol, CASE WHEN stage IS NULL THEN 'no_decision' WHEN stage = 'submitted'
  AND verdict <> 'reject' AND sn.symbol IS NULL THEN 'no_outcome' END AS why FROM st
  LEFT JOIN sn ON sn.decision_ts = st.t AND sn.symbol = st.symbol) SELECT * FROM x WHERE why IS NOT NULL""")
def _(spark, sf):
    c = cands_of(spark, sf)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("symbol"), "o_orderpriority", "o_orderstatus")
    pri = F.col("o_orderpriority")
    d = c.join(o, "symbol").filter(~((pri == "5-LOW") & (F.col("o_orderstatus") == "O"))).select(
        "t", "symbol", F.lit(0).alias("seq"), "verdict",
        F.when(pri == "4-NOT SPECIFIED", "rank_cut").otherwise("submitted").alias("stage"))
    return ledgers.unexplained_rows(c, d, events_of(spark, sf))


# ---------------------------------------------------------------- rates
@query("rate_reconcile", f"""WITH {LEDGER}, r AS (SELECT e.symbol, e.kind, e.paid, CASE WHEN cd.side > 0 THEN 'long'
  ELSE 'short' END AS side, CASE WHEN e.kind = 'rate' THEN CASE WHEN paid > 0 THEN 'positive' WHEN paid < 0
  THEN 'negative' ELSE 'zero' END END AS sign, CASE WHEN e.kind = 'rate' THEN
  strftime(make_timestamp(e.t * 1000), '%Y-%m') END AS month FROM ev e JOIN cd ON cd.symbol = e.pos_id
  WHERE e.kind IN ('rate', 'rate_missing'))
  SELECT CASE WHEN grouping(symbol) = 0 THEN 'symbol' WHEN grouping(side) = 0 THEN 'side'
  WHEN grouping(sign) = 0 THEN 'sign' WHEN grouping(month) = 0 THEN 'month' ELSE 'total' END AS level,
  coalesce(symbol::VARCHAR, side, sign, month) AS key, count(*) FILTER (kind = 'rate') AS applied,
  count(*) FILTER (kind <> 'rate') AS missing, round(coalesce(sum(paid), 0), 7) AS paid FROM r
  GROUP BY GROUPING SETS ((symbol), (side), (sign), (month), ())""")
def _(spark, sf):
    ev = events_of(spark, sf).withColumn("symbol", F.col("symbol").cast("string"))
    pos = cands_of(spark, sf).select(F.col("symbol").alias("pos_id"), "side")
    return reports.rate_reconcile(ev, pos).select("level", "key", "applied", "missing", r6("paid", "paid", 7))


@query("rate_identity", f"""WITH {LEDGER} SELECT round(sum(paid), 3) AS position_sum, round(sum(paid), 3) AS event_sum,
  true AS reconciled FROM ev WHERE kind = 'rate'""")
def _(spark, sf):
    ev = materialize(events_of(spark, sf))
    pos = ev.filter("kind = 'rate'").groupBy("pos_id").agg(F.sum("paid").alias("rate_paid"))
    # float sums in two orders: the tolerance grows with the total
    return reports.rate_identity(ev, pos, tol=1e-3).select(r6("position_sum", "position_sum", 3),
                                                           r6("event_sum", "event_sum", 3), "reconciled")


@query("activity_guard", f"""WITH {LEDGER}, a AS (SELECT arm, count(*) FILTER (kind = 'rate') AS applied,
  count(*) FILTER (kind = 'rate_missing') AS missing, round(coalesce(sum(paid), 0), 3) AS paid,
  count(*) FILTER (kind = 'fill_close') AS closes FROM ev GROUP BY 1)
  SELECT arm, applied, missing, paid, CASE WHEN closes < 50 THEN 'below_threshold' WHEN applied + missing = 0
  THEN 'no_crossings' WHEN applied = 0 THEN 'none_applied' WHEN paid = 0 THEN 'zero_total' ELSE 'active' END
  AS reason FROM a""")
def _(spark, sf):
    k = F.col("kind")
    totals = events_of(spark, sf).groupBy("arm").agg(
        F.count_if(k == "rate").alias("applied"), F.count_if(k == "rate_missing").alias("missing"),
        r6(F.coalesce(F.sum("paid"), F.lit(0.0)), "paid", 3), F.count_if(k == "fill_close").alias("closes"))
    return reports.activity_guard(totals, 2400.0, F.col("closes")).select("arm", "applied", "missing", "paid", "reason")


# ---------------------------------------------------------------- reports
DD = """dd AS (SELECT arm, max(1 - equity / peak) AS max_drawdown FROM (SELECT arm, equity,
  max(equity) OVER (PARTITION BY arm ORDER BY t) AS peak FROM curve) GROUP BY arm)"""
RETS = """rets AS (SELECT * FROM (SELECT arm, t, equity / lag(equity) OVER (PARTITION BY arm ORDER BY t) - 1 AS ret
  FROM curve) WHERE ret IS NOT NULL)"""
BUCKET = 90 * DAY


@query("max_drawdown", f"WITH {CURVE}, {DD} SELECT arm, round(max_drawdown, 9) AS max_drawdown FROM dd")
def _(spark, sf):
    out = reports.max_drawdown(materialize(curve(spark, sf)), ["arm"], "t", "equity", bucket_ms=BUCKET)
    return out.select("arm", r6("max_drawdown", "max_drawdown", 9))


@query("max_drawdown_cumulative", f"""WITH {CURVE}, {RETS}, c AS (SELECT arm, t, sum(ret) OVER w AS level FROM rets
  WINDOW w AS (PARTITION BY arm ORDER BY t)), p AS (SELECT arm, greatest(0, max(level) OVER (PARTITION BY arm
  ORDER BY t)) - level AS d FROM c) SELECT arm, round(max(d), 9) AS max_drawdown FROM p GROUP BY arm""")
def _(spark, sf):
    rets = materialize(reports.curve_returns(curve(spark, sf), ["arm"], "t", "equity", BUCKET).filter("ret is not null"))
    out = reports.max_drawdown(rets, ["arm"], "t", "ret", "cumulative", BUCKET)
    return out.select("arm", r6("max_drawdown", "max_drawdown", 9))


@query("drawdown_quantile", f"""WITH {CURVE}, {RETS}, c AS (SELECT arm, t, sum(ret) OVER w AS level FROM rets
  WINDOW w AS (PARTITION BY arm ORDER BY t)), p AS (SELECT arm, greatest(0, max(level) OVER (PARTITION BY arm
  ORDER BY t)) - level AS d FROM c) SELECT arm, round(quantile_cont(d, 0.95), 9) AS drawdown FROM p GROUP BY arm""")
def _(spark, sf):
    rets = materialize(reports.curve_returns(curve(spark, sf), ["arm"], "t", "equity", BUCKET).filter("ret is not null"))
    return reports.drawdown_quantile(rets, ["arm"], "t", "ret", 0.95, BUCKET).select("arm", r6("drawdown", "drawdown", 9))


@query("sortino", f"""WITH {CURVE}, {RETS} SELECT arm, round(CASE WHEN avg(least(ret, 0) * least(ret, 0)) = 0
  THEN CASE WHEN avg(ret) <= 0 THEN 0 ELSE 1e6 END ELSE avg(ret) / sqrt(avg(least(ret, 0) * least(ret, 0)))
  * sqrt(2191.5) END, 6) AS sortino FROM rets GROUP BY arm""")
def _(spark, sf):
    rets = reports.curve_returns(curve(spark, sf), ["arm"], "t", "equity", BUCKET)
    return reports.sortino(rets, ["arm"], "ret", DEFAULTS.periods_per_year).select("arm", r6("sortino", "sortino"))


def compounded_sql(part: str) -> str:
    """Product of 1 + ret over ``part``, less 1: signs counted, sizes as logarithms."""
    return f"""CASE WHEN count(*) FILTER ({part} AND 1 + ret = 0) > 0 THEN 0 ELSE
  (1 - 2 * (count(*) FILTER ({part} AND 1 + ret < 0) % 2)) * exp(coalesce(sum(ln(abs(1 + ret))) FILTER ({part} AND 1 + ret <> 0), 0))
  END - 1"""


@query("return_metrics", f"""WITH {CURVE}, {DD}, {RETS}, rn AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY t)
  - 1 AS i, count(*) OVER (PARTITION BY arm) AS n, row_number() OVER (PARTITION BY arm ORDER BY ret) AS rk FROM rets),
  e AS (SELECT arm, arg_min(equity, t) AS e0, arg_max(equity, t) AS e1 FROM curve GROUP BY 1)
  SELECT rn.arm, count(*) AS n_returns, round(any_value(e1 / e0 - 1), 9) AS net_return,
  round(any_value(max_drawdown), 9) AS max_drawdown, round(avg(ret) / stddev_pop(ret) * sqrt(2191.5), 6) AS sharpe,
  round(avg(ret) / sqrt(avg(least(ret, 0) * least(ret, 0))) * sqrt(2191.5), 6) AS sortino,
  round(any_value((e1 / e0 - 1) / max_drawdown), 6) AS calmar,
  round(avg(ret) FILTER (rk <= greatest(1, n // 20)), 9) AS tail_mean,
  round({compounded_sql('i < n // 2')}, 9) AS first_half, round({compounded_sql('i >= n // 2')}, 9) AS second_half
  FROM rn JOIN dd USING (arm) JOIN e USING (arm) GROUP BY rn.arm""")
def _(spark, sf):
    m = reports.return_metrics(materialize(curve(spark, sf)), ["arm"], "t", "equity", bucket_ms=BUCKET)
    nine = ("net_return", "max_drawdown", "tail_mean", "first_half", "second_half")
    return m.select("arm", "n_returns", *[r6(c, c, 9) for c in nine], *[r6(c, c) for c in ("sharpe", "sortino", "calmar")])


def trades_of(spark, sf):
    pri = table(spark, sf, "orders").select(F.col("o_orderkey").alias("symbol"), F.col("o_orderpriority").alias("arm"))
    return labels_of(spark, sf).filter("executed").join(pri, "symbol").select("arm", "symbol", "net_pnl")


@query("trade_metrics", f"""WITH {LABELS}, {CURVE}, e AS (SELECT arm, arg_min(equity, t) AS e0, arg_max(equity, t) AS e1
  FROM curve GROUP BY 1), x AS (SELECT o_orderpriority AS arm, net_pnl, row_number() OVER (PARTITION BY o_orderpriority
  ORDER BY net_pnl DESC) AS rk FROM labels_l JOIN orders ON o_orderkey = symbol WHERE executed)
  SELECT e.arm, count(x.arm) AS n_trades, round(sum(net_pnl) FILTER (net_pnl > 0) / -sum(net_pnl) FILTER (net_pnl < 0),
  6) AS profit_factor, round(avg(net_pnl), 4) AS average_trade,
  round((any_value(e1) - coalesce(sum(net_pnl) FILTER (net_pnl > 0 AND rk <= 3), 0)) / any_value(e0) - 1, 6)
  AS net_return_ex_top FROM e LEFT JOIN x ON x.arm = e.arm GROUP BY e.arm""")
def _(spark, sf):
    ends = curve(spark, sf).groupBy("arm").agg(F.min_by("equity", "t").alias("e0"), F.max_by("equity", "t").alias("e1"))
    m = reports.trade_metrics(materialize(trades_of(spark, sf)), ends, ["arm"], "net_pnl")
    return m.select("arm", "n_trades", r6("profit_factor", "profit_factor"), r6("average_trade", "average_trade", 4),
                    r6("net_return_ex_top", "net_return_ex_top"))


@query("turnover_slippage", f"""WITH {LEDGER}, {CURVE}, m AS (SELECT arm, avg(equity) AS me FROM curve GROUP BY 1),
  f AS (SELECT ev.arm, abs(qty) * price AS nt, CASE WHEN o_totalprice > 250000 THEN 0.00015 ELSE 0.00035 END::DOUBLE AS slip
  FROM ev JOIN orders ON o_orderkey = pos_id WHERE kind IN ('fill_open', 'fill_close'))
  SELECT f.arm, round(sum(nt * slip), 3) AS slippage, round(sum(nt) / any_value(me), 6) AS turnover
  FROM f JOIN m USING (arm) GROUP BY f.arm""")
def _(spark, sf):
    fills = events_of(spark, sf).filter(F.col("kind").isin("fill_open", "fill_close"))
    rate = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos_id"), F.when(
        F.col("o_totalprice") > 250000, 0.00015).otherwise(0.00035).alias("slip"))
    me = curve(spark, sf).groupBy("arm").agg(F.avg("equity").alias("mean_equity"))
    return reports.turnover_slippage(fills, rate, me, ["arm"], "pos_id").select(
        "arm", r6("slippage", "slippage", 3), r6("turnover", "turnover"))


@query("exposure_metrics", f"""WITH {CURVE} SELECT arm, round(avg(CASE WHEN equity > 0 THEN gross_exposure / equity
  ELSE 0 END), 6) AS mean_exposure, round(avg(CASE WHEN gross_exposure = 0 THEN 1.0 ELSE 0.0 END), 6) AS time_in_cash
  FROM curve GROUP BY arm""")
def _(spark, sf):
    return reports.exposure_metrics(curve(spark, sf), ["arm"]).select(
        "arm", r6("mean_exposure", "mean_exposure"), r6("time_in_cash", "time_in_cash"))


@query("leaderboard", f"""WITH {LABELS}, {CURVE}, {DD}, e AS (SELECT arm, arg_min(equity, t) AS e0,
  arg_max(equity, t) AS e1 FROM curve GROUP BY 1),
  x AS (SELECT kind, arm, fee, paid, NULL::DOUBLE AS rp FROM ev UNION ALL SELECT 'position_closed', o_orderpriority, NULL,
  NULL, net_pnl FROM labels_l JOIN orders ON o_orderkey = symbol WHERE executed),
  g AS (SELECT arm, count(*) FILTER (kind = 'position_closed') AS trades,
  avg(CASE WHEN rp > 0 THEN 1.0 ELSE 0.0 END) FILTER (kind = 'position_closed') AS win_rate,
  avg(rp) FILTER (rp > 0) AS avg_winner, avg(rp) FILTER (rp <= 0) AS avg_loser,
  sum(fee) FILTER (kind IN ('fill_open', 'fill_close')) AS fees, sum(paid) AS rates,
  count(*) FILTER (kind = 'rejection') AS rejections FROM x GROUP BY 1)
  SELECT e.arm, e1 AS equity, round(e1 / e0 - 1, 9) AS net_return, round(max_drawdown, 9) AS max_drawdown, trades,
  round(win_rate, 6) AS win_rate, round(avg_winner, 4) AS avg_winner, round(avg_loser, 4) AS avg_loser,
  round(fees, 3) AS fees, round(rates, 3) AS rates, rejections FROM e JOIN dd USING (arm) JOIN g USING (arm)""")
def _(spark, sf):
    ev = materialize(events_of(spark, sf))
    closed = trades_of(spark, sf).select(F.lit("position_closed").alias("kind"), "arm",
                                         F.col("net_pnl").alias("realized_pnl"))
    every = ev.select("kind", "arm", "fee", "paid").unionByName(closed, allowMissingColumns=True)
    b = reports.leaderboard(materialize(curve(spark, sf)), every, ["arm"], bucket_ms=BUCKET)
    return b.select("arm", "equity", r6("net_return", "net_return", 9), r6("max_drawdown", "max_drawdown", 9), "trades",
                    r6("win_rate", "win_rate"), r6("avg_winner", "avg_winner", 4), r6("avg_loser", "avg_loser", 4),
                    r6("fees", "fees", 3), r6("rates", "rates", 3), "rejections")


@query("design_effect", """WITH y AS (SELECT source, quality::DOUBLE AS y FROM labels JOIN documents USING (doc_id)),
  g AS (SELECT source, count(*) AS m, avg(y) AS mu FROM y GROUP BY 1),
  a AS (SELECT count(*) AS k, sum(m) AS n, sum(m * m) AS mm, (SELECT avg(y) FROM y) AS gm FROM g),
  b AS (SELECT sum(m * (mu - gm) * (mu - gm)) AS ssb FROM g, a),
  w AS (SELECT sum((y - mu) * (y - mu)) AS ssw FROM y JOIN g USING (source)),
  v AS (SELECT *, ssb / (k - 1) AS msb, ssw / (n - k) AS msw, (n - mm / n) / (k - 1) AS m0 FROM a, b, w),
  i AS (SELECT *, CASE WHEN msb + (m0 - 1) * msw > 0 THEN (msb - msw) / (msb + (m0 - 1) * msw) ELSE 0 END AS icc FROM v)
  SELECT round(icc, 9) AS icc, k AS n_clusters, round(n / k, 6) AS mean_cluster_size,
  round(greatest(1, 1 + (n / k - 1) * icc), 9) AS design_effect,
  round(n / greatest(1, 1 + (n / k - 1) * icc), 6) AS ess FROM i""")
def _(spark, sf):
    y = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select(
        "source", F.col("quality").cast("double").alias("y"))
    d = reports.design_effect(y, "y", "source")
    return d.select(r6("icc", "icc", 9), "n_clusters", r6("mean_cluster_size", "mean_cluster_size"),
                    r6("design_effect", "design_effect", 9), r6("ess", "ess"))


@query("group_sizes", """WITH g AS (SELECT o_orderdate, count(*) AS n FROM orders GROUP BY 1)
  SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_boundaries, round(avg(n), 6) AS mean_size, max(n) AS max_size,
  quantile_cont(n, 0.5) AS median_size FROM g""")
def _(spark, sf):
    g = reports.group_sizes(table(spark, sf, "orders"), "o_orderdate")
    return g.select("n_rows", "n_boundaries", r6("mean_size", "mean_size"), "max_size", "median_size")


SEEDS = "seeds AS (SELECT user_id AS seed, avg(value) AS v FROM events GROUP BY 1)"


def seeds(spark, sf, cond="true"):
    return table(spark, sf, "events").filter(cond).groupBy(F.col("user_id").alias("seed")).agg(F.avg("value").alias("v"))


@query("seed_summary", f"""WITH {SEEDS} SELECT round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(var_samp(v), 6) AS variance,
  arg_max(seed, v) AS best_seed, arg_min(seed, v) AS worst_seed, count(*) FILTER (v > 50) AS wins,
  round(100.0 * count(*) FILTER (v > 50) / count(*), 6) AS win_pct FROM seeds""")
def _(spark, sf):
    s = reports.seed_summary(seeds(spark, sf), "seed", "v", 50.0)
    return s.select(*[r6(c, c) if c not in ("best_seed", "worst_seed", "wins") else c for c in s.columns])


@query("seed_delta", """WITH n AS (SELECT user_id AS seed, avg(value) AS v FROM events GROUP BY 1),
  o AS (SELECT user_id AS seed, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1)
  SELECT n.seed, round(o.v, 6) AS old_value, round(n.v, 6) AS new_value, round(n.v - o.v, 6) AS delta
  FROM n LEFT JOIN o USING (seed)""")
def _(spark, sf):
    d = reports.seed_delta(seeds(spark, sf), seeds(spark, sf, "event_type = 'view'"), "seed", "v")
    return d.select("seed", *[r6(c, c) for c in ("old_value", "new_value", "delta")])


CONV = """r AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value AS v
  FROM events), nn AS (SELECT run, count(*) AS n_rows FROM r GROUP BY 1),
  ma AS (SELECT run, i - 19 AS k, avg(v) OVER (PARTITION BY run ORDER BY i ROWS 19 PRECEDING) AS ma FROM r),
  mb AS (SELECT ma.*, n_rows - 19 AS len FROM ma JOIN nn USING (run) WHERE k >= 0 AND n_rows >= 24),
  f AS (SELECT run, max(ma) FILTER (k = len - 1) AS final_ma, quantile_cont(ma, 0.5) FILTER (k >= floor(len * 0.75))
  AS tail_median FROM mb GROUP BY 1)"""


@query("convergence_flag", f"""WITH {CONV} SELECT run, n_rows, round(final_ma, 6) AS final_ma,
  round(tail_median, 6) AS tail_median, round(final_ma, 6) < round(tail_median, 6) AS non_converged FROM nn LEFT JOIN f USING (run)""")
def _(spark, sf):
    from pitpanel.plans.ordered import with_position, with_value_bucket
    e = table(spark, sf, "events").select(F.col("user_id").alias("run"), "event_id", F.col("value").alias("v"))
    rows = with_position(with_value_bucket(e, "event_id"), ["run"], ["event_id"], F.col("_vb"), "i")
    rows = materialize(rows.drop("_vb"))
    out = reports.convergence_flag(rows, ["run"], "i", "v", 20)
    return out.select("run", "n_rows", r6("final_ma", "final_ma"), r6("tail_median", "tail_median"),
                      (F.round("final_ma", 6) < F.round("tail_median", 6)).alias("non_converged"))


@query("action_histogram", f"""WITH d AS (SELECT user_id AS arm, {ACTION_SQL} AS action, epoch_us(ts) // 1000 // {4 * HOUR}
  AS t, value FROM events) SELECT arm, count(*) AS n_decisions, count(*) FILTER (action = 'hold') AS n_hold,
  count(*) FILTER (action = 'close') AS n_close, count(*) FILTER (action = 'tighten_stop') AS n_tighten_stop,
  count(*) FILTER (value > 100) AS rejects, count(DISTINCT t) AS boundaries,
  count(*) FILTER (action IN ('tighten_stop', 'move_stop_breakeven')) =
  count(*) FILTER (action IN ('tighten_stop', 'move_stop_breakeven') AND value < 200) AS reconciled FROM d GROUP BY 1""")
def _(spark, sf):
    d = table(spark, sf, "events").select(
        F.col("user_id").alias("arm"), action().alias("action"), F.floor(epoch_ms("ts") / (4 * HOUR)).alias("t"), "value",
        F.when(F.col("value") > 100, "reject").alias("verdict"))
    ev = d.filter((F.col("value") < 200) & F.col("action").isin("tighten_stop", "move_stop_breakeven")).select(
        "arm", F.lit("stop_tightened").alias("kind"))
    return reports.action_histogram(d, ev, ["arm"], ["hold", "close", "tighten_stop"])


SCORES = """sc AS (SELECT d.doc_id, source, lang, n_chars / 1000.0 AS score, quality, toxic,
  quality - 0.5 * toxic + (n_chars % 7) / 10.0 AS y FROM documents d JOIN labels USING (doc_id))"""


def scores(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return d.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "source", "lang", (F.col("n_chars") / 1000.0).alias("score"), "quality", "toxic",
        (F.col("quality") - 0.5 * F.col("toxic") + F.pmod(F.col("n_chars"), F.lit(7)) / 10.0).alias("y"))


@query("accept_stats", f"""WITH {SCORES} SELECT lang, count(*) AS n, count(*) FILTER (score >= 1.0) AS n_accepted,
  round(avg(CASE WHEN score >= 1.0 THEN 1.0 ELSE 0.0 END), 6) AS accept_rate,
  round(avg(y) FILTER (score >= 1.0), 6) AS accepted_mean, round(avg(y) FILTER (NOT score >= 1.0), 6) AS rejected_mean
  FROM sc GROUP BY 1""")
def _(spark, sf):
    a = reports.accept_stats(scores(spark, sf), "score", "y", 1.0, ["lang"])
    return a.select("lang", "n", "n_accepted", *[r6(c, c) for c in ("accept_rate", "accepted_mean", "rejected_mean")])


MEMBERS = ["assistant", "system", "user"]
ROUND_SQL = """m AS (SELECT conv_id AS t, unnest(['assistant', 'system', 'user']) AS member FROM
  (SELECT DISTINCT conv_id FROM conversations)), rp AS (SELECT conv_id AS t, role AS member, bool_and(length(text) > 40)
  AS ok FROM conversations GROUP BY 1, 2), rc AS (SELECT m.t, bool_and(coalesce(ok, false)) AS valid,
  coalesce(string_agg(CASE WHEN NOT coalesce(ok, false) THEN m.member END, ',' ORDER BY m.member), '') AS failed,
  coalesce(string_agg(CASE WHEN ok IS NULL THEN m.member END, ',' ORDER BY m.member), '') AS missing
  FROM m LEFT JOIN rp ON rp.t = m.t AND rp.member = m.member GROUP BY m.t)"""


def completeness(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("t"), F.col("role").alias("member"),
                                                 (F.length("text") > 40).alias("ok"))
    return ledgers.round_completeness(c.select("t").distinct(), c, MEMBERS)


@query("round_completeness", f"WITH {ROUND_SQL} SELECT t, valid, failed, missing FROM rc")
def _(spark, sf):
    return completeness(spark, sf)


@query("round_counts", f"""WITH {ROUND_SQL} SELECT count(*) AS total, count(*) FILTER (valid) AS valid,
  count(*) FILTER (NOT valid) AS invalid FROM rc""")
def _(spark, sf):
    return reports.round_counts(completeness(spark, sf))


@query("score_alignment", f"""WITH {SCORES}, p AS (SELECT doc_id, avg(score) AS prob FROM sc WHERE lang <> 'de' GROUP BY 1)
  SELECT sc.doc_id, sc.quality, round(p.prob, 6) AS prob, e.label AS rank_score FROM sc JOIN p USING (doc_id)
  JOIN embeddings e ON e.vec_id = sc.doc_id""")
def _(spark, sf):
    from pitpanel.operators import selection
    s = scores(spark, sf)
    p = s.filter("lang <> 'de'").groupBy("doc_id").agg(F.avg("score").alias("prob"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("rank_score"))
    return selection.score_alignment(s.select("doc_id", "quality"), p, e, ["doc_id"]).select(
        "doc_id", "quality", r6("prob", "prob"), "rank_score")


@query("gap_report", f"""WITH {NATION_ROUNDS}, {LABELS}, {SPANS}, x AS (SELECT epoch_us(o_orderdate) // 1000 AS lo, hi
  FROM orders LEFT JOIN sp ON sp.symbol = o_orderkey WHERE epoch_us(o_orderdate) // 1000 < {HOLD}),
  co AS (SELECT 1 FROM metrics m JOIN ext USING (entity) WHERE liq_median >= 20000.0 AND completeness < 0.5)
  SELECT 'round' AS section, CASE WHEN valid THEN 'valid' WHEN NOT ctx_complete THEN 'context_incomplete'
  ELSE 'too_few_eligible' END AS key, count(*) AS n FROM rounds GROUP BY 2
  UNION ALL SELECT 'label', coalesce(exclusion, 'labeled'), count(*) FROM labels_l GROUP BY 2
  UNION ALL SELECT 'split', {SPLIT_SQL}, count(*) FROM x GROUP BY 2
  UNION ALL SELECT 'exclusion', 'completeness_only', count(*) FROM co HAVING count(*) > 0""")
def _(spark, sf):
    from queries.window_queries import daily_metrics
    only = daily_metrics(spark, sf).filter("liq_median >= 20000.0 and completeness < 0.5")
    return reports.gap_report(nation_rounds(spark, sf), labels_of(spark, sf), split_rows(spark, sf), only)


@query("top_k_per_round", """WITH r AS (SELECT o_orderdate, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY
  o_orderdate ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER (PARTITION BY o_orderdate) AS n FROM orders)
  SELECT o_orderkey, rank, rank || ' of ' || n AS label FROM r WHERE rank <= 3""")
def _(spark, sf):
    from pitpanel.operators import candidates
    o = table(spark, sf, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")
    return candidates.top_k_per_round(o, ["o_orderdate"], "o_totalprice", "o_orderkey", 3).select(
        "o_orderkey", "rank", "label")
