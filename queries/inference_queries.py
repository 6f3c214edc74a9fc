"""Resampling, rank statistics, selection and inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions.columns import epoch_ms
from pitpanel.operators import resampling as rs
from pitpanel.operators import selection
from pitpanel.params import DAY
from pitpanel.plans.ordered import time_bucket, with_time_key_bucket
from pitpanel.session import materialize
from queries.base import query, r6, table
from queries.ledger_queries import SCORES, scores

M = 2147483647
T_SQL = f"(doc_id // 5) * {DAY}"


def _mix(x: str) -> str:
    a = f"(({x}) * 48271 % {M})"
    b = f"xor({a}, {a} >> 13)"
    c = f"({b} * 69621 % {M})"
    return f"xor({c}, {c} >> 11)"


def draw_sql(seed: int, a: str, b: str) -> str:
    return _mix(f"({_mix(f'({a} + {seed}) % {M}')} + {b}) % {M}")


SC = SCORES + f""", s AS (SELECT {T_SQL} AS t, doc_id, score, y, quality, row_number() OVER (ORDER BY {T_SQL}, doc_id) - 1 AS i,
  count(*) OVER () AS n FROM sc)"""


def timed(spark, sf):
    t = (F.floor(F.col("doc_id") / 5) * DAY).cast("bigint")
    return scores(spark, sf).select(t.alias("t"), "doc_id", "score", "y", "quality", "lang")


def auc_sql(src: str, by: str = "", y: str = "y > 0") -> str:
    part = f"PARTITION BY {by}" if by else ""
    part2 = f"PARTITION BY {by}, score" if by else "PARTITION BY score"
    head = f"{by}, " if by else ""
    return f"""SELECT {head}(sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2)
  / CASE WHEN count(*) FILTER (pos) * count(*) FILTER (NOT pos) > 0 THEN count(*) FILTER (pos) * count(*) FILTER (NOT pos) END
  AS auc FROM (SELECT *, {y} AS pos, rank() OVER ({part} ORDER BY score) + (count(*) OVER ({part2}) - 1) / 2.0 AS r FROM {src})
  {f'GROUP BY {by}' if by else ''}"""


def ic_sql(src: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    head = f"{by}, " if by else ""

    def r(c):
        p2 = f"PARTITION BY {by}, {c}" if by else f"PARTITION BY {c}"
        return f"rank() OVER ({part} ORDER BY {c}) + (count(*) OVER ({p2}) - 1) / 2.0"
    return f"""SELECT {head}CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) ELSE 0 END AS ic
  FROM (SELECT *, {r('y')} AS a, {r('score')} AS b FROM {src}) {f'GROUP BY {by}' if by else ''}"""


@query("rank_auc", f"""WITH {SC} SELECT lang, round(auc, 9) AS auc FROM (
  {auc_sql('(SELECT s.*, lang FROM s JOIN documents USING (doc_id))', 'lang', 'quality > 0')})""")
def _(spark, sf):
    return rs.rank_auc(timed(spark, sf), "quality", "score", ["lang"]).select("lang", r6("auc", "auc", 9))


@query("rank_ic", f"""WITH {SC} SELECT lang, round(ic, 9) AS ic FROM (
  {ic_sql('(SELECT s.*, lang FROM s JOIN documents USING (doc_id))', 'lang')})""")
def _(spark, sf):
    return rs.rank_ic(timed(spark, sf), "y", "score", ["lang"]).select("lang", r6("ic", "ic", 9))


@query("time_blocks", f"""WITH {SC} SELECT doc_id, t, (t - (SELECT min(t) FROM s)) // {28 * DAY} AS block FROM s""")
def _(spark, sf):
    x = timed(spark, sf)
    x = x.withColumn("_a", x.select(F.min("t")).scalar())
    return rs.time_blocks(x, "t", F.col("_a")).select("doc_id", "t", "block")


REPS, SEED = 200, 20260903
OFFS = f"""bt AS (SELECT t, count(*) AS c FROM s GROUP BY 1), bo AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS j,
  sum(c) OVER (ORDER BY t) - c AS shift, min(t) OVER () AS a, max(t) OVER () AS b FROM bt),
  be AS (SELECT j, t, shift::BIGINT AS shift, row_number() OVER (ORDER BY t) - 1 AS k FROM bo WHERE t - a >= {28 * DAY}
  AND t - a <= b - a - {28 * DAY}),
  offs AS (SELECT rep, j, shift FROM (SELECT rep, {draw_sql(SEED, 'rep', '0')} % (SELECT count(*) FROM be) AS k
  FROM range({REPS}) q(rep)) JOIN be USING (k))"""
ROT = f"""{OFFS}, rot AS (SELECT rep, r.doc_id, r.t, r.score, l.y FROM offs, s r JOIN s l ON l.i = (r.i + shift) % r.n)"""


@query("rotation_offsets", f"WITH {SC}, {OFFS} SELECT rep, j, shift FROM offs")
def _(spark, sf):
    return rs.rotation_offsets(materialize(timed(spark, sf)), "t", REPS, SEED)


def rotated(spark, sf):
    x = materialize(timed(spark, sf))
    offs = materialize(rs.rotation_offsets(x, "t", REPS, SEED))
    x = with_time_key_bucket(x, "t", "doc_id")
    return rs.rotate_labels(x, ["t", "doc_id"], "t", "y", offs, F.col("_tk"), ["doc_id", "score"])


@query("rotate_labels", f"WITH {SC}, {ROT} SELECT rep, doc_id, y FROM rot")
def _(spark, sf):
    return rotated(spark, sf).select("rep", "doc_id", "y")


@query("block_permute", f"""WITH {SC}, b AS (SELECT t, count(*) AS c, row_number() OVER (ORDER BY t) - 1 AS slot,
  (t - min(t) OVER ()) // {28 * DAY} AS blk FROM s GROUP BY t),
  q AS (SELECT rep, t AS st, c, row_number() OVER (PARTITION BY rep ORDER BY {draw_sql(7, 'rep', 'blk')}, blk, t) - 1 AS slot
  FROM b, range({REPS}) g(rep)),
  r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id) - 1 AS rk FROM s)
  SELECT q.rep, r.doc_id, l.y FROM r JOIN b ON b.t = r.t JOIN q ON q.slot = b.slot
  JOIN r l ON l.t = q.st AND l.rk = r.rk % q.c""")
def _(spark, sf):
    x = materialize(timed(spark, sf))
    return rs.block_permute(x, ["doc_id"], "t", "y", REPS, 7, ["doc_id"]).select("rep", "doc_id", "y")


def network_sql(source: str, seed: int) -> str:
    """``rep, i, n, a, b, x`` with x after one pass through the permutation network."""
    inner = f"SELECT rep, i, n, a, b, x // b AS h, x % b AS l FROM {source}"
    for k in range(rs.ROUNDS):
        moved, fixed, base = ("h", "l", "a") if k % 2 == 0 else ("l", "h", "b")
        inner = f"SELECT * REPLACE (({moved} + {draw_sql(seed, f'(rep * {rs.ROUNDS} + {k})', fixed)}) % {base} AS {moved}) FROM ({inner})"
    return f"SELECT rep, i, n, a, b, h * b + l AS x FROM ({inner})"


def permuted_sql(seed: int, reps: int) -> str:
    """CTEs ending in ``h``: rep, i and the source position of every row of ``s``."""
    return f"""g0 AS (SELECT rep, i, n, i AS x, a, (n + a - 1) // a AS b FROM (SELECT *, ceil(sqrt(n::DOUBLE))::BIGINT AS a FROM s),
  range({reps}) g(rep)), wk AS ({network_sql('g0', seed)} UNION ALL {network_sql('wk WHERE x >= n', seed)}),
  h AS (SELECT rep, i, x AS src FROM wk WHERE x < n)"""


@query("shuffle_permute", f"""WITH RECURSIVE {SC}, {permuted_sql(11, REPS)}
  SELECT rep, r.doc_id, l.y FROM h JOIN s r ON r.i = h.i JOIN s l ON l.i = h.src""")
def _(spark, sf):
    x = materialize(timed(spark, sf))
    x = with_time_key_bucket(x, "t", "doc_id")
    return rs.shuffle_permute(x, ["t", "doc_id"], "y", REPS, 11, F.col("_tk"), ["doc_id"]) \
        .select("rep", "doc_id", "y")


# ---------------------------------------------------------------- curves on a weekly grid
WEEK, L, R = 7 * DAY, 8, 1000
WEEKLY = f"""w0 AS (SELECT o_orderpriority AS arm, epoch_us(o_orderdate) // 1000 // {WEEK} AS wk,
  round(coalesce(sum(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN -1.0 END * o_totalprice), 0) / 1e8, 10) AS r
  FROM orders GROUP BY 1, 2),
  wr AS (SELECT arm, wk - (SELECT min(wk) FROM w0) AS idx, r FROM w0),
  un AS (SELECT max(idx) + 1 AS u FROM wr)"""
DRAWS = f"""st AS (SELECT rep, b, {draw_sql(SEED, 'rep', 'b')} % u AS start, u FROM un, range({R}) g(rep),
  (SELECT unnest(generate_series(0, ((SELECT u FROM un) - 1) // {L})) AS b)),
  draws AS (SELECT rep, b * {L} + k AS pos, (start + k) % u AS idx FROM st, range({L}) h(k) WHERE b * {L} + k < u)"""
PATHS = f"""{WEEKLY}, {DRAWS}, pt AS (SELECT rep, arm, pos, r, sum(ln(1 + r)) OVER (PARTITION BY rep, arm ORDER BY pos) AS e
  FROM draws JOIN wr USING (idx)),
  pk AS (SELECT *, max(e) OVER (PARTITION BY rep, arm ORDER BY pos) AS p FROM pt),
  paths AS (SELECT rep, arm, CASE WHEN avg(least(r, 0) * least(r, 0)) = 0 THEN CASE WHEN avg(r) <= 0 THEN 0 ELSE 1e6 END
  ELSE avg(r) / sqrt(avg(least(r, 0) * least(r, 0))) * sqrt(52.0) END AS sortino, max(1 - exp(e - p)) AS max_drawdown
  FROM pk GROUP BY 1, 2)"""


def weekly(spark, sf):
    o = table(spark, sf, "orders")
    sign = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", -1.0)
    w = o.groupBy(F.col("o_orderpriority").alias("arm"), F.floor(epoch_ms("o_orderdate") / WEEK).alias("wk")).agg(
        F.round(F.coalesce(F.sum(sign * F.col("o_totalprice")), F.lit(0.0)) / 1e8, 10).alias("r"))
    w = materialize(w)
    return materialize(w.withColumn("_m", w.select(F.min("wk")).scalar())
                       .select("arm", (F.col("wk") - F.col("_m")).alias("idx"), "r"))


def weekly_draws(spark, wr):
    return rs.block_draws(wr.select(F.max("idx") + 1).scalar(), L, R, SEED, spark)


@query("block_bootstrap", f"""WITH {WEEKLY}, {DRAWS} SELECT rep, pos, idx, arm, r FROM draws JOIN wr USING (idx)""")
def _(spark, sf):
    wr = weekly(spark, sf)
    return rs.block_bootstrap(wr, "idx", weekly_draws(spark, wr)).select("rep", "pos", "idx", "arm", "r")


def paths(spark, sf):
    wr = weekly(spark, sf)
    return materialize(rs.paired_paths(wr, weekly_draws(spark, wr), "arm", "idx", "r", 52.0))


@query("bootstrap_ci", f"""WITH {PATHS}, x AS (SELECT arm, 'sortino' AS stat, sortino AS v FROM paths UNION ALL
  SELECT arm, 'max_drawdown', max_drawdown FROM paths) SELECT arm, stat, round(quantile_cont(v, 0.025), 6) AS lo,
  round(quantile_cont(v, 0.975), 6) AS hi, round(stddev_pop(v), 6) AS se FROM x GROUP BY 1, 2""")
def _(spark, sf):
    ci = rs.bootstrap_ci(paths(spark, sf), ["sortino", "max_drawdown"], ["arm"])
    return ci.select("arm", "stat", r6("lo", "lo"), r6("hi", "hi"), r6("se", "se"))


@query("paired_dd95", f"""WITH {PATHS} SELECT arm, round(quantile_cont(max_drawdown, 0.95), 9) AS dd95 FROM paths GROUP BY 1""")
def _(spark, sf):
    return rs.paired_dd95(paths(spark, sf), "arm").select("arm", r6("dd95", "dd95", 9))


BASE = "5-LOW"
PP = f"""pp AS (SELECT x.arm, (count(*) FILTER (x.sortino - b.sortino <= 0) + 1) / (count(*) + 1) AS p
  FROM paths x JOIN paths b ON b.rep = x.rep AND b.arm = '{BASE}' WHERE x.arm <> '{BASE}' GROUP BY 1)"""
HOLM = """hm AS (SELECT arm, p, max(s) OVER (ORDER BY p, arm) AS p_holm FROM (SELECT arm, p, least(1,
  (count(*) OVER () - row_number() OVER (ORDER BY p, arm) + 1) * p) AS s FROM pp))"""


@query("paired_p", f"WITH {PATHS}, {PP} SELECT arm, round(p, 9) AS p FROM pp")
def _(spark, sf):
    return rs.paired_p(paths(spark, sf), "arm", "sortino", BASE).select("arm", r6("p", "p", 9))


@query("holm", f"WITH {PATHS}, {PP}, {HOLM} SELECT arm, round(p, 9) AS p, round(p_holm, 9) AS p_holm FROM hm")
def _(spark, sf):
    h = rs.holm(rs.paired_p(paths(spark, sf), "arm", "sortino", BASE), "p", "arm")
    return h.select("arm", r6("p", "p", 9), r6("p_holm", "p_holm", 9))


@query("improves_over", f"""WITH {PATHS}, {PP}, {HOLM}, dq AS (SELECT arm, quantile_cont(max_drawdown, 0.95) AS dd95 FROM paths
  GROUP BY 1) SELECT arm, round(p_holm, 9) AS p_holm, round(dd95, 9) AS dd95,
  dd95 <= (SELECT dd95 FROM dq WHERE arm = '{BASE}') AS dd_pass,
  p_holm < 0.05 AND dd95 <= (SELECT dd95 FROM dq WHERE arm = '{BASE}') AS improves FROM hm JOIN dq USING (arm)""")
def _(spark, sf):
    p = paths(spark, sf)
    h = rs.holm(rs.paired_p(p, "arm", "sortino", BASE), "p", "arm")
    return rs.improves_over(h, rs.paired_dd95(p, "arm"), "arm", BASE).select(
        "arm", r6("p_holm", "p_holm", 9), r6("dd95", "dd95", 9), "dd_pass", "improves")


OPT = f"""{PATHS}, op AS (SELECT arm, avg(sortino) AS s, quantile_cont(max_drawdown, 0.95) AS d FROM paths GROUP BY 1),
  ut AS (SELECT arm, s - 2 * greatest(0, (d - d0) / greatest(d0, 0.01)) AS utility, row_number() OVER (ORDER BY arm) AS o
  FROM op, (SELECT d AS d0 FROM op WHERE arm = '{BASE}'))"""


@query("utility_select", f"""WITH {OPT} SELECT arm, round(utility, 6) AS utility, o = (SELECT o FROM ut ORDER BY utility DESC, o
  LIMIT 1) AS selected FROM ut""")
def _(spark, sf):
    op = paths(spark, sf).groupBy("arm").agg(F.avg("sortino").alias("s"),
                                             F.percentile("max_drawdown", F.lit(0.95)).alias("d"))
    base = op.filter(F.col("arm") == BASE).select("d").scalar()
    # the leading digit of the arm name is its order
    o = op.withColumn("d0", base).withColumn("o", F.substring("arm", 1, 1).cast("int"))
    return selection.utility_select(o, "o", "s", "d", "d0").select("arm", r6("utility", "utility"), "selected")


# ---------------------------------------------------------------- nulls
NULLS = f"{SC}, {ROT}, na AS ({auc_sql('rot', 'rep')}), ni AS ({ic_sql('rot', 'rep')}), " \
    f"oa AS ({auc_sql('s')}), oi AS ({ic_sql('s')})"


def nulls(spark, sf):
    x = materialize(timed(spark, sf).withColumn("prob", F.col("score")))
    offs = materialize(rs.rotation_offsets(x, "t", REPS, SEED))
    return x, materialize(rs.rotation_null(x, ["t", "doc_id"], "t", "y", "prob", "score", offs,
                                           time_bucket("t", 60 * DAY)))


@query("two_sided_p", f"""WITH {NULLS}, x AS (SELECT 'auc' AS stat, abs(auc - 0.5) >= abs((SELECT auc FROM oa) - 0.5) AS hit
  FROM na UNION ALL SELECT 'ic', abs(ic) >= abs((SELECT ic FROM oi)) FROM ni) SELECT stat, count(*) FILTER (hit) AS count_ge,
  count(*) AS n, count(*) FILTER (hit) / count(*) AS p_raw, (count(*) FILTER (hit) + 1) / (count(*) + 1) AS p_upper
  FROM x GROUP BY 1""")
def _(spark, sf):
    x, null = nulls(spark, sf)
    out = None
    for stat, obs, center in (("auc", rs.rank_auc(x, "y", "score"), 0.5), ("ic", rs.rank_ic(x, "y", "score"), 0.0)):
        rows = null.withColumn("_obs", obs.select(stat).scalar())
        row = rs.two_sided_p(rows, stat, F.col("_obs"), center).select(F.lit(stat).alias("stat"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def _erf(x: str) -> str:
    k = f"(1 / (1 + 0.3275911 * abs({x})))"
    return (f"(sign({x}) * (1 - ((((1.061405429 * {k} - 1.453152027) * {k} + 1.421413741) * {k} - 0.284496736) * {k} "
            f"+ 0.254829592) * {k} * exp(-({x}) * ({x}))))")


@query("approx_power", f"""WITH {NULLS}, c AS (SELECT quantile_cont(abs(ic), 0.95) AS critical, stddev_pop(ic) AS se FROM ni)
  SELECT round(critical, 9) AS critical, round(se, 9) AS se,
  round(1 - 0.5 * (1 + {_erf('((critical - 0.05) / se / sqrt(2.0))')}), 6) AS power FROM c""")
def _(spark, sf):
    null = nulls(spark, sf)[1]
    se = null.select(F.stddev_pop("ic")).scalar()
    return rs.approx_power(null, "ic", 0.0, se, 0.05).select(
        r6("critical", "critical", 9), r6("se", "se", 9), r6("power", "power"))


BOOTS = 1000
VERDICT = f"""{NULLS}, ub AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS idx FROM (SELECT DISTINCT t FROM s)),
  one AS (SELECT count(*) AS u, greatest(1, ceil(count(*) * 28 / greatest((max(t) - min(t)) / {DAY}, 28)))::BIGINT AS l FROM ub),
  vst AS (SELECT rep, b, {draw_sql(SEED + 1, 'rep', 'b')} % u AS start, u, l FROM one, range({BOOTS}) g(rep),
  (SELECT unnest(generate_series(0, ((SELECT u FROM one) - 1) // (SELECT l FROM one))) AS b)),
  vd AS (SELECT rep, (start + k) % u AS idx FROM vst, range(200) h(k) WHERE k < l AND b * l + k < u),
  boot AS (SELECT rep, s.y, s.score FROM vd JOIN ub USING (idx) JOIN s ON s.t = ub.t),
  ba AS ({auc_sql('boot', 'rep')}), bi AS ({ic_sql('boot', 'rep')}),
  ca AS (SELECT quantile_cont(auc, 0.025) AS lo, quantile_cont(auc, 0.975) AS hi, stddev_pop(auc) AS se FROM ba),
  ci AS (SELECT quantile_cont(ic, 0.025) AS lo, quantile_cont(ic, 0.975) AS hi, stddev_pop(ic) AS se FROM bi),
  z AS (SELECT (SELECT u FROM one) AS n_boundaries, (SELECT count(*) FROM offs) AS n_offsets, (SELECT auc FROM oa) AS auc,
  (SELECT ic FROM oi) AS ic,
  (SELECT (count(*) FILTER (abs(auc - 0.5) >= abs((SELECT auc FROM oa) - 0.5)) + 1) / (count(*) + 1) FROM na) AS p_auc,
  (SELECT (count(*) FILTER (abs(ic) >= abs((SELECT ic FROM oi))) + 1) / (count(*) + 1) FROM ni) AS p_ic,
  ca.lo AS auc_lo, ca.hi AS auc_hi, ci.lo AS ic_lo, ci.hi AS ic_hi, ca.se AS sa, ci.se AS si,
  (SELECT quantile_cont(abs(auc - 0.5), 0.95) FROM na) AS xa, (SELECT quantile_cont(abs(ic), 0.95) FROM ni) AS xi FROM ca, ci),
  y2 AS (SELECT *, 1 - 0.5 * (1 + {_erf('((xa - 0.02) / sa / sqrt(2.0))')}) AS power_auc,
  1 - 0.5 * (1 + {_erf('((xi - 0.05) / si / sqrt(2.0))')}) AS power_ic FROM z),
  v AS (SELECT *, p_auc >= 0.05 AND p_ic >= 0.05 AS ca2, 0.5 BETWEEN auc_lo AND auc_hi AND 0 BETWEEN ic_lo AND ic_hi AS cb2,
  power_auc >= 0.6 AND power_ic >= 0.6 AS cc2 FROM y2)"""


@query("learnability_verdict", f"""WITH {VERDICT} SELECT n_boundaries, n_offsets, round(auc, 6) AS auc, round(ic, 6) AS ic,
  round(p_auc, 6) AS p_auc, round(p_ic, 6) AS p_ic, round(auc_lo, 6) AS auc_lo, round(auc_hi, 6) AS auc_hi,
  round(ic_lo, 6) AS ic_lo, round(ic_hi, 6) AS ic_hi, round(power_auc, 5) AS power_auc, round(power_ic, 5) AS power_ic,
  CASE WHEN n_boundaries < 4 OR n_offsets = 0 THEN 'INSUFFICIENT DATA' WHEN ca2 AND cb2 AND cc2
  THEN 'INSUFFICIENT LEARNABLE VARIATION' WHEN ca2 AND cb2 THEN 'UNDERPOWERED' ELSE 'CONDITIONS NOT MET' END AS verdict FROM v""")
def _(spark, sf):
    x = timed(spark, sf).withColumn("prob", F.col("score"))
    v = rs.learnability(x, "t", "doc_id", "y", "prob", "score", REPS, BOOTS, SEED)
    six = ("auc", "ic", "p_auc", "p_ic", "auc_lo", "auc_hi", "ic_lo", "ic_hi")
    return v.select("n_boundaries", "n_offsets", *[r6(c, c) for c in six], r6("power_auc", "power_auc", 5),
                    r6("power_ic", "power_ic", 5), "verdict")


GRID = [0.5, 1.0, 2.0, 5.0, 20.0]


@query("grid_select", f"""WITH {SC}, g AS (SELECT p AS param, (SELECT count(*) FROM s WHERE score >= p) AS n_selected,
  (SELECT avg(y) FROM s WHERE score >= p) AS metric, (SELECT count(*) FROM s) AS n_total
  FROM (SELECT unnest({GRID}) AS p)), o AS (SELECT *, n_selected >= ceil(50 * n_total / 750) AND metric IS NOT NULL AS ok FROM g)
  SELECT coalesce((SELECT param FROM o WHERE ok ORDER BY metric DESC, param LIMIT 1), {GRID[0]})::DOUBLE AS selected,
  count(*) FILTER (ok) AS n_selectable, round(max(metric) FILTER (ok), 6) AS best_metric FROM o""")
def _(spark, sf):
    pts = selection.threshold_grid(timed(spark, sf), "score", "y", GRID)
    return selection.grid_select(pts, GRID[0]).select("selected", "n_selectable", r6("best_metric", "best_metric"))


@query("grid_select_top_k", f"""WITH {SC}, r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, doc_id) AS rk FROM s),
  g AS (SELECT p AS param, count(*) AS n_selected, avg(y) AS metric, any_value(n) AS n_total FROM r,
  (SELECT unnest([1, 2, 3, 5]) AS p) WHERE rk <= p GROUP BY 1), o AS (SELECT *, n_selected >= ceil(50 * n_total / 750) AS ok FROM g)
  SELECT coalesce((SELECT param FROM o WHERE ok ORDER BY metric DESC, param LIMIT 1), 1)::DOUBLE AS selected,
  count(*) FILTER (ok) AS n_selectable, round(max(metric) FILTER (ok), 6) AS best_metric FROM o""")
def _(spark, sf):
    pts = selection.topk_grid(timed(spark, sf), ["t"], "score", "doc_id", "y", [1, 2, 3, 5])
    return selection.grid_select(pts, 1).select("selected", "n_selectable", r6("best_metric", "best_metric"))
