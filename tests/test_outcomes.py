"""First-touch outcomes against a row-by-row walk, accrual, features, episodes."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pitpanel.operators import candidates, features, outcomes
from pitpanel.params import DEFAULTS
from pitpanel.plans.asof import asof_join
from pitpanel.plans.extrema import climb, first_crossing, pyramid
from tests.util import H4, M15, bars_df, fine_df

P = replace(DEFAULTS, max_hold=4, half_spread=(0.0, 0.0), slippage=(0.0, 0.0), fee=0.0)
SIG = "entity string, boundary bigint, close double, ll_exit double, hh_exit double"


def _run(spark, bars, cands, sig=(), valid=None, p=P):
    b = fine_df(spark, bars)
    c = spark.createDataFrame(cands, "entity string, t bigint, side bigint, rank bigint, r_dist double")
    s = spark.createDataFrame(list(sig), SIG)
    top = max(r[0] for r in bars) + 10 * H4
    v = spark.createDataFrame([(t, valid is None or t in valid) for t in range(0, top, H4)],
                              "boundary bigint, valid boolean")
    return {r["t"]: r for r in outcomes.first_touch(c, b, s, v, p).collect()}


def flat(n, price=100.0, spread=0.5):
    return [(i * M15, price, price + spread, price - spread, price) for i in range(n)]


def test_stop_before_target_in_one_bar(spark):
    bars = flat(40)
    bars[5] = (5 * M15, 100, 140, 60, 100)
    r = _run(spark, bars, [("A", 0, 1, 1, 10.0)])[0]
    assert (r["reason"], r["exit_t"], r["exit_fill"], r["ambiguous"]) == ("stop", 5 * M15, 90.0, True)
    assert r["net_r"] == -1.0


def test_target_fills_exactly_and_on_the_entry_bar(spark):
    bars = flat(40)
    bars[0] = (0, 100, 131, 99, 100)
    r = _run(spark, bars, [("A", 0, 1, 1, 10.0)])[0]
    assert (r["reason"], r["exit_t"], r["exit_fill"], r["net_r"]) == ("target", 0, 130.0, 3.0)


def test_gap_through_fills_at_the_open(spark):
    bars = flat(40)
    bars[7] = (7 * M15, 80, 82, 79, 81)
    r = _run(spark, bars, [("A", 0, 1, 1, 10.0)])[0]
    assert (r["reason"], r["exit_fill"]) == ("stop", 80.0)
    short = _run(spark, [(t, 200 - o, 200 - low, 200 - h, 200 - c) for t, o, h, low, c in bars],
                 [("A", 0, -1, 1, 10.0)])[0]
    assert (short["reason"], short["exit_fill"]) == ("stop", 120.0)


def test_missing_entry_bar_cancels(spark):
    assert _run(spark, flat(40)[1:], [("A", 0, 1, 1, 10.0)])[0]["reason"] == "cancelled"


def test_time_exit_waits_for_a_valid_round_and_an_existing_bar(spark):
    due = 4 * H4
    bars = [b for b in flat(200) if not due + H4 <= b[0] < due + H4 + 3 * M15]
    valid = {0, due + H4, due + 2 * H4}
    r = _run(spark, bars, [("A", 0, 1, 1, 10.0)], valid=valid)[0]
    assert (r["reason"], r["exit_t"]) == ("time_exit", due + H4 + 3 * M15)


def test_trailing_exit_and_gap_priority(spark):
    sig = [("A", i * H4, 100.0 if i < 2 else 97.0, 98.0, 103.0) for i in range(8)]
    bars = flat(100)
    r = _run(spark, bars, [("A", 0, 1, 1, 10.0)], sig)[0]
    assert (r["reason"], r["exit_t"], r["exit_fill"]) == ("trailing_exit", 2 * H4, 100.0)
    i = 2 * H4 // M15
    bars[i] = (2 * H4, 85, 86, 84, 85)
    r = _run(spark, bars, [("A", 0, 1, 1, 10.0)], sig)[0]
    assert (r["reason"], r["exit_t"], r["exit_fill"]) == ("stop", 2 * H4, 85.0)


def test_still_open_at_the_end_of_data(spark):
    assert _run(spark, flat(10), [("A", 0, 1, 1, 10.0)], valid={0})[0]["reason"] == "still_open"


def _walk(bars, t, side, r, due, valid):
    """Row-by-row walk of one candidate in time order."""
    by, times = {b[0]: b for b in bars}, sorted(b[0] for b in bars)
    if t not in by:
        return "cancelled", None
    fill = by[t][1]
    stop, target = fill - side * r, fill + side * 3 * r
    queue = min((v for v in valid if v >= due), default=None)
    for x in [x for x in times if x >= t]:
        _, o, h, low, _ = by[x]
        if queue is not None and x >= queue:
            return ("stop" if side * (o - stop) <= 0 else "time_exit"), x
        if (low <= stop) if side > 0 else (h >= stop):
            return "stop", x
        if (h >= target) if side > 0 else (low <= target):
            return "target", x
    return "still_open", None


def test_first_crossing_reads_one_node_per_level(spark):
    rng = random.Random(3)
    rows = [(e, i * 10 + 5, rng.choice([None, 50 + rng.random()]), 50 + rng.random()) for e in "AB" for i in range(3000) if rng.random() < 0.9]
    bars = spark.createDataFrame(rows, "entity string, ts bigint, low double, high double")
    tower = pyramid(bars, ["entity"], "ts", "low", "high", [], 10, fan=4)
    assert tower.levels == 6
    asked = [(e, k, rng.randrange(-50, 31_000), rng.choice([None, 0.0, 50.001, 50.05]), rng.choice([None, 99.0, 50.999, 50.9]))
             for k in range(150) for e in "ABC"]
    s = spark.createDataFrame(asked, "entity string, k int, lo bigint, f double, c double")
    got = {(r["entity"], r["k"]): r["hit"]["id"] for r in first_crossing(s, tower, ["entity", "k"], "lo", "f", "c").collect()}
    want = {}
    for e, k, lo, f, c in asked:
        hits = [t for x, t, low, high in rows if x == e and t >= lo and
                ((f is not None and low is not None and low <= f) or (c is not None and high >= c))]
        if hits:
            want[e, k] = min(hits)
    assert got == want and len(want) > 100
    # logarithmic: a node of at most fan children per level on the way up, and as many down
    up = climb(s.selectExpr("entity", "k", "lo", "f AS floor", "c AS ceil"), tower, ["entity", "k"], "lo").groupBy("entity", "k").count()
    assert up.agg(F.max("count")).first()[0] <= tower.levels
    assert tower.nodes.agg(F.max(F.size("children"))).first()[0] <= 4
    none = pyramid(bars.limit(0), ["entity"], "ts", "low", "high", [], 10)
    assert first_crossing(s, none, ["entity", "k"], "lo", "f", "c").collect() == []


def test_random_walks_match(spark):
    rng = random.Random(11)
    price, bars = 100.0, []
    for i in range(900):
        o = price
        price *= math.exp(rng.gauss(0, 0.004))
        if rng.random() > 0.08:
            bars.append((i * M15, o, max(o, price) * 1.001, min(o, price) * 0.999, price))
    valid = {k * H4 for k in range(60) if rng.random() > 0.3}
    cands = [("A", k * H4, rng.choice([1, -1]), 1, rng.choice([0.5, 1.0, 2.0, 5.0])) for k in range(50)]
    got = _run(spark, bars, cands, valid=valid)
    assert len(got) == 50
    for _, t, side, _, r in cands:
        want = _walk(bars, t, side, r, t + 4 * H4, valid)
        assert (got[t]["reason"], got[t]["exit_t"]) == want, t
    assert {g["reason"] for g in got.values()} >= {"stop", "target", "time_exit"}


def test_rate_accrual_window_and_mark(spark):
    h8 = 2 * H4
    bars = fine_df(spark, [(i * M15, 100 + i, 101 + i, 99 + i, 100.5 + i) for i in range(100)])
    pos = spark.createDataFrame([("A", 0, 0, h8, 2.0, -1)],
                                "entity string, t bigint, entry_t bigint, exit_t bigint, qty double, side bigint")
    rates = spark.createDataFrame([("A", 0, 0.5), ("A", h8, 0.01)], "entity string, ts bigint, rate double")
    r = outcomes.rate_accrual(pos, rates, bars).first()
    # entered at 0 after that bar's rate phase, still held in the phase at 8 h
    mark = 100.5 + (h8 // M15 - 1)
    assert (r["applied"], r["missing"]) == (1, 0)
    assert abs(r["paid"] + 0.01 * 2.0 * mark) < 1e-12
    none = outcomes.rate_accrual(pos, rates.filter("ts < 0"), bars).first()
    assert (none["applied"], none["missing"], none["paid"]) == (0, 1, 0.0)


def test_breakouts_and_open_positions(spark):
    uni = spark.createDataFrame([(H4, e, 1.0, i + 1, 3) for i, e in enumerate("ABC")],
                                "boundary bigint, entity string, liq_median double, rank bigint, n_eligible bigint")
    sig = spark.createDataFrame(
        [("A", H4, 11.0, 10.0, 5.0, 10.0, 5.0, 1.0), ("B", H4, 4.0, 10.0, 5.0, 10.0, 5.0, 1.0),
         ("C", H4, 12.0, 10.0, 5.0, 10.0, 5.0, None)],
        "entity string, boundary bigint, close double, hh_entry double, ll_entry double, hh_exit double,"
        "ll_exit double, atr double")
    out = {r["entity"]: r for r in candidates.breakout_candidates(uni, sig).collect()}
    assert {e: (r["side"], r["r_dist"]) for e, r in out.items()} == {"A": (1, 2.0), "B": (-1, 2.0)}
    held = spark.createDataFrame([("A", H4)], "entity string, boundary bigint")
    assert [r["entity"] for r in candidates.breakout_candidates(uni, sig, open_intervals=held).collect()] == ["B"]
    assert candidates.skip_count(uni, sig).first()["skipped"] == 1


def test_features_of_one_breakout(spark):
    from pitpanel.operators import windows
    rows = [(100.25, 99.75, 100.0)] * 95 + [(105.25, 104.75, 105.0)]
    sig = windows.signals(bars_df(spark, rows))
    ser = windows.feature_series(sig)
    t = 96 * H4
    uni = spark.createDataFrame([(t, "A", 1e8, 1, 1)],
                                "boundary bigint, entity string, liq_median double, rank bigint, n_eligible bigint")
    cands = candidates.breakout_candidates(uni, sig).withColumn("atr", F.lit(0.375))
    rates = spark.createDataFrame([("A", t - 1, 0.01), ("A", t, 9.0), ("A", t - 2, 0.03)],
                                  "entity string, ts bigint, rate double")
    f = features.features_28(cands, ser, ser, windows.regime(bars_df(spark, rows)),
                             candidates.breadth(uni, ser), rates).first()
    assert abs(f["F07_ret_1"] - math.log(1.05)) < 1e-12
    assert abs(f["F13_trend_sma20"] - (105 - 100.25) / 0.375) < 1e-9
    assert f["F16_breakout_run"] == 1 and f["F21_breadth_sma20"] == 1.0 and f["F24_log_liq"] == 8.0
    # rates strictly before the decision only
    assert f["F25_rate_last"] == 0.01 and abs(f["F26_rate_mean_3d"] - 0.02) < 1e-12
    assert f["F27_hour_slot"] == 0 and f["F28_dow"] == (16 + 4) % 7


def test_context_join_raises_without_a_bar(spark):
    df = spark.createDataFrame([("A", 1)], "entity string, t bigint")
    ctx = spark.createDataFrame([(2, 0.5)], "boundary bigint, x double")
    with pytest.raises(Exception, match="no context bar"):
        candidates.context_join(df, ctx, "t", {"c": "x"}).collect()


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_matches_brute_force_with_a_hot_key(spark, inclusive, direction):
    rng = random.Random(4)
    left = [(i, "hot" if rng.random() < 0.8 else rng.choice("ab"), rng.randint(0, 400)) for i in range(400)]
    left += [(1000 + i, "hot", None) for i in range(5)] + [(2000, None, 5)]
    right = {}
    for _ in range(150):
        right[("hot" if rng.random() < 0.8 else rng.choice("ab"), rng.randint(0, 400))] = rng.random()
    lf = spark.createDataFrame(left, "id bigint, k string, t bigint")
    rf = spark.createDataFrame([(k, t, v) for (k, t), v in right.items()], "k string, rt bigint, v double")
    got = {r["id"]: r["v"] for r in asof_join(lf, rf, ["k"], "t", "rt", ["v"], inclusive, direction, bucket_ms=17).collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        if t is None or k is None:
            assert got[i] is None
            continue
        ok = [(x, v) for (kk, x), v in right.items() if kk == k and (
            (x < t or (inclusive and x == t)) if direction == "backward" else (x > t or (inclusive and x == t)))]
        want = (max(ok) if direction == "backward" else min(ok))[1] if ok else None
        assert got[i] == want


def test_trailing_rates_across_blocks(spark):
    rows = [("a", i, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, ts bigint, v double")
    got = {r["ts"]: r["m"] for r in features.trailing_rates(df, "k", "ts", "v", 9, "m").collect()}
    for i in range(200):
        win = list(range(max(0, i - 8), i + 1))
        assert abs(got[i] - sum(win) / len(win)) < 1e-12
