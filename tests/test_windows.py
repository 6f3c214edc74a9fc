"""Hand-computed cases, slow/fast pairs and look-ahead invariance of windows."""

import math
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pitpanel.operators import bars, checks, risk, universe, windows
from pitpanel.params import DAY, DEFAULTS
from tests.util import H4, M15, bars_df, column, fine_df


def test_complete_bars_needs_every_fine_bar(spark):
    rows = [(i * M15, 100 + i, 101 + i, 99 + i, 100.5 + i) for i in range(33)]
    full = fine_df(spark, rows).withColumns({"volume": F.lit(1), "quote_volume": F.lit(1.0)})
    out = bars.complete_bars(full).orderBy("open_ts").collect()
    assert [r["open_ts"] for r in out] == [0, H4]
    assert (out[0]["open"], out[0]["high"], out[0]["low"], out[0]["close"]) == (100, 116, 99, 115.5)
    assert [r["open_ts"] for r in bars.complete_bars(full.filter(F.col("ts") != 3 * M15)).collect()] == [H4]


def test_channel_prior(spark):
    df = bars_df(spark, list(zip((1, 5, 2, 9, 3), (0, 4, 1, 8, 2), (1, 1, 1, 1, 1))))
    out = windows.channel_prior(df, 2, "hh", "ll")
    assert column(out, "hh") == [None, None, 5, 5, 9]
    assert column(out, "ll") == [None, None, 0, 1, 1]


def test_wilder_atr_constant_range(spark):
    n = 28
    out = column(windows.wilder_atr(bars_df(spark, [(101, 99, 100)] * (3 * n + 10)), n), "atr")
    assert out[:3 * n - 1] == [None] * (3 * n - 1)
    assert all(abs(v - 2.0) < 1e-12 for v in out[3 * n - 1:])


@pytest.mark.parametrize("chunk", [None, 16, 7])
def test_wilder_atr_equals_recursion(spark, chunk):
    rng, n = random.Random(5), 7
    rows = [(100 + rng.random() * 5, 95 + rng.random() * 5, 97 + rng.random() * 5) for _ in range(150)]
    tr = [rows[0][0] - rows[0][1]] + [max(h - lo, abs(h - rows[i][2]), abs(lo - rows[i][2]))
                                      for i, (h, lo, _) in enumerate(rows[1:])]
    val, want = sum(tr[:n]) / n, {}
    for i in range(n, len(rows)):
        val = (val * (n - 1) + tr[i]) / n
        want[i] = val
    got = column(windows.wilder_atr(bars_df(spark, rows), n, chunk=chunk), "atr")
    for i in range(len(rows)):
        assert got[i] is None if i < 3 * n - 1 else abs(got[i] - want[i]) < 1e-9


def test_signed_run_clips_and_breaks(spark):
    closes = [10, 10] + [20] * 13 + [15, 1, 1]
    df = bars_df(spark, [(20, 10, c) for c in closes]).withColumns({"hh_entry": F.lit(20.0), "ll_entry": F.lit(10.0)})
    out = column(windows.signed_run(df), "run")
    assert out == [-1, -2, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 10, 10, 10, 0, -1, -2]


def _regime(spark, closes):
    out = windows.regime(bars_df(spark, [(c, c, c) for c in closes]))
    return out.orderBy(F.desc("boundary")).first()


def test_regimes(spark):
    assert _regime(spark, [100 + i for i in range(300)])["regime"] == "uptrend"
    assert _regime(spark, [1000 * 0.999 ** i for i in range(300)])["regime"] == "downtrend"
    assert _regime(spark, [100 + (i % 2) for i in range(301)])["regime"] == "sideways"
    calm = [100 + 0.01 * (i % 2) for i in range(300)]
    wild = [100 * (1.2 if i % 2 else 0.8) for i in range(30)]
    assert _regime(spark, calm + wild)["regime"] == "stress"
    short = _regime(spark, [100.0] * 50)
    assert short["regime"] == "stress" and short["insufficient_history"]


def test_trailing_daily_matches_slow_definition(spark):
    rng, p = random.Random(3), replace(DEFAULTS, bars_per_day=96)
    rows = []
    for e in range(6):
        for d in range(100):
            n = rng.choice([96, 92, 80, 0])
            if n:
                rows.append((f"e{e}", d, n, float(rng.randint(1, 10**6)) if n >= 90 else None))
    cal = spark.createDataFrame(rows, "entity string, day bigint, bars_present bigint, qvol double")
    got = {(r["entity"], r["day"]): r for r in universe.trailing_daily(cal, p).collect()}
    by = {}
    for e, d, n, q in rows:
        by.setdefault(e, {})[d] = (n, q)
    for e, days in by.items():
        for day in range(min(days), max(days) + 2):
            win = [days[d] for d in range(day - 30, day) if d in days]
            defined = sorted(q for _, q in win if q is not None)
            r = got[(e, day)]
            if len(defined) < 20:
                assert r["liq_median"] is None
            else:
                m = len(defined) // 2
                want = defined[m] if len(defined) % 2 else (defined[m - 1] + defined[m]) / 2
                assert abs(r["liq_median"] - want) < 1e-6
            if win:
                assert abs(r["completeness"] - sum(n for n, _ in win) / 2880) < 1e-12


def test_eligibility_keeps_only_the_good_one(spark):
    day_rows = []
    spec = {"good": (0, 200, 50e6, 96), "young": (150, 200, 50e6, 96), "illiquid": (0, 200, 1e6, 96),
            "gappy": (0, 200, 50e6, 92), "delisted": (0, 150, 50e6, 96)}
    ext = []
    for name, (a, b, q, n) in spec.items():
        day_rows += [(name, d, n, q) for d in range(a, b)]
        ext.append((name, a * DAY, b * DAY - M15))
    cal = spark.createDataFrame(day_rows, "entity string, day bigint, bars_present bigint, qvol double")
    extent = spark.createDataFrame(ext, "entity string, first_ts bigint, last_ts bigint")
    m = universe.trailing_daily(cal)
    t = 180 * DAY
    out = universe.eligibility(m, extent, t, t)
    assert [r["entity"] for r in out.collect()] == ["good"]
    pit = universe.eligibility(m, extent, 100 * DAY, 200 * DAY, point_in_time=True, bars_by_day=cal)
    seen = pit.filter("entity = 'delisted'").agg(F.max("boundary")).first()[0]
    assert 149 * DAY <= seen <= 152 * DAY


def test_universe_ranks_and_ties(spark):
    rows = [(0, f"s{i:02d}", 100.0 + i) for i in range(80)] + [(0, "tie_b", 500.0), (0, "tie_a", 500.0)]
    out = universe.universe_top_n(spark.createDataFrame(rows, "boundary bigint, entity string, liq_median double"), 75)
    got = [r["entity"] for r in out.orderBy("rank").collect()]
    assert len(got) == 75 and got[:3] == ["tie_a", "tie_b", "s79"]
    assert out.first()["n_eligible"] == 75


@pytest.mark.parametrize("n,edges", [(1000, (600, 800)), (7, (4, 5))])
def test_chrono_partition(spark, n, edges):
    grid = universe.boundary_grid(spark, 0, (n - 1) * H4, H4)
    parts = {r["part"]: r for r in universe.partition_edges(universe.chrono_partition(grid, H4)).collect()}
    assert parts["train"]["n"] == edges[0]
    assert parts["validation"]["n"] == edges[1] - edges[0]
    assert parts["holdout"]["n"] == n - edges[1]


def test_grid_ends_must_align(spark):
    with pytest.raises(ValueError):
        universe.boundary_grid(spark, 1, H4, H4)


def test_valid_span(spark):
    flags = [(i * H4, i >= 30) for i in range(800)]
    df = spark.createDataFrame(flags, "boundary bigint, valid boolean")
    start, end = universe.require_span(universe.valid_span(df, 800 * H4))
    assert start == 30 * H4 and end == 800 * H4 - 12 * H4
    with pytest.raises(RuntimeError):
        universe.require_span(universe.valid_span(df.withColumn("valid", F.lit(False)), 800 * H4))


def test_pause_flags(spark):
    rows = [("a", 0, 100.0), ("a", H4, 98.0), ("a", 2 * H4, 96.9), ("a", DAY, 96.9), ("a", 40 * DAY, 74.0),
            ("a", 91 * DAY, 74.0), ("a", 95 * DAY, 74.0)]
    df = spark.createDataFrame(rows, "arm string, t bigint, equity double")
    out = {r["t"]: r["paused"] for r in risk.pause_flags(df, ["arm"], "t", "equity").collect()}
    # the last snapshot sees no peak older than 90 days
    assert out == {0: None, H4: None, 2 * H4: "daily_loss_limit", DAY: None, 40 * DAY: "drawdown_limit",
                   91 * DAY: None, 95 * DAY: None}


def test_no_lookahead_in_series(spark):
    rng = random.Random(9)
    price, rows = 100.0, []
    for _ in range(320):
        price *= math.exp(rng.gauss(0, 0.02))
        rows.append((price * 1.01, price * 0.99, price))
    df = bars_df(spark, rows).withColumn("volume", F.lit(1))
    t = 250 * H4
    cols = ["open", "high", "low", "close"]

    def ops(d):
        return windows.feature_series(windows.signals(d))
    assert checks.lookahead_check(ops, df, "boundary", t, cols, "boundary").count() == 0
    assert checks.lookahead_check(lambda d: windows.regime(d), df, "boundary", t, cols, "boundary").count() == 0
    # the check itself finds a leak
    leak = checks.lookahead_check(lambda d: d.withColumn("x", F.lead("close").over(
        windows._w("entity", "boundary"))).select("boundary", "x"), df, "boundary", t, cols, "boundary")
    assert leak.count() > 0


def test_trailing_quantile_equals_percentile_over_the_frame(spark):
    from pyspark.sql import Window as W

    from pitpanel.plans.sliding import trailing_quantile
    rng, rows = random.Random(9), []
    for e, size in (("a", 211), ("b", 1), ("c", 40), ("d", 7)):
        rows += [(e, i * 3, None if e == "d" or rng.random() < 0.2 else rng.choice([rng.random(), 1.5, -2.0])) for i in range(size)]
    df = spark.createDataFrame(rows, "entity string, boundary bigint, x double")
    for n, q, least in ((40, 0.9, 5), (7, 0.5, 1), (1, 0.9, 1), (300, 0.33, 0), (40, 1.0, 3)):
        w = W.partitionBy("entity").orderBy("boundary").rowsBetween(-(n - 1), 0)
        want = df.withColumn("y", F.when(F.count("x").over(w) >= least, F.percentile("x", F.lit(q)).over(w)))
        got = trailing_quantile(df, "x", n, q, least, "y", "entity", "boundary")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), n
    assert trailing_quantile(df.limit(0), "x", 5, 0.5, 1, "y", "entity", "boundary").count() == 0


def test_regime_at_a_boundary_without_a_bar(spark):
    states = windows.regime(bars_df(spark, [(100 + i,) * 3 for i in range(300)]))
    last = states.agg(F.max("boundary")).first()[0]
    got = windows.regime_at(spark.createDataFrame([(last,), (last + 1,)], "boundary bigint"), states).orderBy("boundary").collect()
    assert [(r["regime"], r["insufficient_history"]) for r in got] == [("uptrend", False), ("stress", True)]


def test_partition_recomputed_from_raw_records_agrees_and_finds_changes(spark):
    from pitpanel.operators import bars, recompute
    rng, day = random.Random(4), 86_400_000
    p = replace(DEFAULTS, coarse_ms=day, fine_ms=day // 4, bars_per_coarse=4, bars_per_day=4, trailing_days=5, min_defined_days=3,
                daily_min_bars=3, min_liquidity=200.0, min_completeness=0.6, min_history_ms=4 * day, tradable_ms=2 * day,
                min_eligible=2, span_window_ms=6 * day, span_fraction=0.7, span_buffer_ms=0)
    rows = [(e, d * day + s * day // 4, float(rng.randint(40, 120))) for e, a, b in (("x", 0, 80), ("y", 3, 60), ("z", 9, 80), ("w", 30, 50))
            for d in range(a, b) for s in range(4) if rng.random() < 0.97]
    raw = spark.createDataFrame(rows, "entity string, ts bigint, quote_volume double")

    def recorded(df):
        cal = bars.daily_calendar(df, p=p)
        elig = universe.eligibility(universe.trailing_daily(cal, p), bars.extent(df), 0, 85 * day, p)
        slots = bars.slot_counts(df.filter("entity = 'x'"), p=p)
        rounds = universe.round_validity(universe.boundary_grid(spark, 0, 85 * day, day), elig, slots, p)
        return recompute.partition_record(rounds, 85 * day, 90 * day, day, p)

    def differing(a, b):
        anew = recompute.partition_recompute(b, "x", 0, 85 * day, day, p)
        return {(r["key"], r["field"]) for r in checks.partition_verify(recorded(a), anew, "key").collect()}

    record = {(r["key"], r["field"]): r["value"] for r in recorded(raw).collect()}
    assert len(record) == 86 + 4 and 0 < sum(v for (_, f), v in record.items() if f == "valid") < 80
    start, n = record[0, "start_ts"], record[0, "n_boundaries"]
    assert n == (85 * day - start) // day + 1
    assert record[0, "validation_start"] == start + int(p.train_fraction * n) * day
    assert record[0, "holdout_start"] == start + int(p.validation_fraction * n) * day
    assert differing(raw, raw) == set()
    victim = max(k for (k, f), v in record.items() if f == "valid" and v)
    # a valid round had every bar of the context's window, one of them goes
    assert differing(raw, raw.filter(f"NOT (entity = 'x' AND ts = {victim - day // 2})")) >= {(victim, "valid")}
