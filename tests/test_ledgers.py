"""Labels, splits, rounds, admission, coverage and comparisons."""

import random

import pytest
from pyspark.sql import functions as F

from pitpanel.operators import checks, coverage, ledgers, reports, risk
from pitpanel.params import DAY
from pitpanel.plans.intervals import concurrency, interval_join, overlap_pairs
from pitpanel.plans.ordered import time_bucket

EV = ("kind string, t bigint, pos_id bigint, symbol string, qty double, fee double, pnl double, paid double,"
      "reason string, decision_ts bigint")


def test_ledger_labels_every_class(spark):
    ev = [("fill_open", 10, 1, "A", 2.0, 0.1, None, None, None, 10),
          ("rate", 20, 1, "A", None, None, None, 0.5, None, None),
          ("fill_close", 30, 1, "A", 1.0, 0.1, 3.0, None, None, None),
          ("fill_close", 40, 1, "A", 1.0, 0.1, 5.0, None, None, None),
          ("fill_open", 10, 2, "B", 2.0, 0.1, None, None, None, 10),
          ("fill_close", 30, 2, "B", 1.0, 0.1, 3.0, None, None, None),
          ("rejection", 10, None, "C", None, None, None, None, "max_positions", 10),
          ("entry_cancelled", 10, None, "D", None, None, None, None, None, 10),
          ("rejection", 10, None, "E", None, None, None, None, "odd", 10),
          ("fill_open", 10, 3, "G", 2.0, 0.1, None, None, None, 10)]
    cands = spark.createDataFrame([(10, s, 1, 2.0, "reject" if s == "G" else "approve") for s in "ABCDEFG"],
                                  "t bigint, symbol string, side bigint, r_dist double, verdict string")
    out = {r["symbol"]: r for r in ledgers.ledger_labels(cands, spark.createDataFrame(ev, EV)).collect()}
    a = out["A"]
    assert a["executed"] and (a["entry_t"], a["exit_t"], a["lo"], a["hi"]) == (10, 40, 10, 40)
    assert abs(a["net_pnl"] - (8.0 - 0.3 - 0.5)) < 1e-12 and abs(a["net_r"] - 7.2 / 4.0) < 1e-12
    assert {s: out[s]["exclusion"] for s in "BCDEFG"} == {
        "B": "still_open", "C": "capacity_rejected", "D": "cancelled_missing_bar", "E": "odd", "F": "no_fill",
        "G": "governor_rejected"}


def test_purged_split_classes_and_guards(spark):
    v, h = 100, 200
    rows = [(0, 0, 50), (10, 10, 99), (90, 90, 100), (120, 120, 150), (190, 190, 200), (130, None, None)]
    df = spark.createDataFrame(rows, "t bigint, lo bigint, hi bigint")
    got = sorted(r["split"] for r in ledgers.purged_split(df, v, h, 1000).collect())
    assert got == ["purged_train", "purged_validation", "train", "train", "unlabeled", "validation"]
    with pytest.raises(ledgers.HorizonError):
        ledgers.purged_split(df, v, h, 5)
    with pytest.raises(ledgers.SealedRowError):
        ledgers.purged_split(spark.createDataFrame([(200, 200, 201)], df.schema), v, h, 1000)
    with pytest.raises(ValueError):
        ledgers.purged_split(df, 5, 5, 1)


def test_overlap_and_concurrency_match_brute_force(spark):
    rng = random.Random(2)
    iv = [(a := rng.randint(0, 300), a + rng.randint(0, 40)) for _ in range(250)]
    df = spark.createDataFrame(iv, "lo bigint, hi bigint")
    r = overlap_pairs(df, "lo", "hi", 13).first()
    want = sum(1 for i in range(len(iv)) for j in range(i) if iv[i][0] <= iv[j][1] and iv[j][0] <= iv[i][1])
    assert (r["n"], r["pairs"]) == (250, want)
    grid = spark.range(0, 350, 7).select(F.col("id").alias("t"))
    got = {r["t"]: r["open_n"] for r in concurrency(df, grid, "lo", "hi", "t", 13).collect()}
    assert got == {t: sum(lo <= t <= hi for lo, hi in iv) for t in range(0, 350, 7)}
    pts = spark.createDataFrame([(i,) for i in range(0, 340, 3)], "ts bigint")
    joined = interval_join(df.withColumn("k", F.lit(1)), pts.withColumn("k", F.lit(1)), ["k"], "lo", "hi", "ts", 11)
    assert joined.count() == sum(lo <= i <= hi for lo, hi in iv for i in range(0, 340, 3))


def test_uncovered_boundaries(spark):
    iv = spark.createDataFrame([("x", 10, 30), ("x", 50, 60), ("y", 0, 5)], "arm string, o bigint, c bigint")
    grid = spark.createDataFrame([(a, t) for a in "xy" for t in range(0, 70, 10)], "arm string, t bigint")
    dec = spark.createDataFrame([("x", 20)], "arm string, t bigint")
    out = ledgers.uncovered_boundaries(grid, iv, dec, "arm", "o", "c", "t", 15)
    assert sorted((r["arm"], r["t"]) for r in out.collect()) == [("x", 30), ("x", 60)]


def test_round_completeness(spark):
    members = list("ABCDEFG")
    rep = [(0, m, True) for m in members] + [(1, m, m != "B") for m in members] + \
        [(2, m, True) for m in members if m != "G"] + [(3, m, True) for m in members]
    df = spark.createDataFrame(rep, "t bigint, member string, ok boolean")
    out = {r["t"]: (r["valid"], r["failed"], r["missing"]) for r in ledgers.round_completeness(
        df.select("t").distinct(), df, members).collect()}
    assert out == {0: (True, "", ""), 1: (False, "B", ""), 2: (False, "G", "G"), 3: (True, "", "")}


def test_greedy_admit(spark):
    df = spark.createDataFrame([(0, 1, 7000.0), (0, 2, 7000.0), (0, 3, 2000.0), (0, 4, 900.0), (0, 5, 10.0)],
                               "g bigint, rk bigint, size double")
    out = risk.greedy_admit(df, ["g"], ["rk"], "size", F.lit(15000.0), 3, 50.0)
    assert {r["rk"]: r["outcome"] for r in out.collect()} == {
        1: "admitted", 2: "admitted", 3: "capacity", 4: "admitted", 5: "min_notional"}
    few = risk.greedy_admit(df, ["g"], ["rk"], "size", F.lit(15000.0), 1, 50.0)
    assert {r["rk"]: r["outcome"] for r in few.collect()}[2] == "max_positions"


def test_greedy_admit_with_repeated_keys_and_no_size(spark):
    rng = random.Random(8)
    rows = [(g, rng.randrange(40), rng.choice([None, *(float(v) for v in range(1, 100))])) for g in range(8) for _ in range(60)]
    df = spark.createDataFrame(rows, "g bigint, rk bigint, size double")
    want = []
    for g in range(8):
        used, n = 0.0, 0
        for _, rk, size in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2] is None, r[2] or 0)):
            fit = "min_notional" if size is None or size < 5 else "max_positions" if n >= 6 else "capacity" if used + size > 250 else "admitted"
            used, n = (used + size, n + 1) if fit == "admitted" else (used, n)
            want.append((g, rk, size, fit))
    got = risk.greedy_admit(df, ["g"], ["rk"], "size", F.lit(250.0), 6, 5.0).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_drawdown_quantile_of_a_path(spark):
    import numpy as np
    rng = random.Random(4)
    rows = [(k, i * 7, rng.choice([None, rng.gauss(0, 1)])) for k in "ab" for i in range(400)] + [("none", 0, None), ("one", 5, -2.0)]
    df = spark.createDataFrame(rows, "k string, t bigint, r double")
    got = {r["k"]: r["drawdown"] for r in reports.drawdown_quantile(df, ["k"], "t", "r", 0.95, bucket_ms=100).collect()}
    want = {}
    for k in ("a", "b", "one"):
        level = np.cumsum([v for x, _, v in rows if x == k and v is not None])
        want[k] = float(np.quantile(np.maximum(np.maximum.accumulate(level), 0) - level, 0.95))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_size_limits(spark):
    base = {"qty": 10.0, "price": 100.0, "stop_distance": 1.0, "side": 1, "data_complete": True, "has_stop": True,
            "paused": None, "equity": 10_000.0, "gross_exposure": 0.0, "long_exposure": 0.0, "short_exposure": 0.0,
            "n_positions": 0}
    cases = [({}, "approve", 10.0, "ok"), ({"data_complete": False}, "reject", 0.0, "missing_data_fail_safe"),
             ({"stop_distance": 0.0}, "reject", 0.0, "no_protective_stop"),
             ({"paused": "drawdown_limit"}, "reject", 0.0, "drawdown_limit"),
             ({"equity": 0.0}, "reject", 0.0, "non_positive_equity"),
             ({"n_positions": 10}, "reject", 0.0, "max_positions"),
             ({"stop_distance": 20.0}, "restrict", 5.0, "restricted_to_fit_limits"),
             ({"long_exposure": 11_800.0}, "restrict", 2.0, "restricted_to_fit_limits"),
             ({"gross_exposure": 14_980.0}, "reject", 0.0, "insufficient_capacity")]
    schema = ("id bigint, qty double, price double, stop_distance double, side bigint, data_complete boolean,"
              "has_stop boolean, paused string, equity double, gross_exposure double, long_exposure double,"
              "short_exposure double, n_positions bigint")
    rows = [(i, *{**base, **c[0]}.values()) for i, c in enumerate(cases)]
    out = {r["id"]: r for r in risk.size_limits(spark.createDataFrame(rows, schema)).collect()}
    for i, (_, d, q, why) in enumerate(cases):
        assert (out[i]["decision"], out[i]["reason"]) == (d, why) and abs(out[i]["allowed_qty"] - q) < 1e-9


def test_coverage_finds_an_internal_loss(spark):
    ms = {"2021-01": 1609459200000, "2021-02": 1612137600000, "2021-03": 1614556800000}
    ext = [("A", "2021-01", 31, ms["2021-01"], ms["2021-02"] - DAY), ("A", "2021-03", 31, ms["2021-03"],
                                                                     ms["2021-03"] + 30 * DAY)]
    df = spark.createDataFrame(ext, "entity string, month string, n_rows bigint, first_ts bigint, last_ts bigint")
    far = 1893456000000
    months = coverage.coverage_months(df, DAY, far, far, 2)
    got = {r["month"]: (r["status"], r["expected"], r["completeness"]) for r in months.collect()}
    assert got == {"2021-01": ("present", 31, 1.0), "2021-02": ("missing", 28, None), "2021-03": ("present", 31, 1.0)}
    arch = spark.createDataFrame([("A", "2021-02", "daily")], "entity string, month string, kind string")
    v = coverage.coverage_verdict(months, arch, far, far, 2, "2020-01").first()
    assert (v["verdict"], v["n_internal"], v["n_head_truncated"]) == ("FAIL", 1, 0)
    assert coverage.coverage_verdict(months, None, far, far, 2, "2020-01").first()["verdict"] == "UNVERIFIED"
    clean = arch.filter("month = ''")
    assert coverage.coverage_verdict(months, clean, far, far, 2, "2020-01").first()["verdict"] == "PASS"


def test_report_edge_cases(spark):
    trades = spark.createDataFrame([("a", 10.0), ("a", -5.0), ("a", 2.0), ("a", 1.0)], "arm string, net double")
    ends = spark.createDataFrame([("a", 100.0, 110.0), ("b", 1.0, 1.0)], "arm string, e0 double, e1 double")
    m = {r["arm"]: r for r in reports.trade_metrics(trades, ends, ["arm"], "net").collect()}
    assert abs(m["a"]["profit_factor"] - 2.6) < 1e-12 and m["a"]["average_trade"] == 2.0
    assert abs(m["a"]["net_return_ex_top"] + 0.03) < 1e-12 and m["b"]["profit_factor"] == 0.0
    curve = spark.createDataFrame([("a", i, 100.0, g) for i, g in enumerate((0.0, 50.0, 100.0))],
                                  "arm string, t bigint, equity double, gross_exposure double")
    e = reports.exposure_metrics(curve, ["arm"]).first()
    assert e["mean_exposure"] == 0.5 and abs(e["time_in_cash"] - 1 / 3) < 1e-12
    s = spark.createDataFrame([("up", 0.1), ("flat", 0.0), ("down", -0.1)], "arm string, r double")
    got = {r["arm"]: r["sortino"] for r in reports.sortino(s, ["arm"], "r").collect()}
    assert got == {"up": 1e6, "flat": 0.0, "down": -1.0}
    one = reports.max_drawdown(spark.createDataFrame([(i, v) for i, v in enumerate((10.0, 8.0, 12.0, 9.0))],
                                                     "t bigint, e double"), [], "t", "e", bucket_ms=2).first()
    assert one["max_drawdown"] == 0.25


def test_halves_of_a_curve_that_crosses_zero(spark):
    paths = {"cross": (10.0, -5.0, -8.0, 4.0, 6.0, 3.0, -1.0), "up": (1.0, 2.0, 3.0), "two": (4.0, 5.0), "zero": (2.0, 4.0, 6.0, 0.0)}
    curve = spark.createDataFrame([(k, i, v) for k, path in paths.items() for i, v in enumerate(path)],
                                  "arm string, t bigint, equity double")
    m = {r["arm"]: r for r in reports.return_metrics(curve, ["arm"], "t", "equity", bucket_ms=2).collect()}
    for k, path in paths.items():
        half = (len(path) - 1) // 2
        assert abs(m[k]["first_half"] - (path[half] / path[0] - 1)) < 1e-12
        assert abs(m[k]["second_half"] - (path[-1] / path[half] - 1)) < 1e-12


def test_divergence_and_guards(spark):
    rows = [(i, "x", 1.0 * i) for i in range(50)]
    a = spark.createDataFrame(rows, "t bigint, kind string, v double")
    assert checks.ledger_first_divergence(a, a, ["t"], time_bucket("t", 7), ["kind"], ["v"]).count() == 0
    b = a.withColumn("v", F.when(F.col("t") == 30, F.col("v") + 1e-12).otherwise(F.col("v")))
    r = checks.ledger_first_divergence(a, b, ["t"], time_bucket("t", 7), ["kind"], ["v"]).first()
    assert (r["seq"], r["field"], r["within"]) == (30, "v", True)
    r = checks.ledger_first_divergence(a, a.filter("t < 40"), ["t"], time_bucket("t", 7), ["kind"], ["v"]).first()
    assert (r["seq"], r["field"]) == (40, "length")
    with pytest.raises(checks.LeakError):
        checks.column_guard(["F01_side", "F02_net_r"])
    with pytest.raises(checks.LeakError):
        checks.column_guard(["F29_new"])
    with pytest.raises(checks.LeakError):
        checks.purge_guard(a, "t", 49)
    with pytest.raises(checks.LeakError):
        checks.sealed_leak_check(a, "kind", "t", 10)
    with pytest.raises(ValueError):
        checks.join_1to1(a, a.union(a), ["t"])
    with pytest.raises(ValueError):
        checks.overlay_union(a.withColumnRenamed("kind", "entity"), a.withColumnRenamed("kind", "entity"), "t", 1, 10,
                             ["entity", "t"])


def test_registry_order(spark):
    reg = {"a": {"bases": ["X"]}, "b": {"bases": ["Y"], "pattern": "^X"}, "c": {"pattern": "Z$"}}
    df = spark.createDataFrame([("XQQQQ",), ("XYQQQQ",), ("YQQQQ",), ("QZQQQQ",), ("QQQQQ",), ("QQQQ",)], "s string")
    out = {r["s"]: (r["category"], r["rule"], r["included"]) for r in
           checks.registry_classify(df, "s", reg, "QQQQ").collect()}
    assert out["XQQQQ"] == ("a", "base-list", False) and out["XYQQQQ"] == ("b", "pattern:^X", False)
    assert out["YQQQQ"] == ("b", "base-list", False) and out["QZQQQQ"][0] == "c" and out["QQQQQ"][2]
