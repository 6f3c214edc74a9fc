"""Ranks, quantiles, rotations, bootstraps and decisions against direct computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitpanel.functions.columns import clip_finite, draw, erf, normalize_epoch
from pitpanel.operators import reports
from pitpanel.operators import resampling as rs
from pitpanel.operators import selection
from pitpanel.params import DAY
from pitpanel.plans.ordered import exact_quantiles, running, time_bucket, with_position


def _mid(xs):
    s = sorted(xs)
    return [s.index(x) + (s.count(x) + 1) / 2 for x in xs]


def test_running_with_a_hot_group_equals_a_plain_scan(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.9 else "cold", i, rng.choice([None, rng.randint(-9, 9)])) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint")
    specs = {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "hi": ("max", F.col("v")),
             "lo": ("min", F.col("v")), "z": ("last", F.col("v")), "a": ("first", F.col("v"))}
    for exclusive in (False, True):
        got = {r["t"]: r for r in running(df, ["k"], ["t"], time_bucket("t", 23), specs, exclusive).collect()}
        seen = {}
        for k, t, v in rows:
            past = seen.setdefault(k, [])
            if not exclusive and v is not None:
                past.append(v)
            want = (sum(past) if past else None, len(past), max(past, default=None), min(past, default=None),
                    past[-1] if past else None, past[0] if past else None)
            r = got[t]
            assert (r["s"], r["n"], r["hi"], r["lo"], r["z"], r["a"]) == want
            if exclusive and v is not None:
                past.append(v)
    pos = with_position(df, ["k"], ["t"], time_bucket("t", 23)).orderBy("t").collect()
    count = {}
    for r in pos:
        assert r["seq"] == count.get(r["k"], 0)
        count[r["k"]] = r["seq"] + 1


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0, 2.0, 2.0, 2.0], "random"])
def test_exact_quantiles(spark, values):
    import numpy as np
    rng = random.Random(6)
    xs = [rng.choice([7.0, rng.random() * 10]) for _ in range(301)] if values == "random" else values
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["prob"]: r["quantile"] for r in exact_quantiles(df, "x", probs).collect()}
    for p in probs:
        assert abs(got[p] - float(np.quantile(xs, p))) < 1e-9


def test_auc_and_ic_with_ties(spark):
    rng = random.Random(12)
    rows = [(rng.randint(0, 1), float(rng.randint(0, 5)), rng.random()) for _ in range(200)]
    df = spark.createDataFrame(rows, "y int, s double, z double")
    auc = rs.rank_auc(df, "y", "s").first()["auc"]
    pos, neg = [s for y, s, _ in rows if y], [s for y, s, _ in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(auc - want) < 1e-12
    ic = rs.rank_ic(df, "s", "z").first()["ic"]
    ra, rb = _mid([r[1] for r in rows]), _mid([r[2] for r in rows])
    ma, mb = sum(ra) / 200, sum(rb) / 200
    cov = sum((a - ma) * (b - mb) for a, b in zip(ra, rb))
    want = cov / math.sqrt(sum((a - ma) ** 2 for a in ra) * sum((b - mb) ** 2 for b in rb))
    assert abs(ic - want) < 1e-12
    assert rs.rank_auc(df.withColumn("y", F.lit(1)), "y", "s").first()["auc"] is None
    assert rs.rank_ic(df.withColumn("s", F.lit(1.0)), "s", "z").first()["ic"] == 0.0


def _labels(spark):
    rng = random.Random(7)
    rows, k = [], 0
    for d in range(120):
        for _ in range(rng.randint(1, 5)):
            rows.append((d * DAY, k, float(k)))
            k += 1
    return spark.createDataFrame(rows, "t bigint, key bigint, y double"), rows


def test_rotation_is_an_exact_circular_shift(spark):
    df, rows = _labels(spark)
    offs = rs.rotation_offsets(df, "t", 12, 5)
    picks = {r["rep"]: r for r in offs.collect()}
    assert len(picks) == 12
    for r in picks.values():
        assert 28 <= r["j"] <= 119 - 28
        assert r["shift"] == sum(t < r["j"] * DAY for t, _, _ in rows)
    out = rs.rotate_labels(df, ["t", "key"], "t", "y", offs, time_bucket("t", 9 * DAY), ["key"])
    got = {}
    for r in out.collect():
        got.setdefault(r["rep"], {})[r["key"]] = r["y"]
    n = len(rows)
    for rep, vec in got.items():
        assert [vec[i] for i in range(n)] == [float((i + picks[rep]["shift"]) % n) for i in range(n)]
    again = rs.rotation_offsets(df, "t", 12, 5)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, offs.collect()))


def test_no_offsets_for_a_short_span(spark):
    df = spark.createDataFrame([(d * DAY, d, 1.0) for d in range(20)], "t bigint, key bigint, y double")
    assert rs.rotation_offsets(df, "t", 5, 1).count() == 0


def test_permutations_keep_structure(spark):
    df, rows = _labels(spark)
    perm = rs.shuffle_permute(df, ["t", "key"], "y", 3, 4, time_bucket("t", 9 * DAY), ["key"])
    by = {}
    for r in perm.collect():
        by.setdefault(r["rep"], {})[r["key"]] = r["y"]
    assert all(sorted(v.values()) == [float(i) for i in range(len(rows))] for v in by.values())
    assert by[0] != by[1]
    block = rs.block_permute(df, ["key"], "t", "y", 2, 4, ["key"])
    assert block.count() == 2 * len(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 64, 97, 1000, 4099])
def test_permutation_is_a_bijection(spark, n):
    reps = 200 if n <= 97 else 5
    x = spark.range(n).crossJoin(spark.range(reps).withColumnRenamed("id", "rep"))
    out = x.select("rep", "id", rs.permuted(F.col("id"), F.lit(n), F.col("rep"), 9).alias("to")).collect()
    by = {}
    for r in out:
        by.setdefault(r["rep"], {})[r["id"]] = r["to"]
    assert len(by) == (reps if n else 0) and all(sorted(m.values()) == list(range(n)) for m in by.values())
    if n >= 64:
        assert len({tuple(sorted(m.items())) for m in by.values()}) == reps
        fixed = sum(k == v for m in by.values() for k, v in m.items())
        assert fixed < 4 * reps  # one is expected in each
    if n == 10:
        # every place goes everywhere about equally often
        hits = [sum(m[k] == v for m in by.values()) for k in range(n) for v in range(n)]
        assert min(hits) >= 5 and max(hits) <= 45


@pytest.mark.parametrize("length", [1, 7, 50, 1024])
def test_rotation_by_chunks_of_any_length(spark, length):
    df, rows = _labels(spark)
    df = df.withColumn("s", F.pmod(F.col("key") * 7, F.lit(5)).cast("double")).withColumn("y", F.pmod(F.col("key") * 11, F.lit(7)) - 3.0)
    n = len(rows)
    shifts = {0: 0, 1: 1, 2: n - 1, 3: n // 2, 4: n + 5}
    offs = spark.createDataFrame([(r, s) for r, s in shifts.items()], "rep bigint, shift bigint")
    y = [k * 11 % 7 - 3.0 for k in range(n)]
    s = [float(k * 7 % 5) for k in range(n)]
    moved = rs.rotate_labels(df, ["t", "key"], "t", "y", offs, time_bucket("t", 9 * DAY), ["key"], length)
    got = {(r["rep"], r["key"]): r["y"] for r in moved.collect()}
    assert got == {(r, i): y[(i + k) % n] for r, k in shifts.items() for i in range(n)}
    # rows that meet in the join: replicates times chunks
    chunks = rs.rotated_chunks(df, ["t", "key"], "y", offs, time_bucket("t", 9 * DAY), ["key"], length)
    assert chunks.count() == len(shifts) * -(-n // length)
    null = {r["rep"]: r for r in rs.rotation_null(df, ["t", "key"], "t", "y", "s", "s", offs, time_bucket("t", 9 * DAY), length).collect()}
    rank_s, rank_y = _mid(s), _mid(y)
    for r, k in shifts.items():
        pos = [y[(i + k) % n] > 0 for i in range(n)]
        auc = (sum(a for a, b in zip(rank_s, pos) if b) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (n - sum(pos)))
        assert abs(null[r]["auc"] - auc) < 1e-9
        import numpy as np
        assert abs(null[r]["ic"] - np.corrcoef(rank_s, [rank_y[(i + k) % n] for i in range(n)])[0, 1]) < 1e-9


def test_block_draws_are_circular_and_exact(spark):
    out = {}
    for r in rs.block_draws(50, 8, 20, 3, spark).collect():
        out.setdefault(r["rep"], {})[r["pos"]] = r["idx"]
    assert len(out) == 20
    for seq in out.values():
        assert sorted(seq) == list(range(50)) and all(0 <= i < 50 for i in seq.values())
        assert all(seq[p + 1] == (seq[p] + 1) % 50 for p in range(49) if (p + 1) % 8)
    starts = {s[0] for s in out.values()}
    assert len(starts) > 10


def test_draws_are_spread_evenly(spark):
    x = spark.range(20000).select(F.pmod(draw(1, F.lit(3), "id"), F.lit(10)).alias("d")).groupBy("d").count().collect()
    assert len(x) == 10 and all(1700 < r["count"] < 2300 for r in x)


def test_holm_worked_example(spark):
    p = dict(zip("abcdef", (.01, .04, .03, .005, .5, .2)))
    df = spark.createDataFrame(list(p.items()), "k string, p double")
    got = {r["k"]: r["p_holm"] for r in rs.holm(df, "p", "k").collect()}
    for k, v in zip("abcdef", (.05, .12, .12, .03, .5, .4)):
        assert abs(got[k] - v) < 1e-12


def test_paired_paths_and_dominance(spark):
    rng = random.Random(5)
    rows = [(a, i, (0.002 if a == "x" else -0.001) + r * 0.01) for i in range(120)
            for r in [rng.gauss(0, 1)] for a in ("x", "base")]
    df = spark.createDataFrame(rows, "arm string, idx bigint, r double")
    draws = rs.block_draws(120, 10, 60, 9, spark)
    paths = rs.paired_paths(df, draws, "arm", "idx", "r")
    p = rs.paired_p(paths, "arm", "sortino", "base").first()
    assert abs(p["p"] - 1 / 61) < 1e-12
    dd = rs.paired_dd95(paths, "arm")
    out = rs.improves_over(rs.holm(rs.paired_p(paths, "arm", "sortino", "base"), "p", "arm"), dd, "arm", "base").first()
    assert out["dd_pass"] and out["improves"]


def test_verdict_texts(spark):
    base = {"n_boundaries": 50, "n_offsets": 9, "p_auc": .5, "p_ic": .5, "auc_lo": .4, "auc_hi": .6, "ic_lo": -.1,
            "ic_hi": .1, "power_auc": .7, "power_ic": .7}
    cases = [({}, 0), ({"power_ic": .5}, 1), ({"p_auc": .01}, 2), ({"auc_lo": .51}, 2), ({"n_offsets": 0}, 3)]
    for change, want in cases:
        row = spark.createDataFrame([tuple({**base, **change}.values())],
                                    "n_boundaries int, n_offsets int, p_auc double, p_ic double, auc_lo double,"
                                    "auc_hi double, ic_lo double, ic_hi double, power_auc double, power_ic double")
        assert rs.learnability_verdict(row).first()["verdict"] == rs.VERDICTS[want]


def test_selection_rules(spark):
    pts = spark.createDataFrame([(1.0, 100, 0.5, 150), (2.0, 50, 0.5, 150), (3.0, 5, 0.9, 150)],
                                "param double, n_selected bigint, metric double, n_total bigint")
    r = selection.grid_select(pts, 9.0).first()
    assert (r["selected"], r["n_selectable"], r["best_metric"]) == (1.0, 2, 0.5)
    assert selection.grid_select(pts.filter("param > 2"), 9.0).first()["selected"] == 9.0
    u = spark.createDataFrame([(1, 1.0, 0.10), (2, 1.0, 0.10), (3, 1.2, 0.30)], "o int, s double, d double")
    rows = {r["o"]: r for r in selection.utility_select(u, "o", "s", "d", 0.10).collect()}
    assert [o for o, r in rows.items() if r["selected"]] == [1]
    assert abs(rows[3]["utility"] - (1.2 - 2 * 2.0)) < 1e-12


def test_convergence_and_group_sizes(spark):
    rows = [("up", i, float(i)) for i in range(60)] + [("down", i, float(-i)) for i in range(60)] + \
        [("few", i, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, i bigint, r double")
    got = {r["k"]: r["non_converged"] for r in reports.convergence_flag(df, ["k"], "i", "r", 10, block=16).collect()}
    assert got == {"up": False, "down": True, "few": None}
    g = reports.group_sizes(df, "k").first()
    assert (g["n_rows"], g["n_boundaries"], g["max_size"], g["median_size"]) == (125, 3, 60, 60.0)


def test_scalars(spark):
    r = spark.range(1).select(
        clip_finite(F.lit(float("inf")), -1, 2).alias("a"), clip_finite(F.lit(float("nan")), -1.0, 2.0).alias("b"),
        clip_finite(F.lit(0.5), -1.0, 2.0).alias("c"), normalize_epoch(F.lit(1_700_000_000_000_123)).alias("d"),
        normalize_epoch(F.lit(1_700_000_000_000)).alias("e"), erf(F.lit(-0.7)).alias("f")).first()
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == (2, -1.0, 0.5, 1_700_000_000_000, 1_700_000_000_000)
    assert abs(r["f"] - math.erf(-0.7)) < 2e-7


def _sent_to_all(df):
    """Whether rows multiplied by an explode lie below a broadcast in the plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for j in range(i + 1, len(lines)):
                if depth[j] <= depth[i]:
                    break
                if "Generate explode" in lines[j]:
                    return True
    return False


def test_replicates_are_never_broadcast(spark):
    df, _ = _labels(spark)
    offs = spark.createDataFrame([(0, 3), (1, 70)], "rep bigint, shift bigint")
    order, b = ["t", "key"], time_bucket("t", 10 * DAY)
    assert not _sent_to_all(rs.rotate_labels(df, order, "t", "y", offs, b, ["key"], 8))
    assert not _sent_to_all(rs.rotated_chunks(df, order, "y", offs, b, ["key"], 8))
    assert not _sent_to_all(rs.block_permute(df, ["key"], "t", "y", 5, 3, ["key"]))
    assert not _sent_to_all(rs.shuffle_permute(df, order, "y", 5, 3, b, ["key"]))


def test_bootstrap_weights_are_never_broadcast(spark, monkeypatch):
    df, _ = _labels(spark)
    seen, write = [], rs.materialize

    def watched(x):
        seen.append(_sent_to_all(x))
        return write(x)
    monkeypatch.setattr(rs, "materialize", watched)
    x = df.withColumn("p", F.col("y") + F.col("key") / 10).withColumn("s", F.col("p"))
    assert rs.learnability(x, "t", "key", "y", "p", "s", 4, 6, 3).count() == 1
    assert seen and not any(seen)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4097])
def test_permutation_on_arrays_equals_the_column(spark, n):
    x = spark.range(n).crossJoin(spark.range(5).withColumnRenamed("id", "rep"))
    want = x.select("id", "rep", rs.permuted(F.col("id"), F.lit(n), F.col("rep"), 11).alias("to")).collect()
    got = rs._positions(n, 5, 11)(np.arange(n))
    assert all(got[r["id"], r["rep"]] == r["to"] for r in want)


def test_replicates_are_drawn_in_many_tasks(spark):
    df, _ = _labels(spark)
    plan = rs.shuffle_permute(df, ["t", "key"], "y", 5, 3, time_bucket("t", 10 * DAY), ["key"])._jdf.queryExecution()
    # a number of partitions that adaptive execution must keep
    assert "REPARTITION_BY_NUM" in plan.executedPlan().toString()
