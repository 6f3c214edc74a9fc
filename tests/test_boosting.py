"""All replicates in one fit against a plain booster per replicate."""

import math
import random

from pyspark.sql import functions as F

from pitpanel.operators import boosting, models
from pitpanel.operators.boosting import UNIT, Boost

COLS = ["F02_a", "F03_b"]


def plain(bins, labels, s):
    """Scores of one replicate; rows without a label are scored, not learnt from."""
    known = [i for i, v in enumerate(labels) if v is not None]
    if s.positive:
        goal = {i: float(labels[i] > 0) for i in known}
        mean = sum(goal.values()) / len(known)
        f = [math.log(mean / (1 - mean))] * len(bins)
    else:
        goal = {i: labels[i] for i in known}
        f = [sum(round(goal[i] * UNIT) for i in known) / UNIT / len(known)] * len(bins)
    for _ in range(s.trees):
        p = [1 / (1 + math.exp(-v)) for v in f] if s.positive else f
        g = {i: round((goal[i] - p[i]) * UNIT) for i in known}
        h = {i: round(p[i] * (1 - p[i]) * UNIT) if s.positive else 1 for i in known}
        groups = [(known, list(range(len(bins))))]
        for _ in range(s.depth):
            below = []
            for fit, rows in groups:
                ga, ha = sum(g[i] for i in fit), sum(h[i] for i in fit)
                best = (0.0,)
                for j in range(len(COLS)):
                    for cut in sorted({bins[i][j] for i in fit}):
                        left = [i for i in fit if bins[i][j] <= cut]
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        if hl >= s.least and ha - hl >= s.least:
                            gain = float(gl) ** 2 / hl + float(ga - gl) ** 2 / (ha - hl) - float(ga) ** 2 / ha
                            best = max(best, (gain, -j, -cut))
                if best[0] > 0:
                    j, cut = -best[1], -best[2]
                    for right in (False, True):
                        below.append(tuple([i for i in part if (bins[i][j] > cut) == right] for part in (fit, rows)))
                else:
                    below.append((fit, rows))
            groups = below
        for fit, rows in groups:
            ha = sum(h[i] for i in fit)
            for i in rows:
                f[i] += s.step * sum(g[i] for i in fit) / ha / (1 if s.positive else UNIT) if ha else 0.0
    return [1 / (1 + math.exp(-v)) for v in f] if s.positive else f


def table(spark, n=90, reps=3):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([None, float("nan"), *[k / 8 for k in range(8)]]), float(rnd.randrange(40))) for i in range(n)]
    y = [[round(rnd.random(), 3) - (0.6 if (r[1] or 0) < 0.4 else 0.2) for r in rows] for _ in range(reps)]
    y[0][:2] = [1.0, 0.0]
    y[1][3] = y[2][7] = None
    lo, hi = (fn(v for ys in y for v in ys if v is not None) for fn in (min, max))
    y = [[None if v is None else (v - lo) / (hi - lo) for v in ys] for ys in y]
    return (spark.createDataFrame(rows, "id bigint, F02_a double, F03_b double"), y,
            spark.createDataFrame([(r, i, v) for r in range(reps) for i, v in enumerate(y[r])], "rep bigint, id bigint, y double"))


def test_each_replicate_equals_a_plain_booster(spark):
    df, y, labels = table(spark)
    shifted = labels.withColumn("y", F.col("y") - 0.5)
    for s, given in ((Boost(trees=4, depth=3, step=0.3, share=1.0, bins=8, least=3, keep_every=3), labels),
                     (Boost(trees=3, depth=2, step=0.3, share=1.0, bins=4, positive=True, keep_every=2), shifted)):
        forest = boosting.fit_replicates(df, COLS, given, ["id"], "y", 3, s)
        got = {(r["rep"], r["id"]): r["score"] for r in forest.score(df, ["id"]).collect()}
        bins = [list(r[0]) for r in df.orderBy("id").select(boosting.binned(forest.edges)).collect()]
        assert {b[0] for b in bins if b[0] == 0} == {0} and len(got) == 3 * len(bins)
        for rep in range(3):
            ys = [None if v is None else v - 0.5 for v in y[rep]] if s.positive else y[rep]
            want = plain(bins, ys, s)
            assert all(abs(got[rep, i] - w) < 1e-9 for i, w in enumerate(want))


def test_jobs_follow_trees_and_depth_not_replicates(spark, monkeypatch):
    df, _, labels = table(spark, 40)
    calls, level = [], boosting._level
    monkeypatch.setattr(boosting, "_level", lambda *a: calls.append(1) or level(*a))
    s = Boost(trees=2, depth=2, bins=4)
    for reps in (1, 3):
        calls.clear()
        a = boosting.fit_replicates(df, COLS, labels, ["id"], "y", reps, s)
        assert len(calls) == 4
    # samples are drawn by row, tree and replicate: partitions don't matter, replicates differ
    b = boosting.fit_replicates(df.repartition(5), COLS, labels.repartition(3), ["id"], "y", 3, s)
    assert all((x["leaf"] == z["leaf"]).all() for x, z in zip(a.trees, b.trees, strict=True))


def test_refit_of_labels_without_a_pattern_and_of_no_rows(spark):
    df, _, labels = table(spark, 60)
    true = df.join(labels.where("rep = 0").drop("rep"), "id")
    same = labels.where("rep < 2").join(labels.where("rep = 0").select("id", F.col("y").alias("z")), "id").select("rep", "id", F.col("z").alias("y"))
    s = Boost(trees=3, depth=2, share=1.0)
    stats = {r["rep"]: r["stat"] for r in models.permutation_refit(true, true, COLS, "y", same, ["id"], 2, settings=s).collect()}
    assert stats[0] == stats[1] > 0.2
    empty = boosting.fit_replicates(df.limit(0), COLS, labels, ["id"], "y", 2, s)
    assert {r["score"] for r in empty.score(df, ["id"]).collect()} == {0.0}
    assert models.permutation_refit(true, true.limit(0), COLS, "y", same, ["id"], 2, settings=s).collect() == []
