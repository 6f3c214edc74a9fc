"""Rank statistics, permutations, block bootstraps and the inference built on them.

Replicates are rows, not loops: a replicate number is exploded onto boundary-level rows (one
per time step, so bounded by the calendar) and every statistic is a grouped aggregate by it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitpanel.functions.columns import DRAW_M1, DRAW_M2, DRAW_MOD, div, draw, normal_cdf
from pitpanel.operators.reports import downside, sortino_of
from pitpanel.params import DAY, DEFAULTS, Params
from pitpanel.plans.ordered import (mid_ranks, running, time_bucket, with_position,
                                    with_time_key_bucket, with_value_bucket)
from pitpanel.session import materialize


def replicates(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))


# ---------------------------------------------------------------- rank statistics
def rank_auc(df: DataFrame, y: str, score: str, by: list[str] | None = None,
             weight: str | None = None, cuts_from: DataFrame | None = None) -> DataFrame:
    """Area under the ROC curve with mid-ranks; NULL with a single class.

    Rows collapse to distinct scores with class counts before they are ranked.
    """
    by = by or []
    w = F.col(weight) if weight else F.lit(1)
    cells = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*by, score).agg(
        F.sum(w).alias("_n"), F.sum(F.when(F.col(y) > 0, w).otherwise(F.lit(0))).alias("_p"))
    j = running(with_value_bucket(cells, score, cuts_from=cuts_from), by, [score], F.col("_vb"), {"_cum": ("sum", F.col("_n"))})
    j = j.withColumn("rank", F.col("_cum") - F.col("_n") + (F.col("_n") + 1) / 2.0)
    agg = [F.sum(F.col("_p") * F.col("rank")).alias("_r"), F.sum("_p").alias("n_pos"),
           F.sum(F.col("_n") - F.col("_p")).alias("n_neg")]
    out = j.groupBy(*by).agg(*agg) if by else j.agg(*agg)
    p, n = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return out.select(*by, F.try_divide(F.col("_r") - p * (p + 1) / 2.0, p * n)
                      .alias("auc"))


def rank_ic(df: DataFrame, a: str, b: str, by: list[str] | None = None,
            weight: str | None = None, cuts_from: DataFrame | None = None) -> DataFrame:
    """Spearman correlation with mid-ranks, 0 when a side is constant; equal pairs collapse
    first."""
    by = by or []
    w = F.sum(weight) if weight else F.count(F.lit(1))
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(w.alias("_n"))
    j = cells
    for c, r in ((a, "_ra"), (b, "_rb")):
        ranks = mid_ranks(cells, c, by, "_n", cuts_from).select(*by, c, F.col("rank").alias(r))
        j = j.join(ranks, by + [c])
    n, x, z = F.col("_n"), F.col("_ra"), F.col("_rb")
    aggs = [F.sum(n).alias("n"), F.sum(n * x).alias("sx"), F.sum(n * z).alias("sz"),
            F.sum(n * x * x).alias("sxx"), F.sum(n * z * z).alias("szz"), F.sum(n * x * z).alias("sxz")]
    s = j.groupBy(*by).agg(*aggs) if by else j.agg(*aggs)
    k = F.col("n").cast("double")
    cov = F.col("sxz") - F.col("sx") * F.col("sz") / k
    var = (F.col("sxx") - F.col("sx") * F.col("sx") / k) * (F.col("szz") - F.col("sz") * F.col("sz") / k)
    return s.select(*by, F.when(var > 0, cov / F.sqrt(var)).otherwise(F.lit(0.0)).alias("ic"))


# ---------------------------------------------------------------- permutations
def time_blocks(df: DataFrame, t: str, anchor: Column, length: int = DEFAULTS.block_ms) -> DataFrame:
    return df.withColumn("block", div(F.col(t) - anchor, length))


def eligible_offsets(df: DataFrame, t: str, length: int = DEFAULTS.block_ms) -> DataFrame:
    """Boundaries displaced from the first one by at least a block and at most span minus a
    block, with the number of rows before them: ``(j, boundary, shift)``.

    The counts per time are written once, as the ends and the running sums all read them."""
    per = materialize(df.groupBy(t).agg(F.count(F.lit(1)).alias("_n")))
    per = per.withColumn("_a", per.select(F.min(t)).scalar()).withColumn("_b", per.select(F.max(t)).scalar())
    seq = running(per, [], [t], time_bucket(t, 90 * DAY),
                  {"_cum": ("sum", F.col("_n")), "_j": ("count", F.lit(1))})
    d = F.col(t) - F.col("_a")
    return seq.filter((d >= length) & (d <= F.col("_b") - F.col("_a") - length)).select(
        (F.col("_j") - 1).alias("j"), F.col(t).alias("boundary"), (F.col("_cum") - F.col("_n")).alias("shift"))


def rotation_offsets(df: DataFrame, t: str, reps: int, seed: int,
                     length: int = DEFAULTS.block_ms) -> DataFrame:
    """One eligible rotation per replicate, drawn with replacement: ``(rep, j, shift)``."""
    e = materialize(eligible_offsets(df, t, length))
    placed = with_position(e, [], ["boundary"], time_bucket("boundary", 90 * DAY), "_k")
    n = e.select(F.count(F.lit(1))).scalar()
    picks = (df.sparkSession.range(reps).select(F.col("id").alias("rep")).withColumn("_n", n)
             .filter(F.col("_n") > 0)
             .withColumn("_k", F.pmod(draw(seed, "rep", F.lit(0)), F.col("_n"))))
    return picks.join(placed, "_k").select("rep", "j", "shift")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows about to multiply, over as many tasks as shuffles have.

    The number is given: adaptive execution joins the small partitions of a shuffle that leaves it open, and
    one task would then write all replicates.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _chunks(placed: DataFrame, n: int, y: str, keep: list[str], length: int) -> tuple[DataFrame, DataFrame]:
    """Vectors of ``length`` rows by position, and of the labels of that stretch and the next one.

    Labels wrap around, so any ``length`` labels in a row lie in the vector of their first one's chunk.
    """
    last = (n - 1) // length
    rows = dealt(placed.withColumn("_c", div("_i", length)), "_c").groupBy("_c").agg(
        F.sort_array(F.collect_list(F.struct("_i", *keep))).alias("_rows"))
    # a label stands wherever i + k n lies within the stretches, once in its own chunk and once in the one before
    turns = F.sequence(F.lit(0), F.lit(((last + 2) * length - 1) // n))
    at = placed.select(F.col(y).alias("_y"), F.explode(F.transform(turns, lambda k: F.col("_i") + k * n)).alias("_v"))
    both = at.select("_y", "_v", F.explode(F.array(div("_v", length), div("_v", length) - 1)).alias("_q"))
    labels = both.where((F.col("_q") >= 0) & (F.col("_q") <= last)).groupBy("_q").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_v", "_y"))), lambda x: x["_y"]).alias("_labels"))
    return rows, labels


def rotated_chunks(df: DataFrame, order: list[str], y: str, offsets: DataFrame, bucket: Column, keep: list[str],
                   length: int = 1024) -> DataFrame:
    """``rep, _rows, _ys``: stretches of ``length`` rows, and the labels each replicate's shift lays on them.

    A replicate meets a stretch in one row of vectors, so replicates times rows over ``length`` are shuffled.
    """
    placed = materialize(with_position(df, [], order, bucket, "_i").select("_i", F.col(y).alias("_label"), *keep))
    n = placed.count()
    if not n:
        n = 1
    rows, labels = _chunks(placed, n, "_label", keep, length)
    # the offsets table has one small row per replicate and is attached by a literal array
    shifts = offsets.select(F.array_sort(F.collect_list(F.struct("rep", "shift")))).scalar()
    start = F.pmod(F.col("_c") * length + F.col("_o.shift"), F.lit(n))
    spread = rows.withColumn("_s", shifts).withColumn("_o", F.explode("_s")).select(
        F.col("_o.rep").alias("rep"), "_rows", div(start, length).alias("_q"), F.pmod(start, F.lit(length)).cast("int").alias("_at"))
    # sizes are estimated without the replicates, so Spark would send ``spread`` to all; labels have one row per _q
    return dealt(spread, "_q").join(labels.hint("shuffle_hash"), "_q").select("rep", "_rows", F.slice("_labels", F.col("_at") + 1, F.size("_rows")).alias("_ys"))


def rotate_labels(df: DataFrame, order: list[str], t: str, y: str, offsets: DataFrame,
                  bucket: Column, keep: list[str], length: int = 1024) -> DataFrame:
    """Label vector rotated by each replicate's shift, so the multiset of labels is kept exactly.

    Output: ``rep, keep..., y``, unpacked after the only join.
    """
    x = rotated_chunks(df, order, y, offsets, bucket, keep, length)
    each = x.select("rep", F.explode(F.arrays_zip(F.col("_rows").alias("r"), F.col("_ys").alias("y"))).alias("_x"))
    return each.select("rep", *[F.col("_x.r")[c].alias(c) for c in keep], F.col("_x.y").alias(y))


def rotation_null(df: DataFrame, order: list[str], t: str, y: str, prob: str, score: str,
                  offsets: DataFrame, bucket: Column, length: int = 1024) -> DataFrame:
    """AUC of ``prob`` and rank correlation of ``score`` under every rotation: ``(rep, auc, ic)``.

    A rotation keeps all three multisets, so ranks are taken once on the original rows and the
    rotated label carries its own rank. A replicate is a circular cross-correlation: dot products of
    vectors, chunk by chunk. Scores without a difference have no correlation: 0.
    """
    ranked = df
    for c, r in dict.fromkeys(((prob, "_rp"), (score, "_rs"), (y, "_ry"))):
        ranked = ranked.join(mid_ranks(df, c).select(c, F.col("rank").alias(r)), c)
    label = F.struct((F.col(y) > 0).cast("double").alias("pos"), F.col("_ry").alias("ry"))
    ranked = materialize(ranked.withColumn("_lab", label))
    # what no rotation changes; ranks are centred before they are multiplied
    one = ranked.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("_lab.pos").alias("p"), F.avg("_rs").alias("ms"),
                     F.avg("_ry").alias("my"), F.var_pop("_rs").alias("vs"), F.var_pop("_ry").alias("vy"))
    one = materialize(one)
    centre = one.select(F.struct("ms", "my")).scalar()
    x = rotated_chunks(ranked, order, "_lab", offsets, bucket, ["_rp", "_rs"], length).withColumn("_m", centre)

    def dot(product):
        return F.aggregate(F.zip_with("_rows", "_ys", product), F.lit(0.0), lambda a, v: a + v)
    s = x.groupBy("rep").agg(F.sum(dot(lambda r, v: r["_rp"] * v["pos"])).alias("r"),
                             F.sum(dot(lambda r, v: (r["_rs"] - F.col("_m.ms")) * (v["ry"] - F.col("_m.my")))).alias("c"))
    s = s.withColumn("_one", one.select(F.struct("n", "p", "vs", "vy")).scalar())
    n, p = F.col("_one.n"), F.col("_one.p")
    spread = F.sqrt(F.col("_one.vs") * F.col("_one.vy"))
    return s.select("rep", F.try_divide(F.col("r") - p * (p + 1) / 2.0, p * (n - p)).alias("auc"),
                    F.when(spread > 0, F.col("c") / n / spread).otherwise(0.0).alias("ic"))


def block_permute(df: DataFrame, order: list[str], t: str, y: str, reps: int, seed: int,
                  keep: list[str], length: int = DEFAULTS.block_ms) -> DataFrame:
    """Superseded variant: shuffled time blocks laid onto the original boundary slots, with
    ``r mod len`` inside a slot (may duplicate or drop values). ``order`` starts with a number."""
    bounds = df.groupBy(t).agg(F.count(F.lit(1)).alias("_len"))
    anchor = bounds.select(F.min(t)).scalar()
    b = bounds.withColumn("_a", anchor).withColumn("_blk", div(F.col(t) - F.col("_a"), length))
    b = with_position(b, [], [t], time_bucket(t, 90 * DAY), "_slot")
    b = materialize(b)
    rep = dealt(b, "_slot").select(replicates(reps).alias("rep"), F.col(t).alias("_src_t"), "_blk", "_len")
    # boundaries per replicate: bounded by the calendar
    w = W.partitionBy("rep").orderBy(draw(seed, "rep", "_blk"), "_blk", "_src_t")
    seq = rep.withColumn("_slot", F.row_number().over(w).cast("bigint") - 1)
    slots = b.select("_slot", F.col(t))
    ranked = with_position(with_value_bucket(df, order[0]), [t], order, F.col("_vb"), "_r").drop("_vb")
    ranked = materialize(ranked)
    # sizes are estimated without the replicates: left to them, Spark would send all replicates to every task
    target = (ranked.select(t, "_r", *keep).join(slots, t).join(seq.select("rep", "_slot", "_src_t", "_len").hint("merge"), "_slot")
              .withColumn("_m", F.pmod(F.col("_r"), F.col("_len"))))
    src = ranked.select(F.col(t).alias("_src_t"), F.col("_r").alias("_m"), F.col(y).alias(y))
    return target.hint("merge").join(src, ["_src_t", "_m"]).select("rep", *keep, y)


#: rounds of the permutation network; each sums a keyed draw of one half into the other
ROUNDS = 6
#: steps an index outside the domain is walked on. Such indices are fewer than the root of n and a walk
#: never meets one twice, so it ends within them for n up to 4,096; above, 64 in a row don't happen
WALK = 64


def permuted(i: Column, n: Column, rep: Column, seed: int, rounds: int = ROUNDS, walk: int = WALK) -> Column:
    """Image of ``i`` under a bijection of [0, n) of its own for every ``rep``: a Feistel network on digits.

    An index is split into two digits in base ``ceil(n / ceil(sqrt(n)))``; every round adds a draw keyed by
    round, replicate and one digit to the other. What leaves [0, n) goes through the network again. Null
    outside [0, n). One folded expression: as columns of their own the rounds would be multiplied out
    by every filter that is pushed through them.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")
    b = F.call_function("div", n + a - 1, a)

    def step(x, k):
        high, low = F.call_function("div", x, b), F.pmod(x, b)
        # the round numbers the key: even rounds change the high digit
        even = F.pmod(high + draw(seed, rep * rounds + k, low), a) * b + low
        return F.when(F.pmod(k, F.lit(2)) == 0, even).otherwise(high * b + F.pmod(low + draw(seed, rep * rounds + k, high), b))

    def network(x):
        return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.lit(rounds - 1).cast("bigint")), x, step)

    def inside(x):
        return F.when(x < n, x).otherwise(F.aggregate(
            F.sequence(F.lit(1), F.lit(walk)), x, lambda v, _: F.when(v < n, v).otherwise(network(v)),
            lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("walk too short")).cast("bigint"))))
    return F.when((i >= 0) & (i < n), F.get(F.transform(F.array(network(i)), inside), 0))


def _positions(n: int, reps: int, seed: int, rounds: int = ROUNDS):
    """``permuted`` for arrays, nested so that it travels with the job: images of ``i`` for every replicate, a row each."""
    m1, m2, mod = DRAW_M1, DRAW_M2, DRAW_MOD
    a = max(1, math.isqrt(max(n - 1, 0)) + 1 if n else 1)
    b = (n + a - 1) // a

    def mix(x):
        x = x * m1 % mod
        x ^= x >> 13
        x = x * m2 % mod
        return x ^ (x >> 11)

    # the first half of a draw depends on round and replicate only
    first = mix((np.arange(reps * rounds, dtype=np.int64).reshape(reps, rounds) + seed) % mod)

    def network(x, rep):
        high, low = x // b, x % b
        for k in range(rounds):
            if k % 2 == 0:
                high = (high + mix((first[rep, k] + low) % mod)) % a
            else:
                low = (low + mix((first[rep, k] + high) % mod)) % b
        return high * b + low

    def images(i):
        rep = np.broadcast_to(np.arange(reps), (len(i), reps))
        x = network(np.broadcast_to(i[:, None], rep.shape), rep)
        while (out := np.nonzero(x >= n))[0].size:
            x[out] = network(x[out], rep[out])
        return x

    return images


def shuffle_permute(df: DataFrame, order: list[str], y: str, reps: int, seed: int, bucket: Column,
                    keep: list[str]) -> DataFrame:
    """Plain label permutation: the source position is computed from position and replicate.

    Nothing is sorted per replicate; one join brings the labels. The network runs on arrays: as a column
    it is interpreted, row by row and replicate by replicate.
    """
    placed = materialize(with_position(df, [], order, bucket, "_i").select("_i", F.col(y).alias("_label"), *keep))
    images = _positions(placed.count(), reps, seed)

    def draw_all(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), reps))
                each = pa.array(np.tile(np.arange(reps, dtype=np.int64), batch.num_rows))
                src = images(batch.column(0).to_numpy()).ravel()
                yield pa.RecordBatch.from_arrays([each, pa.array(src), *[c.take(rows) for c in batch.columns[1:]]],
                                                 ["rep", "_src", *batch.schema.names[1:]])

    # the rows are few against their replicates: dealt out again before they multiply
    rows = dealt(placed.select("_i", *keep), "_i")
    schema = rows.select(F.col("_i").alias("rep"), F.col("_i").alias("_src"), *keep).schema
    source = rows.mapInArrow(draw_all, schema)
    labels = placed.select(F.col("_i").alias("_src"), F.col("_label").alias(y))
    # sizes are estimated without the replicates; ``labels`` has one row per position
    return source.join(labels.hint("shuffle_hash"), "_src").select("rep", *keep, y)


# ---------------------------------------------------------------- bootstrap
def block_draws(u: Column | int, block_len: Column | int, reps: int, seed: int, spark) -> DataFrame:
    """Circular moving-block indices ``(rep, pos, idx)``: uniform starts, consecutive with wrap,
    cut to exactly ``u``. The same draws serve every paired series."""
    u = F.lit(u) if isinstance(u, int) else u
    block_len = F.lit(block_len) if isinstance(block_len, int) else block_len
    base = spark.range(reps).select(F.col("id").alias("rep")).withColumn("_u", u.cast("bigint")) \
        .withColumn("_l", block_len.cast("bigint"))
    starts = base.select("rep", "_u", "_l", F.posexplode(F.sequence(
        F.lit(0), F.call_function("div", F.col("_u") - 1, F.col("_l")).cast("int"))).alias("_b", "_x")) \
        .withColumn("_start", F.pmod(draw(seed, "rep", "_b"), F.col("_u")))
    steps = starts.select("rep", "_u", "_l", "_b", "_start", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("_l") - 1)).alias("_k"))
    pos = F.col("_b") * F.col("_l") + F.col("_k")
    return steps.select("rep", pos.alias("pos"), F.pmod(F.col("_start") + F.col("_k"), F.col("_u"))
                        .alias("idx"), "_u").filter(F.col("pos") < F.col("_u")).drop("_u")


def block_bootstrap(df: DataFrame, idx: str, draws: DataFrame) -> DataFrame:
    """Rows of each replicate; a boundary drawn k times contributes k copies."""
    return draws.join(df.withColumnRenamed(idx, "idx"), "idx")


def bootstrap_ci(reps: DataFrame, stats: list[str], by: list[str] | None = None,
                 level: float = 0.95) -> DataFrame:
    """Percentile interval and standard error per statistic (replicate counts are small)."""
    a = (1 - level) / 2
    long = reps.select(*(by or []), F.explode(F.array(*[
        F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("v")) for s in stats])).alias("x")) \
        .select(*(by or []), "x.stat", "x.v")
    return long.groupBy(*(by or []), "stat").agg(
        F.percentile("v", F.lit(a)).alias("lo"), F.percentile("v", F.lit(1 - a)).alias("hi"),
        F.stddev_pop("v").alias("se"))


def paired_paths(rets: DataFrame, draws: DataFrame, arm: str, idx: str, r: str,
                 periods: float = DEFAULTS.periods_per_year) -> DataFrame:
    """Sortino and maximal drawdown of the compounded path per (replicate, arm).

    A path has one row per time step of the curve, so its window is bounded by the calendar.
    """
    x = draws.join(rets.select(F.col(idx).alias("idx"), arm, F.col(r).alias("_r")), "idx")
    w = W.partitionBy("rep", arm).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    level = x.withColumn("_e", F.sum(F.ln(1 + F.col("_r"))).over(w))
    path = level.withColumn("_peak", F.max("_e").over(w))
    return path.groupBy("rep", arm).agg(
        F.avg("_r").alias("_m"), F.avg(downside(F.col("_r"))).alias("_d"),
        F.max(1 - F.exp(F.col("_e") - F.col("_peak"))).alias("max_drawdown")).select(
        "rep", arm, sortino_of(F.col("_m"), F.col("_d"), periods).alias("sortino"), "max_drawdown")


def paired_dd95(paths: DataFrame, arm: str, q: float = 0.95) -> DataFrame:
    return paths.groupBy(arm).agg(F.percentile("max_drawdown", F.lit(q)).alias("dd95"))


# ---------------------------------------------------------------- p-values and decisions
def two_sided_p(null: DataFrame, stat: str, observed: Column, center: float) -> DataFrame:
    hit = F.abs(F.col(stat) - center) >= F.abs(observed - center)
    return null.agg(F.count_if(hit).alias("count_ge"), F.count(F.lit(1)).alias("n")).select(
        "count_ge", "n", (F.col("count_ge") / F.col("n")).alias("p_raw"),
        ((F.col("count_ge") + 1) / (F.col("n") + 1)).alias("p_upper"))


def paired_p(reps: DataFrame, arm: str, stat: str, base: str) -> DataFrame:
    """``(#[stat_x - stat_base <= 0] + 1) / (R + 1)`` per arm against the base arm."""
    b = reps.filter(F.col(arm) == base).select("rep", F.col(stat).alias("_b"))
    x = reps.filter(F.col(arm) != base).join(b, "rep")
    return x.groupBy(arm).agg(((F.count_if(F.col(stat) - F.col("_b") <= 0) + 1)
                               / (F.count(F.lit(1)) + 1)).alias("p"))


def holm(df: DataFrame, p: str, key: str) -> DataFrame:
    """Step-down adjustment over one family (a handful of rows)."""
    w = W.partitionBy(F.lit(0)).orderBy(p, key)
    m = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    step = df.withColumn("_s", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p)))
    return step.withColumn("p_holm", F.max("_s").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_s")


def improves_over(p: DataFrame, dd: DataFrame, arm: str, base: str, alpha: float = DEFAULTS.alpha) -> DataFrame:
    ref = dd.filter(F.col(arm) == base).select("dd95").scalar()
    return (p.join(dd, arm).withColumn("dd_base", ref)
            .withColumn("dd_pass", F.col("dd95") <= F.col("dd_base"))
            .withColumn("improves", (F.col("p_holm") < alpha) & F.col("dd_pass")))


def approx_power(null: DataFrame, stat: str, center: float, se: Column, effect: float) -> DataFrame:
    """Normal-theory power at ``effect``; the critical value is the null's 95th percentile."""
    c = null.select(F.percentile(F.abs(F.col(stat) - center), F.lit(0.95)).alias("critical"))
    z = F.try_divide(F.col("critical") - effect, F.col("se"))
    return c.withColumn("se", se).select(
        "critical", "se", F.when(F.col("se") > 0, 1 - normal_cdf(z))
        .otherwise((F.lit(effect) > F.col("critical")).cast("double")).alias("power"))


# Verdict texts.
VERDICTS = ("INSUFFICIENT LEARNABLE VARIATION", "UNDERPOWERED", "CONDITIONS NOT MET",
            "INSUFFICIENT DATA")


def learnability_verdict(stats: DataFrame) -> DataFrame:
    """Three-way verdict from one row of p-values, intervals and powers.

    Needs ``n_boundaries, n_offsets, p_auc, p_ic, auc_lo, auc_hi, ic_lo, ic_hi, power_auc, power_ic``.
    """
    a = (F.col("p_auc") >= 0.05) & (F.col("p_ic") >= 0.05)
    b = F.lit(0.5).between(F.col("auc_lo"), F.col("auc_hi")) & F.lit(0.0).between(F.col("ic_lo"), F.col("ic_hi"))
    c = (F.col("power_auc") >= 0.60) & (F.col("power_ic") >= 0.60)
    few = (F.col("n_boundaries") < 4) | (F.col("n_offsets") == 0)
    return stats.withColumns({"cond_p": a, "cond_ci": b, "cond_power": c}).withColumn(
        "verdict", F.when(few, VERDICTS[3]).when(a & b & c, VERDICTS[0]).when(a & b, VERDICTS[1])
        .otherwise(VERDICTS[2]))


def learnability(df: DataFrame, t: str, key: str, y: str, prob: str, score: str, reps: int,
                 boots: int, seed: int, effects: tuple[float, float] = (0.02, 0.05),
                 p: Params = DEFAULTS) -> DataFrame:
    """Fixed-score assessment: rotation nulls, circular block-bootstrap intervals, power, verdict.

    One row. ``effects`` are the smallest deviations of interest of AUC and rank IC.
    """
    base = materialize(df.select(t, key, y, prob, score))
    offs = materialize(rotation_offsets(base, t, reps, seed, p.block_ms))
    keyed = with_time_key_bucket(base, t, key)
    null_stats = materialize(rotation_null(keyed, [t, key], t, y, prob, score, offs,
                                           F.col("_tk")))
    bounds = with_position(base.select(t).distinct(), [], [t], time_bucket(t, 90 * DAY), "idx")
    one = base.agg(F.count_distinct(t).alias("u"), F.min(t).alias("a"), F.max(t).alias("b"))
    span = F.greatest((F.col("b") - F.col("a")) / DAY, F.lit(float(p.block_ms // DAY)))
    length = F.greatest(F.lit(1), F.ceil(F.col("u") * (p.block_ms // DAY) / span))
    draws = block_draws(one.select("u").scalar(), one.select(length).scalar(), boots, seed + 1, df.sparkSession)
    weights = draws.groupBy("rep", "idx").agg(F.count(F.lit(1)).alias("w"))
    # sizes are estimated without the replicates: the draws must not be sent to every task, the rows may
    placed = materialize(base.join(bounds, t).select("idx", y, prob, score))
    boot = materialize(weights.hint("merge").join(placed, "idx").groupBy("rep", y, prob, score).agg(F.sum("w").alias("w")))
    auc0, ic0 = rank_auc(base, y, prob), rank_ic(base, y, score)
    b_auc = materialize(rank_auc(boot, y, prob, ["rep"], "w", base))
    b_ic = materialize(rank_ic(boot, y, score, ["rep"], "w", base))
    obs = materialize(auc0.withColumn("ic", ic0.select("ic").scalar()))
    ci = {"auc": bootstrap_ci(b_auc, ["auc"]), "ic": bootstrap_ci(b_ic, ["ic"])}
    out = one.withColumnRenamed("u", "n_boundaries").drop("a", "b") \
        .withColumn("n_offsets", offs.select(F.count(F.lit(1))).scalar()) \
        .withColumn("auc", obs.select("auc").scalar()).withColumn("ic", obs.select("ic").scalar())
    for stat, null, center, effect in (("auc", null_stats, 0.5, effects[0]), ("ic", null_stats, 0.0, effects[1])):
        obs_col = null.withColumn("_obs", obs.select(stat).scalar())
        pv = two_sided_p(obs_col, stat, F.col("_obs"), center).select("p_upper").scalar()
        pw = approx_power(null, stat, center, ci[stat].select("se").scalar(), effect).select("power").scalar()
        out = out.withColumns({f"p_{stat}": pv, f"{stat}_lo": ci[stat].select("lo").scalar(),
                               f"{stat}_hi": ci[stat].select("hi").scalar(), f"power_{stat}": pw})
    return learnability_verdict(out)
