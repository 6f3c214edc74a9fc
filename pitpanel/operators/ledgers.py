"""Labels from event ledgers, purged splits, coverage of open intervals, round completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.params import DEFAULTS, Params
from pitpanel.plans.intervals import concurrency, overlap_pairs

# Exclusion text per rejection reason; other reasons pass through.
EXCLUSIONS = {"capacity": "capacity_rejected", "min_notional": "min_notional_rejected",
              "missing_bar": "cancelled_missing_bar", "ruined": "ruined_rejected",
              "max_positions": "capacity_rejected"}


def ledger_labels(cands: DataFrame, events: DataFrame) -> DataFrame:
    """One labeled or excluded row per candidate.

    ``cands``: ``t, symbol, side, r_dist, verdict``; ``events``: ``kind, t, pos_id, symbol, qty,
    fee, pnl, paid, reason, decision_ts``. Events reduce to one row per position (or decision)
    before the joins.
    """
    kind = F.col("kind")
    opens = (events.filter(kind == "fill_open").groupBy(F.col("decision_ts").alias("t"), "symbol")
             .agg(F.max_by(F.struct("pos_id", "qty", "fee", F.col("t").alias("entry_t")), "t")
                  .alias("_open")))
    per_pos = events.filter(kind.isin("fill_close", "rate")).groupBy("pos_id").agg(
        F.sum(F.when(kind == "fill_close", F.col("qty"))).alias("_cqty"),
        F.sum(F.when(kind == "fill_close", F.col("fee"))).alias("_cfee"),
        F.sum(F.when(kind == "fill_close", F.col("pnl"))).alias("_pnl"),
        F.max(F.when(kind == "fill_close", F.col("t"))).alias("_exit"),
        F.sum(F.when(kind == "rate", F.col("paid"))).alias("_paid"))
    refusals = (events.filter(kind.isin("rejection", "entry_cancelled")
                              & F.col("decision_ts").isNotNull())
                .groupBy(F.col("decision_ts").alias("t"), "symbol")
                .agg(F.max_by(F.when(kind == "entry_cancelled", "missing_bar")
                              .otherwise(F.col("reason")), "t").alias("_why")))
    x = (cands.join(opens, ["t", "symbol"], "left").join(refusals, ["t", "symbol"], "left")
         .withColumn("_pos", F.col("_open.pos_id")))
    x = x.join(per_pos.withColumnRenamed("pos_id", "_pos"), "_pos", "left")
    zero = F.lit(0.0)
    qty, opened = F.col("_open.qty"), F.col("_open").isNotNull()
    left_over = qty - F.coalesce("_cqty", zero)
    mapped = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in EXCLUSIONS.items() for v in kv]),
                                     F.col("_why")), F.col("_why"))
    why = (F.when(F.col("verdict") == "reject", "governor_rejected")
           .when(opened & (left_over > 1e-12), "still_open").when(opened, F.lit(None))
           .when(F.col("_why").isNotNull(), mapped).otherwise("no_fill"))
    done = F.col("exclusion").isNull()
    fees = F.col("_open.fee") + F.coalesce("_cfee", zero)
    net = F.coalesce("_pnl", zero) - fees - F.coalesce("_paid", zero)
    return x.withColumn("exclusion", why).select(
        *cands.columns, done.alias("executed"), F.when(done, F.col("_pos")).alias("pos_id"),
        F.when(done, qty).alias("qty_filled"), F.when(done, F.col("_open.entry_t")).alias("entry_t"),
        F.when(done, F.col("_exit")).alias("exit_t"), F.when(done, net).alias("net_pnl"),
        F.when(done, net / (qty * F.col("r_dist"))).alias("net_r"),
        F.when(done, F.col("t")).alias("lo"), F.when(done, F.col("_exit")).alias("hi"), "exclusion")


class HorizonError(RuntimeError):
    """An information interval is longer than the outcome rules allow."""


class SealedRowError(RuntimeError):
    """A candidate lies in the sealed range."""


def purged_split(df: DataFrame, val_start: int, holdout_start: int, max_horizon: int,
                 t: str = "t", lo: str = "lo", hi: str = "hi", labeled: Column | None = None,
                 guard: bool = True) -> DataFrame:
    """Exactly one class per row: train, validation, purged_train, purged_validation, unlabeled."""
    if not val_start < holdout_start:
        raise ValueError("the validation start must precede the holdout start")
    has = labeled if labeled is not None else F.col(hi).isNotNull()
    if guard:
        hit = df.filter((F.col(t) >= holdout_start)
                        | (has & (F.col(hi) - F.col(lo) > max_horizon))).take(1)
        if hit:
            row = hit[0]
            if row[t] >= holdout_start:
                raise SealedRowError(f"row at {row[t]} lies at or after {holdout_start}")
            raise HorizonError(f"interval {row[hi] - row[lo]} exceeds {max_horizon}")
    return df.withColumn("split", (
        F.when(~has, "unlabeled")
        .when(F.col(t) < val_start, F.when(F.col(hi) < val_start, "train").otherwise("purged_train"))
        .otherwise(F.when(F.col(hi) < holdout_start, "validation").otherwise("purged_validation"))))


def interval_overlap(df: DataFrame, grid: DataFrame, lo: str, hi: str, t: str,
                     width_ms: int) -> DataFrame:
    """One row: intervals, share of overlapping pairs, mean and maximal concurrency on the grid."""
    pairs = overlap_pairs(df, lo, hi, width_ms)
    conc = concurrency(df, grid, lo, hi, t, width_ms).agg(
        F.avg("open_n").alias("m"), F.max("open_n").alias("x"))
    total = F.col("n").cast("double") * (F.col("n") - 1) / 2
    return pairs.select(
        F.col("n").alias("n_labels"), "pairs",
        F.when(F.col("n") > 1, F.col("pairs").cast("double") / total).otherwise(F.lit(0.0)).alias("pair_fraction"),
        conc.select("m").scalar().alias("mean_concurrent"),
        conc.select("x").scalar().alias("max_concurrent"))


def uncovered_boundaries(grid: DataFrame, intervals: DataFrame, decisions: DataFrame, by: str,
                         open_t: str, close_t: str, t: str, width_ms: int) -> DataFrame:
    """Grid boundaries inside some open interval ``(open, close]`` of an account without a
    decision row. Coverage is a sweep per account, never a join of intervals with boundaries;
    ``grid`` holds ``(account, t)``."""
    from pitpanel.plans.ordered import running, time_bucket
    marks = intervals.filter(F.col(close_t) > F.col(open_t)).select(by, F.explode(F.array(
        F.struct((F.col(open_t) + 1).alias("x"), F.lit(1).alias("d"), F.lit(0).alias("g")),
        F.struct((F.col(close_t) + 1).alias("x"), F.lit(-1).alias("d"), F.lit(0).alias("g"))))
        .alias("m")).select(by, "m.*")
    points = grid.select(by, F.col(t).alias("x"), F.lit(0).alias("d"), F.lit(1).alias("g"))
    per = marks.unionByName(points).groupBy(by, "x").agg(F.sum("d").alias("d"), F.max("g").alias("g"))
    swept = running(per, [by], ["x"], time_bucket("x", width_ms), {"open_n": ("sum", F.col("d"))})
    held = swept.filter("g = 1 and open_n > 0").select(by, F.col("x").alias(t))
    return held.join(decisions.select(by, t).distinct(), [by, t], "left_anti")


def unexplained_rows(cands: DataFrame, decisions: DataFrame, events: DataFrame) -> DataFrame:
    """Candidates without a decision, or submitted but neither filled nor refused."""
    key = ["t", "symbol"]
    first = decisions.groupBy(*key).agg(F.min_by(F.struct("stage", "verdict"), "seq").alias("_d"))
    outcome = (events.filter(F.col("kind").isin("fill_open", "rejection", "entry_cancelled"))
               .select(F.col("decision_ts").alias("t"), "symbol").distinct()
               .withColumn("_seen", F.lit(True)))
    x = cands.select(*key).join(first, key, "left").join(outcome, key, "left")
    why = (F.when(F.col("_d").isNull(), "no_decision")
           .when((F.col("_d.stage") == "submitted")
                 & F.coalesce(F.col("_d.verdict") != "reject", F.lit(True))
                 & F.col("_seen").isNull(), "no_outcome"))
    return x.withColumn("why", why).filter("why is not null").select(*key, "why")


def round_completeness(rounds: DataFrame, reports: DataFrame, members: list[str],
                       t: str = "t") -> DataFrame:
    """Validity per round; the member list is configuration, exploded per round.

    A missing report is a failure. ``reports``: ``(t, member, ok)``.
    """
    spine = rounds.select(t, F.explode(F.array(*[F.lit(m) for m in members])).alias("member"))
    seen = reports.groupBy(t, "member").agg(F.bool_and("ok").alias("ok"))
    x = spine.join(seen, [t, "member"], "left")
    failed = ~F.coalesce(F.col("ok"), F.lit(False))

    def names(cond):
        return F.concat_ws(",", F.array_sort(F.collect_list(F.when(cond, F.col("member")))))
    return x.groupBy(t).agg((~F.bool_or(failed)).alias("valid"), names(failed).alias("failed"),
                            names(F.col("ok").isNull()).alias("missing"))


def support_min(n: Column, p: Params = DEFAULTS) -> Column:
    return F.ceil(F.lit(p.support_num) * n / F.lit(p.support_den))
