"""Guards and comparisons that return the offending rows, and the forms that raise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.functions.columns import on_grid
from pitpanel.operators.features import FEATURES
from pitpanel.plans.ordered import with_position

# Substrings that mark outcome columns.
FORBIDDEN = ["net_r", "net_pnl", "label", "target", "exit_t", "realized_pnl", "pnl",
             "info_interval", "outcome"]


class LeakError(RuntimeError):
    """A structural leak guard fired."""


def column_guard(columns: list[str]) -> list[str]:
    """Refuse outcome columns and names outside the feature dictionary."""
    bad = [c for c in columns if any(f in c.lower() for f in FORBIDDEN)]
    if bad:
        raise LeakError(f"outcome columns among features: {bad}")
    known = tuple(f.split("_", 1)[0] + "_" for f in FEATURES)
    unknown = [c for c in columns if not c.startswith(known)]
    if unknown:
        raise LeakError(f"columns outside the feature dictionary: {unknown}")
    return columns


def purge_violations(train: DataFrame, hi: str, val_start: int) -> DataFrame:
    return train.filter(F.col(hi) >= val_start)


def purge_guard(train: DataFrame, hi: str, val_start: int) -> DataFrame:
    hit = purge_violations(train, hi, val_start).take(1)
    if hit:
        raise LeakError(f"training interval reaches the validation start {val_start}: {hit[0]}")
    return train


def sealed_leaks(df: DataFrame, by: str, ts: str, q: int) -> DataFrame:
    """Entities with a readable row at or after the cutoff."""
    return (df.groupBy(by).agg(F.max(ts).alias("last_ts"), F.count_if(F.col(ts) >= q).alias("n"))
            .filter(F.col("last_ts") >= q))


def sealed_leak_check(df: DataFrame, by: str, ts: str, q: int) -> DataFrame:
    hit = sealed_leaks(df, by, ts, q).take(1)
    if hit:
        raise LeakError(f"readable rows at or after the cutoff {q}: {hit[0]}")
    return df


def split_at_cutoff(df: DataFrame, ts: str, q: int) -> DataFrame:
    """``side`` = keep before the cutoff, sealed at or after; write with ``partitionBy('side')``."""
    return df.withColumn("side", F.when(F.col(ts) < q, "keep").otherwise("sealed"))


def split_census(df: DataFrame, ts: str, q: int, unit: Column) -> DataFrame:
    return split_at_cutoff(df, ts, q).groupBy(unit.alias("unit"), "side").agg(
        F.count(F.lit(1)).alias("n_rows"))


def overlay_violations(pre: DataFrame, post: DataFrame, ts: str, step: int, q: int,
                       by: str = "entity") -> DataFrame:
    """``(reason, entity, n)`` over both sides; duplicates are found by a partial aggregate."""
    both = pre.select(by, ts, F.lit(True).alias("_pre")).unionByName(
        post.select(by, ts, F.lit(False).alias("_pre")))
    flags = F.array_compact(F.array(
        F.when(~on_grid(ts, step), "off_grid"),
        F.when(F.col("_pre") & (F.col(ts) >= q), "pre_after_cutoff"),
        F.when(~F.col("_pre") & (F.col(ts) < q), "post_before_cutoff")))
    direct = (both.select(by, F.explode(flags).alias("reason"))
              .groupBy("reason", by).agg(F.count(F.lit(1)).alias("n")))
    dup = (both.groupBy(by, ts).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
           .groupBy(by).agg(F.sum(F.col("_c") - 1).alias("n"))
           .select(F.lit("duplicate").alias("reason"), by, "n"))
    return direct.unionByName(dup)


def overlay_union(pre: DataFrame, post: DataFrame, ts: str, step: int, q: int,
                  required: list[str], by: str = "entity") -> DataFrame:
    """Union of a panel and its later part, refused on any violation."""
    for name, part in (("pre", pre), ("post", post)):
        missing = [c for c in required if c not in part.columns]
        if missing:
            raise ValueError(f"{name}: missing columns {missing}")
    hit = overlay_violations(pre, post, ts, step, q, by).take(1)
    if hit:
        raise ValueError(f"overlay refused: {hit[0]}")
    return pre.select(*required).unionByName(post.select(*required))


def entity_census(pre: DataFrame, post: DataFrame, by: str = "entity") -> DataFrame:
    a = pre.select(by).distinct().withColumn("_a", F.lit(True))
    b = post.select(by).distinct().withColumn("_b", F.lit(True))
    return a.join(b, by, "full_outer").select(by, F.when(
        F.col("_a") & F.col("_b"), "combined").when(F.col("_a"), "pre_only")
        .otherwise("overlay_only").alias("class"))


def registry_classify(df: DataFrame, name: str, registry: dict[str, dict], suffix: str) -> DataFrame:
    """First matching category in registry order (base list, else pattern) and its rule.

    ``registry`` maps a category to ``{"bases": [...], "pattern": "..."}``; it is configuration,
    so it becomes one ordered CASE rather than a join.
    """
    base = F.when(F.col(name).endswith(suffix) & (F.length(name) > len(suffix)),
                  F.expr(f"substring({name}, 1, length({name}) - {len(suffix)})")).otherwise(F.col(name))
    cat, rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for category, spec in reversed(registry.items()):
        if spec.get("pattern"):
            m = F.col("_base").rlike(spec["pattern"])
            cat = F.when(m, category).otherwise(cat)
            rule = F.when(m, "pattern:" + spec["pattern"]).otherwise(rule)
        if spec.get("bases"):
            m = F.col("_base").isin(spec["bases"])
            cat = F.when(m, category).otherwise(cat)
            rule = F.when(m, "base-list").otherwise(rule)
    return (df.withColumn("_base", base).withColumn("category", cat).withColumn("rule", rule)
            .withColumn("included", F.col("category").isNull()).drop("_base"))


def fill_identity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that are not in both multisets, with the side they are on."""
    return (a.exceptAll(b).withColumn("side", F.lit("only_a"))
            .unionByName(b.exceptAll(a).withColumn("side", F.lit("only_b"))))


def join_1to1(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    for name, part in (("left", left), ("right", right)):
        hit = part.groupBy(*on).count().filter("count > 1").take(1)
        if hit:
            raise ValueError(f"{name} keys are not unique: {hit[0]}")
    return left.join(right, on, "left")


def lookahead_check(op: Callable[[DataFrame], DataFrame], df: DataFrame, ts: str, t: int,
                    values: list[str], out_ts: str) -> DataFrame:
    """Rows before ``t`` that change when every input row at or after ``t`` is altered."""
    altered = df.withColumns({c: F.when(F.col(ts) >= t, F.col(c) * 3 + 7).otherwise(F.col(c))
                              for c in values})
    before = F.col(out_ts) < t
    return fill_identity(op(df).filter(before), op(altered).filter(before))


def partition_verify(recorded: DataFrame, computed: DataFrame, key: str) -> DataFrame:
    """``(field, recorded, computed)`` of every differing field; both sides hold one long value
    per (key, field)."""
    a = recorded.withColumnRenamed("value", "recorded")
    b = computed.withColumnRenamed("value", "computed")
    return a.join(b, [key, "field"], "full_outer").filter(
        ~F.col("recorded").eqNullSafe(F.col("computed")))


def ledger_first_divergence(a: DataFrame, b: DataFrame, order: list[str], bucket: Column,
                            structural: list[str], numeric: list[str],
                            tol: float = 1e-9) -> DataFrame:
    """First position and field at which two ordered ledgers differ; empty when identical.

    Structural fields come before numeric ones, presence counts as a difference, and a numeric
    difference is annotated with whether it is within ``tol``.
    """
    def placed(df, tag):
        seq = with_position(df, [], order, bucket)
        return seq.select("seq", F.struct(*structural, *numeric).alias(tag))
    both = placed(a, "a").join(placed(b, "b"), "seq", "full_outer")
    checks = F.array_compact(F.array(
        F.when(F.col("a").isNull() | F.col("b").isNull(), F.struct(
            F.lit("length").alias("field"), F.lit(None).cast("boolean").alias("within"))),
        *[F.when(F.col("a").isNotNull() & F.col("b").isNotNull()
                 & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")),
                 F.struct(F.lit(c).alias("field"), F.lit(None).cast("boolean").alias("within")))
          for c in structural],
        *[F.when(F.col("a").isNotNull() & F.col("b").isNotNull()
                 & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")),
                 F.struct(F.lit(c).alias("field"),
                          (F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))
                           <= F.greatest(F.lit(tol), F.lit(tol) * F.greatest(
                               F.abs(F.col(f"a.{c}")), F.abs(F.col(f"b.{c}"))))).alias("within")))
          for c in numeric]))
    hit = F.try_element_at(checks, F.lit(1))
    return (both.withColumn("_x", F.when(F.size(checks) > 0, hit)).filter("_x is not null")
            .agg(F.min_by(F.struct("seq", "_x.field", "_x.within"), "seq").alias("m"),
                 F.count(F.lit(1)).alias("n_differing"))
            .filter("m is not null")
            .select("m.seq", "m.field", "m.within", "n_differing"))


