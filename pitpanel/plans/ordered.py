"""Ordered computations over groups of any size.

A window that partitions by an entity alone puts the whole entity into one task. Where a
group has no size bound, the helpers here cut it into ordered buckets (a time bucket, or a
value bucket from approximate quantiles), reduce each bucket with a partial aggregate, carry
the reductions forward over the small bucket table, and finish inside ``(group, bucket)``
windows. A hot group is thereby spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from pitpanel.functions.columns import col, div

_BUCKET = "_bucket"

_REDUCE = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def _reduce(kind: str, value: Column, order: Column) -> Column:
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), order))
    if kind == "first":
        return F.min_by(value, F.when(value.isNotNull(), order))
    return _REDUCE[kind](value)


def _over(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    if kind == "first":
        return F.first(value, ignorenulls=True).over(window)
    return _REDUCE[kind](value).over(window)


def _carry_over(kind: str, value: Column, window) -> Column:
    return _over("sum" if kind == "count" else kind, value, window)


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(carried + local, local, carried)
    if kind == "max":
        return F.greatest(carried, local)
    if kind == "min":
        return F.least(carried, local)
    if kind == "last":
        return F.coalesce(local, carried)
    return F.coalesce(carried, local)


def running(df: DataFrame, by: list[str], order: list[str], bucket: Column,
            specs: dict[str, tuple[str, Column]], exclusive: bool = False) -> DataFrame:
    """Running aggregates up to (or, with ``exclusive``, strictly before) each row.

    ``specs`` maps an output column to ``(kind, value)`` with kind in sum, count, max, min,
    last, first. ``order`` must be a total order within the group, and ``bucket`` must not
    decrease along it; a struct without ``by`` is carried field by field. Group keys and buckets are expected to be defined; a row without one is
    kept but receives nothing from other buckets.
    """
    keyed = df.withColumn(_BUCKET, bucket)
    key = F.struct(*order)
    parts = keyed.groupBy(*by, _BUCKET).agg(
        *[_reduce(k, v, key).alias(f"_part_{out}") for out, (k, v) in specs.items()])
    kind_of = keyed.schema[_BUCKET].dataType
    if not by and isinstance(kind_of, StructType):
        # buckets of buckets: one carry per leading field, so no task gets the whole bucket table
        above = {f"_carry_{out}": ("sum" if k == "count" else k, F.col(f"_part_{out}")) for out, (k, _) in specs.items()}
        carry = running(parts.withColumnRenamed(_BUCKET, "_lower"), [], ["_lower"], F.col("_lower")[kind_of.names[0]], above,
                        exclusive=True).withColumnRenamed("_lower", _BUCKET).select(_BUCKET, *above)
    else:
        across = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy(_BUCKET)
        earlier = across.rowsBetween(W.unboundedPreceding, -1)
        carry = parts.select(*by, _BUCKET, *[
            _carry_over(k, F.col(f"_part_{out}"), earlier).alias(f"_carry_{out}")
            for out, (k, _) in specs.items()])
    joined = keyed.join(carry, by + [_BUCKET], "left")
    within = W.partitionBy(*by, _BUCKET).orderBy(*order).rowsBetween(
        W.unboundedPreceding, -1 if exclusive else 0)
    done = joined.select("*", *[
        _combine(k, F.col(f"_carry_{out}"), _over(k, v, within)).alias(out)
        for out, (k, v) in specs.items()])
    out = done.drop(_BUCKET, *[f"_carry_{o}" for o in specs])
    counts = [o for o, (k, _) in specs.items() if k == "count"]
    return out.withColumns({o: F.coalesce(F.col(o), F.lit(0)).cast("bigint") for o in counts}) \
        if counts else out


def with_position(df: DataFrame, by: list[str], order: list[str], bucket: Column,
                  out: str = "seq", start: int = 0) -> DataFrame:
    """``row_number`` over a total order without a single-task sort."""
    done = running(df, by, order, bucket, {out: ("count", F.lit(1))})
    return done.withColumn(out, F.col(out) + F.lit(start - 1))


def previous(df: DataFrame, by: list[str], order: list[str], bucket: Column,
             outs: dict[str, Column]) -> DataFrame:
    """Last non-NULL value strictly before each row, for several columns at once."""
    return running(df, by, order, bucket, {o: ("last", c) for o, c in outs.items()},
                   exclusive=True)


def with_value_bucket(df: DataFrame, value: str, n: int = 256,
                      cuts_from: DataFrame | None = None) -> DataFrame:
    """Add ``_vb``, a bucket number that never decreases with ``value``.

    The cut points are approximate quantiles (one partial aggregate, an uncorrelated scalar
    subquery of at most ``n`` numbers); their quality affects balance, never results. A row is
    placed in two steps of about ``sqrt(n)`` comparisons. ``cuts_from`` may name a cheaper table
    with the same value distribution (the rows before they were replicated, say).
    """
    step = int(n ** 0.5)
    marks = [i / n for i in range(1, n)]
    source = df if cuts_from is None else cuts_from
    every = source.select(F.coalesce(
        F.percentile_approx(F.col(value).cast("double"), marks, 10_000),
        F.array().cast("array<double>")).alias("every"))
    tops = F.filter("every", lambda c, i: F.pmod(i + 1, F.lit(step)) == 0)
    cuts = every.select(F.struct("every", tops.alias("tops"))).scalar()

    def below(cuts_column):
        return F.size(F.filter(cuts_column, lambda c: c < F.col(value)))
    return (df.withColumn("_cuts", cuts).withColumn("_top", below(F.col("_cuts.tops")) * step)
            .withColumn("_vb", F.col("_top") + below(F.slice("_cuts.every", F.col("_top") + 1, step)))
            .drop("_cuts", "_top"))


def with_time_key_bucket(df: DataFrame, t: str, key: str, n: int = 256) -> DataFrame:
    """Add ``_tk``, a bucket that follows the order ``(t, key)`` for a numeric ``key``.

    A time bucket alone leaves all rows of one busy time step in one task; here every step is
    cut further by quantiles of the key.
    """
    return with_value_bucket(df, key, n).withColumn("_tk", F.struct(t, "_vb")).drop("_vb")


def exact_quantiles(df: DataFrame, value: str, probs: list[float],
                    by: list[str] | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles of groups of any size: ``(by, prob, quantile)``.

    Spark's own exact percentile merges a whole group in one task; here duplicates collapse
    first, ranks come from bucketed running counts, and only the rows that hold the wanted
    ranks survive.
    """
    by = by or []
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*by, value)
              .agg(F.count(F.lit(1)).alias("_n")))
    cum = running(with_value_bucket(counts, value), by, [value], F.col("_vb"),
                  {"_cum": ("sum", F.col("_n"))})
    prob = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    if by:
        totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
        cum = cum.join(totals, by)
    else:
        cum = cum.withColumn("_total", counts.select(F.sum("_n")).scalar())
    wanted = cum.select("*", prob).withColumn("_pos", F.col("prob") * (F.col("_total") - 1))
    lo, hi = F.floor("_pos"), F.ceil("_pos")
    first, last = F.col("_cum") - F.col("_n"), F.col("_cum")
    has_lo, has_hi = (lo >= first) & (lo < last), (hi >= first) & (hi < last)
    return (wanted.filter(has_lo | has_hi).groupBy(*by, "prob")
            .agg(F.max(F.when(has_lo, F.col(value))).alias("_vlo"),
                 F.max(F.when(has_hi, F.col(value))).alias("_vhi"),
                 F.max(F.col("_pos") - lo).alias("_frac"))
            .select(*by, "prob",
                    (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac"))
                    .alias("quantile")))


def mid_ranks(df: DataFrame, value: str, by: list[str] | None = None,
              weight: str | None = None, cuts_from: DataFrame | None = None) -> DataFrame:
    """Distinct values with multiplicity and average rank: ``(by, value, n, rank)``."""
    by = by or []
    w = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(*by, value).agg(w.alias("n"))
    cum = running(with_value_bucket(counts, value, cuts_from=cuts_from), by, [value],
                  F.col("_vb"), {"_cum": ("sum", F.col("n"))})
    return cum.select(*by, value, "n",
                      (F.col("_cum") - F.col("n") + (F.col("n") + 1) / 2.0).alias("rank"))


def time_bucket(ts: str, width_ms: int) -> Column:
    return div(col(ts), width_ms)
