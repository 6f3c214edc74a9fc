"""Month-level coverage of a panel and its verdict against an availability table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitpanel.functions.columns import month_of


def month_extent(df: DataFrame, by: str = "entity", ts: str = "ts",
                 distinct: bool = False) -> DataFrame:
    """Rows (or, with ``distinct``, different times) and time extent per entity and month; reads
    only the key and time columns."""
    rows = df.select(by, ts).distinct() if distinct else df
    return (rows.groupBy(by, month_of(ts).alias("month"))
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"),
                 F.max(ts).alias("last_ts")))


def month_start_ms(month: Column) -> Column:
    return F.unix_millis(F.to_timestamp(F.concat(month, F.lit("-01")), "yyyy-MM-dd"))


def shift_month(month: Column, k: int) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), k), "yyyy-MM")


def months_apart(a: Column, b: Column) -> Column:
    first = [F.to_date(F.concat(x, F.lit("-01"))) for x in (a, b)]
    return ((F.year(first[1]) - F.year(first[0])) * 12
            + F.month(first[1]) - F.month(first[0])).cast("bigint")


def slots_between(lo: Column, hi: Column, step: int) -> Column:
    """Grid points ``lo <= t < hi``."""
    first = lo + F.pmod(-lo, F.lit(step))
    n = F.call_function("div", hi - 1 - first, F.lit(step).cast("bigint")) + 1
    return F.when((hi <= lo) | (first >= hi), F.lit(0).cast("bigint")).otherwise(n)


def coverage_months(extent: DataFrame, step: int, sealed_from: int, freeze: int,
                    recent_months: int, by: str = "entity") -> DataFrame:
    """Month spine per entity with expected slots, completeness and a status."""
    span = extent.groupBy(by).agg(F.min("first_ts").alias("first_bar"),
                                  F.max("last_ts").alias("last_bar"))
    months = F.sequence(F.trunc(F.timestamp_millis("first_bar").cast("date"), "month"),
                        F.trunc(F.timestamp_millis("last_bar").cast("date"), "month"),
                        F.expr("interval 1 month"))
    spine = span.withColumn("_m", F.explode(months)).withColumn(
        "month", F.date_format("_m", "yyyy-MM")).drop("_m")
    joined = spine.join(extent.select(by, "month", "n_rows"), [by, "month"], "left")
    lo = F.greatest(month_start_ms(F.col("month")), F.col("first_bar"))
    hi = F.least(month_start_ms(shift_month(F.col("month"), 1)), F.col("last_bar") + step,
                 F.lit(sealed_from), F.lit(freeze))
    expected = slots_between(lo, hi, step)
    sealed_month = month_of(F.lit(sealed_from))
    recent = months_apart(F.col("month"), month_of(F.lit(freeze))) < recent_months
    status = (F.when(F.col("n_rows").isNotNull(), "present")
              .when(F.col("month") >= sealed_month, "sealed")
              .when(recent, "recent").otherwise("missing"))
    return joined.select(by, "month", "first_bar", "last_bar", "n_rows",
                         expected.alias("expected"),
                         F.when(F.col("n_rows").isNotNull() & (expected > 0),
                                F.round(F.col("n_rows") / expected, 6)).alias("completeness"),
                         status.alias("status"))


def coverage_verdict(months: DataFrame, archive: DataFrame | None, sealed_from: int, freeze: int,
                     recent_months: int, start_month: str, by: str = "entity") -> DataFrame:
    """Losses by kind per entity and the overall verdict.

    ``archive`` has ``(by, month, kind)``; an absent row means the archive has no data. Without
    an archive nothing is verified. A month is requested when it is missing inside an entity's
    span, directly before its first month, or directly after its last one.
    """
    spans = months.groupBy(by).agg(F.min("month").alias("m0"), F.max("month").alias("m1"))
    sealed_month, freeze_month = month_of(F.lit(sealed_from)), month_of(F.lit(freeze))
    inner = months.filter("status = 'missing'").select(by, "month", F.lit("internal").alias("loss"))
    head = spans.select(by, shift_month(F.col("m0"), -1).alias("month"),
                        F.lit("head_truncated").alias("loss")).filter(F.col("month") >= start_month)
    tail = (spans.select(by, shift_month(F.col("m1"), 1).alias("month"),
                         F.lit("tail_truncated").alias("loss"))
            .filter((F.col("month") < sealed_month)
                    & (months_apart(F.col("month"), freeze_month) >= recent_months)))
    probes = inner.unionByName(head).unionByName(tail)
    if archive is None:
        lost = probes.filter(F.lit(False)).withColumn("kind", F.lit(None).cast("string"))
        ok = F.lit("UNVERIFIED")
    else:
        lost = probes.join(archive.select(by, "month", "kind"), [by, "month"])
        ok = F.lit("PASS")
    per = lost.groupBy(by).agg(
        *[F.count_if(F.col("loss") == k).alias(f"n_{k}")
          for k in ("internal", "head_truncated", "tail_truncated")])
    zero = F.lit(0).cast("bigint")
    counts = {c: F.coalesce(F.col(c), zero)
              for c in ("n_internal", "n_head_truncated", "n_tail_truncated")}
    total = counts["n_internal"] + counts["n_head_truncated"] + counts["n_tail_truncated"]
    return (spans.join(per, by, "left").withColumns(counts)
            .select(by, *counts, F.when(total > 0, "FAIL").otherwise(ok).alias("verdict")))
