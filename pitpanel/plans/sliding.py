"""Exact quantiles of trailing frames at a cost per row that doesn't grow with the frame."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def trailing_quantile(df: DataFrame, value: str, n: int, q: float, least: int, out: str, by, ts: str) -> DataFrame:
    """``out``: exact ``q`` quantile of ``value`` over a row and the ``n - 1`` before it; NULL below ``least`` values.

    Equal to ``percentile`` over that frame, which sorts every frame anew. Rows are packed by ``n`` in the
    order of ``ts``; a pack and the one before it hold all its frames. The k-th smallest of every frame is
    found in bit planes of the ranks, one step per bit for all frames at once. Packs stay in the
    partitions of ``by``, so there is one shuffle, and a task holds two packs of an entity at a time.
    Nulls are skipped; columns must be orderable types.
    """
    by = [by] if isinstance(by, str) else list(by)

    @F.pandas_udf("array<double>")
    def quantiles(before: pd.Series, here: pd.Series) -> pd.Series:
        import numpy as np

        def smallest(rank, start, stop, k):
            found = np.zeros(len(k), np.int64)
            for bit in reversed(range(len(rank).bit_length())):
                zero = (rank >> bit) & 1 == 0
                zeros = np.r_[0, np.cumsum(zero)]
                a, b = zeros[start], zeros[stop]
                up = k >= b - a
                found |= up.astype(np.int64) << bit
                start, stop = np.where(up, zeros[-1] + start - a, a), np.where(up, zeros[-1] + stop - b, b)
                k = np.where(up, k - (b - a), k)
                rank = np.r_[rank[zero], rank[~zero]]
            return found

        def frames(old, new):
            old = np.empty(0) if old is None else np.asarray(old, dtype=float)
            x = np.r_[old, np.asarray(new, dtype=float)]
            known = ~np.isnan(x)
            upto = np.r_[0, np.cumsum(known)]
            last = np.arange(len(old), len(x))
            start, stop = upto[np.maximum(0, last - n + 1)], upto[last + 1]
            enough = stop - start >= max(least, 1)
            result = [None] * len(last)
            if not enough.any():
                return result
            start, stop, values = start[enough], stop[enough], np.sort(x[known])
            rank = np.empty(len(values), np.int64)
            rank[np.argsort(x[known], kind="stable")] = np.arange(len(values))
            at = (stop - start - 1) * q
            low, high = np.floor(at), np.ceil(at)
            v, u = (values[smallest(rank, start, stop, e.astype(np.int64))] for e in (low, high))
            mixed = np.where((low == high) | (v == u), v, (high - at) * v + (at - low) * u)
            for i, m in zip(np.flatnonzero(enough), mixed.tolist(), strict=True):
                result[i] = m
            return result

        return pd.Series([frames(a, b) for a, b in zip(before, here, strict=True)])

    place = F.row_number().over(W.partitionBy(*by).orderBy(ts)) - 1
    packs = (df.withColumn("_place", place).withColumn("_pack", F.floor(F.col("_place") / n))
             .groupBy(*by, "_pack").agg(F.sort_array(F.collect_list(F.struct("_place", *df.columns))).alias("_rows"))
             .withColumn("_values", F.transform("_rows", lambda r: r[value].cast("double"))))
    before = F.lag("_values").over(W.partitionBy(*by).orderBy("_pack"))
    rows = packs.withColumn("_before", before).select(
        F.explode(F.arrays_zip("_rows", quantiles("_before", "_values").alias("_q"))).alias("_e"))
    return rows.select(*[F.col(f"_e._rows.`{c}`").alias(c) for c in df.columns], F.col("_e._q").alias(out))
