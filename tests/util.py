"""Small frames for hand-computed cases."""

from __future__ import annotations

H4 = 4 * 3_600_000
M15 = 15 * 60_000


def bars_df(spark, rows, entity="A", start=0, step=H4):
    """Coarse bars from (high, low, close) rows; open equals close."""
    data = [(entity, start + i * step, start + (i + 1) * step, float(c), float(h), float(low), float(c))
            for i, (h, low, c) in enumerate(rows)]
    return spark.createDataFrame(
        data, "entity string, open_ts bigint, boundary bigint, open double, high double, low double, close double")


def column(df, name, order="boundary"):
    return [r[name] for r in df.orderBy(order).select(order, name).collect()]


def fine_df(spark, rows, entity="A"):
    """(ts, open, high, low, close) rows."""
    return spark.createDataFrame(
        [(entity, int(t), float(o), float(h), float(low), float(c)) for t, o, h, low, c in rows],
        "entity string, ts bigint, open double, high double, low double, close double")
