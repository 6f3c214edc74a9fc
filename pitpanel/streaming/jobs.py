"""Incremental forms of batch operators.

Rows behind the watermark are dropped and counted (``late_rows``): nothing that was finished is
reopened or backfilled. A stream that ends is closed by one row of the future (``closing_row``), so that
its last windows are not left waiting.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitpanel.params import DAY, DEFAULTS, Params

_MS = "milliseconds"


def stream_fine_bars(ticks: DataFrame, by: str, ts: str, value: str, tie: list[str], step: int,
                     delay_ms: int) -> DataFrame:
    """Fine bars in append mode; ``ts`` is a timestamp column."""
    order = F.struct(ts, *tie)
    w = F.window(ts, f"{step} {_MS}")
    return (ticks.withWatermark(ts, f"{delay_ms} {_MS}").groupBy(by, w.alias("w"))
            .agg(F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"),
                 F.max_by(value, order).alias("close"), F.count(F.lit(1)).alias("volume"),
                 F.sum(value).alias("quote_volume"))
            .withColumn("bar_time", F.window_time("w")).drop("w"))


def stream_complete_bars(fine: DataFrame, by: str, p: Params = DEFAULTS, ts: str = "bar_time") -> DataFrame:
    """Coarse bars once the watermark passes their end, kept only when every fine bar came.

    ``fine`` is a stream of fine bars (chained after ``stream_fine_bars`` or read from a table).
    """
    w = F.window(ts, f"{p.coarse_ms} {_MS}")
    return (fine.groupBy(by, w.alias("w"))
            .agg(F.min_by("open", ts).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                 F.max_by("close", ts).alias("close"), F.sum("volume").alias("volume"),
                 F.count(F.lit(1)).alias("_n"))
            .filter(F.col("_n") == p.bars_per_coarse)
            .select(by, F.unix_millis("w.start").alias("open_ts"), F.unix_millis("w.end").alias("boundary"),
                    "open", "high", "low", "close", "volume"))


def stream_dedup(rows: DataFrame, keys: list[str], ts: str, delay_ms: int) -> DataFrame:
    return rows.withWatermark(ts, f"{delay_ms} {_MS}").dropDuplicatesWithinWatermark(keys)


def stream_round_status(reports: DataFrame, members: list[str], ts: str, step: int,
                        delay_ms: int) -> DataFrame:
    """Round validity when a round closes: a member without an ok report fails the round."""
    ok = F.bool_and("ok")
    w = F.window(ts, f"{step} {_MS}")
    cols = []
    for m in members:
        cols.append(F.max(F.when(F.col("member") == m, 1)).alias(f"_s_{m}"))
        cols.append(F.min(F.when(F.col("member") == m, F.col("ok").cast("int"))).alias(f"_o_{m}"))
    agg = reports.withWatermark(ts, f"{delay_ms} {_MS}").groupBy(w.alias("w")).agg(ok.alias("_all"), *cols)
    failed = F.concat_ws(",", *[F.when(F.coalesce(F.col(f"_o_{m}"), F.lit(0)) == 0, m) for m in sorted(members)])
    missing = F.concat_ws(",", *[F.when(F.col(f"_s_{m}").isNull(), m) for m in sorted(members)])
    return agg.select(F.unix_millis("w.start").alias("t"), (failed == "").alias("valid"),
                      failed.alias("failed"), missing.alias("missing"))


def stream_rate_enrich(positions: DataFrame, rates: DataFrame, ts: str, delay_ms: int) -> DataFrame:
    """Rate at exactly the position's grid time; an absent rate stays NULL."""
    d = f"{delay_ms} {_MS}"
    left = positions.withWatermark(ts, d)
    right = rates.select(F.col("entity").alias("_re"), F.col(ts).alias("_rt"), "rate").withWatermark("_rt", d)
    return left.join(right, (F.col("entity") == F.col("_re")) & (F.col(ts) == F.col("_rt")), "left_outer") \
        .drop("_re", "_rt")


PAUSE_SCHEMA = T.StructType([
    T.StructField("arm", T.StringType()), T.StructField("t", T.LongType()),
    T.StructField("equity", T.DoubleType()), T.StructField("daily_loss", T.BooleanType()),
    T.StructField("drawdown", T.BooleanType())])


def _pause_processor(p: Params, day_ms: int):
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class PauseMonitor(StatefulProcessor):
        """Day start and trailing daily peaks of one account; older days are evicted."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.peaks = handle.getMapState("peaks", "day long", "peak double")
            self.start = handle.getValueState("start", "day long, equity double")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            frame = pd.concat(list(rows)).sort_values("t", kind="stable")
            peaks = {k[0]: v[0] for k, v in self.peaks.iterator()}
            day, start = self.start.get() if self.start.exists() else (None, None)
            out = []
            for t, equity in zip(frame["t"], frame["equity"], strict=True):
                d = int(t) // day_ms
                if d != day:
                    day, start = d, float(equity)
                peaks[d] = max(peaks.get(d, float(equity)), float(equity))
                peak = max(v for k, v in peaks.items() if k >= d - p.drawdown_days)
                out.append((key[0], int(t), float(equity),
                            bool(start > 0 and (start - equity) / start >= p.daily_loss),
                            bool(peak > 0 and (peak - equity) / peak >= p.drawdown_limit)))
            for old in [k for k in peaks if k < day - p.drawdown_days]:
                del peaks[old]
                if self.peaks.containsKey((old,)):
                    self.peaks.removeKey((old,))
            for k, v in peaks.items():
                self.peaks.updateValue((k,), (v,))
            self.start.update((day, start))
            yield pd.DataFrame(out, columns=[f.name for f in PAUSE_SCHEMA])

        def close(self) -> None:
            pass

    return PauseMonitor()


def stream_pause_monitor(curve: DataFrame, p: Params = DEFAULTS, day_ms: int = DAY) -> DataFrame:
    """Loss and drawdown pauses per account as snapshots arrive in time order.

    ``curve``: ``arm, t, equity``. State per account is one number per day of the window. Needs
    the RocksDB state store provider.
    """
    return curve.groupBy("arm").transformWithStateInPandas(
        statefulProcessor=_pause_processor(p, day_ms), outputStructType=PAUSE_SCHEMA,
        outputMode="Append", timeMode="None")


def closing_row(rows: DataFrame, ts: str, beyond_ms: int, **values) -> DataFrame:
    """One row ``beyond_ms`` after the last time of ``rows``, null but for ``values``; none if no row has a time.

    To be appended as the last of a stream: it moves the watermark past everything before it, and stays
    in the state itself if ``beyond_ms`` is more than the delay and the longest window. A column that the
    stream is joined by needs a value that no row has, as rows without one never reach the watermark.
    """
    last = F.expr(f"max({ts}) + make_dt_interval(0, 0, 0, {beyond_ms} / 1000.0)").alias(ts)
    kinds = {f.name: f.dataType for f in rows.schema}
    return rows.agg(last).filter(F.col(ts).isNotNull()).select(
        *[F.col(c) if c == ts else F.lit(values.get(c)).cast(kinds[c]).alias(c) for c in rows.columns])


def run_available(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Process what is there and stop, into a Parquet table; the number of ``late_rows``."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return late_rows(query)


def late_rows(query) -> int:
    """Rows that came behind the watermark, over the batches Spark remembers of this run.

    An aggregation counts them as they reach its state: those of one group and task in a batch as one.
    """
    return sum(op["numRowsDroppedByWatermark"] for batch in query.recentProgress for op in batch["stateOperators"])
