"""Bars, calendars, gaps and window indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.operators import bars
from pitpanel.params import DAY, HOUR
from queries.base import COARSE, CONTEXT, FINE, NATION_LINES, P, U, coarse, fine, nation_lines, query, r6, ticks

BAR_COLS = ["entity", "open_ts", "boundary", "open", "high", "low", "close", "volume"]


@query("complete_bars", f"""WITH {COARSE} SELECT entity, open_ts, boundary, open, high, low, close,
  volume, round(quote_volume, 6) AS quote_volume FROM coarse""")
def _(spark, sf):
    return coarse(spark, sf).select(*BAR_COLS, r6("quote_volume", "quote_volume"))


@query("daily_calendar", f"""WITH {NATION_LINES} SELECT entity, ts // {DAY} AS day,
  count(quote_volume) AS bars_present,
  CASE WHEN count(quote_volume) >= 3 THEN round(sum(quote_volume), 2) END AS qvol
  FROM nlines GROUP BY ALL""")
def _(spark, sf):
    from dataclasses import replace
    cal = bars.daily_calendar(nation_lines(spark, sf), p=replace(U, daily_min_bars=3))
    return cal.select("entity", "day", "bars_present", r6("qvol", "qvol", 2))


@query("slot_counts", f"""WITH {FINE} SELECT entity, ts - ts % {4 * HOUR} AS open_ts,
  count(*) AS slots, count(*) = 4 AS complete FROM fine WHERE entity = '{CONTEXT}' GROUP BY 1, 2""")
def _(spark, sf):
    return bars.slot_counts(fine(spark, sf).filter(F.col("entity") == CONTEXT), p=P)


@query("entity_extent", """SELECT event_type AS entity, strftime(ts, '%Y-%m') AS month,
  count(*) AS n_rows, epoch_us(min(ts)) // 1000 AS first_ts, epoch_us(max(ts)) // 1000 AS last_ts
  FROM events GROUP BY 1, 2""")
def _(spark, sf):
    from pitpanel.operators import coverage
    return coverage.month_extent(ticks(spark, sf))


@query("missing_slots", f"""WITH {FINE}, g AS (SELECT entity, ts,
  lag(ts) OVER (PARTITION BY entity ORDER BY ts) AS p FROM fine)
  SELECT entity, p + {HOUR} AS gap_start, ts - {HOUR} AS gap_end, (ts - p) // {HOUR} - 1
  AS slots_missing FROM g WHERE ts - p > {HOUR}""")
def _(spark, sf):
    return bars.missing_slots(fine(spark, sf), step=P.fine_ms, bucket_ms=5 * DAY)


@query("grid_violations", f"""SELECT event_id, epoch_us(ts) // 1000 AS ts FROM events
  WHERE (epoch_us(ts) // 1000) % {60000} <> 0""")
def _(spark, sf):
    return bars.grid_violations(ticks(spark, sf).select("event_id", "ts"), "ts", 60_000)
