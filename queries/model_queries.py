"""Fitted models, hooks and streams."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import functions as F

from pitpanel.functions.columns import epoch_ms
from pitpanel.operators import models
from pitpanel.operators import resampling as rs
from pitpanel.params import DAY, HOUR
from pitpanel.plans.ordered import time_bucket
from pitpanel.session import materialize, scratch_path
from pitpanel.streaming import jobs
from queries.base import CURVE, P, curve, query, r6, table
from queries.inference_queries import timed
from queries.ledger_queries import MEMBERS
from queries.source_queries import SPANS, VAL, spans

COLS = ["F02_size", "F05_lines", "F27_month", "F28_dow"]


def examples(spark, sf):
    """Orders as examples: features known at the order date, outcome from the lines."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.avg(F.col("l_discount") - F.col("l_tax")).alias("net"), F.count(F.lit(1)).cast("double").alias("F05_lines"))
    o = table(spark, sf, "orders")
    x = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(
        spans(spark, sf), F.col("o_orderkey") == F.col("symbol"))
    size = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice"))
    return x.select("symbol", "lo", "hi", "net", size.alias("F02_size"), "F05_lines",
                    F.month("o_orderdate").alias("F27_month"), F.dayofweek("o_orderdate").alias("F28_dow"))


def _fit_and_score(spark, sf, fit):
    x = materialize(examples(spark, sf))
    m = fit(x.filter((F.col("lo") < VAL) & (F.col("hi") < VAL)), COLS, "net", VAL, maxIter=5)
    return x.filter(F.col("lo") >= VAL), m


@query("fit_filter")
def _(spark, sf):
    v, m = _fit_and_score(spark, sf, models.fit_filter)
    return m.score(v).select("symbol", "score")


@query("fit_ranker")
def _(spark, sf):
    v, m = _fit_and_score(spark, sf, models.fit_ranker)
    return m.score(v).select("symbol", "score")


@query("fit_sizer")
def _(spark, sf):
    v, m = _fit_and_score(spark, sf, models.fit_sizer)
    return m.bucket(v).select("symbol", "bucket")


# a fixed linear model stands in for an external one; its result can be stated in SQL
@query("score_batch", f"""WITH {SPANS}, li AS (SELECT l_orderkey, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1)
  SELECT o_orderkey AS symbol, round(0.5 * n + 0.1 * month(o_orderdate) - 0.01 * (dayofweek(o_orderdate) + 1), 6)
  AS score FROM orders JOIN li ON l_orderkey = o_orderkey""")
def _(spark, sf):
    def predict(batches):
        for b in batches:
            yield 0.5 * b["F05_lines"] + 0.1 * b["F27_month"] - 0.01 * b["F28_dow"]
    out = models.score_external(examples(spark, sf), ["F05_lines", "F27_month", "F28_dow"], predict)
    return out.select("symbol", r6("score", "score"))


@query("feature_importance")
def _(spark, sf):
    _, m = _fit_and_score(spark, sf, models.fit_ranker)
    return spark.createDataFrame(m.importance(), "feature string, importance double")


@query("permutation_refit")
def _(spark, sf):
    x = materialize(timed(spark, sf).select("t", "doc_id", "y", F.col("score").alias("F02_size"),
                                            F.col("quality").cast("double").alias("F05_lines")))
    perm = rs.shuffle_permute(x, ["t", "doc_id"], "y", 200, 11, time_bucket("t", 60 * DAY), ["doc_id"])
    return models.permutation_refit(x, x, ["F02_size", "F05_lines"], "y", perm, ["doc_id"], settings=models.Boost(trees=10)).select(
        "rep", F.col("stat").alias("ic"))


@query("udf_surface", """SELECT l_returnflag AS grp, round(avg(l_quantity), 6) AS stat,
  count(*) FILTER (l_quantity * 2 > 50) AS n_doubled FROM lineitem GROUP BY 1""")
def _(spark, sf):
    @F.pandas_udf("double")
    def twice(x: pd.Series) -> pd.Series:
        return x * 2
    li = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", twice("l_quantity").alias("d"))
    # the custom aggregate runs per (flag, quantity) cell with its weight, so groups stay small
    cells = li.groupBy(F.col("l_returnflag").alias("grp"), "l_quantity").agg(
        F.count(F.lit(1)).cast("double").alias("w"), F.count_if(F.col("d") > 50).alias("n_doubled"))

    def mean(v: pd.Series, w: pd.Series) -> float:
        return float((v * w).sum() / w.sum())
    stat = models.statistic_per_replicate(cells, "grp", ["l_quantity", "w"], mean)
    n = cells.groupBy("grp").agg(F.sum("n_doubled").alias("n_doubled"))
    return stat.join(n, "grp").select("grp", r6("stat", "stat"), "n_doubled")


# ---------------------------------------------------------------- streams
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _rocks:
    """The state store provider is a session setting; put it back afterwards."""

    key = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark):
        self.spark = spark

    def __enter__(self):
        self.old = self.spark.conf.get(self.key)
        self.spark.conf.set(self.key, ROCKS)

    def __exit__(self, *exc):
        self.spark.conf.set(self.key, self.old)


def _source(spark, sf, name, prepared=None, closed=None):
    """Stream over a directory of Parquet files in file order; ``closed`` (time column, distance, values...) ends it."""
    if prepared is None:
        prepared = table(spark, sf, name)
    path = scratch_path(spark, "stream-in")
    prepared.write.parquet(path)
    if closed:
        jobs.closing_row(spark.read.schema(prepared.schema).parquet(path), *closed[:2], **dict(closed[2:])).write.mode("append").parquet(path)
    return spark.readStream.schema(prepared.schema).parquet(path)


def _run(spark, stream):
    out, cp = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-cp")
    jobs.run_available(stream, out, cp)
    return spark.read.schema(stream.schema).parquet(out)


def _ticks(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("entity"), F.col("ts").cast("timestamp"),
                                             "event_id", "user_id", "value")


# streams end with a closing row, so every window is compared
@query("stream_complete_bars", f"""WITH t AS (SELECT event_type AS entity, epoch_us(ts) // 1000 AS ms, ts, event_id, value
  FROM events), f AS (SELECT entity, ms - ms % {HOUR} AS slot, arg_min(value, row(ts, event_id)) AS o, max(value) AS h,
  min(value) AS l, arg_max(value, row(ts, event_id)) AS c, count(*) AS v FROM t GROUP BY 1, 2),
  g AS (SELECT entity, slot - slot % {4 * HOUR} AS open_ts, arg_min(o, slot) AS open, max(h) AS high, min(l) AS low,
  arg_max(c, slot) AS close, sum(v)::BIGINT AS volume FROM f GROUP BY 1, 2 HAVING count(*) = 4)
  SELECT entity, open_ts, open_ts + {4 * HOUR} AS boundary, open, high, low, close, volume FROM g""")
def _(spark, sf):
    src = _source(spark, sf, "events", _ticks(spark, sf), ("ts", 2 * DAY))
    fine = jobs.stream_fine_bars(src, "entity", "ts", "value", ["event_id"], HOUR, HOUR)
    return _run(spark, jobs.stream_complete_bars(fine, "entity", P))


@query("stream_dedup", f"""SELECT event_type AS entity, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % {4 * HOUR} AS slot,
  count(*) AS n FROM (SELECT DISTINCT ON (event_id) * FROM (FROM events UNION ALL FROM events)) GROUP BY 1, 2""")
def _(spark, sf):
    e = _ticks(spark, sf)
    src = _source(spark, sf, "events", e.unionByName(e).repartition(2, "entity"))
    done = _run(spark, jobs.stream_dedup(src, ["event_id"], "ts", 60 * DAY))
    ms = F.unix_millis("ts")
    return done.groupBy("entity", (ms - F.pmod(ms, F.lit(4 * HOUR))).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


# one round per conversation, a day apart
@query("stream_round_status", f"""WITH m AS (SELECT conv_id, unnest(['assistant', 'system', 'user']) AS member FROM
  (SELECT DISTINCT conv_id FROM conversations)), rp AS (SELECT conv_id, role AS member, bool_and(length(text) > 40)
  AS ok FROM conversations GROUP BY 1, 2)
  SELECT m.conv_id * {DAY} AS t, bool_and(coalesce(ok, false)) AS valid,
  coalesce(string_agg(CASE WHEN NOT coalesce(ok, false) THEN m.member END, ',' ORDER BY m.member), '') AS failed,
  coalesce(string_agg(CASE WHEN ok IS NULL THEN m.member END, ',' ORDER BY m.member), '') AS missing
  FROM m LEFT JOIN rp ON rp.conv_id = m.conv_id AND rp.member = m.member GROUP BY m.conv_id""")
def _(spark, sf):
    c = table(spark, sf, "conversations").select(
        F.timestamp_millis(F.col("conv_id") * DAY + F.col("turn")).alias("ts"), F.col("role").alias("member"),
        (F.length("text") > 40).alias("ok"))
    src = _source(spark, sf, "conversations", c, ("ts", 3 * DAY))
    return _run(spark, jobs.stream_round_status(src, MEMBERS, "ts", DAY, HOUR))


PAUSE = replace(P, daily_loss=0.003, drawdown_limit=0.01)


@query("stream_pause_monitor", f"""WITH {CURVE}, d AS (SELECT *, t // {7 * DAY} AS day FROM curve),
  x AS (SELECT arm, t, equity, first_value(equity) OVER (PARTITION BY arm, day ORDER BY t) AS start_equity,
  max(equity) OVER (PARTITION BY arm, day ORDER BY t) AS peak_today,
  (SELECT max(e.equity) FROM d e WHERE e.arm = d.arm AND e.day BETWEEN d.day - 90 AND d.day - 1)
  AS peak_before FROM d)
  SELECT arm, t, coalesce(start_equity > 0 AND (start_equity - equity) / start_equity >= 0.003, false)
  AS daily_loss, (greatest(peak_today, peak_before) - equity) / greatest(peak_today, peak_before)
  >= 0.01 AS drawdown FROM x""")
def _(spark, sf):
    with _rocks(spark):
        src = _source(spark, sf, "orders", curve(spark, sf).select("arm", "t", "equity"))
        return _run(spark, jobs.stream_pause_monitor(src, PAUSE, 7 * DAY)).select("arm", "t", "daily_loss", "drawdown")


@query("stream_rate_enrich", f"""WITH p AS (SELECT event_id, event_type AS entity, (epoch_us(ts) // 1000) -
  (epoch_us(ts) // 1000) % {HOUR} AS slot FROM events WHERE event_type <> 'error'),
  r AS (SELECT user_id, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % {HOUR} AS slot, max(value) AS rate FROM events
  WHERE event_type = 'error' GROUP BY 1, 2)
  SELECT e.event_id, r.rate FROM events e LEFT JOIN r ON r.user_id = e.user_id
  AND r.slot = (epoch_us(e.ts) // 1000) - (epoch_us(e.ts) // 1000) % {HOUR}
  WHERE event_type <> 'error'""")
def _(spark, sf):
    e = table(spark, sf, "events").withColumn("ms", epoch_ms("ts"))
    slot = F.timestamp_millis(F.col("ms") - F.pmod(F.col("ms"), F.lit(HOUR)))
    pos = e.filter("event_type <> 'error'").select("event_id", F.col("user_id").alias("entity"), slot.alias("slot"))
    rate = e.filter("event_type = 'error'").groupBy(F.col("user_id").alias("entity"), slot.alias("slot")).agg(
        F.max("value").alias("rate"))
    both = [_source(spark, sf, "events", x, ("slot", 9 * DAY, ("entity", none))) for x, none in ((pos, -1), (rate, -2))]
    return _run(spark, jobs.stream_rate_enrich(*both, "slot", DAY)).select("event_id", "rate")
