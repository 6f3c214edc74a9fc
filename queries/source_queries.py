"""Scans, files, manifests, overlays, coverage, guards and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitpanel.functions.columns import (bucket_of, by_tier, clip_finite, entry_fill, epoch_ms, erf,
                                        exit_fill, floor_to, nan_to_null, normalize_epoch, on_grid, tier)
from pitpanel.operators import bars, checks, coverage, recompute, risk, universe, windows
from pitpanel.params import DAY, HOUR
from pitpanel.plans.ordered import exact_quantiles, time_bucket, with_value_bucket
from pitpanel.session import materialize, scratch_path
from pitpanel.sources import manifests, panel
from queries.base import (COARSE, CURVE, EU, FEB, FINE, JAN, TICKS, Panel, curve, fine, nation_lines,
                          query, r6, rates, table, ticks)
from queries.outcomes import (FEATURE_CTE, FREEZE, NATION_CTX, NATION_ROUNDS, RATES, SPAN, Y01, Y95,
                              feature_rows, nation_rounds)

A, B = JAN + 5 * DAY, JAN + 12 * DAY


def _written(spark, sf):
    path = scratch_path(spark, "panel")
    panel.write_panel(fine(spark, sf), path, partitions=4)
    return path


@query("scan_panel", f"""WITH {FINE} SELECT entity, ts, open, close FROM fine
  WHERE ts BETWEEN {A} AND {B} AND entity IN ('click', 'view')""")
def _(spark, sf):
    return panel.scan_panel(spark, _written(spark, sf), A, B, ["click", "view"]).select(
        "entity", "ts", "open", "close")


@query("write_panel", f"""WITH {FINE} SELECT entity, strftime(make_timestamp(ts * 1000), '%Y-%m') AS month,
  count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM fine GROUP BY 1, 2""")
def _(spark, sf):
    df = spark.read.parquet(_written(spark, sf)).withColumn("month", F.col("month").cast("string"))
    return df.groupBy("entity", "month").agg(F.count(F.lit(1)).alias("n_rows"),
                                             F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("scan_rates", f"""WITH {FINE}, {RATES} SELECT entity, ts, rate FROM rates
  WHERE ts BETWEEN {A} AND {B}""")
def _(spark, sf):
    path = scratch_path(spark, "rates")
    r = rates(Panel(spark, sf))
    r.filter("entity < 'p'").write.partitionBy("entity").parquet(path)
    # two entities in the other nesting: a plain directory per entity
    for name in ("purchase", "signup", "view"):
        r.filter(F.col("entity") == name).drop("entity").write.parquet(f"{path}/{name}")
    return panel.scan_rates(spark, path, A, B).select("entity", "ts", "rate")


@query("read_bar_csv", f"""WITH {FINE} SELECT ts, open, high, low, close, CAST(volume AS DOUBLE) AS volume FROM fine""")
def _(spark, sf):
    """All entities: every third day with a header line, every other day in microseconds."""
    path = scratch_path(spark, "bars-csv")
    b = materialize(fine(spark, sf))
    day = F.floor(F.col("ts") / DAY)
    raw = b.select(
        day.alias("day"), F.when(F.pmod(day, F.lit(2)) == 0, F.col("ts") * 1000).otherwise(F.col("ts")).alias("open_time"),
        "open", "high", "low", "close", "volume",
        F.lit(0).alias("close_time"), "quote_volume", F.lit(0).alias("count"), F.lit(0).alias("tb"),
        F.lit(0).alias("tq"), F.lit(0).alias("ignore"))
    raw.filter("day % 3 > 0").drop("day").write.csv(f"{path}/plain")
    raw.filter("day % 3 = 0").drop("day").write.option("header", "true").csv(f"{path}/headed")
    out = panel.read_bar_csv(spark, [f"{path}/plain", f"{path}/headed"], HOUR)
    return out.select("ts", "open", "high", "low", "close", "volume")


@query("read_rate_csv", f"""WITH {FINE}, {RATES} SELECT ts, rate FROM rates""")
def _(spark, sf):
    """All entities, whose files name and order their columns in three ways."""
    path = scratch_path(spark, "rates-csv")
    r = materialize(rates(Panel(spark, sf)))
    first = F.ascii("entity") % 3
    for k, (t, v) in enumerate((("calc_time", "last_funding_rate"), ("fundingTime", "fundingRate"), ("funding_time", "funding_rate"))):
        named = [F.col("ts").alias(t), F.lit(8).alias("interval_hours"), F.col("rate").alias(v)]
        r.filter(first == k).select(*(named if k < 2 else named[::-1])).write.option("header", "true").csv(f"{path}/{k}")
    return panel.read_rate_csv(spark, [f"{path}/{k}" for k in range(3)])


@query("normalize_epoch", """WITH x AS (SELECT event_id, CASE WHEN event_type = 'view' THEN epoch_us(ts)
  ELSE epoch_us(ts) // 1000 END AS raw FROM events) SELECT event_id,
  CASE WHEN raw > 100000000000000 THEN raw // 1000 ELSE raw END AS ts FROM x""")
def _(spark, sf):
    e = table(spark, sf, "events")
    raw = F.when(F.col("event_type") == "view", F.unix_micros(F.col("ts").cast("timestamp"))).otherwise(
        epoch_ms("ts"))
    return e.select("event_id", normalize_epoch(raw).alias("ts"))


@query("merge_dedup", f"""WITH {TICKS}, m AS (SELECT entity, ts - ts % {HOUR} AS slot,
  CASE WHEN user_id < 75 THEN 0 ELSE 1 END AS prio, value FROM ticks)
  SELECT entity, slot AS ts, arg_min(value, row(prio, value)) AS value FROM m GROUP BY 1, 2""")
def _(spark, sf):
    t = ticks(spark, sf).select("entity", floor_to("ts", HOUR).alias("ts"), "value", "user_id")
    return panel.merge_dedup([t.filter("user_id < 75").drop("user_id"),
                              t.filter("user_id >= 75").drop("user_id")], ["entity", "ts"])


@query("write_ledger", """SELECT o_orderkey AS seq, o_orderstatus AS kind,
  epoch_us(o_orderdate) // 1000 AS t, o_totalprice AS amount FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("kind"),
        epoch_ms("o_orderdate").alias("t"), F.col("o_totalprice").alias("amount"))
    path = scratch_path(spark, "ledger")
    panel.write_ledger(o, path)
    return panel.read_ledger(spark, path, o.schema)


@query("file_manifest")
def _(spark, sf):
    m = manifests.file_manifest(spark, sf)
    return m.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "bytes", "sha256")


DIGEST = """h AS (SELECT grp, sha256(concat_ws('|', coalesce(o_orderkey::VARCHAR, '~'),
  coalesce(o_custkey::VARCHAR, '~'), coalesce(o_orderstatus, '~'),
  coalesce(o_totalprice::DECIMAL(18,2)::VARCHAR, '~'))) AS h FROM src),
  dg AS (SELECT grp, count(*) AS n_rows, sha256(concat_ws('|', sum(('0x' || substr(h, 1, 15))::UBIGINT::HUGEINT),
  sum(('0x' || substr(h, 16, 15))::UBIGINT::HUGEINT), sum(('0x' || substr(h, 31, 15))::UBIGINT::HUGEINT),
  sum(('0x' || substr(h, 46, 15))::UBIGINT::HUGEINT), count(*))) AS digest FROM h GROUP BY 1)"""


def order_digest(df):
    cols = [F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"),
            F.col("o_totalprice").cast("decimal(18,2)")]
    return manifests.row_digest(df, ["grp"], cols)


@query("row_digest", f"""WITH src AS (SELECT o_orderpriority AS grp, * FROM orders), {DIGEST}
  SELECT grp, n_rows, digest FROM dg""")
def _(spark, sf):
    return order_digest(table(spark, sf, "orders").withColumn("grp", F.col("o_orderpriority")))


MD = "strftime(o_orderdate, '%Y-%m') AS grp"


@query("manifest_diff", f"""WITH e AS (WITH src AS (SELECT {MD}, * FROM orders
  WHERE o_orderdate < TIMESTAMP '2001-05-01'), {DIGEST} SELECT * FROM dg),
  a AS (WITH src AS (SELECT {MD}, * FROM orders WHERE o_orderdate >= TIMESTAMP '1995-04-01'
  AND (o_orderpriority <> '1-URGENT' OR o_orderdate >= TIMESTAMP '1999-01-01')), {DIGEST}
  SELECT * FROM dg), d AS (SELECT coalesce(e.grp, a.grp) AS path,
  CASE WHEN a.grp IS NULL THEN 'missing' WHEN e.grp IS NULL THEN 'additional'
  WHEN a.digest <> e.digest THEN 'mismatch' END AS status FROM e FULL JOIN a ON e.grp = a.grp)
  SELECT path, status FROM d WHERE status IS NOT NULL""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("grp", F.date_format("o_orderdate", "yyyy-MM"))
    day = F.col("o_orderdate")
    e = order_digest(o.filter(day < F.lit("2001-05-01").cast("timestamp_ntz")))
    a = order_digest(o.filter((day >= F.lit("1995-04-01").cast("timestamp_ntz")) & (
        (F.col("o_orderpriority") != "1-URGENT") | (day >= F.lit("1999-01-01").cast("timestamp_ntz")))))
    return manifests.manifest_diff(e, a, "grp", "digest").withColumnRenamed("grp", "path")


@query("split_at_cutoff", f"""WITH {TICKS} SELECT entity AS unit,
  CASE WHEN ts < {B} THEN 'keep' ELSE 'sealed' END AS side, count(*) AS n_rows FROM ticks GROUP BY 1, 2""")
def _(spark, sf):
    return checks.split_census(ticks(spark, sf), "ts", B, F.col("entity"))


@query("guarded_scan", f"""WITH {FINE} SELECT entity, ts, close FROM fine WHERE ts BETWEEN {A} AND {B}""")
def _(spark, sf):
    out = panel.guarded_scan(spark, _written(spark, sf), A, B, (B + 1, FEB), scratch_path(spark, "audit"))
    return out.select("entity", "ts", "close")


@query("sealed_leak_check", f"""WITH {TICKS} SELECT entity, max(ts) AS last_ts,
  count(*) FILTER (ts >= {B}) AS n FROM ticks GROUP BY 1 HAVING max(ts) >= {B}""")
def _(spark, sf):
    return checks.sealed_leaks(ticks(spark, sf), "entity", "ts", B)


@query("overlay_union", f"""WITH {FINE}, o AS (SELECT entity, ts, true AS pre FROM fine WHERE ts < {B + DAY}
  UNION ALL SELECT entity, ts + CASE WHEN entity = 'view' THEN 1 ELSE 0 END, false FROM fine
  WHERE ts >= {B - HOUR}),
  v AS (SELECT 'off_grid' AS reason, entity, count(*) AS n FROM o WHERE ts % {HOUR} <> 0 GROUP BY 2
  UNION ALL SELECT 'pre_after_cutoff', entity, count(*) FROM o WHERE pre AND ts >= {B} GROUP BY 2
  UNION ALL SELECT 'post_before_cutoff', entity, count(*) FROM o WHERE NOT pre AND ts < {B} GROUP BY 2
  UNION ALL SELECT 'duplicate', entity, CAST(sum(c - 1) AS BIGINT) FROM (SELECT entity, ts, count(*) AS c
  FROM o GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 2) SELECT * FROM v""")
def _(spark, sf):
    f = fine(spark, sf).select("entity", "ts")
    post = f.filter(F.col("ts") >= B - HOUR).withColumn(
        "ts", F.col("ts") + F.when(F.col("entity") == "view", 1).otherwise(0))
    return checks.overlay_violations(f.filter(F.col("ts") < B + DAY), post, "ts", HOUR, B)


@query("overlay_union_clean", f"""WITH {FINE} SELECT entity, ts, close FROM fine""")
def _(spark, sf):
    f = materialize(fine(spark, sf))
    return checks.overlay_union(f.filter(F.col("ts") < B), f.filter(F.col("ts") >= B), "ts", HOUR, B,
                                ["entity", "ts", "close"])


CENSUS = """pre AS (SELECT DISTINCT o_custkey AS entity FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'),
  post AS (SELECT DISTINCT o_custkey AS entity FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'
  AND o_orderstatus = 'F')"""


def _pre_post(spark, sf):
    o = table(spark, sf, "orders").withColumn("entity", F.col("o_custkey"))
    cut = F.lit("1996-01-01").cast("timestamp_ntz")
    return (o.filter(F.col("o_orderdate") < cut),
            o.filter((F.col("o_orderdate") >= cut) & (F.col("o_orderstatus") == "F")))


@query("entity_census", f"""WITH {CENSUS} SELECT coalesce(pre.entity, post.entity) AS entity,
  CASE WHEN pre.entity IS NULL THEN 'overlay_only' WHEN post.entity IS NULL THEN 'pre_only'
  ELSE 'combined' END AS class FROM pre FULL JOIN post ON pre.entity = post.entity""")
def _(spark, sf):
    return checks.entity_census(*_pre_post(spark, sf))


@query("set_ops", f"""WITH {CENSUS} SELECT 'union' AS op, count(*) AS n FROM (FROM pre UNION FROM post)
  UNION ALL SELECT 'intersect', count(*) FROM (FROM pre INTERSECT FROM post)
  UNION ALL SELECT 'except', count(*) FROM (FROM pre EXCEPT FROM post)
  UNION ALL SELECT 'union_all', count(*) FROM (FROM pre UNION ALL FROM post)
  UNION ALL SELECT 'except_all', count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL FROM pre)""")
def _(spark, sf):
    pre, post = (x.select("entity") for x in _pre_post(spark, sf))
    a, b = pre.distinct(), post.distinct()
    every = table(spark, sf, "orders").select("o_custkey")
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b),
             "union_all": a.union(b), "except_all": every.exceptAll(a)}
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n")
            for k, df in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


# ---------------------------------------------------------------- coverage
SEALED, FREEZE_C, RECENT = 11_400 * DAY, 11_620 * DAY, 2
MONTHS = f"""ln AS (SELECT 'k' || l_suppkey || l_returnflag AS entity, epoch_us(l_shipdate) // 1000 AS ts
  FROM lineitem),
  ext AS (SELECT entity, strftime(make_timestamp(ts * 1000), '%Y-%m') AS month, count(DISTINCT ts) AS n_rows,
  min(ts) AS first_ts, max(ts) AS last_ts FROM ln GROUP BY 1, 2),
  sp AS (SELECT entity, min(first_ts) AS first_bar, max(last_ts) AS last_bar FROM ext GROUP BY 1),
  spine AS (SELECT *, unnest(generate_series(date_trunc('month', make_timestamp(first_bar * 1000)),
  date_trunc('month', make_timestamp(last_bar * 1000)), INTERVAL 1 MONTH)) AS m0 FROM sp),
  j AS (SELECT s.entity, strftime(m0, '%Y-%m') AS month, first_bar, last_bar, n_rows,
  greatest(epoch_us(m0) // 1000, first_bar) AS lo,
  least(epoch_us(m0 + INTERVAL 1 MONTH) // 1000, last_bar + {DAY}, {SEALED}, {FREEZE_C}) AS hi
  FROM spine s LEFT JOIN ext e ON e.entity = s.entity AND e.month = strftime(m0, '%Y-%m')),
  k AS (SELECT *, CASE WHEN hi <= lo THEN 0 ELSE (hi - 1) // {DAY} - (lo - 1) // {DAY} END AS expected FROM j),
  months AS (SELECT entity, month, n_rows, CAST(expected AS BIGINT) AS expected,
  CASE WHEN n_rows IS NOT NULL AND expected > 0 THEN round(n_rows / expected, 6) END AS completeness,
  CASE WHEN n_rows IS NOT NULL THEN 'present'
  WHEN month >= strftime(make_timestamp({SEALED} * 1000), '%Y-%m') THEN 'sealed'
  WHEN datediff('month', strptime(month || '-01', '%Y-%m-%d'),
  date_trunc('month', make_timestamp({FREEZE_C} * 1000))) < {RECENT} THEN 'recent'
  ELSE 'missing' END AS status FROM k)"""


def _months(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.concat(F.lit("k"), F.col("l_suppkey").cast("string"), "l_returnflag").alias("entity"),
        epoch_ms("l_shipdate").alias("ts"))
    return coverage.coverage_months(coverage.month_extent(li, distinct=True), DAY, SEALED, FREEZE_C, RECENT)


@query("coverage_months", f"""WITH {MONTHS} SELECT entity, month, n_rows, expected, completeness, status
  FROM months""")
def _(spark, sf):
    return _months(spark, sf).select("entity", "month", "n_rows", "expected", "completeness", "status")


# the archive holds, per supplier-flag key, every month in which an order was placed for the
# customer of the same number
@query("coverage_verdict", f"""WITH {MONTHS}, arch AS (SELECT DISTINCT 'k' || o_custkey || 'R' AS entity,
  strftime(o_orderdate, '%Y-%m') AS month FROM orders),
  sp2 AS (SELECT entity, min(month) AS m0, max(month) AS m1 FROM months GROUP BY 1),
  probes AS (SELECT entity, month, 'internal' AS loss FROM months WHERE status = 'missing'
  UNION ALL SELECT entity, strftime(strptime(m0 || '-01', '%Y-%m-%d') - INTERVAL 1 MONTH, '%Y-%m'),
  'head_truncated' FROM sp2
  UNION ALL SELECT entity, strftime(strptime(m1 || '-01', '%Y-%m-%d') + INTERVAL 1 MONTH, '%Y-%m'),
  'tail_truncated' FROM sp2),
  ok AS (SELECT * FROM probes WHERE loss = 'internal' OR (loss = 'head_truncated' AND month >= '1995-01')
  OR (loss = 'tail_truncated' AND month < strftime(make_timestamp({SEALED} * 1000), '%Y-%m')
  AND datediff('month', strptime(month || '-01', '%Y-%m-%d'),
  date_trunc('month', make_timestamp({FREEZE_C} * 1000))) >= {RECENT})),
  l AS (SELECT ok.* FROM ok JOIN arch USING (entity, month))
  SELECT sp2.entity, count(*) FILTER (loss = 'internal') AS n_internal,
  count(*) FILTER (loss = 'head_truncated') AS n_head_truncated,
  count(*) FILTER (loss = 'tail_truncated') AS n_tail_truncated,
  CASE WHEN count(loss) > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict
  FROM sp2 LEFT JOIN l ON l.entity = sp2.entity GROUP BY 1""")
def _(spark, sf):
    arch = table(spark, sf, "orders").select(
        F.concat(F.lit("k"), F.col("o_custkey").cast("string"), F.lit("R")).alias("entity"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.lit("monthly").alias("kind")).distinct()
    return coverage.coverage_verdict(materialize(_months(spark, sf)), arch, SEALED, FREEZE_C, RECENT,
                                     "1995-01")


# ---------------------------------------------------------------- predicates and scalars
@query("time_grid", f"""WITH g AS (SELECT unnest(generate_series({JAN}, {FEB}, {4 * HOUR})) AS boundary)
  SELECT g.boundary, count(e.event_id) AS n_events, count(e.event_id) FILTER
  (epoch_us(e.ts) // 1000 % {HOUR} = 0) AS n_on_grid FROM g LEFT JOIN events e
  ON (epoch_us(e.ts) // 1000) - (epoch_us(e.ts) // 1000) % {4 * HOUR} = g.boundary GROUP BY 1""")
def _(spark, sf):
    per = ticks(spark, sf).groupBy(floor_to("ts", 4 * HOUR).alias("boundary")).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(on_grid("ts", HOUR)).alias("n_on_grid"))
    zero = F.lit(0).cast("bigint")
    return universe.boundary_grid(spark, JAN, FEB, 4 * HOUR).join(per, "boundary", "left").select(
        "boundary", F.coalesce("n_events", zero).alias("n_events"),
        F.coalesce("n_on_grid", zero).alias("n_on_grid"))


REGISTRY = {"listed": {"bases": ["src2", "src4"]},
            "teens": {"bases": ["src7"], "pattern": "^src1[0-5]$"},
            "late": {"pattern": "^src1"}}


@query("registry_classify", """WITH b AS (SELECT doc_id, source, CASE WHEN source LIKE '%9' THEN
  substr(source, 1, length(source) - 1) ELSE source END AS base FROM documents),
  c AS (SELECT *, CASE WHEN base IN ('src2', 'src4') THEN 'listed' WHEN base = 'src7' THEN 'teens'
  WHEN regexp_matches(base, '^src1[0-5]$') THEN 'teens' WHEN regexp_matches(base, '^src1') THEN 'late' END
  AS category, CASE WHEN base IN ('src2', 'src4', 'src7') THEN 'base-list'
  WHEN regexp_matches(base, '^src1[0-5]$') THEN 'pattern:^src1[0-5]$'
  WHEN regexp_matches(base, '^src1') THEN 'pattern:^src1' END AS rule FROM b)
  SELECT doc_id, source, category, rule, category IS NULL AS included FROM c""")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return checks.registry_classify(d, "source", REGISTRY, "9").select(
        "doc_id", "source", "category", "rule", "included")


@query("column_guard", f"""WITH RECURSIVE {FEATURE_CTE} SELECT F01_side, F22_round_side_count, count(*) AS n
  FROM feats GROUP BY 1, 2""")
def _(spark, sf):
    f = feature_rows(spark, sf)
    names = checks.column_guard([c for c in f.columns if c not in ("entity", "t")])
    return f.select(*names).groupBy("F01_side", "F22_round_side_count").agg(F.count(F.lit(1)).alias("n"))


SPANS = """sp AS (SELECT o_orderkey AS symbol, epoch_us(any_value(o_orderdate)) // 1000 AS lo,
  greatest(epoch_us(max(l_shipdate)) // 1000, epoch_us(any_value(o_orderdate)) // 1000) AS hi FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  GROUP BY 1)"""


def spans(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("s"))
    o = table(spark, sf, "orders")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("symbol"), epoch_ms("o_orderdate").alias("lo"), F.greatest(epoch_ms("s"), epoch_ms("o_orderdate")).alias("hi"))


VAL, HOLD = 10_600 * DAY, 11_100 * DAY


@query("purge_guard", f"""WITH {SPANS} SELECT symbol, lo, hi FROM sp WHERE lo < {VAL} AND hi >= {VAL}""")
def _(spark, sf):
    return checks.purge_violations(spans(spark, sf).filter(F.col("lo") < VAL), "hi", VAL)


@query("clip_finite", """SELECT event_id, CASE event_type WHEN 'view' THEN 3.0 WHEN 'click' THEN -1.0
  WHEN 'error' THEN -1.0 ELSE least(3.0, greatest(-1.0, round(ln(value), 9))) END::DOUBLE AS x FROM events""")
def _(spark, sf):
    kind = F.col("event_type")
    raw = (F.when(kind == "view", F.lit(float("inf"))).when(kind == "click", F.lit(float("-inf")))
           .when(kind == "error", F.lit(float("nan"))).otherwise(F.round(F.ln("value"), 9)))
    return table(spark, sf, "events").select("event_id", clip_finite(raw, -1.0, 3.0).alias("x"))


BUCKETS = (0.25, 0.5, 0.75, 1.0)


def _bucket_sql(a, b, c):
    return (f"CASE WHEN x <= {a} THEN 0.25 WHEN x <= {b} THEN 0.5 WHEN x <= {c} THEN 0.75 "
            "ELSE 1.0 END::DOUBLE")


@query("quantile_bucket", f"""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q25,
  quantile_cont(o_totalprice, 0.5) AS q50, quantile_cont(o_totalprice, 0.75) AS q75,
  quantile_cont(o_totalprice, 0.9) AS q90 FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01')
  SELECT o_orderkey, {_bucket_sql('q25', 'q50', 'q75')} AS m1, {_bucket_sql('0.0', 'q50', 'q75')} AS m2,
  {_bucket_sql('q25', 'q75', 'q90')} AS m3, 1.0::DOUBLE AS m4
  FROM (SELECT o_orderkey, o_totalprice AS x FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'), q""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    cut = F.lit("1999-01-01").cast("timestamp_ntz")
    qs = materialize(exact_quantiles(o.filter(F.col("o_orderdate") < cut), "o_totalprice",
                                     [0.25, 0.5, 0.75, 0.9]))
    rows = o.filter(F.col("o_orderdate") >= cut)
    for p in (25, 50, 75, 90):
        rows = rows.withColumn(f"q{p}", qs.filter(F.col("prob") == p / 100).select("quantile").scalar())
    q = F.col
    return rows.select(
        "o_orderkey", bucket_of("o_totalprice", [q("q25"), q("q50"), q("q75")], BUCKETS).alias("m1"),
        bucket_of("o_totalprice", [F.lit(0.0), q("q50"), q("q75")], BUCKETS).alias("m2"),
        bucket_of("o_totalprice", [q("q25"), q("q75"), q("q90")], BUCKETS).alias("m3"),
        F.lit(1.0).alias("m4"))


@query("cost_tier", """WITH r AS (SELECT o_orderkey, o_totalprice AS ref, CASE o_orderstatus WHEN 'F' THEN 1
  ELSE -1 END AS side, substr(o_orderpriority, 1, 1)::INT * 4 AS rank FROM orders), c AS (SELECT *, CASE WHEN rank <= 10 THEN 0.0001 ELSE 0.00025 END::DOUBLE AS hs,
  CASE WHEN rank <= 10 THEN 0.00015 ELSE 0.00035 END::DOUBLE AS sl FROM r)
  SELECT o_orderkey, CASE WHEN rank <= 10 THEN 1 ELSE 2 END AS tier, hs AS half_spread,
  sl AS slippage, round(ref * (1 + side * (hs + sl)), 7) AS entry_fill,
  round(ref * (1 - side * (hs + sl * 2)), 7) AS stop_fill FROM c""")
def _(spark, sf):
    o = table(spark, sf, "orders").withColumn("rank", F.substring("o_orderpriority", 1, 1).cast("int") * 4).withColumn(
        "side", F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1))
    return o.select(
        "o_orderkey", tier("rank").alias("tier"), by_tier("rank", EU.half_spread).alias("half_spread"),
        by_tier("rank", EU.slippage).alias("slippage"),
        r6(entry_fill("o_totalprice", "side", "rank"), "entry_fill", 7),
        r6(exit_fill("o_totalprice", "side", "rank", 2.0), "stop_fill", 7))


@query("scalar_suite", """SELECT o_orderkey, round(ln(o_totalprice), 6) AS ln_p, round(log10(o_totalprice), 6)
  AS log10_p, round(sqrt(o_totalprice), 6) AS sqrt_p, abs(o_custkey - 700) AS abs_c,
  least(o_custkey, 500) AS least_c, o_custkey // 7 AS div_c, o_custkey % 7 AS mod_c,
  round(erf_x, 6) AS erf_x, strftime(o_orderdate, '%Y-%m') AS month,
  strftime(o_orderdate - INTERVAL 1 MONTH, '%Y-%m') AS prev_month, dayofweek(o_orderdate) AS dow,
  regexp_replace(o_orderpriority, '^[0-9]-', '') AS pri, starts_with(o_orderpriority, '1') AS urgent,
  sha256(o_orderpriority) AS pri_hash, o_orderstatus IN ('F', 'O') AS done,
  CASE o_orderstatus WHEN 'F' THEN 1.5 WHEN 'O' THEN 2.5 END::DOUBLE AS mapped FROM (SELECT *,
  1 - ((((1.061405429 * k - 1.453152027) * k + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k
  * exp(-x * x) AS erf_x FROM (SELECT *, o_custkey / 1000.0 AS x,
  1 / (1 + 0.3275911 * (o_custkey / 1000.0)) AS k FROM orders))""")
def _(spark, sf):
    c, p, d = F.col("o_custkey"), F.col("o_totalprice"), F.col("o_orderdate")
    m = F.create_map(F.lit("F"), F.lit(1.5), F.lit("O"), F.lit(2.5))
    return table(spark, sf, "orders").select(
        "o_orderkey", r6(F.ln(p), "ln_p"), r6(F.log10(p), "log10_p"), r6(F.sqrt(p), "sqrt_p"),
        F.abs(c - 700).alias("abs_c"), F.least(c, F.lit(500)).alias("least_c"),
        F.call_function("div", c, F.lit(7).cast("bigint")).alias("div_c"), F.pmod(c, F.lit(7)).alias("mod_c"),
        r6(erf(c / 1000.0), "erf_x"), F.date_format(d, "yyyy-MM").alias("month"),
        F.date_format(F.add_months(d, -1), "yyyy-MM").alias("prev_month"),
        (F.dayofweek(d) - 1).cast("bigint").alias("dow"),
        F.regexp_replace("o_orderpriority", "^[0-9]-", "").alias("pri"),
        F.col("o_orderpriority").startswith("1").alias("urgent"),
        F.sha2("o_orderpriority", 256).alias("pri_hash"), F.col("o_orderstatus").isin("F", "O").alias("done"),
        F.element_at(m, F.col("o_orderstatus")).alias("mapped"))


@query("json_props", """SELECT k, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT
  CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events) GROUP BY 1""")
def _(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    x = nan_to_null("value")
    return table(spark, sf, "events").groupBy(k.alias("k")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum(x), "total", 4))


# ---------------------------------------------------------------- risk
@query("size_limits", """WITH r AS (SELECT o_orderkey, o_totalprice / 1000 AS qty, 100.0 AS price,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 0.0 ELSE o_totalprice / 50000 END AS sd,
  o_orderpriority < '3' AS long, o_orderstatus <> 'P' AS dc, o_orderpriority <> '5-LOW' AS hs,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'daily_loss_limit' END AS paused, c_acctbal * 5 AS eq,
  c_acctbal * 2 AS gross, c_acctbal AS lx, c_acctbal * 5.5 AS sx, c_nationkey // 2 AS npos
  FROM orders JOIN customer ON o_custkey = c_custkey),
  k AS (SELECT *, CASE WHEN NOT dc THEN 'missing_data_fail_safe' WHEN NOT hs OR sd <= 0
  THEN 'no_protective_stop' WHEN paused IS NOT NULL THEN paused WHEN eq <= 0 THEN 'non_positive_equity'
  WHEN npos >= 10 THEN 'max_positions' END AS why,
  CASE WHEN sd > 0 THEN least(qty, 0.01 * eq / sd, greatest(0, 1.5 * eq - gross) / price,
  greatest(0, 1.2 * eq - CASE WHEN long THEN lx ELSE sx END) / price) END AS cap FROM r),
  z AS (SELECT *, coalesce(why, CASE WHEN cap * price < 50 THEN 'insufficient_capacity' END) AS rej FROM k)
  SELECT o_orderkey, CASE WHEN rej IS NOT NULL THEN 'reject' WHEN cap >= qty THEN 'approve'
  ELSE 'restrict' END AS decision, round(CASE WHEN rej IS NOT NULL THEN 0.0 WHEN cap >= qty THEN qty
  ELSE cap END, 6) AS allowed_qty, coalesce(rej, CASE WHEN cap >= qty THEN 'ok'
  ELSE 'restricted_to_fit_limits' END) AS reason FROM z""")
def _(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    pri, bal = F.col("o_orderpriority"), F.col("c_acctbal")
    req = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", (F.col("o_totalprice") / 1000).alias("qty"), F.lit(100.0).alias("price"),
        F.when(pri == "4-NOT SPECIFIED", 0.0).otherwise(F.col("o_totalprice") / 50000).alias("stop_distance"),
        F.when(pri < "3", 1).otherwise(-1).alias("side"),
        (F.col("o_orderstatus") != "P").alias("data_complete"), (pri != "5-LOW").alias("has_stop"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "daily_loss_limit").alias("paused"),
        (bal * 5).alias("equity"), (bal * 2).alias("gross_exposure"), bal.alias("long_exposure"),
        (bal * 5.5).alias("short_exposure"),
        F.floor(F.col("c_nationkey") / 2).alias("n_positions"))
    return risk.size_limits(req).select("o_orderkey", "decision", r6("allowed_qty", "allowed_qty"), "reason")


ACTION = {"view": "hold", "click": "tighten_stop", "purchase": "add", "signup": "close",
          "error": "move_stop_breakeven"}
ACTION_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTION.items()) + " END"


def action():
    return F.element_at(F.create_map(*[F.lit(x) for kv in ACTION.items() for x in kv]), F.col("event_type"))


@query("risk_action_filter", f"""WITH a AS (SELECT event_id, {ACTION_SQL} AS action, value > 100 AS emergency
  FROM events), b AS (SELECT *, CASE WHEN emergency AND action NOT IN ('close', 'reduce_25', 'reduce_50', 'hold')
  THEN 'emergency_pause' WHEN action NOT IN ('hold', 'reduce_25', 'reduce_50', 'close', 'tighten_stop',
  'move_stop_breakeven') THEN 'not_risk_reducing' END AS reason FROM a)
  SELECT event_id, action, reason, reason IS NULL AS allowed FROM b""")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", action().alias("action"),
                                          (F.col("value") > 100).alias("emergency"))
    return risk.risk_action_filter(e, "action", "emergency").select("event_id", "action", "reason", "allowed")


@query("stage_funnel", f"""WITH c AS (SELECT epoch_us(ts) // 1000 // {HOUR} AS t, event_id AS entity,
  event_type = 'view' AS is_open, event_type <> 'error' AS accepted, value AS score,
  CASE WHEN value < 20 THEN 0.25 WHEN value < 50 THEN 0.5 ELSE 1.0 END AS bucket,
  CASE event_type WHEN 'signup' THEN 0.0 WHEN 'click' THEN 0.5 ELSE 1.0 END AS rm FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY t, is_open ORDER BY score DESC, entity) AS rk FROM c),
  s AS (SELECT *, CASE WHEN is_open THEN 'already_open' WHEN NOT accepted THEN 'filter_rejected'
  WHEN rk > 4 THEN 'rank_cut' WHEN least(bucket, rm) <= 0 THEN 'regime_blocked' ELSE 'submitted' END
  AS stage FROM r)
  SELECT t, entity, stage, CASE WHEN stage = 'submitted' THEN least(bucket, rm) END::DOUBLE AS multiplier
  FROM s""")
def _(spark, sf):
    kind, v = F.col("event_type"), F.col("value")
    c = table(spark, sf, "events").select(
        F.floor(epoch_ms("ts") / HOUR).alias("t"),
        F.col("event_id").alias("entity"), (kind == "view").alias("is_open"),
        (kind != "error").alias("accepted"), v.alias("score"),
        F.when(v < 20, 0.25).when(v < 50, 0.5).otherwise(1.0).alias("bucket"),
        F.when(kind == "signup", 0.0).when(kind == "click", 0.5).otherwise(1.0).alias("regime_mult"))
    return risk.stage_funnel(c, 4).select("t", "entity", "stage", "multiplier")


ADMIT = """r AS (SELECT o_orderdate, o_orderkey, o_totalprice AS size, row_number() OVER
  (PARTITION BY o_orderdate ORDER BY o_orderkey) AS rn FROM orders),
  a(o_orderdate, rn, o_orderkey, size, used, n, outcome) AS (
  SELECT o_orderdate, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, 0.0::DOUBLE, 0, NULL::VARCHAR FROM r WHERE rn = 1
  UNION ALL SELECT r.o_orderdate, r.rn, r.o_orderkey, r.size,
  CASE WHEN r.size >= 20000 AND a.n < 4 AND a.used + r.size <= 700000 THEN a.used + r.size ELSE a.used END,
  CASE WHEN r.size >= 20000 AND a.n < 4 AND a.used + r.size <= 700000 THEN a.n + 1 ELSE a.n END,
  CASE WHEN r.size < 20000 THEN 'min_notional' WHEN a.n >= 4 THEN 'max_positions'
  WHEN a.used + r.size > 700000 THEN 'capacity' ELSE 'admitted' END
  FROM a JOIN r ON r.o_orderdate = a.o_orderdate AND r.rn = a.rn + 1)"""


@query("greedy_admit", f"""WITH RECURSIVE {ADMIT} SELECT o_orderkey, size, outcome FROM a WHERE rn > 0""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderdate", "o_orderkey", F.col("o_totalprice").alias("size"))
    out = risk.greedy_admit(o, ["o_orderdate"], ["o_orderkey"], "size", F.lit(700000.0), 4, 20000.0)
    return out.select("o_orderkey", "size", "outcome")


@query("greedy_admit_large", f"""WITH RECURSIVE {ADMIT} SELECT o_orderkey, size, outcome FROM a WHERE rn > 0""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderdate", "o_orderkey", F.col("o_totalprice").alias("size"))
    out = risk.greedy_admit(materialize(o), ["o_orderdate"], ["o_orderkey"], "size", F.lit(700000.0), 4, 20000.0)
    return out.select("o_orderkey", "size", "outcome")


@query("stable_order", """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS seq
  FROM orders""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", epoch_ms("o_orderdate").alias("t"))
    return risk.stable_order(o, "t", "o_orderkey").select("o_orderkey", "seq")


# ---------------------------------------------------------------- integrity
CHAIN = """l AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
  event_type || '|' || event_id AS body FROM events),
  c(user_id, rn, event_id, prev, hash) AS (SELECT user_id, rn, event_id, repeat('0', 64),
  sha256(repeat('0', 64) || body) FROM l WHERE rn = 1
  UNION ALL SELECT l.user_id, l.rn, l.event_id, c.hash, sha256(c.hash || l.body) FROM c
  JOIN l ON l.user_id = c.user_id AND l.rn = c.rn + 1)"""


def chain(spark, sf):
    e = table(spark, sf, "events").select(
        "user_id", "event_id", F.concat_ws("|", "event_type", F.col("event_id").cast("string")).alias("body"))
    return manifests.build_chain(e, "user_id", "event_id", "body")


@query("build_chain", f"""WITH RECURSIVE {CHAIN} SELECT user_id, event_id, prev, hash FROM c""")
def _(spark, sf):
    return chain(spark, sf).select("user_id", "event_id", "prev", "hash")


# the event with the largest value of a user is altered after hashing
@query("verify_chain", """SELECT user_id, count(*) AS n_rows, min(event_id) FILTER (value > 250) AS first_break
  FROM events GROUP BY 1""")
def _(spark, sf):
    big = table(spark, sf, "events").select("user_id", "event_id", "value")
    c = materialize(chain(spark, sf)).join(big, ["user_id", "event_id"]).withColumn(
        "body", F.when(F.col("value") > 250, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    return manifests.verify_chain(with_value_bucket(c, "event_id"), ["user_id"], "event_id", "body", F.col("_vb"))


# every 97th recorded round and the recorded start of the validation part are altered
@query("partition_verify", f"""WITH {NATION_ROUNDS}, s AS (SELECT boundary, valid,
  avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END) OVER (ORDER BY boundary RANGE BETWEEN CURRENT ROW
  AND {SPAN.span_window_ms} FOLLOWING) AS share FROM rounds),
  f AS (SELECT min(boundary) AS a FROM s WHERE valid AND share >= {SPAN.span_fraction}),
  e AS (SELECT a + floor({SPAN.train_fraction} * (({Y01} - a) // {DAY} + 1))::BIGINT * {DAY} AS v FROM f)
  SELECT boundary AS key, 'valid' AS field, (NOT valid)::BIGINT AS recorded, valid::BIGINT AS computed
  FROM rounds WHERE boundary // {DAY} % 97 = 0
  UNION ALL SELECT 0, 'validation_start', v + {DAY}, v FROM e WHERE v IS NOT NULL""")
def _(spark, sf):
    lines = materialize(nation_lines(spark, sf))
    rounds = materialize(nation_rounds(spark, sf))
    rec = recompute.partition_record(rounds, Y01, FREEZE, DAY, SPAN)
    altered = (F.when((F.col("field") == "valid") & (F.floor(F.col("key") / DAY) % 97 == 0), 1 - F.col("value"))
               .when(F.col("field") == "validation_start", F.col("value") + DAY).otherwise(F.col("value")))
    anew = recompute.partition_recompute(lines, NATION_CTX, Y95, Y01, DAY, SPAN)
    return checks.partition_verify(rec.withColumn("value", altered), anew, "key")


LOOK = JAN + 15 * DAY


@query("lookahead_check", f"""WITH {COARSE} SELECT count(*) AS n_before, 0::BIGINT AS n_changed FROM coarse
  WHERE boundary < {LOOK}""")
def _(spark, sf):
    base = materialize(bars.complete_bars(fine(spark, sf), p=EU))

    def series(d):
        return windows.feature_series(windows.signals(d, EU), EU)
    changed = checks.lookahead_check(series, base, "boundary", LOOK, ["open", "high", "low", "close"], "boundary")
    n = changed.select(F.count(F.lit(1))).scalar()
    return base.filter(F.col("boundary") < LOOK).agg(F.count(F.lit(1)).alias("n_before")).withColumn("n_changed", n)


DIV = """a AS (SELECT row_number() OVER (ORDER BY t, arm) - 1 AS seq, arm, t, equity FROM curve),
  b AS (SELECT row_number() OVER (ORDER BY t, arm) - 1 AS seq, arm, t, CASE WHEN equity > 20010
  THEN equity + 1e-10 WHEN equity < 19990 THEN equity + 1 ELSE equity END AS equity FROM curve)"""


@query("ledger_first_divergence", f"""WITH {CURVE}, {DIV}, d AS (SELECT a.seq, a.equity AS x, b.equity AS y
  FROM a JOIN b USING (seq) WHERE a.equity <> b.equity) SELECT min(seq) AS seq, 'equity' AS field,
  arg_min(abs(x - y) <= greatest(1e-9, 1e-9 * greatest(abs(x), abs(y))), seq) AS within,
  count(*) AS n_differing FROM d""")
def _(spark, sf):
    a = materialize(curve(spark, sf))
    e = F.col("equity")
    b = a.withColumn("equity", F.when(e > 20010, e + 1e-10).when(e < 19990, e + 1).otherwise(e))
    return checks.ledger_first_divergence(a, b, ["t", "arm"], time_bucket("t", 90 * DAY), ["arm", "t"],
                                          ["equity"])


@query("fill_identity", """WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem),
  b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.07 THEN l_quantity + 1 ELSE l_quantity END
  AS l_quantity FROM lineitem WHERE l_discount < 0.09)
  SELECT *, 'only_a' AS side FROM (FROM a EXCEPT ALL FROM b)
  UNION ALL SELECT *, 'only_b' AS side FROM (FROM b EXCEPT ALL FROM a)""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    a = li.select("l_orderkey", "l_linenumber", "l_quantity")
    b = li.filter("l_discount < 0.09").select("l_orderkey", "l_linenumber", F.when(
        F.col("l_tax") > 0.07, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("l_quantity"))
    return checks.fill_identity(a, b)



@query("join_1to1", """SELECT o_orderkey, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem
  GROUP BY 1) ON o_orderkey = l_orderkey""")
def _(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"))
    return checks.join_1to1(table(spark, sf, "orders").select("o_orderkey"), n, ["o_orderkey"])
