"""Files, digests, chains, guarded scans and streams."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pitpanel.operators import models
from pitpanel.plans.ordered import time_bucket
from pitpanel.sources import manifests, panel
from tests.util import M15

GRID = 1_888_888 * M15
ROW = "{t},1,2,0.5,1.5,10,0,15,3,0,0,0"
HEAD = ",".join(panel.BAR_CSV_COLUMNS)


def _text(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "v string").coalesce(1).write.text(path)
    return path


def test_panel_round_trip_and_pruning(spark, scratch):
    df = spark.range(0, 5000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("entity"),
                                     (F.col("id") * 6 * 3_600_000).alias("ts"), F.col("id").cast("double").alias("close"))
    panel.write_panel(df, scratch, partitions=4)
    lo, hi = 40 * 86_400_000, 70 * 86_400_000
    out = panel.scan_panel(spark, scratch, lo, hi, ["a"])
    want = df.filter(F.col("ts").between(lo, hi) & (F.col("entity") == "a"))
    assert out.count() == want.count() and out.exceptAll(want.select(*out.columns)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan or "PartitionFilters: [isnotnull(entity" in plan
    assert "GreaterThanOrEqual(ts" in plan


def test_bar_csv_with_and_without_header(spark, scratch):
    a = _text(spark, scratch + "/a", [HEAD, ROW.format(t=M15), ROW.format(t=GRID * 1000)])
    b = _text(spark, scratch + "/b", [ROW.format(t=0)])
    out = panel.read_bar_csv(spark, [a, b]).orderBy("ts").collect()
    assert [r["ts"] for r in out] == [0, M15, GRID]
    assert out[0]["high"] == 2.0 and out[0]["quote_volume"] == 15.0
    with pytest.raises(Exception, match="off the grid"):
        panel.read_bar_csv(spark, _text(spark, scratch + "/c", [ROW.format(t=7)])).collect()
    with pytest.raises(Exception, match="column count"):
        panel.read_bar_csv(spark, _text(spark, scratch + "/d", ["0,1,2,3"])).collect()


def test_rate_csv_headers(spark, scratch):
    a = _text(spark, scratch + "/a", ["calc_time,funding_interval_hours,last_funding_rate", "28800000,8,0.0001"])
    assert panel.read_rate_csv(spark, a).collect()[0] == (28800000, 0.0001)
    b = _text(spark, scratch + "/b", ["fundingTime,fundingRate", "28800000,0.5"])
    assert panel.read_rate_csv(spark, b).collect()[0] == (28800000, 0.5)
    other = _text(spark, scratch + "/o", ['"funding_rate", "x", "funding_time"', " 0.25,7, 57600000", "", "-0.5,7,86400000"])
    assert sorted(map(tuple, panel.read_rate_csv(spark, [a, b, other]).collect())) == [
        (28800000, 0.0001), (28800000, 0.5), (57600000, 0.25), (86400000, -0.5)]
    c = _text(spark, scratch + "/c", ["when,what", "1,2"])
    with pytest.raises(ValueError):
        panel.read_rate_csv(spark, c)
    with pytest.raises(ValueError):
        panel.read_rate_csv(spark, [a, c])
    with pytest.raises(Exception, match="no rate header"):
        panel.read_rate_csv(spark, _text(spark, scratch + "/n", ["28800000,8,0.5"])).collect()


def test_rates_in_both_layouts(spark, scratch):
    one = spark.createDataFrame([(10, 0.1), (99, 0.9)], "ts bigint, rate double")
    one.write.parquet(scratch + "/nested")
    one.write.parquet(scratch + "/entity=hive")
    # a flat file named after its entity
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path
    fs = hpath(scratch).getFileSystem(spark._jsc.hadoopConfiguration())
    one.coalesce(1).write.parquet(scratch + "-tmp")
    part = [s.getPath() for s in fs.listStatus(hpath(scratch + "-tmp")) if s.getPath().getName().startswith("part")][0]
    fs.rename(part, hpath(scratch + "/flat.parquet"))
    got = {(r["entity"], r["ts"]) for r in panel.scan_rates(spark, scratch, 0, 50).collect()}
    assert got == {("nested", 10), ("hive", 10), ("flat", 10)}


def test_merge_dedup_prefers_the_first_source(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "ts bigint, v double")
    b = spark.createDataFrame([(2, 9.0), (3, 3.0)], "ts bigint, v double")
    assert sorted(map(tuple, panel.merge_dedup([a, b], ["ts"]).collect())) == [(1, 1.0), (2, 2.0), (3, 3.0)]


def test_guarded_scan_refuses_and_records(spark, scratch):
    panel.write_panel(spark.createDataFrame([("a", 5, 1.0)], "entity string, ts bigint, v double"), scratch + "/p")
    audit = scratch + "/audit"
    assert panel.guarded_scan(spark, scratch + "/p", 0, 9, (10, 20), audit).count() == 1
    for a, b in ((0, 10), (15, 16), (20, 30)):
        with pytest.raises(panel.SealedRangeError):
            panel.guarded_scan(spark, scratch + "/p", a, b, (10, 20), audit)
    assert spark.read.json(audit).filter("decision = 'REFUSED'").count() == 3


def test_row_digest_ignores_order_and_sees_changes(spark):
    df = spark.range(500).select(F.lit("g").alias("g"), "id", (F.col("id") * 3).alias("x"))

    def dig(d, **kw):
        return manifests.row_digest(d, ["g"], [F.col("id"), F.col("x")], **kw).first()["digest"]
    base = dig(df)
    assert dig(df.repartition(7).orderBy(F.desc("id"))) == base
    assert dig(df.withColumn("x", F.when(F.col("id") == 77, 0).otherwise(F.col("x")))) != base
    assert dig(df.union(df.limit(1))) != base
    a, b = (manifests.tree_digest(d, ["g"], [F.col("id"), F.col("x")]).first()["digest"] for d in (df, df.repartition(3)))
    assert a == b


def test_manifest_and_diff(spark, scratch):
    spark.range(10).write.parquet(scratch + "/a")
    m = manifests.file_manifest(spark, scratch + "/a")
    row = m.orderBy("path").first()
    with open(row["path"].removeprefix("file:"), "rb") as f:
        data = f.read()
    assert row["sha256"] == hashlib.sha256(data).hexdigest() and row["bytes"] == len(data)
    assert manifests.file_manifest(spark, scratch + "/a", block=7).exceptAll(m).isEmpty()  # many blocks a file
    e = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3")], "path string, sha256 string")
    a = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "4")], "path string, sha256 string")
    got = {r["path"]: r["status"] for r in manifests.manifest_diff(e, a).collect()}
    assert got == {"y": "mismatch", "z": "missing", "w": "additional"}
    census = {r["path"]: r["status"] for r in manifests.manifest_diff(e, a, sample=0.0).collect()}
    assert census == {"z": "missing", "w": "additional"}


def test_chain_build_verify_and_tamper(spark):
    df = spark.createDataFrame([(k, i, f"{k}{i}") for k in ("p", "q") for i in range(40)], "k string, seq bigint, body string")
    chain = manifests.build_chain(df, "k", "seq", "body").cache()
    last = manifests.GENESIS
    for r in chain.filter("k = 'p'").orderBy("seq").collect():
        assert r["prev"] == last
        last = hashlib.sha256((last + r["body"]).encode()).hexdigest()
        assert r["hash"] == last

    def first_break(d):
        return {r["k"]: r["first_break"] for r in
                manifests.verify_chain(d, ["k"], "seq", "body", time_bucket("seq", 7)).collect()}
    assert first_break(chain) == {"p": None, "q": None}
    hit = (F.col("k") == "q") & (F.col("seq") == 13)
    assert first_break(chain.withColumn("body", F.when(hit, "x").otherwise(F.col("body"))))["q"] == 13
    assert first_break(chain.filter(~hit))["q"] == 14


def test_models_guard_and_bind_by_name(spark):
    rows = [(float(i % 17), None if i % 5 == 0 else float(i % 3), float((i % 17) > 8), i, i + 1) for i in range(300)]
    df = spark.createDataFrame(rows, "F02_a double, F03_b double, net double, lo bigint, hi bigint")
    with pytest.raises(Exception, match="reaches the validation start"):
        models.fit_ranker(df, ["F02_a", "F03_b"], "net", 300, maxIter=2)
    with pytest.raises(Exception, match="outside the feature"):
        models.fit_ranker(df, ["other"], "net", maxIter=2)
    m = models.fit_filter(df, ["F02_a", "F03_b"], "net", 1000, maxIter=3)
    assert m.importance()[0][0] == "F02_a"
    a = m.score(df).agg(F.sum("score")).first()[0]
    b = m.score(df.select("F03_b", "lo", "F02_a")).agg(F.sum("score")).first()[0]
    assert abs(a - b) < 1e-9
    s = models.fit_sizer(df, ["F02_a"], "net", maxIter=3)
    assert {r["bucket"] for r in s.bucket(df).select("bucket").distinct().collect()} <= {0.25, 0.5, 0.75, 1.0}


def test_late_rows_are_dropped_and_counted_and_the_end_is_closed(spark, scratch):
    from pitpanel.params import HOUR
    from pitpanel.streaming import jobs

    rows = lambda *hs: spark.createDataFrame([(h, 3_600 * h) for h in hs], "id int, s bigint").select("id", F.timestamp_seconds("s").alias("ts"))
    path = scratch + "/in"
    rows(1, 2, 3, 100).coalesce(1).write.parquet(path)
    # the first batch moves the watermark to hour 98, which holds from the batch after the next on
    rows(102).coalesce(1).write.mode("append").parquet(path)
    rows(97, 5, 6, 99, 101).coalesce(1).write.mode("append").parquet(path)
    jobs.closing_row(spark.read.parquet(path), "ts", 10 * HOUR).coalesce(1).write.mode("append").parquet(path)
    assert jobs.closing_row(spark.read.parquet(path).limit(0), "ts", 1).count() == 0
    stream = spark.readStream.schema("id int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    late = jobs.run_available(jobs.stream_dedup(stream, ["id"], "ts", 2 * HOUR), scratch + "/out", scratch + "/cp")
    got = sorted(r["id"] or 0 for r in spark.read.parquet(scratch + "/out").collect())
    assert late == 3 and got == [0, 1, 2, 3, 99, 100, 101, 102]
    stream = spark.readStream.schema("id int, ts timestamp").parquet(path)
    status = jobs.stream_round_status(stream.selectExpr("ts", "'a' AS member", "id > 2 AS ok"), ["a"], "ts", HOUR, HOUR)
    assert jobs.run_available(status, scratch + "/out2", scratch + "/cp2") == 0
    assert spark.read.parquet(scratch + "/out2").count() == 10
