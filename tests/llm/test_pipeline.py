"""Stages of the corpus pipeline on rows whose ids repeat or are null."""

import random

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RNG = random.Random(4)
CLEAN = [" ".join(RNG.choice("the river house walked under green light slowly with another small bird".split()) + str(i % 7)
                  for i in range(30)) for _ in range(6)]
LOOP = "one two three four five six " * 20


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).repartition(3)


def kept(spark, stage, rows):
    got = stage(spark, frame(spark, rows), "")
    assert got.columns == corpus_pipeline.COLUMNS
    return sorted(((r.doc_id, r.text, r.source) for r in got.collect()), key=str)


def in_order(rows):
    return sorted(rows, key=str)


def test_quality_judges_each_row(spark):
    good = [(None, CLEAN[0], "a"), (None, CLEAN[1], "a"), (1, CLEAN[2], "a"), (2, CLEAN[3], "a"), (2, CLEAN[3], "a")]
    bad = [(None, LOOP, "a"), (1, LOOP, "a"), (3, "too short", "a"), (None, None, "a")]
    assert kept(spark, corpus_pipeline.quality_rules, good + bad) == in_order(good)


def test_exact_dedup_leaves_one_row_of_equal_texts(spark):
    rows = [(5, CLEAN[0], "a"), (5, CLEAN[0], "a"), (9, CLEAN[0], "a"), (None, CLEAN[0], "a"),
            (None, CLEAN[1], "a"), (None, CLEAN[1], "a"), (5, CLEAN[2], "a"), (None, None, "a"), (4, "", "a")]
    stay = [(5, CLEAN[0], "a"), (None, CLEAN[1], "a"), (5, CLEAN[2], "a"), (4, "", "a")]
    assert kept(spark, corpus_pipeline.exact_dedup, rows) == in_order(stay)


def test_near_dedup_leaves_one_row_of_each_component(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(7, long + " end", "a"), (7, long, "a"), (7, long, "a"), (None, long + " stop", "a"),
            (None, CLEAN[4], "a"), (None, CLEAN[4], "a"), (7, CLEAN[5], "a"), (3, None, "a"), (None, "", "a")]
    got = kept(spark, corpus_pipeline.near_dedup, rows)
    assert len(got) == 5 and sum((t or "").startswith("w0") for _, t, _ in got) == 1
    assert {(i, t) for i, t, _ in got if not (t or "").startswith("w0")} == {(None, CLEAN[4]), (7, CLEAN[5]), (3, None), (None, "")}
    assert [i for i, t, _ in got if (t or "").startswith("w0")] == [7]


def test_mix_repeats_each_row_by_its_own_share(spark):
    from pitpanel.llm import mixing

    rows = [(i % 10 if i % 4 else None, f"t{i} " + "w " * (i % 23), f"s{i % 3}") for i in range(300)]
    keyed = frame(spark, rows).selectExpr("*", "n_chars + 1000 * cast(substring(split(text, ' ')[0], 2) as bigint) AS own")
    taken = {r.own: (r.taken, r.size) for r in mixing.mix(keyed, row_col="own").collect()}
    assert len(taken) == len(rows)
    times = {}
    for i, t, s in rows:
        n, size = taken[len(t) + 1000 * int(t.split()[0][1:])]
        times[i, t, s] = (2 * n + size) // (2 * size)
    want = [k for k, n in times.items() for _ in range(n)]
    assert len(set(times.values())) > 1 and kept(spark, corpus_pipeline.mix_sources, rows) == in_order(want)


def test_texts_of_kept_rows_are_not_shuffled(spark):
    docs = spark.range(0, 200_000, 1, 3).selectExpr("id AS doc_id", "sha2(string(id), 256) AS text", "'en' AS lang", "'s' AS source", "64L AS n_chars")
    rows = corpus_pipeline._rows(docs)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "60000")
    try:
        kept = corpus_pipeline._keep(rows, rows.where("text < '8'").repartition(4, "text").select("_row"))
        got = sorted(r.doc_id for r in kept.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted(r.doc_id for r in docs.where("text < '8'").collect())
    assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
