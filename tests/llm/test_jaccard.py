"""The join against brute force over all pairs."""

import random
from itertools import combinations
from pathlib import Path

import pyarrow as pa
from pitpanel.llm import jaccard

SCHEMA = "doc_id bigint, text string, set_id int"


def brute(rows):
    sets = {}
    for i, t, _ in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(sets, 2):
        x, y = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if y and 100 * x >= 80 * y:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    shared = [rng.choice(words) for _ in range(40)]
    texts = [None, "", "  \t", "one two", "One TWO", "a b c d e", "a b c d e f", "Ä b c d e", "ä b c d e"]
    for size in (6, 9, 14, 26, 34, 60, 130, 400):
        for _ in range(6):
            base = [rng.choice(words) for _ in range(size)] + (shared if rng.random() < 0.5 else [])
            texts.append(" ".join(base))
            for edits in (0, 1, 1, 2, max(1, size // 50), max(2, size // 30)):
                copy = list(base)
                for _ in range(edits):
                    at = rng.randrange(len(copy))
                    copy[at:at + 1] = rng.choice([[], ["x"], ["y", copy[at]]])
                texts.append(" ".join(copy))
    ids = rng.sample(range(10_000), len(texts))
    rows = [(i, t, 0) for i, t in zip(ids, texts, strict=True)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    assert jaccard.components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shared_passages_and_split_tiles(spark, monkeypatch):
    """Many texts around one passage: frequent shingles go last, and tiles are compared in several blocks."""
    monkeypatch.setattr(jaccard, "OFTEN", 5)
    monkeypatch.setattr(jaccard, "TILE", 4)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    shared = [rng.choice(words) for _ in range(50)]
    rows = [(i, " ".join(shared + [rng.choice(words) for _ in range(rng.randrange(1, 40))]), 0) for i in range(240)]
    rows += [(1000 + i, t, 0) for i, (_, t, _) in enumerate(rows[::3])]
    rows += [(2000 + i, t + " z", 0) for i, (_, t, _) in enumerate(rows[1:240:3])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_arrays_take_their_form_before_the_shuffle(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(30)), 0) for i in range(20)], SCHEMA)
    sets = jaccard.materialize(jaccard._sets(docs.select("doc_id", "text")))
    wanted = sets.where("doc_id % 3 = 0").select("set_id").distinct()
    kept = jaccard._distinct(sets, wanted, jaccard.bitmap, "bits")
    want = {r[0] for r in wanted.collect()}
    assert sorted(r["set_id"] for r in kept.collect()) == sorted(want)
    lines = kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()
    at = next(i for i, x in enumerate(lines) if "MapInArrow" in x)
    depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines]
    below = []
    for i in range(at + 1, len(lines)):
        if depth[i] <= depth[at]:
            break
        below.append(lines[i])
    assert not any("Exchange" in x for x in below)


def test_arrays_of_all_sets_are_not_written(spark, monkeypatch):
    """What is written of unlike texts is less than the texts; arrays of shingles are several times that."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(1000)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(400)), 0) for i in range(300)]
    written = []

    def recorded(df):
        table = write(df)
        written.append(sum(f.stat().st_size for f in Path(table._written_to.removeprefix("file:")).glob("*.parquet")))
        return table
    write = jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", recorded)
    assert jaccard.components(spark.createDataFrame(rows, SCHEMA)).count() == 300
    assert max(written) < sum(len(t) for _, t, _ in rows) / 3


def test_batches_are_bounded_in_bytes(spark):
    docs = spark.range(0, 60, 1, 1).selectExpr("repeat('x', 200000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with jaccard.small_batches(spark):
        assert max(r.n for r in docs.mapInArrow(sizes, "n bigint").collect()) < 5_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
