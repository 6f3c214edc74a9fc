"""Exact groups and mixing against plain Python."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from pitpanel.llm import exact, mixing

ROWS = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (7, None), (9, ""), (8, "a b"), (4, "z" * 50_000), (5, "z" * 50_000), (None, "lone")]


def expected(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups[norm(t)].append(i)
    first = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return {(i, first[norm(t)], len(groups[norm(t)]), i == first[norm(t)]) for i, t in rows}


def test_groups_and_hash_collisions(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id bigint, text string, keep_id string")
    for content_hash in (F.md5, lambda c: F.substring(F.md5(c), 1, 1), lambda c: F.lit("one")):
        got = exact.exact_groups(df, content_hash=content_hash).collect()
        assert {tuple(r)[:4] for r in got} == expected(ROWS) and len(got) == len(ROWS)
    assert exact.exact_groups(df.limit(0)).collect() == []


def test_targets_are_shared_by_weight_under_caps(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 300}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    # weights a 1, b 2, c 3, null 1: a and c stop at their caps
    left = 1315 - 30 - 15
    assert got["a"] == 30 and got["c"] == 15
    assert abs(got["b"] - left * 2 / 3) < 1e-6 and abs(got[None] - left / 3) < 1e-6


def test_mix_comes_near_its_targets_and_repeats(spark):
    rows = [(i, " ".join(["w"] * (i % 37)), f"s{i % 5}" if i % 3 else "hot", 1) for i in range(900)] + [(1000, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, taken int")
    first, again = (sorted(mixing.mix(df, block=8).collect(), key=lambda r: r.doc_id) for _ in range(2))
    assert first == again and len(first) == len(rows)
    taken, target = defaultdict(int), {}
    for r, (_, text, source, _) in zip(first, rows, strict=True):
        assert r.size == len((text or "").split()) and 0 <= r.taken <= 3 * r.size
        taken[source] += r.taken
        target[source] = r.target
    assert all(abs(taken[s] - target[s]) <= 40 for s in target)
    assert mixing.mix(df.limit(0)).collect() == []
    assert [r.taken for r in mixing.mix(df.where("source IS NULL")).collect()] == [0]
