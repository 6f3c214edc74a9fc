"""Near words and forms against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from pitpanel.llm import spelling


def near(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:k] + v[k + 1:] == u for k in range(len(v)))


def brute_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute(docs):
    words = brute_words(docs)
    out = {}
    for w, n in words.items():
        found = sorted(((-words[v], v) for v in words if near(w, v)))
        form = found[0][1] if found and -found[0][0] >= 10 * n else None
        out[w] = [form, None, n, len(found), words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return sorted((w, *row) for w, row in out.items())


def mutate(rng, w, letters):
    k = rng.randrange(len(w) + 1)
    return rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]])


@pytest.mark.parametrize("seed", range(5))
def test_sorted_list_walk(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(150)})
    assert set(spelling._near(words)) == {(i, j) for i, u in enumerate(words) for j, v in enumerate(words) if i < j and near(u, v)}


@pytest.mark.parametrize("most", [2, 5, 2000])
def test_pairs_of_any_list_size(spark, most):
    rng = random.Random(most)
    # a third of the words start alike, and letters repeat
    words = {"aaaaaaa" + "".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(80)}
    words |= {"".join(rng.choice("abÿ") for _ in range(rng.randrange(7, 11))) for _ in range(150)}
    words |= {w for w in (mutate(rng, w, "abz") for w in list(words)) if len(w) >= 7}
    df = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n long")
    got = spelling.near_pairs(df, 7, most).collect()
    counts = {r.word: r.n for r in df.collect()}
    assert len(got) == len(set(got))
    assert {(r.word, r.near, r.near_n) for r in got} == {(u, v, counts[v]) for u in words for v in words if near(u, v)}


def test_forms_and_roots(spark):
    rng = random.Random(1)
    stock = ["".join(rng.choice("abcdefghà÷") for _ in range(rng.randrange(7, 12))) for _ in range(25)]
    docs = [(i, " ".join(rng.choice(stock if rng.random() < 0.97 else [mutate(rng, w, "abc") for w in stock]) for _ in range(60))) for i in range(120)]
    chain = "elephant " * 400 + "elephamt " * 30 + "elephamd " * 2 + "Elephant,ELEPHANT"
    docs += [(None, chain), (None, None), (7, ""), (7, docs[3][1]), (8, "short words only"), (9, "x" * 30_000 + " " + "x" * 30_000), (9, "x" * 30_000)]
    df = spark.createDataFrame([(i, t, "w", 3) for i, t in docs], "doc_id int, text string, word string, n int")
    rows = spelling.group(df)
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got, wanted = sorted(map(tuple, rows.collect()), key=lambda r: r[0]), brute(docs)
    assert got == wanted
    roots = {r[0]: r[1:3] for r in wanted}
    assert any(form and form != root for form, root in roots.values())
    assert spelling.group(df.limit(0)).collect() == []
