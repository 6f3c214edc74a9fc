"""Preference pairs against plain Python, on rows in odd order, ties, nulls and conversations over several ranges."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from pitpanel.llm import chat
from pitpanel.llm.tokens import segments

SCHEMA = "conv_id bigint, turn int, role string, text string, side string"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def brute(chosen, rejected, end_id=1):
    """conv_id to n_shared_turns, prompt, (ids, mask) of both sides."""
    sides = [defaultdict(list), defaultdict(list)]
    for held, rows in zip(sides, (chosen, rejected), strict=True):
        for conv, turn, role, text, _ in rows:
            if conv is not None:
                held[conv].append((turn is not None, turn or 0, role or "", text or ""))
    encode = lambda t: np.frombuffer(segments(VOCABULARY, spaced=True).ids(t), "<u4").tolist()
    draw = lambda t: f"<{t[2]}>\n{t[3]}\n"
    out = {}
    for conv in sides[0].keys() & sides[1].keys():
        x, y = (sorted(s[conv]) for s in sides)
        k = 0
        while k < min(len(x), len(y)) and x[k][2:] == y[k][2:]:
            k += 1
        if k == len(x) == len(y):
            continue
        both = []
        for turns in (x, y):
            ids, mask = [], []
            for i, t in enumerate(turns):
                new = encode(draw(t))
                ids += new
                mask += [int(i >= k and t[2] == "assistant")] * len(new)
            both.append((ids + [end_id], mask + [1]))
        out[conv] = (k, "".join(map(draw, x[:k])), *both)
    return out


def laid(rows):
    """The same from rows of preference_turns."""
    held = defaultdict(list)
    for r in rows:
        held[r.conv_id].append(r)
    out = {}
    for conv, turns in held.items():
        turns.sort(key=lambda r: r["rank"])
        both = []
        for side in ("chosen", "rejected"):
            own = [r for r in turns if r.side in ("prompt", side)]
            assert [r["rank"] for r in own] == list(range(len(own))) and own[-1].role is None
            assert all(len(r.ids) == r.n_tokens for r in own)
            both.append(([i for r in own for i in r.ids], [r.loss for r in own for _ in r.ids]))
        prompt = "".join(f"<{r.role}>\n{r.text}\n" for r in turns if r.side == "prompt")
        out[conv] = (turns[0].n_shared_turns, prompt, *both)
    return out


def tables():
    rng = random.Random(3)
    chosen, rejected = [], []
    for conv in [None, *range(40)]:
        for turn in range(300 if conv == 7 else rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", None])
            row = (conv, turn if rng.random() < 0.9 else 0, role, rng.choice(["hello there", "a\n\n", "", None, f"text {turn}"]), "x")
            if conv != 1:
                chosen.append(row)
            if conv != 2 and not (conv in (3, 7) and turn == (0 if conv == 3 else 290)):
                rejected.append(row if rng.random() < (0.9 if conv != 7 else 1.0) else (*row[:3], "other", "x"))
    rng.shuffle(chosen)
    rng.shuffle(rejected)
    return chosen, rejected


def test_pairs_match_plain_python(spark):
    chosen, rejected = tables()
    a, b = (spark.createDataFrame(rows, SCHEMA) for rows in (chosen, rejected))
    want = brute(chosen, rejected)
    assert len(want) > 10 and 7 in want and 1 not in want and 2 not in want
    assert laid(chat.preference_turns(a, b, VOCABULARY).collect()) == want
    got = {r.conv_id: tuple(r)[1:] for r in chat.pair_counts(chat.preference_turns(a, b, VOCABULARY, with_ids=False)).collect()}
    assert got == {c: (k, hashlib.sha256(p.encode()).hexdigest(), len(x[0]), len(y[0]), sum(x[1]), sum(y[1]))
                   for c, (k, p, x, y) in want.items()}


@pytest.mark.parametrize("conv", [None, 5])
def test_no_row_holds_a_whole_conversation(spark, conv):
    """A null id is no conversation; a long one stays a row per turn."""
    rows = [(conv, t, "user", "word " * 50, "x") for t in range(500)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = chat.preference_turns(df, df.where("turn < 499"), VOCABULARY).collect()
    assert len(got) == (0 if conv is None else 499 + 1 + 2)
    assert all(r.n_shared_turns == 499 and r.n_tokens < 200 for r in got)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.pair_counts(chat.preference_turns(df, df, VOCABULARY, with_ids=False)).collect() == []
