"""Bands of fertility: every text with words is judged, in groups of any size, at any length."""

import random

import public_tokenizers
import pytest
import sentencepiece

from pitpanel.llm import fertility

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string"


def whole_words():
    """Words of six letters that are one token each."""
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    words = [p[1:] for p in pieces if len(p) == 7 and p[0] == "▁" and p[1:].isascii() and p[1:].isalpha() and p[1:].islower()]
    return [w for w in words if len(model.encode(w)) == 1]


def texts(n, words, rng):
    return [" ".join(rng.choice(words) for _ in range(rng.choice([14, 30, 60, 120, 250, 400]))) for _ in range(n)]


def verdicts(spark, rows):
    return {r.doc_id: r.reason for r in fertility.quality(spark.createDataFrame(rows, SCHEMA), VOCABULARY).collect()}


@pytest.mark.parametrize("n", [30, 98, 140])
def test_noise_is_found_in_groups_of_any_size(spark, n):
    rng = random.Random(n)
    words = whole_words()
    common, noise = words[:60], lambda k: " ".join("".join(rng.choice("qxzjkvw") for _ in range(6)) for _ in range(k))
    rows = [(i, t, "xx" if i % 5 else None) for i, t in enumerate(texts(n, common, rng))]
    long, short = (9001, noise(200), "xx"), (9002, noise(12), "xx")
    varied = (9003, " ".join(rng.sample(words, 400)), "xx")
    assert len(words) > 400
    got = verdicts(spark, [*rows, long, short, varied])
    assert got.pop(9001) == "chars_per_token" and got.pop(9002) == "chars_per_token"
    assert got.pop(9003) == "entropy"
    assert set(got.values()) <= {None, "repeated_words"}


def test_alone_alike_null_and_empty(spark):
    words = whole_words()
    text = " ".join(words[:40])
    rows = [(1, text, "xx"), (2, text, None), (3, None, None), (4, "", "xx"), (5, "two words", "yy")]
    assert verdicts(spark, rows) == {1: None, 2: None, 3: "few_words", 4: "few_words", 5: "few_words"}
    assert verdicts(spark, rows[:1]) == {1: None} and verdicts(spark, rows[2:4]) == {3: "few_words", 4: "few_words"}
    assert verdicts(spark, []) == {}
