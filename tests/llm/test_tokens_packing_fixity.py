"""Wavelet shards, packing and the audit against plain Python."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pitpanel.llm import fixity, packing, wavelet

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(3, "the cat sat on the mat", "x"), (1, None, "x"), (7, "", "x"), (5, "the the the", "x"), (9, "the cat sat on the mat", "x"),
        (12, "x1 " * 6_000, "x"), (None, "no id", "x"), (5, "the other five", "x")]


def ids_of(path, text):
    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_holds_each_id_once_without_gaps(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, sequence_id string")
    got = packing.pack(packing.tokenize(df, BYTES)).collect()
    want = Counter()
    for i, text, _ in ROWS:
        ids = ids_of(BYTES, text)
        at = 0
        while at < len(ids):
            sizes = {r["length"] for r in got if (r["doc_id"], r["start"], r["doc_tokens"]) == (i, at, len(ids))
                     and r["ids_crc32"] == crc(ids[at:at + r["length"]])}
            assert sizes, (i, at)
            size = max(sizes)
            want[i, at, size, crc(ids[at:at + size]), len(ids)] += 1
            at += size
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.tokenize(df.limit(0), BYTES)).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_matrix_answers_access_rank_select_and_count(seed):
    rng = np.random.default_rng(seed)
    for n, most in ((0, 4), (1, 1), (64, 2), (65, 9), (700, 50), (1025, 60_000), (513, 1 << 18)):
        ids = rng.integers(0, most, n).astype(np.uint32)
        matrix = wavelet.WaveletMatrix.build(ids)
        assert matrix.decode().tolist() == ids.tolist()
        for token in {0, most, 1 << 20, *ids[:20].tolist()}:
            at = np.flatnonzero(ids == token).tolist()
            assert matrix.count(token) == len(at) and matrix.occurrences(token) == at
            assert [matrix.select(token, k) for k in range(len(at))] == at
            assert [matrix.rank(token, end) for end in (0, n // 2, n, n + 9)] == [int((ids[:end] == token).sum()) for end in (0, n // 2, n, n + 9)]
            with pytest.raises(IndexError):
                matrix.select(token, len(at))
        assert [matrix.access(i) for i in range(min(n, 40))] == ids[:40].tolist()
        with pytest.raises(IndexError):
            matrix.access(n)


def test_shards_read_back_hold_every_document_and_find_tokens(spark, scratch):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string, n_tokens string")
    wavelet.write_shards(df, scratch, WORDS, shard_tokens=50, parts=3)
    shards = spark.read.parquet(scratch)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    stream, want = [], []
    for i, text, _ in order:
        ids = ids_of(WORDS, text)
        want.append((i, len(stream), len(ids), crc(ids)))
        stream += ids
    got = wavelet.read_documents(shards).collect()
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in got), key=lambda r: r[1]) == want
    for token in (1, stream[0], stream[-2], 2):
        assert sorted(r["place"] for r in wavelet.find_token(shards, token).collect()) == [i for i, t in enumerate(stream) if t == token]
    assert wavelet.token_file_digests(df.limit(0), WORDS).collect() == []


def test_audit_tells_changed_missing_added_null_and_repeated_keys(spark):
    schema = "id bigint, body string, status string, node int"
    old = [(i, f"b{i}", "s", 0) for i in range(300)] + [(None, "n", "s", 0), (400, "x", "s", 0), (400, "y", "s", 0), (401, "x", "s", 0), (402, None, "s", 0)]
    new = [r for r in old if r[0] not in (17, 250, 402)]
    new = [(r[0], "other" if r[0] in (5, 299) else r[1], *r[2:]) for r in new]
    new += [(1000, "late", "s", 0), (-4, "early", "s", 0), (401, "x", "s", 0), (None, "n2", "s", 0), (402, "", "s", 0)]
    a, b = (spark.createDataFrame(rows, schema) for rows in (old, new))
    want = {(5, "changed"), (299, "changed"), (17, "missing"), (250, "missing"), (1000, "added"), (-4, "added"),
            (401, "changed"), (None, "changed"), (402, "changed")}
    for fan in (2, 64):
        assert {(r["id"], r["status"]) for r in fixity.audit(a, b, "id", ["body"], fan).collect()} == want
    # the order of rows doesn't matter, that of repeated keys neither
    assert fixity.audit(a, spark.createDataFrame(old[::-1], schema), "id", ["body"]).collect() == []
    assert fixity.audit(a.limit(0), b.limit(0), "id", ["body"]).collect() == []
