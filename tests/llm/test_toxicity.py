"""Toxicity: gradients, windows, batches and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from pitpanel.llm import toxicity as T

BAD, GOOD = "you vile rotten filthy fool go away", "the river runs past seven quiet green hills"


def _rows(n=24):
    return [(f"{BAD if i % 2 else GOOD} number {i} and {'x' * (i % 5)} more words", i % 2) for i in range(n)]


def test_gradients_equal_finite_differences():
    net = T.Network(5, {"vile": 1, "river": 2})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vocabulary, ids, mask, _ = T._batch([BAD.encode().split(), (GOOD + " " + BAD * 6).encode().split()])

    def loss():
        x = net.embed(vocabulary)
        return x, *net.forward(net.project(x), ids, mask, keep=True)

    x, logit, held = loss()
    grads = net.backward(x, vocabulary, ids, mask, held, np.ones(len(logit), np.float32))
    gen = np.random.default_rng(1)
    for name, g in grads.items():
        flat, value = np.asarray(g).reshape(-1), net.p[name].reshape(-1)
        moving = np.flatnonzero(np.abs(flat) > 1e-3)
        for i in gen.permutation(moving)[:4]:
            kept, out = value[i], []
            for step in (1e-2, -1e-2):
                value[i] = kept + step
                out.append(float(loss()[1].astype(np.float64).sum()))
            value[i] = kept
            assert np.isclose((out[0] - out[1]) / 2e-2, flat[i], rtol=0.05, atol=2e-3), (name, i)


def test_highest_window_equals_a_plain_loop_over_all_windows():
    net = T.train(_rows())
    texts = [None, "", "  \n", BAD, " ".join([GOOD] * 9 + [BAD]), " ".join([GOOD] * 2_000 + [BAD, GOOD]), BAD, "é" * 5_000]
    together = T.Scorer(net, block=64).logits(texts)

    def plain(text):
        words = (text or "").encode().split()
        starts = [0] if 0 < len(words) <= T.SPAN else [*range(0, len(words) - T.SPAN, T.STRIDE), len(words) - T.SPAN] if words else []
        best = -np.inf
        for s in starts:
            vocabulary, ids, mask, _ = T._batch([words[s:s + T.SPAN]])
            best = max(best, float(net.forward(net.project(net.embed(vocabulary)), ids, mask)[0][0]))
        return best

    assert np.allclose(together, [plain(t) for t in texts], atol=1e-4)
    assert together[3] == together[6]
    assert np.array_equal(T.Scorer(net, block=64).logits(texts[3:6]), together[3:6])  # the texts beside don't matter
    assert np.allclose(T.Scorer(net, most=8, block=64).logits(texts), together, atol=1e-5)  # a forgetful scorer


def test_labelled_rows_are_chosen_whole_and_once(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(_rows(40))] + [(3, _rows(4)[3][0]), (5, "z " * 9_000), (None, "a"), (7, None)],
                                 "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (2, None), (4, 1)], "doc_id bigint, label int")
    got = T.labelled(docs, labels, 1_000, 10_000)
    held = {r[0] for r in spark.range(40).where(F.crc32(F.col("id").cast("string")) % 3 == 1).collect()}
    want = sorted((t, 1 if i in (4,) else i % 2) for i, (t, _) in enumerate(_rows(40)) if i not in held)
    assert sorted(got) == want
    assert len(T.labelled(docs, labels, 4, 10_000)) == 8 and T.labelled(docs, labels, 4, 10_000) == T.labelled(docs, labels, 4, 10_000)


def test_scores_of_odd_rows(spark):
    rows = [(i, t, "score") for i, (t, _) in enumerate(_rows(60))]
    rows += [(None, BAD, "s"), (100, None, "s"), (101, "", "s"), (102, " \t\n", "s"), (1, rows[1][1], "s"), (103, (GOOD + " ") * 4_000 + BAD, "s"), (104, (GOOD + " ") * 4_001, "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    got = T.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["score"] for i in (100, 101, 102)] == [0, 0, 0] and not by_id[None]["held_out"]
    assert by_id[103]["score"] > by_id[104]["score"]  # the last words of a long text count
    held = [r for r in got if r["held_out"] and r["doc_id"] < 60]
    assert held and all(r["predicted"] == r["doc_id"] % 2 for r in held)
    assert T.score(docs.limit(0), labels).count() == 0
    assert T.score(docs, labels.limit(0)).count() == len(rows)
