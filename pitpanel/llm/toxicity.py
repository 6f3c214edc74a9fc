"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are hashed words and their character trigrams. A text is read in overlapping windows; its score
is the network's highest over all of them. The model has a fixed size and is trained on the driver on a
bounded sample of labelled rows (``most`` rows per class, texts up to ``most_chars``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_view, mix64, prepare

GRAMS, DIM, HIDDEN = 1 << 12, 8, 8
LEAST, MOST_WORDS = 3, 1 << 14  # training rows that must hold a word to name it; words named
SPAN, STRIDE = 32, 16


Vocabulary = tuple[list[str], np.ndarray, np.ndarray]


def _features(words: list[bytes]) -> Vocabulary:
    """Plain form of each word, the hashed trigrams of all in a row, and their number per word."""
    plain = [w.decode("utf-8", "replace").lower().strip(".,;:!?\"'()|") for w in words]
    chars = np.frombuffer("".join([f"<{w or ' '}>" for w in plain]).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.maximum(np.fromiter(map(len, plain), np.int64, len(plain)), 1)
    ends = np.cumsum(sizes + 2)
    within = np.ones(len(chars), bool)
    within[ends - 1] = within[ends - 2] = False  # no trigram goes past its word
    at = np.flatnonzero(within)
    code = chars[at] | chars[at + 1] << np.uint64(21) | chars[at + 2] << np.uint64(42)
    return plain, (mix64(code) & np.uint64(GRAMS - 1)).astype(np.int64), sizes


def _sums(rows: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``rows`` by their place in an array of ``n``."""
    order = np.argsort(where, kind="stable")
    at = where[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(at):
        out[at[starts]] = np.add.reduceat(rows[order], starts)
    return out


def _windows(n: int) -> np.ndarray:
    """Starts of the windows over ``n`` words; the last ends with the text."""
    if n <= SPAN:
        return np.zeros(min(n, 1), np.int64)
    return np.append(np.arange(0, n - SPAN, STRIDE), n - SPAN)


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters ``p`` and their gradients; hidden states run both ways over each window."""

    def __init__(self, seed: int = 3, words: dict[str, int] | None = None):
        self.words = words or {}  # row 0: any other word
        g = np.random.default_rng(seed)
        init = lambda *s: (g.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {"words": init(len(self.words) + 1, DIM) * 0.1, "grams": init(GRAMS, DIM) * 0.1,
                  "attend": init(2 * HIDDEN, HIDDEN), "pick": init(HIDDEN), "out": init(2 * HIDDEN),
                  "bias": np.full(1, -1, np.float32)}
        for d in "fb":
            self.p |= {f"{d}_in": init(2 * DIM, 3 * HIDDEN), f"{d}_rec": init(HIDDEN, 3 * HIDDEN),
                       f"{d}_bias": np.zeros(3 * HIDDEN, np.float32)}

    def embed(self, vocabulary: Vocabulary) -> np.ndarray:
        """A row per word: its own vector and the mean of its trigrams'."""
        names, flat, sizes = vocabulary
        grams = np.add.reduceat(self.p["grams"][flat], np.cumsum(sizes) - sizes) / sizes[:, None]
        return np.hstack([self.p["words"][self._known(names)], grams]).astype(np.float32)

    def _known(self, names: list[str]) -> np.ndarray:
        return np.array([self.words.get(w, 0) for w in names], np.int64)

    def _run(self, d: str, table: np.ndarray, ids: np.ndarray, live: np.ndarray, keep: bool):
        """States of one direction; ``table`` has projected inputs, ``ids`` (window, place) their rows, ``live`` 1 for a word."""
        p, n, H = self.p, len(ids), HIDDEN
        h, out, kept = np.zeros((n, H), np.float32), np.zeros((n, SPAN, H), np.float32), []
        places, live = np.ascontiguousarray(ids.T), np.ascontiguousarray(live.T)[:, :, None]
        gates, fresh = np.ascontiguousarray(p[f"{d}_rec"][:, :2 * H]), np.ascontiguousarray(p[f"{d}_rec"][:, 2 * H:])
        for t in range(SPAN) if d == "f" else reversed(range(SPAN)):
            x = table.take(places[t], axis=0)
            zr = _sigmoid(x[:, :2 * H] + h @ gates)
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(x[:, 2 * H:] + (r * h) @ fresh)
            if keep:
                kept.append((t, h, z, r, c))
            h = h + live[t] * z * (c - h)
            out[:, t] = h
        return out, kept

    def forward(self, table: dict[str, np.ndarray], ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logit per window; ``table`` has the words' projections, ``ids`` (window, place) their rows."""
        p = self.p
        live = mask.astype(np.float32)
        sides = [self._run(d, table[d], ids, live, keep) for d in "fb"]
        states = np.concatenate([s for s, _ in sides], 2)
        u = np.tanh(states @ p["attend"])
        a = np.where(mask, u @ p["pick"], -1e9)
        a = np.exp(a - a.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = np.matmul(a[:, None], states)[:, 0]
        logit = pooled @ p["out"] + p["bias"][0]
        return logit, (sides, states, u, a, pooled) if keep else None

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: (x @ self.p[f"{d}_in"] + self.p[f"{d}_bias"]).astype(np.float32) for d in "fb"}

    def backward(self, x, vocabulary, ids, mask, held, d_logit) -> dict[str, np.ndarray]:
        """Gradients of all parameters for a gradient per window logit."""
        p, H = self.p, HIDDEN
        sides, states, u, a, pooled = held
        g = {"out": d_logit @ pooled, "bias": np.array([d_logit.sum()])}
        d_pool = d_logit[:, None] * p["out"]
        d_states = a[:, :, None] * d_pool[:, None]
        d_a = np.einsum("nh,nth->nt", d_pool, states)
        d_e = a * (d_a - (a * d_a).sum(1, keepdims=True))
        g["pick"] = np.einsum("nt,nth->h", d_e, u)
        d_u = d_e[:, :, None] * p["pick"] * (1 - u * u)
        g["attend"] = np.einsum("nti,ntj->ij", states, d_u)
        d_states = d_states + d_u @ p["attend"].T
        d_x = np.zeros_like(x)
        for i, d in enumerate("fb"):
            rec, d_in = p[f"{d}_rec"], np.zeros((*ids.shape, 3 * H), np.float32)
            g[f"{d}_rec"], carry = np.zeros_like(rec), np.zeros((len(ids), H), np.float32)
            for t, h, z, r, c in reversed(sides[i][1]):
                total = carry + d_states[:, t, i * H:(i + 1) * H]
                dh = np.where(mask[:, t, None], total, 0)
                dc = dh * z * (1 - c * c)
                d_rh = dc @ rec[:, 2 * H:].T
                gates = np.hstack([dh * (c - h) * z * (1 - z), d_rh * h * r * (1 - r)])
                g[f"{d}_rec"] += np.hstack([h.T @ gates, (r * h).T @ dc])
                carry = np.where(mask[:, t, None], dh * (1 - z) + d_rh * r + gates @ rec[:, :2 * H].T, total)
                d_in[:, t] = np.hstack([gates, dc])
            d_proj = _sums(d_in.reshape(-1, 3 * H), ids.ravel(), len(x))
            g[f"{d}_in"], g[f"{d}_bias"] = x.T @ d_proj, d_proj.sum(0)
            d_x = d_x + d_proj @ p[f"{d}_in"].T
        names, flat, sizes = vocabulary
        g["words"] = _sums(d_x[:, :DIM], self._known(names), len(p["words"]))
        g["grams"] = _sums(np.repeat(d_x[:, DIM:] / sizes[:, None], sizes, axis=0), flat, GRAMS)
        return g


def _batch(texts: list[list[bytes]]):
    """Vocabulary, word rows and mask per window, and the text of each window."""
    index: dict[bytes, int] = {}
    ids, masks, owner = [], [], []
    for i, words in enumerate(texts):
        rows = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
        starts = _windows(len(rows))
        places = starts[:, None] + np.arange(SPAN)
        mask = places < len(rows)
        if len(rows):
            ids.append(rows[np.minimum(places, len(rows) - 1)])
            masks.append(mask)
            owner.append(np.full(len(starts), i))
    if not ids:
        return _features([]), np.zeros((0, SPAN), np.int64), np.zeros((0, SPAN), bool), np.zeros(0, np.int64)
    return _features(list(index)), np.concatenate(ids), np.concatenate(masks), np.concatenate(owner)


def train(rows: list[tuple[str | None, int]], epochs: int = 3, size: int = 16, rate: float = 0.01, seed: int = 3) -> Network:
    """A network fitted to (text, label) rows by the highest of each text's windows.

    First components of the embeddings start at the smoothed log odds of a word or trigram in toxic rows.
    Without rows of both labels the network stays as drawn.
    """
    gen = np.random.default_rng(seed)
    data = [((t or "").encode().split(), int(y)) for t, y in rows]
    data = [(w, y) for w, y in data if w]
    total = np.bincount([y for _, y in data], minlength=2)[:2]
    if not total.all():
        return Network(seed)
    seen: dict[str, np.ndarray] = {}
    grams = np.zeros((GRAMS, 2))
    for words, y in data:
        names, flat, _ = _features(list(set(words)))
        for w in set(names):
            seen.setdefault(w, np.zeros(2))[y] += 1
        grams[np.unique(flat), y] += 1
    # a word of one or two rows would only name these rows
    named = sorted((w for w, c in seen.items() if c.sum() >= LEAST), key=lambda w: (-seen[w].sum(), w))[:MOST_WORDS]
    net = Network(seed, {w: i + 1 for i, w in enumerate(named)})
    for k, c in (("words", np.array([[0, 0], *[seen[w] for w in named]])), ("grams", grams)):
        odds = np.log((c[:, 1] + 0.5) / (total[1] + 1)) - np.log((c[:, 0] + 0.5) / (total[0] + 1))
        net.p[k][:, 0] = np.clip(odds * (c.sum(1) >= LEAST), -3, 3)
    first = {k: np.zeros_like(v, dtype=np.float64) for k, v in net.p.items()}
    second, step = {k: np.zeros_like(v, dtype=np.float64) for k, v in net.p.items()}, 0
    weight = (total.sum() / (2 * total)).astype(np.float32)
    for _ in range(epochs):
        order = gen.permutation(len(data))
        for at in range(0, len(order), size):
            part = [data[i] for i in order[at:at + size]]
            vocabulary, ids, mask, owner = _batch([w for w, _ in part])
            x = net.embed(vocabulary)
            table = net.project(x)
            logit, _ = net.forward(table, ids, mask)
            # a text is judged by its highest window, so that window learns
            top = np.array([np.flatnonzero(owner == i)[logit[owner == i].argmax()] for i in range(len(part))])
            y = np.array([y for _, y in part])
            logit, held = net.forward(table, ids[top], mask[top], keep=True)
            d = ((_sigmoid(logit) - y) * weight[y] / len(part)).astype(np.float32)
            ids, mask = ids[top], mask[top]
            step += 1
            for k, g in net.backward(x, vocabulary, ids, mask, held, d).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                net.p[k] = (net.p[k] - rate * move).astype(np.float32)
    return net


class Scorer:
    """Scores texts by blocks of windows of many texts.

    A block always has ``block`` rows, so a window's arithmetic doesn't depend on the texts beside it.
    Projections per word are remembered; the memory is bounded and changes no score.
    """

    def __init__(self, net: Network, most: int = 100_000, block: int = 1024):
        self.net, self.most = net, most
        self.index: dict[bytes, int] = {}
        self.table = {d: np.zeros((1024, 3 * HIDDEN), np.float32) for d in "fb"}
        self.ids, self.mask = np.zeros((block, SPAN), np.int64), np.zeros((block, SPAN), bool)
        self.owner, self.used = np.zeros(block, np.int64), 0
        self.best = np.empty(0)

    def _rows(self, words: list[bytes]) -> np.ndarray:
        new = list(dict.fromkeys(w for w in words if w not in self.index))
        if new and len(self.index) + len(new) > self.most:
            self._flush()  # waiting windows point into the table
            self.index.clear()
            new = list(dict.fromkeys(words))
        if new:
            rows, at = self.net.project(self.net.embed(_features(new))), len(self.index)
            for d, t in self.table.items():
                while len(t) < at + len(new):
                    t = np.concatenate([t, np.zeros_like(t)])
                t[at:at + len(new)] = rows[d]
                self.table[d] = t
            self.index.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def _flush(self) -> None:
        if self.used:
            self.mask[self.used:] = False
            logit, _ = self.net.forward(self.table, self.ids, self.mask)
            np.maximum.at(self.best, self.owner[:self.used], logit[:self.used])
            self.used = 0

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """Highest logit over all windows of each text; minus infinity without words."""
        self.best = np.full(len(texts), -np.inf)
        for i, text in enumerate(texts):
            words = (text or "").encode().split()
            if not words:
                continue
            rows, starts, at = self._rows(words), _windows(len(words)), 0
            while at < len(starts):
                to = min(len(starts), at + len(self.ids) - self.used)
                places = starts[at:to, None] + np.arange(SPAN)
                here = slice(self.used, self.used + to - at)
                self.ids[here], self.mask[here] = rows[np.minimum(places, len(rows) - 1)], places < len(rows)
                self.owner[here] = i
                self.used, at = here.stop, to
                if self.used == len(self.ids):
                    self._flush()
        self._flush()
        return self.best

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """From 0 to 1; 0 without words."""
        return _sigmoid(self.logits(texts))


def fit(rows: list[tuple[str | None, int]], threshold: float) -> Network:
    """A network trained on three rows of four, its bias moved so that ``threshold`` parts the fourth best.

    Best: the lowest miss rate plus twice the false-alarm rate.
    """
    net = train([r for i, r in enumerate(rows) if i % 4])
    held = [(t, y) for t, y in rows[::4] if (t or "").split()]
    logits, toxic = Scorer(net).logits([t for t, _ in held]), np.array([y for _, y in held], bool)
    if toxic.any() and not toxic.all():
        at = np.sort(logits)
        cuts = (at[1:] + at[:-1]) / 2
        cost = [(logits[toxic] < c).mean() + 2 * (logits[~toxic] >= c).mean() for c in cuts]
        net.p["bias"] = (net.p["bias"] + np.log(threshold / (1 - threshold)) - cuts[int(np.argmin(cost))]).astype(np.float32)
    return net


def labelled(docs: DataFrame, labels: DataFrame, most: int, most_chars: int) -> list[tuple[str, int]]:
    """At most ``most`` (text, label) rows of each label, in the order of (crc32 of the id, id, md5 of the text).

    Rows are chosen by id and digest alone; only the texts of the chosen ones are then read and sent.
    """
    spark = docs.sparkSession
    crc, md5 = F.crc32(F.col("doc_id").cast("string")), F.md5("text")
    known = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").where(crc % 3 != 1).groupBy("doc_id").agg(F.max("label").alias("label"))
    short = docs.where(F.length("text") <= most_chars)
    usable = (short.where(crc % 3 != 1).select("doc_id", md5.alias("digest")).join(known, "doc_id")
              .groupBy("doc_id", "digest").agg(F.first("label").alias("label")))
    order = [crc, "doc_id", "digest"]
    first, second = (usable.where(F.col("label") == y).orderBy(*order).limit(most) for y in (0, 1))
    chosen = [tuple(r) for r in first.unionByName(second).collect()]  # at most 2 * most rows without texts
    table = spark.createDataFrame(chosen, "doc_id bigint, digest string, label int")
    found = (short.withColumn("digest", md5).join(F.broadcast(table), ["doc_id", "digest"])
             .groupBy("doc_id", "digest").agg(F.first("text").alias("text"), F.first("label").alias("label")).orderBy("label", *order))
    return [(r["text"], r["label"]) for r in found.collect()]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          most: int = 400, most_chars: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per row of ``docs``.

    Labels are learnt from rows whose crc32 of the id modulo 3 is not 1: at most ``most`` of each label, in
    the order of the crc, no longer than ``most_chars``; repeated rows count once. Null labels are skipped; an
    id's greatest label counts. Null and empty texts score 0, a null id is not held out, other columns aren't
    read. An empty table gives no row. No labels at all: an untrained model.
    """
    spark = prepare(docs.sparkSession)
    view = column_view(docs, doc_id=id_col, text=text_col)
    crc = F.crc32(F.col("doc_id").cast("string"))
    rows = labelled(view, column_view(labels, doc_id=id_col, label=label_col), most, most_chars)
    net = spark.sparkContext.broadcast(fit(rows, threshold))  # a fixed size, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(net.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(batch.column(1).to_pylist()), pa.float64())],
                                             ["doc_id", "score"])

    return view.mapInArrow(run, "doc_id bigint, score double").select(
        "doc_id", F.coalesce(crc % 3 == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
