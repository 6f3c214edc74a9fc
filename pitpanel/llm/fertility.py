"""Quality rules from tokeniser fertility, next to plain repetition and length rules.

A public vocabulary with byte fallback is run over every word of every text. Three measures tell
language from noise: code points per token, the share of tokens that are bare bytes, and the entropy
of the token distribution against what its length predicts. Each language, or script where a language
is unknown, has bands per length around its own middle; a document beyond a band is rejected.
"""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, column_view, materialize, mix64, prepare

MEASURES = ("chars_per_token", "fallback_share", "entropy")
JUDGED = ("chars_per_token", "fallback_share", "entropy_excess")
STATS = ("doc_id bigint, lang string, script string, n_words bigint, word_chars bigint, n_symbols bigint, "
         "n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, n_fallback bigint, token_entropy double")
WINDOW = 5

_SPACES = np.zeros(256, np.int64)
_SPACES[[0x20, *range(0x09, 0x0E)]] = 1
_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1


class _Pieces(dict):
    """Word to its piece ids as unsigned 16-bit integers; bounded memory."""

    def __init__(self, model_file: str, most: int = 400_000):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.most = most
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[word] = ids = array("H", self.model.encode(word.decode(), num_threads=1)).tobytes()
        return ids


_OPEN: dict[str, _Pieces] = {}


def _script(text: str | None) -> str:
    """Most frequent script among the first letters of words, by the Unicode names of letters."""
    seen: dict[str, int] = {}
    for word in set((text or "").split()):
        if word[0].isalpha():
            name = unicodedata.name(word[0], "OTHER").split(" ")[0]
            seen[name] = seen.get(name, 0) + 1
    return min(seen, key=lambda s: (-seen[s], s)) if seen else "NONE"


def repeat_words(h: np.ndarray, codes: np.ndarray) -> int:
    """Words that lie in a window found twice or more; ``h`` hashes of windows, ``codes`` of words.

    Windows of equal hash are compared word by word, so an accidental collision counts nothing.
    """
    order = np.sort(h)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(h, again))
    windows = codes[at[:, None] + np.arange(WINDOW)]
    _, which, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    hit = np.zeros(len(codes) + 1, np.int64)
    twice = at[counts[which.ravel()] > 1]
    np.add.at(hit, twice, 1)
    np.add.at(hit, np.minimum(twice + WINDOW, len(codes)), -1)
    return int((np.cumsum(hit)[:-1] > 0).sum())


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                 0x85EBCA77C2B2AE63], np.uint64)  # odd multipliers (fixed values)


def window_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of every run of five word hashes."""
    n = len(codes) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        h = (h ^ codes[i: i + n]) * _ODD[i]
        h ^= h >> np.uint64(29)
    return mix64(h)


def document_stats(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang") -> DataFrame:
    """Counts and fertility measures of every whole text, one row per row of ``docs``.

    A null or empty text has no word: its counts are 0, its entropy is null.
    """
    prepare(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _OPEN:
            _OPEN[vocabulary] = _Pieces(vocabulary)
        pieces, hashes = _OPEN[vocabulary], _HASHES
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                raw = text.encode()
                words = raw.split()
                flat = np.frombuffer(raw, np.uint8)
                seen = np.bincount(flat, minlength=256)
                lines = [x for x in raw.split(b"\n") if x.strip()]
                codes = hashes.array(words)
                ids = np.frombuffer(b"".join(map(pieces.__getitem__, words)), np.uint16)
                entropy = None
                if len(ids):
                    counts = np.bincount(ids)
                    p = counts[counts > 0] / len(ids)
                    entropy = float(-(p * np.log2(p)).sum())
                rows.append((_script(text) if len(words) else "NONE", len(words), len(text) - int(seen @ _SPACES),
                             int(seen @ _SYMBOLS), len(lines) - len(set(lines)),
                             repeat_words(window_hashes(codes), codes), len(ids), int(pieces.is_byte[ids].sum()), entropy))
            cols = list(zip(*rows)) if rows else [[]] * 9
            kinds = [pa.string(), *[pa.int64()] * 7, pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                [f.split()[0] for f in STATS.split(", ")])

    view = column_view(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("lang", F.col("lang").cast("string"))
    return view.mapInArrow(measure, STATS)


_HASHES = WordHashes()


def _quartiles(stats: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """Count, median length and quartiles of each measure per group, from partial quantile summaries."""
    aggs = [F.percentile_approx(m, [0.25, 0.75], 10_000).alias(m) for m in JUDGED]
    q = stats.groupBy(*keys).agg(F.count("*").alias(f"{prefix}n"), F.percentile_approx("n_tokens", 0.5).alias(f"{prefix}tokens"), *aggs)
    return q.select(*keys, f"{prefix}n", f"{prefix}tokens", *[
        F.col(m)[i].alias(f"{prefix}{m}_{side}") for m in JUDGED for i, side in enumerate(("q1", "q3"))])


def expected_entropy(stats: DataFrame) -> list[float]:
    """Coefficients, constant first, of the token entropy that a length predicts: a parabola in its logarithm.

    Fitted to the medians of all length classes, weighted by their rows, so that neither noise nor a
    class of one row moves it. There are as many classes as a length has bits.
    """
    rows = stats.groupBy("length_class").agg(
        F.count("*").alias("n"), F.percentile_approx("log_tokens", 0.5, 10_000).alias("x"),
        F.percentile_approx("token_entropy", 0.5, 10_000).alias("y")).orderBy("length_class").collect()
    if not rows:
        return [0.0]
    n, x, y = (np.array([r[c] for r in rows], float) for c in "nxy")
    return np.polynomial.polynomial.polyfit(x, y, min(2, len(rows) - 1), w=np.sqrt(n)).tolist()


def bands(stats: DataFrame, spread: float, prior: int) -> DataFrame:
    """group, script, length_class and the lowest and highest usual value of each measure, for all that occur.

    A band is the middle half of comparable rows, widened ``spread`` times its width on both sides. Rows
    compare within their group and length class; the fewer there are, the more their quartiles give way
    to those of the group (whose width is taken to grow as the root of the length falls), and the group's
    to those of its script. A script has its own middle, as scripts differ in kind; the width of a small
    one gives way to that of all rows. ``prior`` is the number of rows at which both weigh the same;
    widths of small groups and scripts grow up to threefold. So every row has a band at any size.
    """
    whole = _quartiles(stats, [], "a_")
    by_script, by_group = _quartiles(stats, ["script"], "s_"), _quartiles(stats, ["group"], "g_")
    by_class = _quartiles(stats, ["group", "length_class"], "c_")
    t = (stats.select("group", "script", "length_class").distinct().join(by_class, ["group", "length_class"])
         .join(by_group, "group").join(by_script, "script").crossJoin(whole))

    def blend(n, own, parent):
        return own + (parent - own) * (prior / (F.col(n) + prior))  # exactly the value where both agree

    def wider(n):
        return 1 + 2 * prior / (F.col(n) + prior)

    out = []
    for m in JUDGED:
        (a1, a3), (s1, s3), (g1, g3), (c1, c3) = ((F.col(f"{p}_{m}_q1"), F.col(f"{p}_{m}_q3")) for p in "asgc")
        width = blend("s_n", s3 - s1, a3 - a1) * wider("s_n")
        width = blend("g_n", g3 - g1, width) * wider("g_n")
        low, high = blend("g_n", g1, s1), blend("g_n", g3, s3)
        shorter = F.sqrt(F.greatest(F.lit(1.0), F.col("g_tokens") / F.col("c_tokens")))
        # many copies can leave a class without width
        width = F.greatest(blend("c_n", c3 - c1, width * shorter), width / 2)
        out += [(blend("c_n", c1, low) - spread * width).alias(f"{m}_low"), (blend("c_n", c3, high) + spread * width).alias(f"{m}_high")]
    return t.select("group", "script", "length_class", *out)


def quality(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            spread: float = 3.0, fallback_floor: float = 0.02, prior: int = 10, min_words: int = 10,
            max_repeat_percent: int = 20) -> DataFrame:
    """Measures and verdict of every document; one row per row of ``docs``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of them in
    repeated five-word windows. Otherwise a document is kept unless a measure lies outside the band of
    its language and length (``bands``), which come from the rows that pass the base rules; rows without a language are compared with those of their script.
    Every text with words is judged, whatever its length and its language's number of documents.
    ``entropy_excess`` is what the token entropy has beyond the one its length predicts, and is judged
    under the reason entropy; ``entropy`` is the share of the most its length allows. The share of byte
    fallback must also pass ``fallback_floor``, as most languages have next to none, and be more than one
    character of four bytes. ``reason`` names the first broken rule. Null and empty texts fail the base
    rules. A text alone in its script has only itself to be compared with.
    """
    stats = document_stats(docs, vocabulary, id_col, text_col, lang_col)
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    log = F.log2(n.cast("double"))
    stats = materialize(
        stats.withColumn("chars_per_token", F.col("word_chars") / n).withColumn("fallback_share", F.col("n_fallback") / n)
        .withColumn("entropy", F.coalesce(F.col("token_entropy") / F.greatest(log, F.lit(1.0)), F.lit(0.0)))
        .withColumn("log_tokens", log).withColumn("length_class", F.floor("log_tokens").cast("int"))
        .withColumn("group", F.coalesce(F.concat(F.lit("lang "), "lang"), F.concat(F.lit("script "), "script"))))
    base = F.when(F.col("n_words") < min_words, "few_words").when(
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"), "repeated_words")
    # rows that fail the base rules say nothing about usual texts
    stats = stats.withColumn("base", base)
    measured = stats.where("n_tokens > 0 AND base IS NULL")
    expected = F.lit(0.0)
    for c in reversed(expected_entropy(measured)):
        expected = expected * F.col("log_tokens") + F.lit(c)
    stats = stats.withColumn("entropy_excess", F.coalesce(F.col("token_entropy") - expected, F.lit(0.0)))
    band = materialize(bands(stats.where("n_tokens > 0 AND base IS NULL"), spread, prior))
    # one row per language, script and length class; adaptive joins size it
    judged = stats.join(band, ["group", "script", "length_class"], "left")
    verdict = F.when(F.col("base").isNotNull(), F.col("base"))
    for m in JUDGED:
        out = F.col(m) > F.col(f"{m}_high")
        if m == "fallback_share":
            out = out & (F.col(m) > fallback_floor) & (F.col("n_fallback") > 4)
        else:
            out = out | (F.col(m) < F.col(f"{m}_low"))
        verdict = verdict.when(out, "entropy" if m == "entropy_excess" else m)
    return (judged.withColumn("base_failed", F.col("base").isNotNull()).withColumn("reason", verdict)
            .withColumn("kept", F.col("reason").isNull())
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                    "reason", "lang", "script", "n_tokens", *MEASURES, "entropy_excess"))
