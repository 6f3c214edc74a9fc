"""Spelling variants: words one edit apart, found on sorted lists by dynamic programming.

Two words one edit apart agree on the first half of the shorter one or on its second half, so every
word is listed under its halves. A list is sorted; for each of its words the others are walked in order
with a band of the edit matrix, whose rows stand for prefixes: those of the prefix shared with the word
before are kept, and a prefix already more than one edit away skips all words that start with it.
Lists above a size are split by the halves of what is left, down to single letters.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_view, materialize, prepare

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = "\U0010ffff"


# ---------------------------------------------------------------- vocabulary
def deleted(doc_id: Column, run: Column, one_in: int) -> Column:
    """``run``, or in one of ``one_in`` (document, run) pairs without one of its letters: the test's own typing errors."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, twice: int = 2, one_in: int = 31) -> DataFrame:
    """word, n: runs of letters of whole texts, A-Z in lower case, of ``least`` code points and ``twice`` occurrences."""
    view = column_view(docs, doc_id=id_col, text=text_col)
    # shorter runs never give a word; counted before the shuffle
    runs = view.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    word = deleted(F.col("doc_id"), F.translate("run", UPPER, LOWER), one_in)
    return (runs.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
            .where(F.col("n") >= twice))


# ---------------------------------------------------------------- pairs
def _split(rows: DataFrame) -> DataFrame:
    """Each row under the first and under the second half of what its list hasn't compared yet.

    A list of class ``size`` holds words of that many letters and of one more, which agree on the first
    ``a`` and the last ``b``. Pairs that agree on the first half belong to it alone: ``unlike`` keeps
    where words under the second half have to differ.
    """
    left = F.col("size") - F.col("a") - F.col("b")
    half = F.floor(left / 2).cast("int")
    spot = F.struct(F.col("a").alias("at"), half.alias("len"))
    first = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"), F.col("unlike").alias("unlike"))
    second = F.struct(F.col("a").alias("a"), (F.col("b") + left - half).alias("b"), F.concat("unlike", F.array(spot)).alias("unlike"))
    out = rows.select("word", "n", "size", F.explode(F.array(first, second)).alias("x")).select("word", "n", "size", "x.*")
    key = F.concat_ws(":", "size", "a", "b", F.substring("word", F.lit(1), F.col("a")), F.expr("right(word, b)"))
    return out.withColumn("list", key)


def lists(vocab: DataFrame, least: int, most: int) -> DataFrame:
    """Rows of ``_split`` in lists of at most ``most`` words, or of words that agree on all but one or two letters.

    Such a last list is bounded by the alphabet, so no list can hold a share of all words.
    """
    of = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")
    rows = vocab.select("word", "n", of).where(F.col("size") >= least).select(
        "*", F.lit(0).alias("a"), F.lit(0).alias("b"), F.array().cast("array<struct<at:int,len:int>>").alias("unlike"))
    done = None
    while True:
        rows = materialize(_split(rows))
        large = materialize(rows.where("size - a - b > 1").groupBy("list").count().where(F.col("count") > most).select("list"))
        last = large.isEmpty()
        small = rows if last else rows.join(large, "list", "left_anti")
        done = small if done is None else done.unionByName(small)
        if last:
            return done
        rows = rows.join(large, "list", "left_semi")


def _shared(a: str, b: str) -> int:
    k, end = 0, min(len(a), len(b))
    while k < end and a[k] == b[k]:
        k += 1
    return k


def _near(words: list[str]) -> Iterator[tuple[int, int]]:
    """Positions i < j of sorted distinct ``words`` that are one edit apart."""
    adjacent = [0, *(_shared(p, q) for p, q in zip(words, words[1:]))]
    for i, query in enumerate(words):
        n = len(query)
        # row d: edits between the first d letters of a word and the first d-1, d, d+1 of the query, 2 for
        # more; those of the query's own prefixes serve the words after it
        rows = [(2, 0, 1), *[(1, 0, 1)] * n]
        rows[n] = (*rows[n][:2], 2)
        last, j = i, i + 1
        while j < len(words):
            word = words[j]
            shared = adjacent[j] if j == last + 1 else _shared(words[last], word)
            del rows[shared + 1:]
            last = j
            for d in range(len(rows), len(word) + 1):
                (low, mid, high), c = rows[-1], word[d - 1]
                left = min(low + (c != query[d - 2]), mid + 1, 2) if d <= n + 1 else 2
                here = min(mid + (c != query[d - 1]), high + 1, left + 1, 2) if d <= n else 2
                right = min(high + (c != query[d]), here + 1, 2) if d < n else 2
                if min(left, here, right) > 1:
                    # nothing that starts like this is near
                    j = bisect_left(words, word[:d] + _LAST, j + 1)
                    break
                rows.append((left, here, right))
            else:
                at = n - len(word) + 1
                if 0 <= at <= 2 and rows[-1][at] == 1:
                    yield i, j
                j += 1


def near_pairs(vocab: DataFrame, least: int = 7, most: int = 2000) -> DataFrame:
    """word, near, near_n: all pairs one inserted, deleted or replaced code point apart, both ways, each once.

    ``vocab`` has distinct words of at least ``least`` letters with a count n.
    """
    prepare(vocab.sparkSession)
    dealt = lists(vocab, least, most).repartition("list").withColumn(
        "middle", F.expr("substring(word, a + 1, length(word) - a - b)")).sortWithinPartitions("list", "middle")

    def scan(batches):
        name, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("list", "middle", "word", "n", "size", "unlike"))):
                if row[0] != name:
                    yield from _pairs(held)
                    name, held = row[0], []
                held.append(row[1:])
        yield from _pairs(held)
    return dealt.select("list", "middle", "word", "n", "size", "unlike").mapInArrow(scan, "word string, near string, near_n long")


def _pairs(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    if len(held) < 2:
        return
    size, unlike = held[0][3], held[0][4]
    out = ([], [], [])
    for i, j in _near([h[0] for h in held]):
        u, v = held[i][1], held[j][1]
        # two longer words are a pair of the next class; likeness is left to the list of that half
        if min(len(u), len(v)) > size or any(u[s["at"]:s["at"] + s["len"]] == v[s["at"]:s["at"] + s["len"]] for s in unlike):
            continue
        for a, b in ((i, j), (j, i)):
            out[0].append(held[a][1])
            out[1].append(held[b][1])
            out[2].append(held[b][2])
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])


# ---------------------------------------------------------------- forms
def variants(vocab: DataFrame, pairs: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n; one row per word of ``vocab``."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    formed = -F.col("best.less") >= times * F.col("n")
    words = materialize(vocab.join(near, "word", "left").select(
        "word", F.when(formed, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, -F.col("best.less")).alias("form_n")))
    # counts grow at least ``times``-fold along forms, so doubling the steps ends after a few rounds
    steps = materialize(words.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = materialize(steps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if steps.where("moved").isEmpty():
            break
        steps = steps.drop("moved")
    return words.join(steps.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, twice: int = 2, one_in: int = 31,
          times: int = 10, most: int = 2000) -> DataFrame:
    """word, form, root, n, n_near, form_n; one row per word of the texts.

    Null texts have no words, and a null id counts as empty where ids choose the deleted letters; rows
    that repeat an id count as often as they stand there. Of near words with the same count the first in
    code-point order is the form. An empty table gives no row; other columns are ignored.
    """
    vocab = materialize(vocabulary(docs, id_col, text_col, least, twice, one_in))
    return variants(vocab, near_pairs(vocab, least, most))
