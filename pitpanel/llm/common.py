"""Helpers shared by the operators: global numbering, stable word hashes, shipping the package."""

from __future__ import annotations

import os

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitpanel.session import ensure_utc, materialize, release, scratch_path

__all__ = ["WordHashes", "column_view", "join_groups", "marks", "materialize", "mix64", "numbered", "prepare", "release", "running_before", "scratch_path",
           "shuffle_partitions", "with_mark"]

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the driver's folder when it isn't installed."""
    ensure_utc(spark)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def column_view(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; extra columns can't clash."""
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in columns.items()])


def numbered(df: DataFrame, keys: list[str | Column], name: str = "pos", parts: int | None = None,
             prefix: str = "_") -> DataFrame:
    """``df`` with its 0-based position in the order of ``keys``.

    Rows are dealt by key range, numbered inside their partition, written once, and shifted by the
    sizes of the partitions before theirs. No task holds more than one range; the table of partition
    sizes has one row per partition, which is what makes its broadcast safe. Full ties are numbered
    in an arbitrary order, fixed by the written table.
    """
    n = parts or shuffle_partitions(df.sparkSession)
    mark, part = f"{prefix}mark", f"{prefix}part"
    dealt = materialize(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                        .withColumn(mark, F.monotonically_increasing_id()))
    of = F.shiftright(F.col(mark), 33)
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = (dealt.groupBy(of.alias(part)).agg(F.count("*").alias(f"{prefix}n"))
            .select(part, F.coalesce(F.sum(f"{prefix}n").over(before), F.lit(0)).alias(f"{prefix}base")))
    return (dealt.withColumn(part, of).join(F.broadcast(base), part)
            .withColumn(name, F.col(f"{prefix}base") + F.col(mark).bitwiseAND(F.lit((1 << 33) - 1)))
            .drop(mark, part, f"{prefix}base"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (the public splitmix64 constants: fixed values)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash per word, remembered; the memory is bounded, the hash does not depend on it."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, share: int = 1000) -> DataFrame:
    """``rows`` with the columns of their group (one row per non-null ``key``), whatever the skew.

    ``size`` counts the rows of a group. Groups above 1/``share`` of all rows are fewer than ``share``;
    only these are broadcast. The others meet their rows in a shuffle none of them can dominate.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) * share > total)
    rest = groups.where(F.col(size) * share <= total)
    first = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return first.unionByName(others)


def marks(keys: DataFrame, key: str) -> DataFrame:
    """(word, bits): the long ``key`` of every row as one bit, 64 neighbouring keys a row."""
    return keys.groupBy(F.shiftright(key, 6).alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, int({key} & 63)))").alias("bits"))


def with_mark(rows: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is in ``words`` of :func:`marks`."""
    met = rows.join(words, F.shiftright(key, 6) == F.col("word"))
    return met.where(F.expr(f"getbit(bits, int({key} & 63)) = 1")).drop("word", "bits")


def running_before(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group that come before in ``order``.

    Rows are dealt by range of (group, order) and written once; sums run inside (range, group) and are
    shifted by the sums of earlier ranges. A group may hold any share of the rows. Nulls group together.
    """
    n = shuffle_partitions(df.sparkSession)
    dealt = materialize(df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
                        .withColumn("_mark", F.monotonically_increasing_id())
                        .withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33)))
    inside = Window.partitionBy("_part", group).orderBy("_mark").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (range, group): at most ranges + groups
    base = (dealt.groupBy("_part", group).agg(F.sum(value).alias("_sum"))
            .select(F.col("_part").alias("_p"), F.col(group).alias("_g"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")))
    own = dealt.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (own.join(base, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
            .withColumn(name, F.col("_base") + F.col("_in")).drop("_mark", "_part", "_p", "_g", "_base", "_in"))
