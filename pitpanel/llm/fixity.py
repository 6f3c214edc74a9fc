"""Merkle fixity audit of two replicas: hash records and ordered offset ranges, descend where they differ.

Leaves are records in the order of their key. The tree has a fixed fan-out over key ranges of the
first replica, so that both replicas cut at the same offsets and a lost record moves no other branch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered

FAN = 64


def leaves(records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, copies, hash. A null differs from an empty value; rows of one key are hashed as a sorted bag.

    The bag's sum of 64-bit halves needs no list of its rows, so a key with many rows is one partial sum.
    """
    # lengths before values: no two records write alike
    parts = [F.when(F.col(f"`{c}`").isNull(), F.lit("-")).otherwise(
        F.concat(F.length(F.encode(F.col(f"`{c}`").cast("string"), "UTF-8")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string"))) for c in columns]
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    quarters = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    rows = records.select(F.col(f"`{key}`").alias("key"), *[q.alias(f"q{i}") for i, q in enumerate(quarters)])
    bag = rows.groupBy("key").agg(F.count("*").alias("copies"), *[F.sum(f"q{i}").alias(f"q{i}") for i in range(4)])
    return bag.select("key", "copies", F.sha2(F.concat_ws(",", F.col("copies").cast("string"), *[
        F.col(f"q{i}").cast("string") for i in range(4)]), 256).alias("hash"))


def tree(placed: DataFrame, levels: int, fan: int = FAN) -> list[DataFrame]:
    """Nodes (node, hash) from the leaves' ranges up to the root; ``placed`` has node, key, hash.

    A node collects ``fan`` children at most; a lowest range holds ``fan`` keys of the first replica and
    what the second has added between them, which is summed, not collected.
    """
    order = [F.conv(F.substring(F.sha2(F.concat_ws("|", F.coalesce(F.col("key").cast("string"), F.lit("-")), "hash"), 256), 1 + 15 * i, 15), 16, 10)
             .cast("decimal(38,0)") for i in range(4)]
    low = placed.groupBy("node").agg(*[F.sum(o).alias(f"s{i}") for i, o in enumerate(order)])
    out = [materialize(low.select("node", F.sha2(F.concat_ws(",", *[F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("hash")))]
    for _ in range(levels):
        kids = F.array_sort(F.collect_list(F.struct("node", "hash")))
        text = F.concat_ws(",", F.transform(kids, lambda k: F.concat_ws(":", k["node"].cast("string"), k["hash"])))
        out.append(materialize(out[-1].groupBy(F.floor(F.col("node") / fan).alias("up")).agg(F.sha2(text, 256).alias("hash"))
                               .select(F.col("up").alias("node"), "hash")))
    return out


def audit(first: DataFrame, second: DataFrame, key: str, columns: list[str], fan: int = FAN) -> DataFrame:
    """Keys whose records differ: key, status (changed, missing, added), node (lowest range), hashes.

    ``first`` is the reference. Two equal replicas, two empty ones too, give no row. Null keys form one
    leaf. Only ranges below mismatching nodes are compared record by record.
    """
    a, b = materialize(leaves(first, key, columns)), materialize(leaves(second, key, columns))
    both = (a.select("key", F.lit(1).alias("of_first"), F.lit(0).alias("of_second"), "hash")
            .unionByName(b.select("key", F.lit(0).alias("of_first"), F.lit(1).alias("of_second"), "hash")))
    # ranges of offsets: the order of all keys, each replica's leaves placed by it
    keys = numbered(both.groupBy("key").agg(F.max("of_first").alias("of_first")), ["key"], "offset", prefix="_k")
    keys = materialize(keys.select("key", F.floor(F.col("offset") / fan).alias("node")))
    placed = []
    for side in (a, b):
        placed.append(materialize(side.join(keys.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k"))).drop("k")))
    top = keys.agg(F.max("node")).first()[0] or 0
    levels = 0
    while fan ** levels <= top:
        levels += 1
    trees = [tree(p, levels, fan) for p in placed]
    bad = None
    for level in reversed(range(levels + 1)):
        left, right = (t[level].withColumnRenamed("hash", h) for t, h in zip(trees, ("ha", "hb"), strict=True))
        if bad is not None:
            up = F.floor(F.col("node") / fan)
            left, right = (x.withColumn("up", up).join(bad.withColumnRenamed("node", "up"), "up", "left_semi").drop("up")
                           for x in (left, right))
        bad = materialize(left.join(right, "node", "full").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("node"))
    left, right = (p.join(bad, "node", "left_semi") for p in placed)
    left = left.select("node", F.col("key").alias("ka"), F.col("hash").alias("first_hash"), F.lit(True).alias("ina"))
    right = right.select(F.col("node").alias("nb"), F.col("key").alias("kb"), F.col("hash").alias("second_hash"), F.lit(True).alias("inb"))
    diff = left.join(right, (F.col("node") == F.col("nb")) & F.col("ka").eqNullSafe(F.col("kb")), "full").where(
        ~F.col("first_hash").eqNullSafe(F.col("second_hash")))
    status = F.when(F.col("ina").isNull(), "added").when(F.col("inb").isNull(), "missing").otherwise("changed")
    return diff.select(F.when(F.col("ina"), F.col("ka")).otherwise(F.col("kb")).alias(key), status.alias("status"),
                       F.coalesce("node", "nb").alias("node"), "first_hash", "second_hash")
