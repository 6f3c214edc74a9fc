"""Mixing sources to target weights along a golden-ratio schedule. DataFrame functions only.

Slot ``n`` of the mix has the point ``n * K mod 2**31`` (K: the golden section of 2**31). Points fall
evenly into the intervals that the sources' targets cut from [0, 2**31); the r-th slot of a source
takes the r-th block of its shuffled documents, laid end to end and read again when they run out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, column_view, join_groups, materialize, running_before

RING = 1 << 31
GOLDEN = 1327217885  # odd, nearest to 2**31 times the golden section (fixed value)
CELLS = 4096
CHUNK = 1 << 16


def targets(sizes: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source: source, source_size, rows, target.

    ``weights`` go round the sources by code point, null last. A target stops at ``most`` times its
    source's size and the excess is shared again by weight: target = min(cap, weight * level), with
    the one level that gives all words away. The table has one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    t = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
         .withColumn("at", F.row_number().over(by_name) - 1).withColumn("w", weight))
    by_level = Window.orderBy("level", "at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("level", most * F.col("source_size") / F.col("w"))
    t = (t.withColumn("given", F.coalesce(F.sum(most * F.col("source_size")).over(by_level), F.lit(0)))
         .withColumn("used", F.coalesce(F.sum("w").over(by_level), F.lit(0)))
         .withColumn("all", F.sum("source_size").over(whole)).withColumn("ws", F.sum("w").over(whole))
         .withColumn("try", (F.col("all") - F.col("given")) / (F.col("ws") - F.col("used"))))
    # sources in the order of their caps: the first that its cap doesn't stop fixes the level
    t = t.withColumn("fits", F.min(F.when(F.col("try") <= F.col("level"), F.struct("level", "at", "try"))).over(whole))
    target = F.least(most * F.col("source_size").cast("double"), F.col("w") * F.col("fits.try"))
    return t.select("source", "source_size", "rows", "at", target.alias("target"))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """Slots of the mix: slot, at (the source's number), rank (of the slot within its source).

    The point of a slot meets its source by cell of the ring, so there's no range join. Ranks count
    inside chunks of consecutive slots and are shifted by the counts of earlier chunks.
    """
    spark = sources.sparkSession
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    up_to = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = sources.withColumn("hi", F.round(F.sum("target").over(up_to) / F.lit(total or 1.0) * RING).cast("long"))
    cuts = ends.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("at")), F.lit(0).cast("long"))).where("hi > lo")
    width = RING // CELLS
    cuts = cuts.select("at", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    point = F.col("slot") % RING * GOLDEN % RING
    slots = spark.range(round(total / block)).select(F.col("id").alias("slot"), point.alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") / width)).join(cuts, "cell")
    slots = materialize(slots.where("point >= lo AND point < hi").select(
        "slot", "at", F.floor(F.col("slot") / CHUNK).alias("chunk")))
    before = Window.partitionBy("at").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = slots.groupBy("at", "chunk").agg(F.count("*").alias("n")).select(
        "at", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("at", "chunk").orderBy("slot"))
    return (slots.withColumn("i", inside - 1).join(base, ["at", "chunk"])
            .select("slot", "at", (F.col("base") + F.col("i")).alias("rank")))


def mix(docs: DataFrame, block: int = 32, most: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 17,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken; one row per document. ``row_col`` is carried along if named.

    Sizes are words (null text: 0). Blocks hold ``block`` words, so a source misses its target by a few
    blocks. No document is taken more than ``most`` times; rows of one id and source are laid apart by
    their size, and full repeats share what the rows take evenly in order. A mix without words takes
    nothing. Null sources form one source, null ids are laid together. Rows of one id and size are laid by
    their text. Reruns agree.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    carried = {"_carried": row_col} if row_col else {}
    view = column_view(docs, doc_id=id_col, text=text_col, source=source_col, **carried)
    sizes = materialize(view.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("tie"), *carried))
    sources = materialize(targets(sizes, most, weights))
    slots = materialize(schedule(sources, block))
    count = slots.groupBy("at").agg(F.count("*").alias("slots"))
    table = sources.join(count, "at", "left").na.fill(0, ["slots"]).withColumn("no", F.col("at")).drop("at")
    keyed = sizes.withColumn("key", F.struct("source")).drop("source")
    rows = join_groups(keyed, table.withColumn("key", F.struct("source")).drop("source"), "key", "rows").drop("key")
    rows = rows.withColumn("shuffle", F.xxhash64("doc_id", F.lit(seed)))
    laid = materialize(running_before(rows, "no", ["shuffle", "doc_id", "size", "tie"], "size", "pos")
                       .withColumn("row", F.monotonically_increasing_id()))
    # the words a source gives end where its slots or its allowed repeats do
    end = F.least(F.col("slots") * block, most * F.col("source_size"))
    reads = (laid.where("size > 0 AND slots > 0").withColumn("end", end)
             .withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
             .withColumn("lo", F.col("turn") * F.col("source_size") + F.col("pos"))
             .withColumn("hi", F.least(F.col("lo") + F.col("size"), "end")).where("lo < hi"))
    pieces = reads.select("row", "no", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))).alias("rank"))
    words = F.least("hi", (F.col("rank") + 1) * block) - F.greatest("lo", F.col("rank") * block)
    given = pieces.join(slots.select(F.col("at").alias("no"), "rank"), ["no", "rank"]).groupBy("row").agg(
        F.sum(words).alias("taken"))
    return laid.join(given, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        *[F.col(c).alias(name) for c, name in carried.items()])
