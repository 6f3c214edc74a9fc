"""Exact deduplication by 128-bit content hash, with bytes compared inside groups.

DataFrame functions only. Texts never meet in one task: equal texts collapse before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, column_view, join_groups, materialize


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash=F.md5) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per row of ``docs``.

    Equal means identical bytes after runs of white space become one space; null counts as empty. The
    smallest id of a group stays; null ids count as largest. Rows that repeat the staying id are all
    marked kept, since an id names one document. An empty table gives no row.

    Rows group by ``content_hash`` and text, so one hash with two texts gives two groups. Such hashes
    are joined back by text; all others by the hash alone.
    """
    view = column_view(docs, doc_id=id_col, text=text_col).withColumn("text", normalised(F.col("text")))
    view = view.withColumn("h", content_hash(F.col("text")))
    groups = materialize(view.groupBy("h", "text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
                         .withColumn("text_sha256", F.sha2("text", 256)).drop("text"))
    shared = materialize(groups.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    found = ["doc_id", "keep_id", "group_size", "text_sha256"]
    rows = view.select("doc_id", "h")
    if shared.isEmpty():
        out = join_groups(rows, groups, "h", "group_size").select(*found)
    else:
        # different texts under one hash: the bytes decide
        single = join_groups(rows.join(shared, "h", "left_anti"), groups.join(shared, "h", "left_anti"), "h", "group_size")
        clash = view.join(shared, "h", "left_semi")
        by_text = clash.groupBy("text").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        out = single.select(*found).unionByName(
            join_groups(clash, by_text, "text", "group_size").withColumn("text_sha256", F.sha2("text", 256)).select(*found))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")
