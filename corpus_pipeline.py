"""A training corpus from raw documents: quality rules, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's documents. All but the last return the columns of documents. Stages judge rows, not
ids: rows that share an id or have none are judged each by its own text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.llm import exact, fertility, jaccard, mixing, packing
from pitpanel.llm.common import marks, materialize, with_mark

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: tokens are no SQL matter; the tests hold the pipeline against brute force
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and the fertility bands, each judged by its own text."""
    rows = _rows(docs)
    judged = fertility.quality(rows, public_tokenizers.path("piece_bpe_32k.model"), id_col="_row")
    return _keep(rows, judged.where("kept").select(F.col("doc_id").alias("_row")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the smallest id, null last; any one where rows repeat it."""
    rows = _rows(docs)
    groups = exact.exact_groups(rows, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("keep_id").alias("_group"))
    return _keep(rows, _first(rows, groups))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: the smallest id, null last; any one where rows repeat it.

    A row without words is its own component and stays.
    """
    rows = _rows(docs)
    groups = jaccard.components(rows, id_col="_row").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"))
    return _keep(rows, _first(rows, groups))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the mix reads it, to the nearest whole number."""
    rows = _rows(docs)
    times = (mixing.mix(rows, row_col="_row").where("size > 0")
             .select("_row", F.expr("(2 * taken + size) div (2 * size)").alias("times")).where("times > 0"))
    again = rows.join(materialize(times), "_row")
    return again.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return packing.pack(packing.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False))


def _rows(docs: DataFrame) -> DataFrame:
    """``docs`` written once with a key of its own for every row, as ids may repeat or be null."""
    return materialize(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))


def _first(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The one row of each group that stays; texts don't move, and groups of any size shrink before the shuffle."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    named = rows.select("_row", "doc_id").join(groups, "_row")
    return named.groupBy("_group").agg(F.min(order).alias("first")).select("first._row")


def _keep(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The ``rows`` of ``keys``, met as one bit a row: a table that small is broadcast where keys would have texts shuffled."""
    return with_mark(rows, materialize(marks(keys, "_row")), "_row").select(*COLUMNS)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
