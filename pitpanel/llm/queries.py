"""One registered query per operator, with production parameters, and the DuckDB text where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact, fertility, fixity, jaccard, mixing, packing, personal, secrets, spelling, toxicity, wavelet, whitening
from .common import join_groups, materialize

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_wavelet_shards(spark: SparkSession, sf: str) -> DataFrame:
    return wavelet.token_file_digests(_table(spark, sf, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op2_shortest_pack_first(spark: SparkSession, sf: str) -> DataFrame:
    pieces = packing.tokenize(_table(spark, sf, "documents"), public_tokenizers.path(BYTE_VOCABULARY), with_ids=False)
    return packing.pack(pieces)


def op3_fertility_rules(spark: SparkSession, sf: str) -> DataFrame:
    return fertility.quality(_table(spark, sf, "documents"), public_tokenizers.path(PIECE_VOCABULARY))


def op4_merkle_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Pages against a replica whose html lost its last character in every seventh record."""
    pages = _table(spark, sf, "pages")
    cut = F.when(F.col("page_id") % 7 == 3, F.expr("substring(html, 1, greatest(length(html) - 1, 0))")).otherwise(F.col("html"))
    return fixity.audit(pages, pages.withColumn("html", cut), "page_id", ["url", "html"])


def op5_preference_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation as chosen, itself with its last turn cut to the first half as rejected."""
    turns = _table(spark, sf, "conversations")
    last = materialize(turns.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.max("turn").alias("last"), F.count("*").alias("n")))
    half = F.when(F.col("turn") == F.col("last"), F.expr("substring(text, 1, length(text) div 2)")).otherwise(F.col("text"))
    rejected = join_groups(turns, last, "conv_id", "n").withColumn("text", half).drop("last", "n")
    return chat.pair_counts(chat.preference_turns(turns, rejected, public_tokenizers.path(BYTE_VOCABULARY), with_ids=False))


def op6_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.components(_table(spark, sf, "documents"))


def op7_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf, "documents"))


def op8_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents"))


def op9_personal_spans(spark: SparkSession, sf: str) -> DataFrame:
    return personal.find(_table(spark, sf, "documents"))


def op10_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op11_trigram_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.find(_table(spark, sf, "documents"))


def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.group(_table(spark, sf, "documents"))


def op13_feast_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf, "embeddings"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


QUERIES = {f.__name__: f for f in (
    op1_wavelet_shards, op2_shortest_pack_first, op3_fertility_rules, op4_merkle_audit, op5_preference_pairs,
    op6_ngram_jaccard, op7_exact_dedup, op8_source_mix, op9_personal_spans, op10_toxicity,
    op11_trigram_secrets, op12_spelling_variants, op13_feast_whitening, pipeline)}

ORACLES = {"op7_exact_dedup": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)""", "op11_trigram_secrets": secrets.oracle_sql()}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
