"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import kmtree, mixing, packing, preference, resample, sanitise, simhash, tokenfile, transport, warc

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.round_trip(_table(spark, sf_dir, "documents"))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.reject(resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op3_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, distance=2)


def op5_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), WORD_VOCABULARY, end_id=1, capacity=4096)


def op6_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op7_disclosure_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.report(sanitise.find(_table(spark, sf_dir, "documents")))


def op8_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.report(preference.pairs(preference.segments(_table(spark, sf_dir, "conversations"))))


def op9_seekable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(_table(spark, sf_dir, "documents"), BYTE_VOCABULARY, end_id=2)


def op10_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmtree.search(_table(spark, sf_dir, "embeddings"), k=10, every=100)


_ALL = (
    op1_transport_stream,
    op2_importance_resampling,
    op3_sainte_lague_mix,
    op4_simhash_variants,
    op5_swap_packing,
    op6_zstd_warc,
    op7_disclosure_sanitiser,
    op8_preference_pairs,
    op9_seekable_tokens,
    op10_kmeans_tree,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """Tokenisers, codecs, fitted models and XXH64 are beyond SQL; those queries are tested by brute force."""
    return {"op6_zstd_warc": warc.ORACLE, "op8_preference_pairs": preference.ORACLE}
