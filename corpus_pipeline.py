"""The corpus pipeline: stages that each apply one operator to what the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import mixing, packing, resample, sanitise, simhash
from lodestrand.llm.common import materialise
from lodestrand.llm.queries import WORD_VOCABULARY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling towards labelled good text draws, without words that such text never has."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample.reject(resample.resample(docs, labels, keep=docs.columns)).select("kept.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies: five-word shingles, similarity 0.8 or more."""
    return simhash.without_copies(docs)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and the terms that give it away."""
    found = sanitise.clean(sanitise.find(docs, keep=docs.columns))
    text = F.when(F.col("kept._had_text"), F.col("cleaned"))
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return found.select(*[(new[c] if c in new else F.col(f"kept.`{c}`")).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents; what it takes twice is there twice."""
    out = mixing.render(mixing.mix(docs, keep=docs.columns))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with the sequence and the place of each."""
    return packing.pack_documents(docs, WORD_VOCABULARY, end_id=1, capacity=4096)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", deduplicate),
    ("PII", sanitised),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: SQL can express neither the tokeniser nor the models; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
