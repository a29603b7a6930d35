"""A training corpus from raw documents: five stages, each an operator of tessera.llm.

Each stage works on all rows that its predecessor kept. All but the last return the
columns of documents, whatever further ones there are and whatever their names; the last
returns the packed pieces. Very long texts are taken in blocks; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, packing, quality_classifier, simhash, suffix_dedup
from tessera.llm.common import stored, table
from tessera.llm.tokens import public


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the classifier scores below 0.3 go; without a trusted label all stay. Null texts are scored as empty ones, repeated rows alike."""
    model = quality_classifier.learn(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.above(docs, model, 0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose five-word shingles are 0.8 similar, the one with the smallest id stays; texts without words, null ones too, are alike."""
    return simhash.first_of_similar(docs, shingle=5, similarity=0.8)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur elsewhere too are cut out; texts of which that leaves nothing go. Null and empty texts stay."""
    kept = suffix_dedup.without_repeats(docs, length=200)
    return kept.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType)) if "n_chars" in kept.columns else kept


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts stay, repeated rows stay or go together."""
    return decontamination.without_contamination(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens; a null or empty text is its end id alone."""
    return packing.pack(docs, public("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"), length=2048, end_id=1)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", decontaminate),
    ("packing", pack),
]

#: A trained classifier, fingerprints and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
