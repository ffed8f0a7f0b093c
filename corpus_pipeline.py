"""Corpus pipeline: language ID, SimHash near-dedup, secret scan, source mixing, best-fit packing.

Each stage takes all that its predecessor kept. All but the last return the columns of
``documents``. Every stage's result is written as Parquet and read again, so a lost executor
costs at most the stage at hand.

Executors pass from stage to stage with the heap they have grown, so the stages that read
texts in Python let little go to a worker at once.

Null, empty and repeated rows, ties and very long texts go through as each operator defines;
an empty table passes all stages as an empty table; columns beyond those of ``documents``
are kept as they are, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provend.llm import language_id, mixing, packing, secret_scan, simhash
from provend.session import bound_batches, stage_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter or with letters that speak against it go."""
    bound_batches(spark)
    return language_id.identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id."""
    bound_batches(spark)
    return simhash.deduplicated(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their secrets replaced; n_chars follows the new text."""
    bound_batches(spark)
    clean = docs.withColumn("text", secret_scan.redacted(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
            F.length("text")).cast(kind))
    return clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: none, one or two copies of each, by their source's target."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids, packed into sequences.

    Executors come to this stage with the heap of four others, so the encoder gets less memory than by default.
    """
    bound_batches(spark)
    return packing.pack(docs, keep_ids=True, slice_chars=1 << 20, max_entries=100_000)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: learned, hashed and tokenized stages have no SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
