"""A corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes all rows that the one before it kept; every stage's result is
written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm import exact_dedup, minhash, packing, suffixes, toxicity
from graftwork.llm.common import shared_folder, small_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under one half. The lexicon is learnt from the labelled rows of ``sf_dir``."""
    lexicon = toxicity.corpus_lexicon(spark, sf_dir)
    return toxicity.keep_clean(docs, lexicon).select(COLUMNS)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.drop_copies(docs, keep=exact_dedup.LARGEST).select(COLUMNS)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest doc_id, of every group of near duplicates."""
    return minhash.drop_near_copies(docs).select(COLUMNS)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the row with the smallest doc_id; other text stays as it is."""
    cut = suffixes.drop_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), added_ids=True)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("minhash_dedup", remove_near_copies),
    ("suffix_dedup", remove_repeats),
    ("best_fit_packing", pack_sequences),
]

# Lexicon scores, similarity of whole shingle sets and the packing plan are not
# expressible in SQL; tests hold run() against a plain single-machine version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/graftwork-stage-{name}-{uuid.uuid4().hex}"
        with small_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
