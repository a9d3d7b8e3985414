"""The corpus pipeline: each stage works on all that the one before it kept, and its decisions take effect.

Stages take documents of any size (long texts whole), and tables without rows, which stay empty; columns beside doc_id,
text and lang go along, whatever their names. Stages that work in Python set the session to batches of 1,000 rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docflow.llm import pii
from docflow.llm.common import documents, materialise, small_batches
from docflow.llm.exact_dedup import drop_copies
from docflow.llm.jaccard_join import drop_near_copies
from docflow.llm.language_id import drop_rejected, fit_on_training_rows
from docflow.llm.packing import pack_documents


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is unknown (null and empty texts, texts without a letter) or too close to call, ties
    among them. The column lang stays as it is; repeated rows are judged alike."""
    small_batches(spark)
    return drop_rejected(docs, fit_on_training_rows(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group of texts that are equal but for white space; null and empty texts
    are one group, and of repeated rows one stays. Other columns keep their values."""
    return drop_copies(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group linked by shared shingles; texts without words stay, and so do
    rows without an id. Rows of one id stay or go together."""
    small_batches(spark)
    return drop_near_copies(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, secrets and terms that disclose them; n_chars stays what the source said. Null, empty and
    clean texts stay as they are, equal texts are changed alike."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, with their sequences and offsets; a null or empty text is its end id alone."""
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), remembered=100_000)  # little memory beside the other stages


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_similar),
    ("pii", remove_personal_data),
    ("best_fit_packing", pack),
]

#: Compression, near copies and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table documents; each stage's rows are written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
