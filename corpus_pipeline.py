"""The corpus pipeline: language, near-duplicates, benchmark passages, secrets, token ids.

``STAGES`` lists (name, function) in order. Each function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, which is written as Parquet and read again as the next stage's documents. All stages but the
last return the columns of their input; the last returns token ids.

* language: documents without a determined language go; the model learns from the stage's own documents
  (those with a label whose id remainder is not 1).
* near-duplicates: of each group of near copies (five-word similarity of 0.8 or more) the document with the
  smallest id stays.
* decontamination: documents with any benchmark window go.
* secrets: found secrets are replaced by a mark, ``n_chars`` follows.
* encoding: ids of every document, its token count, and hashes of ids and decoding.

Null or empty texts have no language and go in the first stage. Empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from blockreach.llm import bpe, decontaminate, language, near_texts, secrets
from blockreach.llm.common import table, written
from blockreach.llm.queries import language_model, vocabulary_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined."""
    return language.keep_identified(docs, language_model(spark, docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_texts.drop_near_texts(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_documents(docs, vocabulary_path(), with_decoded=False)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("encoding", encode),
]

# No stage but the third has a counterpart in SQL; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
