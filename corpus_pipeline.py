"""The corpus pipeline: five stages, each of which calls one text operator.

Every stage reads the Parquet that its predecessor wrote; all but the last return
the columns of documents.

Edge cases, for every stage: a null text is an empty one and a doc_id may be null or
repeat; rows are never joined by doc_id alone.  Very long texts are handled whole.
Extra columns, whatever their names, go through the first four stages.  An empty table
gives an empty result with the same columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import language, lines, packing, secrets, simhash
from tidelog.llm.common import checkpoint_root, documents, remove, ship


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose language the model rejects: without a letter, scored below its calibrated threshold, or unlike all that it has met.

    A null or empty text has no letter and goes; repeated rows stay or go together.
    """
    ship(spark)
    return language.identified(docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that repeat a window of three lines; every document stays.

    Rows equal in doc_id and text are one document; of others with equal texts the first by doc_id (null first) keeps its lines.
    """
    ship(spark)
    return lines.without_repeats(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked fingerprints the document with the smallest id stays.

    One row stays of every class: ids that are null come last, and of equal ids the text's hash decides. Texts without words are one class.
    """
    ship(spark)
    return simhash.one_per_class(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind; every document stays, a null text as null."""
    ship(spark)
    return secrets.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in training sequences; a null or empty text is one id."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("simhash_near_dedup", keep_one_of_near_duplicates),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Fitting, fingerprint classes and packing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is kept as Parquet in the shared checkpoint folder until the next one's is complete."""
    root = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
