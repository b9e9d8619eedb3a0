"""The corpus pipeline: stages that each apply one operator to what the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` applies them in order, each to the stored result of the last.
No stage but packing changes a text, but for the secrets that are replaced. Rows with a null
``doc_id`` pass every filter that does not reject their text; a null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logtide.llm import packing, quality, secret_scan, simhash, toxicity
from logtide.llm.common import stored, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    Null and empty texts stay, as do all rows where no labels are; repeated rows are judged alike.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def poor_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null and empty texts are judged as short
    ones, repeated rows alike."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies by SimHash (shingles of three words, three bits) the document
    with the smallest id stays."""
    return simhash.keep_first(docs)


def secrets_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the name of their kind."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in sequences."""
    return packing.pack(docs, packing.definition("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxic_out),
    ("quality", poor_out),
    ("near_duplicates", one_of_each),
    ("secrets", secrets_out),
    ("packing", packed),
]

#: Models and tokenizers cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
