"""The corpus pipeline: five stages, each written and read again before the next.

Rows that are kept keep all their columns, whatever their names; the secret stage changes texts (and n_chars) where it masks, the
last stage returns what it encodes. Null texts count as empty, empty texts are near copies of each other, rows with a null id are
rows like others. Ids may repeat: rows are told apart by all that they hold, and only the stage for near copies takes equal rows
for one. Of near copies that with the least id stays (ties: the least hash of the row). An empty table passes all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from synteny_spark.llm import bpe, decontam, secrets, simhash, toxicity
from synteny_spark.llm.common import discard, session, table, written

#: SQL can't express the fitted model, the hash majority, the alignment or the vocabulary.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the machine, learned from the labels of those at hand, predicts as toxic."""
    session(spark)
    return toxicity.accepted(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component."""
    session(spark)
    return simhash.representatives(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark passage."""
    session(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    session(spark)
    return secrets.masked(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of ids and decoded texts."""
    session(spark)
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", mask_secrets),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
            if before is not None:
                discard(before)  # the next table is written: nothing reads this one any more
            before = docs
    return docs
