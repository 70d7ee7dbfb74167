"""A corpus pipeline of five stages; each is one llm operator applied to all its predecessor kept.

Defined cases: rows with a null or empty text, or too few words, fail the first stage; ids
may be null or repeated, rows are told apart by themselves (of a class of near copies one row
stays, repeated rows being such a class); other columns, of any name, pass through all stages
but the last; an empty benchmark removes nothing; an empty table gives an empty result; a very
long text goes through all stages whole; of equal rows the one that is read first stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearspan.llm.common import checkpoint_dir, table
from nearspan.llm.decontaminate import drop_leaks
from nearspan.llm.jaccard_join import keep_one
from nearspan.llm.pieces import digest_pieces
from nearspan.llm.pii import redact
from nearspan.llm.quality_rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest_pieces(docs)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("pieces", pieces),
]

#: SQL expresses neither the learned stages nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and reread."""
    import uuid

    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
