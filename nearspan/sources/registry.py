"""Sources by name; any other name is the path of a text file of vector lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearspan.sources import generators as g
from nearspan.sources.replay import replay, stored_blocks
from nearspan.sources.text import read_embeddings, read_vectors


def replayed(spark: SparkSession, path: str, rate: int, store: str, block: int | None = None) -> DataFrame:
    """A file of stored embeddings, one a line, at a rate: a table, or with ``block`` a paced stream.

    The lines' numbers, and the blocks of the stream, are kept under ``store``.
    """
    rows = read_embeddings(spark, path, f"{store}/lines")
    if block is None:
        return g.embedding_stream(spark, rows, rate, "id", "vec")
    stored_blocks(rows.withColumnRenamed("id", "number"), f"{store}/blocks", block)
    out = replay(spark, f"{store}/blocks", rate, block)
    return out.select("event_ts", F.col("event_ts").alias("ingest_ts"), F.col("number").alias("id"), "vec")


GENERATORS = {
    "gaussian_2D_generator": g.gaussian_vectors,
    "gaussian_MD_generator": g.gaussian_vectors,
    "skewed_gaussian_2D_generator": g.skewed_vectors,
    "pareto_2D_generator": g.pareto_vectors,
    "uniform_2D_generator": g.uniform_vectors,
    "uniform_MD_generator": g.benchmark_vectors,
    "zipfian_word_generator": g.zipf_words,
    "uniform_word_generator": g.uniform_words,
    "complex_2D_generator": g.pareto_topics,
    "imdb_stream_generator": replayed,
}


def create(spark: SparkSession, name: str, **params) -> DataFrame:
    if name in GENERATORS:
        return GENERATORS[name](spark, **params)
    return read_vectors(spark, name, **params)
