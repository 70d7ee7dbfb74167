"""Text formats: vector lines, word lines, word-vector files, embedding lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearspan.functions.vectors import parse_vector


def stamped(df: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """Adds ingest_ts: the wall clock in milliseconds, or what the caller gives (for repeatable runs)."""
    return df.withColumn("ingest_ts", F.unix_millis(F.current_timestamp()) if ingest_ts is None else ingest_ts.cast("long"))


def _columns(lines: DataFrame) -> DataFrame:
    parts = F.split("value", ", ", 3)
    return lines.where(F.trim("value") != "").select(F.get(parts, F.lit(0)).cast("long").alias("event_ts"), F.get(parts, F.lit(1)).cast("long").alias("id"), F.get(parts, F.lit(2)).alias("payload"))


def vector_lines(lines: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """'ts, id, [x, y]' lines (any dimension) as event_ts, ingest_ts, id, vec."""
    return stamped(_columns(lines), ingest_ts).select("event_ts", "ingest_ts", "id", parse_vector(F.col("payload")).alias("vec"))


def word_lines(lines: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """'ts, id, word' lines as event_ts, ingest_ts, id, word."""
    return stamped(_columns(lines), ingest_ts).select("event_ts", "ingest_ts", "id", F.trim("payload").alias("word"))


def read_vectors(spark: SparkSession, path: str, ingest_ts: Column | None = None, streaming: bool = False) -> DataFrame:
    """A text file or folder of vector lines, on any file system Spark reads."""
    return vector_lines((spark.readStream if streaming else spark.read).text(path), ingest_ts)


def read_words(spark: SparkSession, path: str, ingest_ts: Column | None = None) -> DataFrame:
    return word_lines(spark.read.text(path), ingest_ts)


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A word-vector file ('word v1 v2 ...', the first line a header of two numbers) as word, vec."""
    parts = F.split("value", " ", 2)
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\d+ \d+\s*$") & (F.trim("value") != ""))
    return lines.select(F.get(parts, F.lit(0)).alias("word"), F.transform(F.split(F.trim(F.get(parts, F.lit(1))), " +"), lambda x: x.cast("double")).alias("vec"))


def read_embeddings(spark: SparkSession, path: str, store: str | None = None) -> DataFrame:
    """One '[v1, v2, ...]' a line as id, vec; ids ascend with the lines of the scan.

    With a folder to ``store`` them in they are 0, 1, ..., however the files are split.
    """
    if store is not None:
        from nearspan.sources.replay import numbered_lines

        return numbered_lines(spark, path, store).select(F.col("number").alias("id"), parse_vector(F.col("value")).alias("vec"))
    return spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("id"), parse_vector(F.col("value")).alias("vec"))


def read_column(spark: SparkSession, path: str, column: int | str) -> DataFrame:
    """One column of a tab-separated file with a header, by place or name, as id, text.

    Quotes are characters like others; ids ascend with the lines of the scan.
    """
    rows = spark.read.csv(path, sep="\t", header=True, quote="", escape="")
    name = rows.columns[column] if isinstance(column, int) else column
    return rows.select(F.monotonically_increasing_id().alias("id"), F.col(f"`{name}`").alias("text"))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A text column as lines of text files."""
    df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").write.mode("overwrite").text(path)


def write_embeddings(df: DataFrame, path: str, vec: str = "vec") -> None:
    """Vectors as '[v1, v2, ...]' lines, which ``read_embeddings`` takes back."""
    write_lines(df.select(F.concat(F.lit("["), F.array_join(F.transform(vec, lambda x: x.cast("string")), ", "), F.lit("]")).alias("value")), "value", path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Rows as vector lines."""
    body = F.concat(F.lit("["), F.array_join(F.transform("vec", lambda x: x.cast("string")), ", "), F.lit("]"))
    df.select(F.concat_ws(", ", "event_ts", "id", body).alias("value")).write.text(path)
