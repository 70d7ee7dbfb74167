"""Stored vectors replayed as a paced stream that takes up where it stopped.

Rows are numbered once, in an order of their own, whatever the splits they are read in, and stored
in blocks of a batch's length. The stream counts numbers (its offsets are row numbers, kept in the
checkpoint), and each batch reads its own block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def numbered(df: DataFrame, path: str, *order: str | Column) -> DataFrame:
    """df with ``number``, 0, 1, ... in the given order, stored under ``path``.

    Sorted by ranges; a range's first number is the count of those before it, one row a range.
    """
    at = F.monotonically_increasing_id()
    df.orderBy(*order).withColumns({"__range": F.shiftright(at, 33).cast("int"), "__at": at.bitwiseAND((1 << 33) - 1)}).write.mode("overwrite").parquet(f"{path}/sorted")
    rows = df.sparkSession.read.parquet(f"{path}/sorted")
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    first = rows.groupBy("__range").count().withColumn("__first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    return rows.join(F.broadcast(first), "__range").withColumn("number", F.col("__first") + F.col("__at")).drop("__range", "__at", "__first")


def numbered_lines(spark: SparkSession, path: str, store: str) -> DataFrame:
    """The lines of text files with their number: files by name, lines as they stand, however they are split."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return numbered(lines, store, "f", "b", "i").select("value", "number").where(F.trim("value") != "")


def stored_blocks(rows: DataFrame, path: str, block: int) -> None:
    """Numbered rows in folders of ``block`` numbers each."""
    rows.withColumn("block", F.expr(f"div(number, {block})")).repartition("block").write.mode("overwrite").partitionBy("block").parquet(path)


def replay(spark: SparkSession, path: str, rate: int, block: int) -> DataFrame:
    """The rows of ``stored_blocks``, a block a batch: event_ts is the number over the rate, with number and columns.

    For its pace start it with a processing-time trigger of block / rate seconds. The stream has
    no end of its own; ``replayed_all`` tells when all rows are through.
    """
    rows = spark.read.parquet(path)
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", block).option("numPartitions", 1).option("startTimestamp", 0).option("advanceMillisPerBatch", max(1, 1000 * block // rate)).load()
    now = ticks.select(F.col("value").alias("number"), F.expr(f"div(value, {block})").alias("block"))
    # The batch's numbers are the small side: at most a block.
    return rows.join(F.broadcast(now), ["block", "number"]).drop("block").select(F.expr(f"div(number, {rate})").alias("event_ts"), "*")


def replayed_all(query, rows: int, block: int) -> bool:
    """Whether a replaying query has gone through so many rows."""
    return sum(1 for p in query.recentProgress[-1:] if (p["batchId"] + 1) * block >= rows) > 0
