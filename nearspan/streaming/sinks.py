"""Streams in and out, statistics over streams, and a manager of running queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: T.StructType, group: str | None = None) -> DataFrame:
    """A topic of JSON values; needs the Kafka connector on the cluster."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if group:
        reader = reader.option("kafka.group.id", group)
    return reader.load().select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def as_messages(df: DataFrame, job: str, metric: str) -> DataFrame:
    """Rows as (key, value) messages: '<job>_<metric>' and the row in JSON."""
    return df.select(F.lit(f"{job}_{metric}").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def from_messages(df: DataFrame, metric: str, schema: T.StructType) -> DataFrame:
    """The rows of one metric; values are parsed as JSON, never evaluated."""
    return df.where(F.substring_index("key", "_", -1) == metric).select(F.from_json("value", schema).alias("v")).select("v.*")


def to_files(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def to_each(df: DataFrame, writes: dict[str, Callable[[DataFrame], DataFrame]], path: str, checkpoint: str) -> StreamingQuery:
    """Several outputs of one stream. Each batch overwrites its own folder, so a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()  # else each output would read the source anew
        for name, make in writes.items():
            make(batch).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(df: DataFrame, seconds: int, *keys: str, ts: str = "ts") -> DataFrame:
    """Counts in tumbling event-time windows, complete once twice the window's length has passed."""
    w = F.window(ts, f"{seconds} seconds")
    return df.withWatermark(ts, f"{2 * seconds} seconds").groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.unix_millis("window.start").alias("window_start"), *keys, "n")


def write_windows(df: DataFrame, path: str) -> None:
    """A metric as JSON files, a folder for each window."""
    df.write.mode("overwrite").partitionBy("window_start").json(path)


class JobManager:
    """Named streaming queries: start, stop, status and progress."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jobs = spark, {}

    def start(self, name: str, launch: Callable[[], StreamingQuery]) -> str:
        if name in self.jobs and self.jobs[name].isActive:
            raise ValueError(f"{name} runs already")
        self.jobs[name] = launch()
        return str(self.jobs[name].id)

    def stop(self, name: str) -> None:
        """Stops after the running batch; the checkpoint holds all state."""
        query = self.jobs[name]
        query.processAllAvailable() if query.isActive else None
        query.stop()

    def wait(self, name: str, seconds: int | None = None) -> bool:
        return bool(self.jobs[name].awaitTermination(seconds))

    def status(self) -> dict[str, bool]:
        return {n: q.isActive for n, q in self.jobs.items()}

    def progress(self, name: str) -> list[dict]:
        """Rows and rates of the recent batches."""
        return [{"batch": p["batchId"], "rows": p["numInputRows"], "per_second": p.get("processedRowsPerSecond")} for p in self.jobs[name].recentProgress]

    def idle(self, name: str) -> bool:
        return not any(p["rows"] for p in self.progress(name)[-1:])
