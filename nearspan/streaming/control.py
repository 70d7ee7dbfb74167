"""Monitoring, rebalancing and migrating a running join, as one flow of Spark jobs.

The join's outputs are files that its statistics read as streams; a barrier lets a window through
when all four metrics of it have come; if the machines' latencies then differ too much, the groups
are assigned anew, the stopped join's state is given to the machines of the new allocation, and the
next query starts from it. Driver code decides and starts jobs; only one row a group passes through it.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

from nearspan.functions.vectors import latency
from nearspan.operators import balance, stats
from nearspan.schemas import GROUP_SIDE, RESULT, THROUGHPUT
from nearspan.streaming import monitor
from nearspan.streaming.join import exported_state, migrated
from nearspan.streaming.sinks import as_messages, from_messages, read_kafka, to_files

#: The metrics a window waits for.
METRICS = ("final-comps-per-machine", "final-comps-per-group", "size-per-group", "latency-percentiles-per-machine")


def watermark_policy(spark: SparkSession, policy: str) -> None:
    """How the watermarks of several inputs make one: 'min' waits for the slowest, 'max' lets an idle one go."""
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", policy)


#: Reads a stream of the join by the name and the schema of its output.
Reader = Callable[[str, T.StructType], DataFrame]


def file_reader(spark: SparkSession, outputs: str) -> Reader:
    """The outputs that ``write_outputs`` writes under a folder."""
    return lambda name, schema: spark.readStream.schema(schema).parquet(f"{outputs}/{name}/*")


def kafka_reader(spark: SparkSession, servers: str, topics: dict[str, str]) -> Reader:
    """The outputs as JSON values of topics by name; needs the Kafka connector on the cluster."""
    return lambda name, schema: read_kafka(spark, servers, topics[name], schema)


def typed_streams(read: Reader, seconds: int, late_s: int | None = None) -> dict[str, DataFrame]:
    """The join's three outputs, each with its own columns, event time and watermark."""
    results = read("results", RESULT).withColumns({"latency": latency(F.col("out_ts"), F.col("in_ts")), "ts": F.col("in_ts")})
    ticks = read("throughput", THROUGHPUT).withColumn("ts", F.col("ingest_ts"))
    return {"results": monitor.timed(results, seconds, late_s=late_s), "group_side": monitor.timed(read("group_side", GROUP_SIDE), seconds, late_s=late_s), "throughput": monitor.timed(ticks, seconds, late_s=late_s)}


def monitored(read: Reader, folder: str, seconds: int, job: str = "job", late_s: int = 0) -> str:
    """Statistics of what a join has written so far; the folder of their messages. Call it again for what came since."""
    streams = typed_streams(read, seconds, late_s)
    results, side = streams["results"], streams["group_side"]
    metrics = {
        "latency-percentiles-per-machine": monitor.per_window(results, seconds, "machine", p=stats.percentiles("latency")).select("window_start", "machine", *stats.percentile_columns("p")),
        "final-comps-per-machine": monitor.comparisons(results, seconds).drop("at"),
        "final-comps-per-group": monitor.running_costs(side, seconds).drop("at"),
        "size-per-group": monitor.per_window(side, seconds, *monitor.GROUP, bytes=F.sum("bytes")).drop("at"),
        "throughput": monitor.per_window(streams["throughput"], seconds, n=F.sum("n")).drop("at"),
    }
    for metric, df in metrics.items():
        to_files(as_messages(df, job, metric), f"{folder}/messages/{metric}", f"{folder}/state/{metric}").awaitTermination()
    return f"{folder}/messages"


_MESSAGE = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])


def complete_windows(spark: SparkSession, messages: str, folder: str) -> list[int]:
    """The windows, in order, for which all metrics have come by now; each was let through once."""
    sent = spark.readStream.schema(_MESSAGE).parquet(f"{messages}/*").select(F.substring_index("key", "_", -1).alias("metric"), F.get_json_object("value", "$.window_start").cast("long").alias("window_start"))
    to_files(monitor.barrier(sent, METRICS), f"{folder}/complete", f"{folder}/state/barrier").awaitTermination()
    return sorted(r[0] for r in spark.read.schema("window_start long").parquet(f"{folder}/complete").collect())


def _metric(sent: DataFrame, metric: str, value: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("window_start", "machine", "group_id", "space_id", value)])
    return from_messages(sent, metric, schema)


def assignment(sent: DataFrame, window: int) -> DataFrame:
    """What the balancer is told of a window: every group's machine, the cost of its window, its bytes up to then."""
    sizes = _metric(sent, "size-per-group", "bytes").where(F.col("window_start") <= window).groupBy("machine", "group_id", "space_id").agg(F.sum("bytes").alias("bytes"))
    costs = _metric(sent, "final-comps-per-group", "cost").where(F.col("window_start") == window)
    return stats.balancer_input(sizes, costs).withColumns({"group_id": F.col("group_id").cast("int"), "space_id": F.col("space_id").cast("int")})


def imbalanced(sent: DataFrame, window: int, tolerance: float = 0.2) -> bool:
    """Whether the machines' 99th percentiles of a window differ by more than the tolerance."""
    one = _metric(sent, "latency-percentiles-per-machine", "p99").where(F.col("window_start") == window)
    return bool((stats.imbalance_by_percentile(one, "p99", tolerance).collect() or [[None, False]])[0][1])


def rebalanced(spark: SparkSession, messages: str, window: int, checkpoint: str, folder: str, tolerance: float = 0.2, names: list[str] | None = None) -> DataFrame | None:
    """The state a new join starts from, once groups were moved; None where the window is in balance.

    The allocation stays in ``folder``, as does the state.
    """
    sent = spark.read.schema(_MESSAGE).parquet(f"{messages}/*")
    if not imbalanced(sent, window, tolerance):
        return None
    plan = balance.rebalance(balance.to_plan(assignment(sent, window)), names)
    balance.write_allocation(spark, plan, f"{folder}/allocation")
    moved = balance.read_allocation(spark.read.text(f"{folder}/allocation"))
    migrated(exported_state(spark, checkpoint), moved).write.mode("overwrite").parquet(f"{folder}/start")
    return spark.read.parquet(f"{folder}/start")


class Rates(StreamingQueryListener):
    """Rows and rates of every batch of the session's queries, as they are reported."""

    SCHEMA = "name string, batch long, at string, rows long, input_rate double, processed_rate double"

    def __init__(self):
        self.rows: list[tuple] = []
        self.ended, self._lock = 0, threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            self.rows.append((p.name, p.batchId, p.timestamp, p.numInputRows, p.inputRowsPerSecond, p.processedRowsPerSecond))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self.ended += 1

    def until_ended(self, queries: int, seconds: float = 60) -> bool:
        """Waits until so many queries have ended; whether they did in time."""
        ends = time.monotonic() + seconds
        while self.ended < queries and time.monotonic() < ends:
            time.sleep(0.1)
        return self.ended >= queries

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.SCHEMA)
