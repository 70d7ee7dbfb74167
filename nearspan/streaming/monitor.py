"""Statistics of a running join: windowed metrics that are written once, when their window is complete.

Every metric is in append mode, with state that does not grow with the number of windows: a
window's aggregate leaves the state when the watermark passes it, and what runs on over windows
(costs, totals, averages, numbers of groups) is one small value for each key in a second stateful
operator that the closed windows flow through.

Records have ts (milliseconds), machine, group_id, space_id, gtype, latency, match and bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from nearspan.operators.stats import FAILURE_WEIGHT, percentile_columns, percentiles
from nearspan.shipping import ship
from nearspan.streaming.sinks import as_messages

GROUP = ("group_id", "machine", "space_id")
#: Keys that groups are dealt to for their costs, many times as many as cores.
SLOTS = 512


def timed(records: DataFrame, seconds: int, ts: str = "ts", late_s: int | None = None) -> DataFrame:
    """Records with the event time and watermark of the statistics; a record may come two windows late (or ``late_s``)."""
    return records.withColumn("at", F.timestamp_millis(ts)).withWatermark("at", f"{2 * seconds if late_s is None else late_s} seconds")


def closing_mark(records: DataFrame, folder: str, last: int, seconds: int, ts: str = "ts") -> DataFrame:
    """A stream that has an end, its last record at ``last``, with a mark of that end.

    The mark is a record of nulls, so late that all windows of real records close, and in a window
    of its own that never does: every window is told of, and the mark itself is not.
    """
    spark = records.sparkSession
    spark.range(1).select(*[(F.lit(last + 4000 * seconds) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in records.schema]).write.mode("overwrite").parquet(folder)
    return records.unionByName(spark.readStream.schema(records.schema).parquet(folder))


def per_window(records: DataFrame, seconds: int, *keys: str, **values: Column) -> DataFrame:
    """Aggregates in tumbling windows of timed records, with the window's start in milliseconds and its own time."""
    made = records.groupBy(F.window("at", f"{seconds} seconds"), *keys).agg(*[x.alias(n) for n, x in values.items()])
    return made.select(F.unix_millis("window.start").alias("window_start"), F.window_time("window").alias("at"), *keys, *values)


class CostProcessor(StatefulProcessor):
    """Join costs of a slot's groups: what came in a window against what the group held and against itself.

    State is three numbers a group: inner, outer and outlier records so far. A key is a slot, not one
    of the many small groups, so what a call costs is paid once a slot and batch.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "group_id int, machine int, space_id int, i long, o long, l long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        names = [*GROUP, *"iol"]
        # What a group holds stands before its windows; a group's columns may be null.
        every = pd.concat(list(rows), ignore_index=True)[["window_start", "at", *names]].assign(came=True)
        held = pd.DataFrame([tuple(x) for x in self.held.get()], columns=names)
        if len(held):
            every = pd.concat([held.assign(window_start=0, at=every["at"].iloc[0], came=False), every], ignore_index=True)
        every = every.astype({c: "Int32" for c in GROUP}).sort_values([*GROUP, "came", "window_start"], ignore_index=True)
        group = every.groupby(list(GROUP), sort=False, dropna=False)
        now = group[["i", "o", "l"]].cumsum()
        i, o, l = (every[c] for c in "iol")
        si, so, sl = (now[c] - every[c] for c in "iol")
        cost = l * (so + sl + si) + o * (si + sl) + i * (so + sl) + l * (o + i) + o * i + l * (l - 1) // 2
        last = group.tail(1).index
        so_far = pd.concat([every.loc[last, list(GROUP)], now.loc[last]], axis=1).astype(object)
        self.held.put(list(so_far.where(so_far.notna(), None).itertuples(index=False, name=None)))
        yield every.assign(cost=cost).loc[every["came"], ["window_start", "at", *GROUP, "cost"]]

    def close(self) -> None:
        pass


def running_costs(records: DataFrame, seconds: int) -> DataFrame:
    """window_start, at, group, machine, space and cost of every closed window."""
    ship(records.sparkSession)
    count = {c: F.count_if(F.col("gtype") == kind) for c, kind in (("i", "inner"), ("o", "outer"), ("l", "outlier"))}
    counts = per_window(records, seconds, *GROUP, **count).withColumn("slot", F.pmod(F.xxhash64(*GROUP), F.lit(SLOTS)).cast("int"))
    schema = "window_start long, at timestamp, group_id int, machine int, space_id int, cost long"
    return counts.groupBy("slot").transformWithStateInPandas(CostProcessor(), schema, "Append", "None", eventTimeColumnName="at")


class RunningProcessor(StatefulProcessor):
    """Values of one key combined over its windows, by sum or by maximum; state is one number for each."""

    def __init__(self, key: str, values: list[str], maximum: bool):
        self.key, self.values, self.maximum = key, values, maximum

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("so_far", ", ".join(f"{v} long" for v in self.values))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        so_far, out = self.state.get(), []
        for r in pd.concat(list(rows)).sort_values("window_start").to_dict("records"):
            new = tuple(int(r[v]) for v in self.values)
            so_far = new if so_far is None else tuple(max(a, b) if self.maximum else a + b for a, b in zip(so_far, new, strict=True))
            out.append((r["window_start"], r["at"], int(key[0]), *so_far))
        self.state.update(tuple(so_far))
        yield pd.DataFrame(out, columns=["window_start", "at", self.key, *self.values])

    def close(self) -> None:
        pass


def running(windows: DataFrame, key: str, *values: str, maximum: bool = False) -> DataFrame:
    """Closed windows' values of a key (one integer column) combined with those of all its windows before."""
    ship(windows.sparkSession)
    schema = f"window_start long, at timestamp, {key} int, " + ", ".join(f"{v} long" for v in values)
    return windows.groupBy(key).transformWithStateInPandas(RunningProcessor(key, list(values), maximum), schema, "Append", "None", eventTimeColumnName="at")


def collected_windows(windows: DataFrame, seconds: int, *columns: str) -> DataFrame:
    """All rows of a closed window in one sorted list (as many as machines): a window over windows."""
    made = windows.groupBy(F.window("at", f"{seconds} seconds")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("items"))
    return made.select(F.unix_millis("window.start").alias("window_start"), "items")


def comparisons(records: DataFrame, seconds: int) -> DataFrame:
    return per_window(records, seconds, "machine", comparisons=F.sum(F.when(F.col("match"), 1).otherwise(FAILURE_WEIGHT)).cast("long"))


def window_costs(records: DataFrame, seconds: int) -> DataFrame:
    """Cost of mapping records to groups plus that of joining them, per closed window and partition.

    Two aggregates, each behind its own stateful operator, meet in a stream-stream join on the
    window's time; both sides' watermarks let their rows go.
    """
    sizes = per_window(records, seconds, "space_id", groups=F.max("group_id").cast("long"), n=F.count("*"))
    ship(records.sparkSession)
    schema = "window_start long, at timestamp, space_id int, mapping long"
    mapping = sizes.groupBy("space_id").transformWithStateInPandas(MappingProcessor(), schema, "Append", "None", eventTimeColumnName="at")
    cost = running_costs(records, seconds)
    joining = cost.groupBy(F.window("at", f"{seconds} seconds"), "space_id").agg(F.sum("cost").alias("joining"))
    joining = joining.select(F.window_time("window").alias("j_at"), F.col("space_id").alias("j_space"), "joining")
    on = (F.col("at") == F.col("j_at")) & (F.col("space_id") == F.col("j_space"))
    return mapping.join(joining, on).select("window_start", F.col("space_id").alias("part"), (F.col("mapping") + F.col("joining")).alias("total_cost"))


class MappingProcessor(StatefulProcessor):
    """Groups a partition has had so far times the records of a window."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.groups = handle.getValueState("groups", "groups long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        most, out = (self.groups.get() or (0,))[0], []
        for r in pd.concat(list(rows)).sort_values("window_start").itertuples():
            most = max(most, int(r.groups))
            out.append((int(r.window_start), r.at, int(key[0]), most * int(r.n)))
        self.groups.update((most,))
        yield pd.DataFrame(out, columns=["window_start", "at", "space_id", "mapping"])

    def close(self) -> None:
        pass


class LatenessProcessor(StatefulProcessor):
    """Tells records whose window has closed from the rest, by the watermark the operator sees."""

    def __init__(self, window_ms: int, columns: list[str]):
        self.window_ms, self.columns = window_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        watermark = timers.getCurrentWatermarkInMs()
        for r in rows:
            yield r.assign(late=(r["ts"] // self.window_ms + 1) * self.window_ms <= watermark)[[*self.columns, "late"]]

    def close(self) -> None:
        pass


def with_lateness(records: DataFrame, seconds: int, late_s: int, key: str = "machine") -> DataFrame:
    """Every record, with ``late`` true where its window had closed when it came; none is dropped.

    The time column of the watermark is left out of what the operator sees, so that late rows
    reach it; ``split_late`` deals a batch to two outputs.
    """
    ship(records.sparkSession)
    plain = timed(records, seconds, late_s=late_s).drop("at")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", late boolean"
    return plain.groupBy(key).transformWithStateInPandas(LatenessProcessor(seconds * 1000, plain.columns), schema, "Append", "EventTime")


def split_late() -> dict[str, Callable[[DataFrame], DataFrame]]:
    return {"on_time": lambda b: b.where("NOT late").drop("late"), "late": lambda b: b.where("late").drop("late")}


class BarrierProcessor(StatefulProcessor):
    """Lets a window through once, when the last of the metrics that it waits for has come."""

    def __init__(self, metrics: tuple[str, ...]):
        self.metrics = metrics

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "metrics array<string>, fired boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        seen, fired = self.seen.get() or ([], False)
        came = {m for r in rows for m in r["metric"]}
        seen = sorted((set(seen) | came) & set(self.metrics))
        fires = not fired and len(seen) == len(self.metrics)
        self.seen.update((seen, fired or fires))
        yield pd.DataFrame({"window_start": [int(key[0])]} if fires else {"window_start": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def barrier(messages: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """window_start, once for every window of which all metrics have come; messages: metric, window_start."""
    ship(messages.sparkSession)
    return messages.groupBy("window_start").transformWithStateInPandas(BarrierProcessor(tuple(metrics)), "window_start long", "Append", "None")


def statistics(results: DataFrame, seconds: int) -> dict[str, DataFrame]:
    """The five windowed metrics of a stream of monitored results, by the name their messages carry."""
    records = timed(results, seconds)
    return {
        "latency-percentiles-per-machine": per_window(records, seconds, "machine", p=percentiles("latency")).select("window_start", "machine", *percentile_columns("p")),
        "final-comps-per-machine": comparisons(records, seconds).drop("at"),
        "final-comps-per-group": running_costs(records, seconds).drop("at"),
        "size-per-group": per_window(records, seconds, *GROUP, bytes=F.sum("bytes")).drop("at"),
        "throughput": per_window(records, seconds, n=F.count("*")).drop("at"),
    }


def write_statistics(results: DataFrame, job: str, seconds: int, path: str, checkpoint: str) -> list[StreamingQuery]:
    """Starts a query for each metric that writes its messages under ``path``, a window once, when it is complete.

    A batch that is repeated overwrites its own folder.
    """
    queries = []
    for metric, df in statistics(results, seconds).items():

        def write(batch: DataFrame, number: int, metric=metric) -> None:
            as_messages(batch, job, metric).write.mode("overwrite").parquet(f"{path}/metric={metric}/batch={number}")

        queries.append(df.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", f"{checkpoint}/{metric}").trigger(availableNow=True).start())
    return queries
