"""The queries of the library's own operators, each with its SQL where SQL can express it.

Tables stand in for the streams: ``embeddings`` are the vectors (event_ts is the number of
a vector), ``events`` the monitored results (a user is a group, ten machines, the value is
a latency), ``documents`` the texts. Low-dimensional queries use a vector's first two
coordinates.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearspan.functions import vectors as v
from nearspan.operators import balance, stats, text
from nearspan.operators.grouping import group_leaders, leader_snapshots
from nearspan.operators.join import (
    HIGH_DIMENSION,
    grid_join,
    group_side,
    grouped_pairs,
    grouped_rows,
    partitioned_pairs,
    partitioned_results,
    result_rows,
    similarity_join,
    split_matches,
    tagged,
    throughput_ticks,
    with_window,
)
from nearspan.operators.space import random_centroids, space_partition
from nearspan.sources import generators
from nearspan.sources.text import vector_lines

DIM, HIGH, LOW, PARTS, WINDOW_S = 64, 0.4, 0.002, 10, 86_400
#: Milliseconds of a time without zone.
MILLIS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"
#: Reference points of the streams that are joined by partitions, not by groups.
STREAM_POINTS = 512
MACHINES = stats.machine_labels(PARTS)
MORE_MACHINES = stats.machine_labels(2 * PARTS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder where all executors can read and write; a local one only in local mode where none is named."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        path = "/tmp/nearspan-checkpoints"
    return f"{path}/{uuid.uuid4().hex}"


def stateful(run):
    """A query that runs streams, with as many state partitions as cores, or fewer where the session has fewer."""

    def wrapped(spark, sf_dir):
        key = "spark.sql.shuffle.partitions"
        before = spark.conf.get(key)
        spark.conf.set(key, str(min(int(before), max(2, spark.sparkContext.defaultParallelism))))
        try:
            return run(spark, sf_dir)
        finally:
            spark.conf.set(key, before)

    return wrapped


def vectors(spark, sf_dir, dim=DIM) -> DataFrame:
    e = F.transform(F.slice("embedding", 1, dim), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("event_ts"), (F.col("vec_id") * 1000).alias("ingest_ts"), F.col("vec_id").alias("id"), e.alias("vec"))


def halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("id % 2 = 0"), df.where("id % 2 = 1")


def monitored(events: DataFrame) -> DataFrame:
    """Monitored rows: ts, machine, group, type, latency, bytes, whether it matched."""
    return events.select(
        F.expr(MILLIS).alias("ts"),
        (F.col("user_id") % PARTS).cast("int").alias("part"),
        v.machine_label(F.col("user_id") % PARTS, PARTS).alias("machine"),
        F.col("user_id").cast("int").alias("group_id"),
        F.when(F.col("event_type") == "click", "outer").when(F.col("event_type") == "error", "outlier").otherwise("inner").alias("gtype"),
        F.floor(F.col("value") * 100).cast("long").alias("latency"),
        (F.col("event_type") == "view").alias("match"),
        "event_id",
        (40 + 8 * (F.col("event_id") % 7)).cast("long").alias("bytes"),
    )


def results(spark, sf_dir) -> DataFrame:
    """The monitored rows with their window."""
    return stats.windowed(monitored(table(spark, sf_dir, "events")), "ts", WINDOW_S)


def pairs(df: DataFrame) -> DataFrame:
    return df.select("left_id", "right_id", F.round("distance", 6).alias("distance"))


def join_query(threshold: float, dim: int, strategy: str, two: bool = False, window: int | None = None):
    def run(spark, sf_dir):
        l, r = halves(vectors(spark, sf_dir, dim)) if two else (vectors(spark, sf_dir, dim), None)
        return pairs(similarity_join(l, r, threshold=threshold, dim=dim, strategy=strategy, window=window))

    return run


def spaces(spark, sf_dir) -> DataFrame:
    return space_partition(vectors(spark, sf_dir, 2), random_centroids(PARTS, 2), LOW)


def compared(spark, sf_dir) -> DataFrame:
    df = with_window(tagged(vectors(spark, sf_dir, 2), None), None)
    return partitioned_pairs(df, True, LOW, 2, PARTS).withColumn("match", F.col("distance") < LOW)


def compared_results(spark, sf_dir) -> DataFrame:
    """The matches and every 101st (by a hash) of the failed ones of the same comparisons."""
    return partitioned_results(with_window(tagged(vectors(spark, sf_dir, 2), None), None), True, LOW, 2, PARTS, 101)


def groups(spark, sf_dir) -> DataFrame:
    return grouped_rows(with_window(tagged(vectors(spark, sf_dir, 2), None), 100), LOW, 2, PARTS)


def streamed(two: bool, grouped: bool, threshold: float = LOW, dim: int = 2):
    @stateful
    def run(spark, sf_dir):
        from nearspan.streaming.join import stream_brute, stream_grouped, stream_partitioned, with_state_store

        def source(rest: int | None) -> DataFrame:
            schema = table(spark, sf_dir, "embeddings").schema
            raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/embeddings.parquet*")  # a pattern fits a file and a folder
            raw = raw if rest is None else raw.where(F.col("vec_id") % 2 == rest)
            e = F.transform(F.slice("embedding", 1, dim), lambda x: x.cast("double"))
            return raw.select(F.col("vec_id").alias("event_ts"), F.col("vec_id").alias("ingest_ts"), F.col("vec_id").alias("id"), e.alias("vec"))

        l, r = (source(0), source(1)) if two else (source(None), None)
        if grouped or dim >= HIGH_DIMENSION:
            with_state_store(spark)
        if grouped:
            out = stream_grouped(l, r, threshold=threshold, dim=dim, window_s=1_000_000, centroids=PARTS)
        elif dim >= HIGH_DIMENSION:
            out = stream_brute(l, r, threshold=threshold, window_s=1_000_000)
        else:  # a stream's size is not known before; in low dimensions more points cost little
            out = stream_partitioned(l, r, threshold=threshold, dim=dim, window_s=1_000_000, centroids=STREAM_POINTS)
        folder = shared_folder(spark)
        writer = out.select("left_id", "right_id").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema("left_id long, right_id long").parquet(f"{folder}/out")

    return run


def vector_stream(spark, sf_dir, where: str = "true") -> DataFrame:
    """The first two coordinates of the embeddings as a stream, one record a second."""
    raw = spark.readStream.schema(table(spark, sf_dir, "embeddings").schema).parquet(f"{sf_dir}/embeddings.parquet*").where(where)
    e = F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double"))
    return raw.select((F.col("vec_id") * 1000).alias("event_ts"), (F.col("vec_id") * 1000).alias("ingest_ts"), F.col("vec_id").alias("id"), e.alias("vec"))


def join_outputs(name: str):
    """One of the outputs of a running grouped join over all embeddings, windows of 100 of them."""

    @stateful
    def run(spark, sf_dir):
        from nearspan.streaming.join import split, stream_outputs, with_state_store, write_outputs

        with_state_store(spark)
        folder = shared_folder(spark)
        out = stream_outputs(vector_stream(spark, sf_dir), threshold=LOW, dim=2, window_s=100, every=101)
        write_outputs(out, f"{folder}/out", f"{folder}/state").awaitTermination()
        made = split()[name](out)
        return spark.read.schema(made.schema).parquet(f"{folder}/out/{name}/*").drop("out_ts")

    return run


@stateful
def stream_migrated(spark, sf_dir):
    """The grouped join stopped half-way, every third group given to another machine, and run on from its state."""
    from nearspan.streaming.join import exported_leaders, exported_state, migrated, split, stream_outputs, with_state_store, write_outputs

    with_state_store(spark)
    folder, half = shared_folder(spark), F.expr("CAST(div(max(vec_id), 2) AS BIGINT)")
    half = table(spark, sf_dir, "embeddings").agg(half).collect()[0][0] or 0
    start = None
    for number, where in enumerate((f"vec_id <= {half}", f"vec_id > {half}")):
        out = stream_outputs(vector_stream(spark, sf_dir, where), threshold=LOW, dim=2, window_s=100, initial=start)
        write_outputs(out, f"{folder}/out{number}", f"{folder}/state{number}").awaitTermination()
        if number == 0:
            leaders = exported_leaders(spark, f"{folder}/state0").select("group_id", F.col("part").alias("space_id"), "machine")
            moves = leaders.where("group_id % 3 = 0").withColumn("new_machine", ((F.col("machine") + 13) % 128).cast("int"))
            migrated(exported_state(spark, f"{folder}/state0"), moves).write.parquet(f"{folder}/moved")
            start = spark.read.parquet(f"{folder}/moved")
    schema = split()["results"](out).schema
    parts = [spark.read.schema(schema).parquet(f"{folder}/out{k}/results/*") for k in (0, 1)]
    return parts[0].unionByName(parts[1]).select("left_id", "right_id", "part", "group_id", "machine")


@stateful
def stream_counts(spark, sf_dir):
    """Counts of all windows so far: every batch writes them anew."""
    from nearspan.streaming.sinks import windowed_counts

    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.timestamp_millis(F.expr(MILLIS)))
    out, folder = windowed_counts(events, WINDOW_S, "event_type"), shared_folder(spark)
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out")
    out.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def monitored_stream(spark, sf_dir) -> DataFrame:
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    return monitored(raw).withColumn("space_id", F.col("part"))


def appended(make):
    """A stream of closed windows of the monitored rows, appended to files and read from there."""

    @stateful
    def run(spark, sf_dir):
        from nearspan.streaming import monitor
        from nearspan.streaming.join import with_state_store
        from nearspan.streaming.sinks import to_files

        with_state_store(spark)
        out, folder = make(monitor, monitor.timed(monitored_stream(spark, sf_dir), WINDOW_S)), shared_folder(spark)
        to_files(out, f"{folder}/out", f"{folder}/state").awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{folder}/out")

    return run


@stateful
def stream_rebalanced(spark, sf_dir):
    """The whole loop: a join is monitored, windows that are complete are judged, groups move, the join runs on from its state."""
    from nearspan.streaming import control
    from nearspan.streaming.join import split, stream_outputs, with_state_store, write_outputs

    with_state_store(spark)
    folder = shared_folder(spark)
    half = table(spark, sf_dir, "embeddings").agg(F.expr("CAST(div(max(vec_id), 2) AS BIGINT)")).collect()[0][0] or 0
    first = stream_outputs(vector_stream(spark, sf_dir, f"vec_id <= {half}"), threshold=LOW, dim=2, window_s=100, every=1)
    write_outputs(first, f"{folder}/first", f"{folder}/first-state").awaitTermination()
    messages = control.monitored(control.file_reader(spark, f"{folder}/first"), folder, 100)
    start = None
    for window in control.complete_windows(spark, messages, folder)[-1:]:
        start = control.rebalanced(spark, messages, window, f"{folder}/first-state", folder, tolerance=0.0)
    if start is None:  # in balance, or no window was complete: the state as it is
        from nearspan.streaming.join import exported_state

        exported_state(spark, f"{folder}/first-state").write.parquet(f"{folder}/start")
        start = spark.read.parquet(f"{folder}/start")
    then = stream_outputs(vector_stream(spark, sf_dir, f"vec_id > {half}"), threshold=LOW, dim=2, window_s=100, every=1, initial=start)
    write_outputs(then, f"{folder}/then", f"{folder}/then-state").awaitTermination()
    schema = split()["results"](then).schema
    return spark.read.schema(schema).parquet(f"{folder}/first/results/*", f"{folder}/then/results/*").where("match").select("left_id", "right_id", "part", "group_id")


def stream_replayed(spark, sf_dir):
    """The stored embeddings replayed 100 a second, a fifth of them a batch, and stopped and started half-way."""
    from nearspan.sources import replay as r

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dim"))
    folder, total = shared_folder(spark), rows.count()
    block = max(1, -(-total // 5))
    r.stored_blocks(r.numbered(rows, f"{folder}/numbered", "vec_id"), f"{folder}/blocks", block)
    for until in (total // 2, total):
        out = r.replay(spark, f"{folder}/blocks", 100, block)
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(processingTime="1 second").start()
        while query.isActive and not r.replayed_all(query, until, block):
            query.awaitTermination(0.2)
        query.stop()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@stateful
def stream_statistics(spark, sf_dir):
    """All messages of the five metrics over the whole stream of events: metric, window, keys, value."""
    from nearspan.streaming.join import with_state_store
    from nearspan.streaming.monitor import closing_mark, write_statistics
    from nearspan.streaming.sinks import from_messages

    with_state_store(spark)
    folder = shared_folder(spark)
    last = monitored(table(spark, sf_dir, "events")).agg(F.max("ts")).collect()[0][0]
    records = monitored_stream(spark, sf_dir)
    if last is not None:
        records = closing_mark(records, f"{folder}/end", last, WINDOW_S)
    for q in write_statistics(records, "job", WINDOW_S, f"{folder}/out", f"{folder}/state"):
        q.awaitTermination()
    values = {"latency-percentiles-per-machine": "p99", "final-comps-per-machine": "comparisons", "final-comps-per-group": "cost", "size-per-group": "bytes", "throughput": "n"}
    sent, out = spark.read.parquet(f"{folder}/out"), None
    for metric, value in values.items():
        # A metric's messages are a folder, so each is read once.
        rows = from_messages(sent.where(F.col("metric") == metric), metric, T.StructType([T.StructField(c, T.LongType()) for c in ("window_start", "machine", "group_id", "space_id", value)]))
        rows = rows.select(F.lit(metric).alias("metric"), "window_start", "machine", "group_id", "space_id", F.col(value).alias("measured"))
        out = rows if out is None else out.unionByName(rows)
    return out


def vocabulary(spark, sf_dir) -> DataFrame:
    """Pseudo-words: the number of a vector names its word, two letters in base 26 and what is left over."""
    rest = F.expr("CASE WHEN vec_id < 676 THEN '' ELSE CAST(div(vec_id, 676) AS STRING) END")
    word = F.concat(F.char(97 + F.col("vec_id") % 26), F.char(97 + F.expr("div(vec_id, 26)") % 26), rest)
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(word.alias("word"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def texts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))


def coordinates(df: DataFrame, *own: str) -> DataFrame:
    """The whole vector, a column v0, v1, ... for each rounded coordinate."""
    return df.select("id", *own, *[F.round(F.get("vec", F.lit(i)), 6).alias(f"v{i}") for i in range(DIM)])


def group_sizes(spark, sf_dir) -> DataFrame:
    r = results(spark, sf_dir)
    return stats.group_bytes(r.withColumn("space_id", F.col("part")), ["group_id", "machine", "space_id"])


def group_costs(spark, sf_dir) -> DataFrame:
    r = results(spark, sf_dir)
    counts = stats.record_counts(r.withColumn("space_id", F.col("part")), ["window_start", "group_id", "machine", "space_id", "gtype"])
    return stats.join_costs(counts, ["group_id", "machine", "space_id"])


def balancer_rows(spark, sf_dir) -> DataFrame:
    costs = group_costs(spark, sf_dir).groupBy("group_id", "machine", "space_id").agg(F.sum("cost").alias("cost"))
    return stats.balancer_input(group_sizes(spark, sf_dir).drop("gtype"), costs)


def rebalanced(name: str | None):
    def run(spark, sf_dir):
        plan = balance.to_plan(balancer_rows(spark, sf_dir))
        return balance.to_frame(spark, balance.ALGORITHMS[name](plan) if name else balance.rebalance(plan))

    return run


def migrated(spark, sf_dir):
    """State of the groups after an allocation that names all and moves every third to the next machine."""
    state = group_sizes(spark, sf_dir).drop("gtype")
    moved = F.expr("CASE WHEN group_id % 3 = 0 THEN CAST((machine + 13) % 128 AS INT) ELSE machine END")
    made = state.select("group_id", "machine", "space_id", moved.alias("new_machine"))
    return balance.rekeyed(state, made)


def machine_windows(spark, sf_dir):
    return stats.latency_percentiles(results(spark, sf_dir), ["window_start", "machine"])


def lines_query(spark, sf_dir):
    e = vectors(spark, sf_dir, 2)
    body = F.concat(F.lit("["), F.array_join(F.transform("vec", lambda x: x.cast("string")), ", "), F.lit("]"))
    parsed = vector_lines(e.select(F.concat_ws(", ", "event_ts", "id", body).alias("value")), F.lit(0))
    return parsed.select("event_ts", "id", F.round(F.get("vec", F.lit(0)), 6).alias("x"), F.round(F.get("vec", F.lit(1)), 6).alias("y"))


def generated_ranges(spark, sf_dir) -> DataFrame:
    """Records of every tick of the random sources, and how many are what the source promises."""
    g, out = generators, None
    for name, df, promise in (
        ("gaussian", g.gaussian_vectors(spark, 100, 10, 8), "size(vec) = 8 AND NOT exists(vec, x -> isnan(x) OR abs(x) > 30)"),
        ("pareto", g.pareto_vectors(spark, 100, 10), "size(vec) = 2 AND array_min(vec) >= 1"),
        ("skewed", g.skewed_vectors(spark, 100, 10), "size(vec) = 2 AND array_min(vec) >= -1 AND array_max(vec) <= 1"),
        ("topics", g.pareto_topics(spark, 100, 10), "size(vec) = 2 AND NOT exists(vec, x -> isnan(x))"),
        ("zipf", g.zipf_words(spark, ["a", "b", "c", "d"], 100, 10), "word IN ('a', 'b', 'c', 'd')"),
    ):
        one = df.groupBy("event_ts").agg(F.count("*").alias("n"), F.count_if(F.expr(promise)).alias("valid")).select(F.lit(name).alias("source"), "event_ts", "n", "valid")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "sim_self_brute": join_query(HIGH, DIM, "brute"),
    "sim_self_high_partitioned": join_query(HIGH, DIM, "partitioned"),
    "sim_self_partitioned": join_query(LOW, 2, "partitioned"),
    "sim_self_grouped": join_query(LOW, 2, "grouped"),
    "sim_self_windowed": join_query(0.01, 2, "partitioned", window=100),
    "sim_self_windowed_grouped": join_query(0.01, 2, "grouped", window=100),
    "sim_twoway_brute": join_query(HIGH, DIM, "brute", True),
    "sim_twoway_partitioned": join_query(LOW, 2, "partitioned", True),
    "sim_twoway_grouped": join_query(LOW, 2, "grouped", True),
    "stream_self_join": streamed(False, False),
    "stream_self_grouped": streamed(False, True),
    "stream_twoway_join": streamed(True, False),
    "stream_twoway_grouped": streamed(True, True),
    "stream_self_high_join": streamed(False, False, HIGH, DIM),
    "stream_result_rows": join_outputs("results"),
    "stream_group_side": join_outputs("group_side"),
    "stream_throughput_ticks": join_outputs("throughput"),
    "stream_compared": join_outputs("compared"),
    "stream_migrated": stream_migrated,
    "stream_rebalanced": stream_rebalanced,
    "stream_replayed": stream_replayed,
    "stream_window_counts": stream_counts,
    "cosine_distance_join": lambda s, d: grid_join(with_window(tagged(vectors(s, d), None), None), True, math.acos(1 - 0.7) / math.pi).select(
        F.col("left_id").alias("l_id"), F.col("right_id").alias("r_id"), F.round(1 - F.cos(F.col("distance") * F.pi()), 6).alias("cosine_distance")
    ),
    "failed_comparison_sample": lambda s, d: compared_results(s, d).where(F.col("distance") >= LOW).select("l_id", "r_id", F.round("distance", 6).alias("distance")),
    "join_result_rows": lambda s, d: result_rows(compared_results(s, d), LOW, 1).drop("out_ts", "group_id"),
    "join_result_split": lambda s, d: split_matches(result_rows(compared_results(s, d), LOW, 1))[1],
    "group_side_output": lambda s, d: group_side(groups(s, d)),
    "throughput_ticks": lambda s, d: throughput_ticks(vectors(s, d)),
    "stream_statistics": stream_statistics,
    "stream_join_costs": appended(lambda m, r: m.running_costs(r, WINDOW_S).drop("at")),
    "stream_comparisons_collected": appended(lambda m, r: m.collected_windows(m.comparisons(r, WINDOW_S), WINDOW_S, "machine", "comparisons").select("window_start", F.expr("array_join(transform(items, x -> concat(x.machine, ':', x.comparisons)), ',')").alias("items"))),
    "stream_latency_avg": appended(lambda m, r: m.running(m.per_window(r, WINDOW_S, "machine", total=F.sum("latency"), n=F.count("*")), "machine", "total", "n").select("machine", "window_start", F.expr("div(total, n)").alias("avg_ms"), F.expr("div(div(total, n), 1000)").alias("avg_s"))),
    "stream_group_numbers": appended(lambda m, r: m.running(m.per_window(r, WINDOW_S, "part", groups=F.max("group_id").cast("long")), "part", "groups", maximum=True).select("part", "window_start", "groups")),
    "stream_window_costs": appended(lambda m, r: m.window_costs(r, WINDOW_S)),
    "space_partition": lambda s, d: spaces(s, d).select("id", "home_part", "part", "ptype", "machine"),
    "partition_sizes": lambda s, d: stats.record_counts(spaces(s, d), ["part"]),
    "partition_record_types": lambda s, d: stats.type_counts(spaces(s, d), "part", "ptype", ["pInner", "pOuter"]),
    "partition_matches": lambda s, d: stats.match_counts(compared(s, d).withColumnRenamed("l_part", "part"), ["part"]),
    "between_partitions": lambda s, d: stats.match_counts(stats.between_partitions(compared(s, d)), ["part", "other_part"]),
    "group_leaders": lambda s, d: group_leaders(groups(s, d)).select("part", "group_id", "ts", "id"),
    "group_snapshots": lambda s, d: leader_snapshots(groups(s, d)).select("win", "part", "groups", F.expr("array_join(transform(leaders, x -> concat(x.group_id, ':', x.id)), ',')").alias("leaders")),
    "group_result_rows": lambda s, d: result_rows(grouped_pairs(groups(s, d), True, 2), LOW, 101).drop("out_ts"),
    "group_record_types": lambda s, d: stats.type_counts(groups(s, d), "part", "gtype", ["inner", "outer", "outlier"]),
    "between_groups": lambda s, d: stats.match_counts(stats.between_groups(grouped_pairs(groups(s, d), True, 2).withColumns({"match": F.col("distance") < LOW, "part": F.col("l_part"), "group_id": F.col("l_group_id")})), ["part", "group_id", "other_group"]),
    "pair_norms": lambda s, d: vectors(s, d).select("id", F.round(v.norm(F.col("vec")), 6).alias("norm"), F.round(v.euclidean_distance(F.col("vec"), F.array(*[F.lit(0.1)] * DIM)), 6).alias("euclid"), v.record_bytes(F.col("vec"), F.lit("inner"), F.lit("pInner"), F.lit("single")).alias("bytes")),
    "parsed_lines": lines_query,
    "latency_percentiles": machine_windows,
    "latency_percentiles_sampled": lambda s, d: stats.latency_percentiles(stats.bernoulli(results(s, d), 0.5, key="event_id"), ["window_start", "machine"]),
    "latency_sums": lambda s, d: stats.latency_sums(results(s, d), ["window_start", "machine"]),
    "latency_avg": lambda s, d: stats.average_latency(stats.latency_sums(results(s, d), ["window_start", "machine"]), "machine", "window_start"),
    "comparisons_per_machine": lambda s, d: stats.weighted_comparisons(results(s, d), ["window_start", "machine"]),
    "comparisons_collected": lambda s, d: stats.collected(stats.weighted_comparisons(results(s, d), ["window_start", "machine"]), "window_start", "machine", "comparisons").select("window_start", F.expr("array_join(transform(items, x -> concat(x.machine, ':', x.comparisons)), ',')").alias("items")),
    "group_bytes_window": lambda s, d: stats.group_bytes(results(s, d), ["window_start", "group_id", "machine"]),
    "running_group_sizes": lambda s, d: stats.running(stats.group_bytes(results(s, d), ["window_start", "group_id"]), ["group_id"], "window_start", "bytes", "total_bytes").select("window_start", "group_id", "bytes", "total_bytes"),
    "record_counts": lambda s, d: stats.record_counts(results(s, d), ["window_start", "machine", "group_id", "gtype"]),
    "join_costs": group_costs,
    "input_throughput": lambda s, d: stats.throughput(results(s, d), 3600),
    "load_candidates": lambda s, d: stats.candidate_nodes(stats.record_counts(results(s, d), ["machine"]).withColumnRenamed("n", "load")),
    "densified_loads": lambda s, d: stats.densified(stats.record_counts(results(s, d), ["machine"]).withColumnRenamed("n", "load"), MORE_MACHINES),
    "match_counts": lambda s, d: stats.match_counts(results(s, d), ["part", "group_id"]),
    "group_numbers": lambda s, d: stats.group_numbers(results(s, d)),
    "latest_sizes": lambda s, d: stats.latest(stats.record_counts(results(s, d), ["part", "window_start"]), ["part"], "window_start", "n"),
    "machine_frame": lambda s, d: stats.by_machine(machine_windows(s, d), MACHINES, "p99"),
    "across_machines": lambda s, d: stats.across_machines(machine_windows(s, d), "p99").select("window_start", F.round("mean", 6).alias("mean"), "max"),
    "latency_imbalance_percentile": lambda s, d: stats.imbalance_by_percentile(machine_windows(s, d), "p50"),
    "latency_imbalance_average": lambda s, d: stats.imbalance_by_average(stats.latency_sums(results(s, d), ["window_start", "machine"])),
    "metric_barrier": lambda s, d: stats.barrier("window_start", results(s, d).where("match"), results(s, d).where("gtype = 'outer'"), results(s, d).where("gtype = 'outlier'")),
    "window_costs": lambda s, d: stats.total_costs(
        stats.window_costs(stats.group_numbers(results(s, d)), stats.record_counts(results(s, d), ["window_start", "part"])),
        group_costs(s, d).groupBy("window_start", F.col("space_id").alias("part")).agg(F.sum("cost").alias("cost")),
    ),
    "lb_input": balancer_rows,
    "rebalance_aaa": rebalanced("aaa"),
    "rebalance_aaa_m": rebalanced("aaa_m"),
    "rebalance_greedy": rebalanced("greedy"),
    "rebalance_mr_partition": rebalanced("mr_partition"),
    "rebalance_imlp_c": rebalanced("imlp_c"),
    "rebalance_imlp_m": rebalanced("imlp_m"),
    "rebalance_best": rebalanced(None),
    "migrated_state": migrated,
    "text_embedding_mean": lambda s, d: coordinates(text.text_vectors(texts(s, d), vocabulary(s, d), DIM), "n_known"),
    "text_embedding_whole": lambda s, d: coordinates(text.text_vectors(texts(s, d), vocabulary(s, d), DIM), "n_known"),
    "vocab_filter": lambda s, d: text.with_known_word(texts(s, d), vocabulary(s, d), ignored="is").select("id"),
    "clean_dataset": lambda s, d: text.clean_dataset(texts(s, d), vocabulary(s, d), "text").select("id", F.length("text").cast("long").alias("n_chars")),
    "embed_dataset": lambda s, d: coordinates(text.embed_dataset(texts(s, d), vocabulary(s, d), DIM, "text")),
    "generated_ticks": lambda s, d: generators.uniform_vectors(s, 100, 30).groupBy("event_ts").agg(F.count("*").alias("n"), F.count_if(F.expr("size(vec) = 2 AND array_min(vec) >= -1 AND array_max(vec) < 1")).alias("valid")),
    "generated_zipf": lambda s, d: generators.zipf_words(s, ["a", "b", "c", "d"], 1000, 10).groupBy("word").count(),
    "generated_gaussian": lambda s, d: generators.gaussian_vectors(s, 100, 10, 8),
    "generated_skewed": lambda s, d: generators.skewed_vectors(s, 100, 10),
    "generated_pareto": lambda s, d: generators.pareto_vectors(s, 100, 10),
    "generated_topics": lambda s, d: generators.pareto_topics(s, 100, 10),
    "generated_ranges": generated_ranges,
    "generated_benchmark": lambda s, d: generators.benchmark_vectors(s, 100, 10, 8).select("event_ts", "ingest_ts", "id", F.expr("size(vec) = 8 AND array_min(vec) >= -1 AND array_max(vec) < 1").alias("valid")),
    "generated_words": lambda s, d: generators.uniform_words(s, ["a", "b", "c"], 100, 30).groupBy("event_ts").agg(F.count("*").alias("n"), F.count_if(F.col("word").isin("a", "b", "c")).alias("valid")),
    "replayed_vectors": lambda s, d: generators.embedding_stream(s, table(s, d, "embeddings"), 100).select("event_ts", "ingest_ts", "id", F.size("vec").alias("dim")),
}


_ANGLE = "acos(greatest(-1.0, least(1.0, list_cosine_similarity({a}, {b})))) / pi()"


def _pairs_sql(threshold: float, dim: int, two: bool = False, window: int | None = None, distance: bool = True) -> str:
    left, right = ("a.id % 2 = 0", "b.id % 2 = 1") if two else ("a.id > b.id", "true")
    within = f" AND a.id // {window} = b.id // {window}" if window else ""
    angle = _ANGLE.format(a="a.vec", b="b.vec")
    return f"""WITH v AS (SELECT vec_id AS id, (embedding[1:{dim}])::DOUBLE[] AS vec FROM embeddings)
SELECT a.id AS left_id, b.id AS right_id{f', round({angle}, 6) AS distance' if distance else ''} FROM v a, v b WHERE {left} AND {right}{within} AND {angle} < {threshold}"""


def _space_sql() -> str:
    rows = ", ".join(f"({k}, [{c[0]!r}, {c[1]!r}]::DOUBLE[])" for k, c in enumerate(random_centroids(PARTS, 2)))
    return f"""v AS (SELECT vec_id AS id, (embedding[1:2])::DOUBLE[] AS vec FROM embeddings),
c(k, centre) AS (VALUES {rows}),
dd AS (SELECT id, list({_ANGLE.format(a='vec', b='centre')} ORDER BY k) AS d FROM v, c GROUP BY id),
hh AS (SELECT id, d, CAST(list_position(d, list_min(d)) - 1 AS INTEGER) AS home_part FROM dd),
sp AS (SELECT id, home_part, CAST(i AS INTEGER) AS part, CASE WHEN i = home_part THEN 'pInner' ELSE 'pOuter' END AS ptype, CAST((i * 128 + {PARTS - 1}) // {PARTS} AS INTEGER) AS machine
  FROM hh, range({PARTS}) r(i) WHERE i = home_part OR (d[i + 1] <= d[home_part + 1] + 2 * {LOW} AND (home_part < i) <> ((home_part + i) % 2 = 1))),
cp AS (SELECT a.part, a.ptype AS l_ptype, b.ptype AS r_ptype, a.home_part AS l_home, b.home_part AS r_home, {_ANGLE.format(a='x.vec', b='y.vec')} < {LOW} AS match
  FROM sp a JOIN sp b ON a.part = b.part AND a.id > b.id AND NOT (a.ptype = 'pOuter' AND b.ptype = 'pOuter') JOIN v x ON x.id = a.id JOIN v y ON y.id = b.id)"""


#: The groups of every partition: leaders one record after the other, through all windows, the rest
#: from the leaders. A copy from outside reaches the leaders before it and the later ones of its window.
_GROUPS_SQL = f"""WITH RECURSIVE {_space_sql()},
a AS (SELECT sp.*, id // 100 AS win, vec FROM sp JOIN v USING (id)),
q AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY id) AS n FROM a WHERE ptype = 'pInner'),
steps(part, n, leads) AS (SELECT DISTINCT part, CAST(0 AS BIGINT), []::STRUCT(id BIGINT, vec DOUBLE[])[] FROM q
  UNION ALL SELECT s.part, q.n, CASE WHEN coalesce(list_min([{_ANGLE.format(a='x.vec', b='q.vec')} for x in s.leads]), 9) > {LOW} THEN list_append(s.leads, {{'id': q.id, 'vec': q.vec}}) ELSE s.leads END
  FROM steps s JOIN q ON q.part = s.part AND q.n = s.n + 1),
ends AS (SELECT part, max_by(leads, n) AS leads FROM steps GROUP BY part),
ld AS (SELECT part, CAST(g AS INTEGER) AS g, leads[g].id AS lead, leads[g].vec AS centre FROM (SELECT *, unnest(range(1, len(leads) + 1)) AS g FROM ends)),
di AS (SELECT a.*, g, lead, {_ANGLE.format(a='vec', b='centre')} AS d FROM a JOIN ld USING (part)),
ho AS (SELECT * FROM di WHERE ptype = 'pInner' AND lead <= id QUALIFY row_number() OVER (PARTITION BY part, id ORDER BY d, g) = 1),
gr AS (SELECT win, part, machine, ptype, id, vec, g AS group_id, CASE WHEN d <= 0.5 * {LOW} THEN 'inner' ELSE 'outlier' END AS gtype, g AS home_group FROM ho
  UNION ALL SELECT di.win, di.part, di.machine, di.ptype, di.id, di.vec, di.g, 'outer', ho.g FROM di JOIN ho ON ho.part = di.part AND ho.id = di.id WHERE di.ptype = 'pInner' AND di.g < ho.g AND di.d <= 2 * {LOW}
  UNION ALL SELECT win, part, machine, ptype, id, vec, g, 'outer', -1 FROM di WHERE ptype = 'pOuter' AND d <= 2 * {LOW} AND (lead < id OR lead // 100 = win)),
gp AS (SELECT l.win, l.part, l.machine, l.group_id, l.id AS l_id, r.id AS r_id, {_ANGLE.format(a='l.vec', b='r.vec')} AS distance, CAST('0x' || substr(md5(l.id || ':' || r.id), 1, 8) AS UBIGINT) % 101 = 0 AS hit
  FROM gr l JOIN gr r ON l.win = r.win AND l.part = r.part AND l.group_id = r.group_id AND l.id > r.id WHERE NOT (l.gtype = 'outer' AND r.gtype = 'outer'))"""

_RESULTS = f"""r AS (SELECT epoch_ms(ts) AS ts, (epoch_ms(ts) // {WINDOW_S * 1000}) * {WINDOW_S * 1000} AS window_start, CAST(user_id % {PARTS} AS INTEGER) AS part,
  CAST(((user_id % {PARTS}) * 128 + {PARTS - 1}) // {PARTS} AS INTEGER) AS machine, CAST(user_id AS INTEGER) AS group_id,
  CASE event_type WHEN 'click' THEN 'outer' WHEN 'error' THEN 'outlier' ELSE 'inner' END AS gtype, CAST(floor(value * 100) AS BIGINT) AS latency, event_type = 'view' AS match,
  CAST(40 + 8 * (event_id % 7) AS BIGINT) AS bytes FROM events)"""
_P = f"p AS (SELECT window_start, machine, {', '.join(f'CAST(quantile_disc(latency, {q}) AS BIGINT) AS {n}' for n, q in stats.PERCENTILES.items())} FROM r GROUP BY 1, 2)"
_COST = """k AS (SELECT window_start, group_id, machine, part AS space_id, count(*) FILTER (WHERE gtype = 'inner') AS i, count(*) FILTER (WHERE gtype = 'outer') AS o, count(*) FILTER (WHERE gtype = 'outlier') AS l FROM r GROUP BY ALL),
s AS (SELECT *, coalesce(sum(i) OVER w, 0) AS si, coalesce(sum(o) OVER w, 0) AS so, coalesce(sum(l) OVER w, 0) AS sl FROM k WINDOW w AS (PARTITION BY group_id, machine, space_id ORDER BY window_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cost AS (SELECT window_start, group_id, machine, space_id, CAST(l * (so + sl + si) + o * (si + sl) + i * (so + sl) + l * (o + i) + o * i + l * (l - 1) // 2 AS BIGINT) AS cost FROM s)"""
_VOCABULARY = "voc AS (SELECT chr(CAST(97 + vec_id % 26 AS INTEGER)) || chr(CAST(97 + (vec_id // 26) % 26 AS INTEGER)) || CASE WHEN vec_id < 676 THEN '' ELSE CAST(vec_id // 676 AS VARCHAR) END AS word, embedding::DOUBLE[] AS vec FROM embeddings)"
#: What a stream has told of: windows whose end lies two windows before its last record.
_CLOSED = f"window_start + {WINDOW_S * 1000} <= (SELECT epoch_ms(max(ts)) FROM events) - {2 * WINDOW_S * 1000}"
_TAKEN = "CAST('0x' || substr(md5(event_id || ':0'), 1, 8) AS UBIGINT) < 2147483648"
_RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

#: The partitioned join's comparisons, and which failed ones the sample takes.
_SAMPLED = f"""pp AS (SELECT a.id AS l_id, b.id AS r_id, a.part, a.machine, {_ANGLE.format(a='x.vec', b='y.vec')} AS distance, CAST('0x' || substr(md5(a.id || ':' || b.id), 1, 8) AS UBIGINT) % 101 = 0 AS hit
  FROM sp a JOIN sp b ON a.part = b.part AND a.id > b.id AND NOT (a.ptype = 'pOuter' AND b.ptype = 'pOuter') JOIN v x ON x.id = a.id JOIN v y ON y.id = b.id)"""

ORACLE_SQL = {
    "sim_self_brute": _pairs_sql(HIGH, DIM),
    "sim_self_high_partitioned": _pairs_sql(HIGH, DIM),
    "sim_self_partitioned": _pairs_sql(LOW, 2),
    "sim_self_grouped": _pairs_sql(LOW, 2),
    "sim_self_windowed": _pairs_sql(0.01, 2, window=100),
    "sim_self_windowed_grouped": _pairs_sql(0.01, 2, window=100),
    "sim_twoway_brute": _pairs_sql(HIGH, DIM, True),
    "sim_twoway_partitioned": _pairs_sql(LOW, 2, True),
    "sim_twoway_grouped": _pairs_sql(LOW, 2, True),
    "stream_self_high_join": _pairs_sql(HIGH, DIM, distance=False),
    "stream_self_join": _pairs_sql(LOW, 2, distance=False),
    "stream_self_grouped": _pairs_sql(LOW, 2, distance=False),
    "stream_twoway_join": _pairs_sql(LOW, 2, True, distance=False),
    "stream_twoway_grouped": _pairs_sql(LOW, 2, True, distance=False),
    "stream_window_counts": f"SELECT (epoch_ms(ts) // {WINDOW_S * 1000}) * {WINDOW_S * 1000} AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "cosine_distance_join": f"WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings) SELECT a.id AS l_id, b.id AS r_id, round(1 - list_cosine_similarity(a.vec, b.vec), 6) AS cosine_distance FROM v a, v b WHERE a.id > b.id AND 1 - list_cosine_similarity(a.vec, b.vec) < 0.7",
    "failed_comparison_sample": f"WITH {_space_sql()}, {_SAMPLED} SELECT l_id, r_id, round(distance, 6) AS distance FROM pp WHERE distance >= {LOW} AND hit",
    "join_result_rows": f"WITH {_space_sql()}, {_SAMPLED} SELECT greatest(l_id, r_id) * 1000 AS in_ts, l_id AS left_id, r_id AS right_id, machine, part, distance < {LOW} AS match FROM pp WHERE distance < {LOW} OR hit",
    "join_result_split": f"WITH {_space_sql()}, {_SAMPLED} SELECT greatest(l_id, r_id) * 1000 AS ts, distance < {LOW} AS match FROM pp WHERE distance < {LOW} OR hit",
    "throughput_ticks": "SELECT vec_id * 1000 AS ingest_ts, CAST(1 AS BIGINT) AS n FROM embeddings",
    "stream_statistics": f"""WITH {_RESULTS}, {_P}, {_COST}, z AS (SELECT CAST(NULL AS BIGINT) AS nil)
SELECT 'latency-percentiles-per-machine' AS metric, window_start, CAST(machine AS BIGINT) AS machine, nil AS group_id, nil AS space_id, p99 AS measured FROM p, z
UNION ALL SELECT 'final-comps-per-machine', window_start, CAST(machine AS BIGINT), nil, nil, CAST(sum(CASE WHEN match THEN 1 ELSE {stats.FAILURE_WEIGHT} END) AS BIGINT) FROM r, z GROUP BY window_start, machine, nil
UNION ALL SELECT 'final-comps-per-group', window_start, CAST(machine AS BIGINT), CAST(group_id AS BIGINT), CAST(space_id AS BIGINT), cost FROM cost
UNION ALL SELECT 'size-per-group', window_start, CAST(machine AS BIGINT), CAST(group_id AS BIGINT), CAST(part AS BIGINT), CAST(sum(bytes) AS BIGINT) FROM r GROUP BY window_start, machine, group_id, part
UNION ALL SELECT 'throughput', window_start, nil, nil, nil, count(*) FROM r, z GROUP BY window_start, nil""",
    "stream_join_costs": f"WITH {_RESULTS}, {_COST} SELECT * FROM cost WHERE {_CLOSED}",
    "stream_comparisons_collected": f"WITH {_RESULTS}, c AS (SELECT window_start, machine, CAST(sum(CASE WHEN match THEN 1 ELSE {stats.FAILURE_WEIGHT} END) AS BIGINT) AS n FROM r GROUP BY 1, 2) SELECT window_start, string_agg(machine || ':' || n, ',' ORDER BY machine) AS items FROM c WHERE {_CLOSED} GROUP BY 1",
    "stream_latency_avg": f"WITH {_RESULTS}, a AS (SELECT window_start, machine, sum(latency) AS t, count(*) AS n FROM r GROUP BY 1, 2), b AS (SELECT machine, window_start, CAST(sum(t) OVER w AS BIGINT) // CAST(sum(n) OVER w AS BIGINT) AS avg_ms FROM a WINDOW w AS (PARTITION BY machine ORDER BY window_start {_RUNNING})) SELECT machine, window_start, avg_ms, avg_ms // 1000 AS avg_s FROM b WHERE {_CLOSED}",
    "stream_group_numbers": f"WITH {_RESULTS}, g AS (SELECT part, window_start, max(group_id) AS groups FROM r GROUP BY 1, 2), h AS (SELECT part, window_start, CAST(max(groups) OVER (PARTITION BY part ORDER BY window_start {_RUNNING}) AS BIGINT) AS groups FROM g) SELECT * FROM h WHERE {_CLOSED}",
    "stream_window_costs": f"WITH {_RESULTS}, {_COST}, g AS (SELECT part, window_start, max(group_id) AS m, count(*) AS n FROM r GROUP BY 1, 2), h AS (SELECT part, window_start, n, max(m) OVER (PARTITION BY part ORDER BY window_start {_RUNNING}) AS groups FROM g), c AS (SELECT window_start, space_id AS part, CAST(sum(cost) AS BIGINT) AS cost FROM cost GROUP BY 1, 2), t AS (SELECT window_start, part, CAST(groups * n + cost AS BIGINT) AS total_cost FROM h JOIN c USING (window_start, part)) SELECT * FROM t WHERE {_CLOSED}",
    "latency_percentiles_sampled": f"WITH {_RESULTS.replace('FROM events', 'FROM events WHERE ' + _TAKEN)}, {_P} SELECT * FROM p",
    "space_partition": f"WITH {_space_sql()} SELECT id, home_part, part, ptype, machine FROM sp",
    "partition_sizes": f"WITH {_space_sql()} SELECT part, count(*) AS n FROM sp GROUP BY 1",
    "partition_record_types": f"WITH {_space_sql()} SELECT part, count(*) FILTER (WHERE ptype = 'pInner') AS pInner, count(*) FILTER (WHERE ptype = 'pOuter') AS pOuter FROM sp GROUP BY 1",
    "partition_matches": f"WITH {_space_sql()} SELECT part, count(*) FILTER (WHERE match) AS matches, count(*) FILTER (WHERE NOT match) AS failures FROM cp GROUP BY 1",
    "between_partitions": f"WITH {_space_sql()} SELECT part, CASE WHEN l_ptype = 'pInner' THEN r_home ELSE l_home END AS other_part, count(*) FILTER (WHERE match) AS matches, count(*) FILTER (WHERE NOT match) AS failures FROM cp WHERE l_ptype <> r_ptype GROUP BY 1, 2",
    "pair_norms": f"SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_distance(embedding::DOUBLE[], list_resize([]::DOUBLE[], {DIM}, 0.1::DOUBLE)), 6) AS euclid, CAST(40 + 8 * {DIM} + 17 AS BIGINT) AS bytes FROM embeddings",
    "parsed_lines": "SELECT vec_id AS event_ts, vec_id AS id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y FROM embeddings",
    "latency_percentiles": f"WITH {_RESULTS}, {_P} SELECT * FROM p",
    "latency_sums": f"WITH {_RESULTS} SELECT window_start, machine, CAST(sum(latency) AS BIGINT) AS total, count(*) AS n FROM r GROUP BY 1, 2",
    "latency_avg": f"WITH {_RESULTS}, a AS (SELECT window_start, machine, sum(latency) AS t, count(*) AS n FROM r GROUP BY 1, 2), b AS (SELECT machine, window_start, CAST(sum(t) OVER w AS BIGINT) // CAST(sum(n) OVER w AS BIGINT) AS avg_ms FROM a WINDOW w AS (PARTITION BY machine ORDER BY window_start {_RUNNING})) SELECT machine, window_start, avg_ms, avg_ms // 1000 AS avg_s FROM b",
    "comparisons_per_machine": f"WITH {_RESULTS} SELECT window_start, machine, CAST(sum(CASE WHEN match THEN 1 ELSE {stats.FAILURE_WEIGHT} END) AS BIGINT) AS comparisons FROM r GROUP BY 1, 2",
    "comparisons_collected": f"WITH {_RESULTS}, c AS (SELECT window_start, machine, CAST(sum(CASE WHEN match THEN 1 ELSE {stats.FAILURE_WEIGHT} END) AS BIGINT) AS n FROM r GROUP BY 1, 2) SELECT window_start, string_agg(machine || ':' || n, ',' ORDER BY machine) AS items FROM c GROUP BY 1",
    "group_bytes_window": f"WITH {_RESULTS} SELECT window_start, group_id, machine, CAST(sum(bytes) AS BIGINT) AS bytes, min(gtype) AS gtype FROM r GROUP BY 1, 2, 3",
    "running_group_sizes": f"WITH {_RESULTS}, g AS (SELECT window_start, group_id, CAST(sum(bytes) AS BIGINT) AS bytes FROM r GROUP BY 1, 2) SELECT window_start, group_id, bytes, CAST(sum(bytes) OVER (PARTITION BY group_id ORDER BY window_start {_RUNNING}) AS BIGINT) AS total_bytes FROM g",
    "record_counts": f"WITH {_RESULTS} SELECT window_start, machine, group_id, gtype, count(*) AS n FROM r GROUP BY ALL",
    "join_costs": f"WITH {_RESULTS}, {_COST} SELECT * FROM cost",
    "input_throughput": f"WITH {_RESULTS} SELECT window_start, count(*) // 3600 AS rate FROM r GROUP BY 1",
    "load_candidates": f"WITH {_RESULTS}, l AS (SELECT machine, count(*) AS load FROM r GROUP BY 1), a AS (SELECT CAST(sum(load) AS BIGINT) // count(*) AS average FROM l) SELECT machine, load, average, CASE WHEN load < 0.8 * average THEN 'under' WHEN load > 1.2 * average THEN 'over' ELSE 'even' END AS class FROM l, a",
    "densified_loads": f"WITH {_RESULTS}, l AS (SELECT machine, count(*) AS load FROM r GROUP BY 1) SELECT CAST(m AS INTEGER) AS machine, CAST(coalesce(load, 0) AS BIGINT) AS load FROM (SELECT unnest({MORE_MACHINES}) AS m) x LEFT JOIN l ON l.machine = m",
    "match_counts": f"WITH {_RESULTS} SELECT part, group_id, count(*) FILTER (WHERE match) AS matches, count(*) FILTER (WHERE NOT match) AS failures FROM r GROUP BY 1, 2",
    "group_numbers": f"WITH {_RESULTS}, g AS (SELECT part, window_start, max(group_id) AS groups FROM r GROUP BY 1, 2) SELECT part, window_start, max(groups) OVER (PARTITION BY part ORDER BY window_start {_RUNNING}) AS groups FROM g",
    "latest_sizes": f"WITH {_RESULTS}, g AS (SELECT part, window_start, count(*) AS n FROM r GROUP BY 1, 2) SELECT part, max_by(n, window_start) AS n FROM g GROUP BY 1",
    "machine_frame": f"WITH {_RESULTS}, {_P} SELECT window_start, {', '.join(f'coalesce(max(p99) FILTER (WHERE machine = {m}), 0) AS m{m}' for m in MACHINES)} FROM p GROUP BY 1",
    "across_machines": f"WITH {_RESULTS}, {_P} SELECT window_start, round(avg(p99), 6) AS mean, max(p99) AS max FROM p GROUP BY 1",
    "latency_imbalance_percentile": f"WITH {_RESULTS}, {_P} SELECT a.window_start, bool_or(a.p50 > 1.2 * b.p50 OR a.p50 < 0.8 * b.p50) AS imbalanced FROM p a JOIN p b USING (window_start) GROUP BY 1",
    "latency_imbalance_average": f"WITH {_RESULTS}, a AS (SELECT window_start, machine, avg(latency) AS own FROM r GROUP BY 1, 2), b AS (SELECT window_start, avg(latency) AS every FROM r GROUP BY 1) SELECT window_start, bool_or(own > 1.2 * every OR own < 0.8 * every) AS imbalanced FROM a JOIN b USING (window_start) GROUP BY 1",
    "metric_barrier": f"WITH {_RESULTS} SELECT window_start FROM r GROUP BY 1 HAVING bool_or(match) AND bool_or(gtype = 'outer') AND bool_or(gtype = 'outlier')",
    "window_costs": f"WITH {_RESULTS}, {_COST}, g AS (SELECT part, window_start, max(group_id) AS m, count(*) AS n FROM r GROUP BY 1, 2), h AS (SELECT part, window_start, n, max(m) OVER (PARTITION BY part ORDER BY window_start {_RUNNING}) AS groups FROM g), c AS (SELECT window_start, space_id AS part, CAST(sum(cost) AS BIGINT) AS cost FROM cost GROUP BY 1, 2) SELECT window_start, part, CAST(groups * n + cost AS BIGINT) AS total_cost FROM h JOIN c USING (window_start, part)",
    "lb_input": f"WITH {_RESULTS}, {_COST} SELECT machine, group_id, machine AS origin_machine, part AS space_id, CAST(sum(cost) AS BIGINT) AS load, any_value(size) AS size FROM (SELECT group_id, machine, part, CAST(sum(bytes) AS BIGINT) AS size FROM r GROUP BY ALL) JOIN (SELECT group_id, machine, space_id AS part, cost FROM cost) USING (group_id, machine, part) GROUP BY 1, 2, 3, 4",
    "migrated_state": f"WITH {_RESULTS} SELECT group_id, CASE WHEN group_id % 3 = 0 THEN CAST((machine + 13) % 128 AS INTEGER) ELSE machine END AS machine, part AS space_id, CAST(sum(bytes) AS BIGINT) AS bytes FROM r GROUP BY r.group_id, r.machine, r.part",
    "text_embedding_mean": f"WITH {_VOCABULARY}, t AS (SELECT doc_id AS id, unnest(string_split(lower(text), ' ')) AS word FROM documents), m AS (SELECT id, count(*) AS n, {', '.join(f'avg(vec[{i + 1}]) AS v{i}' for i in range(DIM))} FROM t JOIN voc USING (word) GROUP BY 1) SELECT doc_id AS id, coalesce(n, 0) AS n_known, {', '.join(f'round(coalesce(v{i}, 0), 6) AS v{i}' for i in range(DIM))} FROM documents LEFT JOIN m ON id = doc_id",
    "text_embedding_whole": f"WITH {_VOCABULARY}, t AS (SELECT doc_id AS id, unnest(string_split(lower(text), ' ')) AS word FROM documents), m AS (SELECT id, count(*) AS n, {', '.join(f'avg(vec[{i + 1}]) AS v{i}' for i in range(DIM))} FROM t JOIN voc USING (word) GROUP BY 1) SELECT doc_id AS id, coalesce(n, 0) AS n_known, {', '.join(f'round(coalesce(v{i}, 0), 6) AS v{i}' for i in range(DIM))} FROM documents LEFT JOIN m ON id = doc_id",
    "vocab_filter": f"WITH {_VOCABULARY}, t AS (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents) SELECT DISTINCT id FROM t JOIN voc USING (word) WHERE word <> 'is'",
    "clean_dataset": f"WITH {_VOCABULARY}, f AS (SELECT doc_id AS id, regexp_replace(lower(text), '[^0-9A-Za-z_\\s]', '', 'g') AS x FROM documents), t AS (SELECT id, unnest(regexp_split_to_array(x, '\\s+')) AS word FROM f) SELECT id, length(x) AS n_chars FROM f WHERE id IN (SELECT id FROM t JOIN voc USING (word) WHERE word <> 'Episode')",
    # Adding zero makes a rounded -0.0 the 0.0 that Spark gives.
    "embed_dataset": f"WITH {_VOCABULARY}, f AS (SELECT doc_id AS id, regexp_replace(lower(text), '[^0-9A-Za-z_\\s]', '', 'g') AS x FROM documents), t AS (SELECT id, unnest(regexp_split_to_array(x, '\\s+')) AS word FROM f), k AS (SELECT DISTINCT id FROM t JOIN voc USING (word) WHERE word <> 'Episode'), w AS (SELECT id, unnest(string_split(x, ' ')) AS word FROM f), m AS (SELECT id, {', '.join(f'avg(vec[{i + 1}]) AS v{i}' for i in range(DIM))} FROM w JOIN voc USING (word) GROUP BY 1) SELECT k.id, {', '.join(f'round(coalesce(v{i}, 0), 6) + 0.0::DOUBLE AS v{i}' for i in range(DIM))} FROM k LEFT JOIN m ON m.id = k.id",
    "group_side_output": f"{_GROUPS_SQL} SELECT id AS ts, machine, part AS space_id, group_id, gtype, CAST(56 + length(gtype) + length(ptype) AS BIGINT) AS bytes FROM gr",
    "group_leaders": f"{_GROUPS_SQL} SELECT part, g AS group_id, lead AS ts, lead AS id FROM ld",
    "group_snapshots": f"{_GROUPS_SQL}, w AS (SELECT DISTINCT win, part FROM gr) SELECT win, w.part, CAST(count(g) AS INTEGER) AS groups, coalesce(string_agg(g || ':' || lead, ',' ORDER BY g), '') AS leaders FROM w LEFT JOIN ld ON ld.part = w.part AND ld.lead // 100 <= w.win GROUP BY win, w.part",
    "group_result_rows": f"{_GROUPS_SQL} SELECT l_id * 1000 AS in_ts, l_id AS left_id, r_id AS right_id, machine, part, group_id, distance < {LOW} AS match FROM gp WHERE distance < {LOW} OR hit",
    "stream_result_rows": f"{_GROUPS_SQL} SELECT l_id * 1000 AS in_ts, l_id AS left_id, r_id AS right_id, machine, part, group_id, distance < {LOW} AS match FROM gp WHERE distance < {LOW} OR hit",
    "stream_group_side": f"{_GROUPS_SQL} SELECT id * 1000 AS ts, machine, part AS space_id, group_id, gtype, CAST(56 + length(gtype) + length(ptype) AS BIGINT) AS bytes FROM gr",
    "stream_throughput_ticks": "SELECT vec_id * 1000 AS ingest_ts, CAST(1 AS BIGINT) AS n FROM embeddings",
    # A window is told of once the stream's time, that of its last record, has passed its end.
    "stream_compared": f"{_GROUPS_SQL} SELECT win, machine, part, group_id, distance < {LOW} AS match, count(*) AS n FROM gp WHERE (win + 1) * 100 <= (SELECT max(vec_id) FROM embeddings) GROUP BY ALL",
    "stream_migrated": f"{_GROUPS_SQL}, h AS (SELECT max(vec_id) // 2 AS half FROM embeddings) SELECT l_id AS left_id, r_id AS right_id, gp.part, group_id, CASE WHEN group_id % 3 = 0 AND lead <= half AND l_id > half THEN CAST((machine + 13) % 128 AS INTEGER) ELSE machine END AS machine FROM gp JOIN ld ON ld.part = gp.part AND ld.g = gp.group_id, h WHERE distance < {LOW}",
    "stream_rebalanced": f"{_GROUPS_SQL} SELECT l_id AS left_id, r_id AS right_id, part, group_id FROM gp WHERE distance < {LOW}",
    "stream_replayed": "SELECT n // 100 AS event_ts, n AS number, vec_id, dim FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS n, vec_id, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings)",
    "group_record_types": f"""{_GROUPS_SQL} SELECT part, count(*) FILTER (WHERE gtype = 'inner') AS "inner", count(*) FILTER (WHERE gtype = 'outer') AS "outer", count(*) FILTER (WHERE gtype = 'outlier') AS outlier FROM gr GROUP BY part""",
    "between_groups": f"""{_GROUPS_SQL}, b AS (SELECT l.part, l.group_id, CASE WHEN l.gtype = 'inner' THEN r.home_group ELSE l.home_group END AS other_group, {_ANGLE.format(a='l.vec', b='r.vec')} < {LOW} AS match
  FROM gr l JOIN gr r ON l.win = r.win AND l.part = r.part AND l.group_id = r.group_id AND l.id > r.id
  WHERE l.ptype = 'pInner' AND r.ptype = 'pInner' AND (l.gtype = 'inner' AND r.gtype = 'outer' OR l.gtype = 'outer' AND r.gtype = 'inner'))
SELECT part, group_id, other_group, count(*) FILTER (WHERE match) AS matches, count(*) FILTER (WHERE NOT match) AS failures FROM b GROUP BY part, group_id, other_group""",
    "generated_ranges": "SELECT source, i AS event_ts, CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS valid FROM (VALUES ('gaussian'), ('pareto'), ('skewed'), ('topics'), ('zipf')) s(source), range(10) r(i)",
    "generated_benchmark": "SELECT i AS event_ts, i // 100 * 1000 AS ingest_ts, i AS id, true AS valid FROM range(1000) r(i)",
    "generated_words": "SELECT i AS event_ts, CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS valid FROM range(30) r(i)",
    "replayed_vectors": f"SELECT vec_id // 100 AS event_ts, vec_id // 100 AS ingest_ts, vec_id AS id, {DIM} AS dim FROM embeddings",
    "generated_ticks": "SELECT i AS event_ts, CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS valid FROM range(30) r(i)",
}
