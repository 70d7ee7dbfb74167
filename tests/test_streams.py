"""The running join, its state, its statistics and their control, over several batches and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from nearspan.operators import join as batch
from nearspan.operators import stats
from nearspan.streaming import control, monitor
from nearspan.streaming import join as sj

SCHEMA = "event_ts long, ingest_ts long, id long, vec array<double>"
EVENTS = "ts long, machine int, group_id int, space_id int, gtype string, latency long, match boolean, bytes long"


def written(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def files(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def outputs(spark, path, name):
    return spark.read.parquet(f"{path}/{name}/*")


@pytest.fixture(scope="module")
def records():
    r = random.Random(6)
    rows = [(i * 1000, i, i, [r.gauss(0, 1), r.gauss(0, 1)]) for i in range(60)]
    rows[33] = (33_000, 33, 33, [0.0, 0.0])
    return rows


def test_outputs_equal_the_batch_over_batches_and_a_restart(spark, tmp_path, records):
    sj.with_state_store(spark)
    run = lambda: sj.write_outputs(sj.stream_outputs(files(spark, SCHEMA, tmp_path / "in"), threshold=0.1, dim=2, window_s=15, centroids=4, every=7), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    written(spark, records[:20], SCHEMA, tmp_path / "in")
    written(spark, records[20:35], SCHEMA, tmp_path / "in")
    run()
    for k in (35, 48):
        written(spark, records[k : k + 13][: 60 - k], SCHEMA, tmp_path / "in")
    run()  # a new query from the checkpoint of the first
    got = {n: outputs(spark, tmp_path / "out", n) for n in sj.split()}
    df = batch.with_window(batch.tagged(spark.createDataFrame(records, SCHEMA), None), 15_000)
    grouped = batch.grouped_rows(df, 0.1, 2, 4)
    pairs = batch.grouped_pairs(grouped, True, 2)
    plain = lambda d: sorted(map(tuple, d.collect()))
    columns = ["in_ts", "left_id", "right_id", "machine", "part", "group_id", "match"]
    assert plain(got["results"].select(*columns)) == plain(batch.result_rows(pairs, 0.1, 7).select(*columns))
    assert plain(got["group_side"]) == plain(batch.group_side(grouped))
    assert plain(got["throughput"]) == plain(batch.throughput_ticks(df)) and got["late"].count() == 0
    seen = pairs.groupBy("l_win", "l_part", "l_group_id", (F.col("distance") < 0.1).alias("match")).count().where("l_win < 3")
    assert plain(got["compared"].select("win", "part", "group_id", "match", "n")) == plain(seen)
    # Of closed windows only the leaders are still held.
    state = sj.exported_state(spark, str(tmp_path / "state"))
    assert {r["win"] for r in state.where("kind IN ('member', 'outer', 'compared')").select("win").distinct().collect()} == {3}
    assert state.where("kind = 'leader'").count() == grouped.where("gtype = 'inner' AND home_group = group_id").select("part", "group_id").distinct().count()


def test_late_records_are_an_output_of_their_own(spark, tmp_path, records):
    sj.with_state_store(spark)
    written(spark, records[:20], SCHEMA, tmp_path / "in")
    written(spark, records[21:40], SCHEMA, tmp_path / "in")
    written(spark, [records[20], *records[40:]], SCHEMA, tmp_path / "in")
    out = sj.stream_outputs(files(spark, SCHEMA, tmp_path / "in"), threshold=0.1, dim=2, window_s=10, centroids=4)
    sj.write_outputs(out, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    late, ticks = outputs(spark, tmp_path / "out", "late"), outputs(spark, tmp_path / "out", "throughput")
    assert [(r["win"], r["id"]) for r in late.collect()] == [(2, 20)]
    assert sorted(r["ingest_ts"] for r in ticks.collect()) == sorted(set(range(60)) - {20})


@pytest.mark.parametrize("two", [False, True])
def test_a_migrated_join_goes_on_as_if_never_stopped(spark, tmp_path, records, two):
    """Stopped in the middle of a window, its groups given to other machines, and started anew."""
    sj.with_state_store(spark)
    start = None
    for k, rows in enumerate((records[:37], records[37:])):
        written(spark, rows, SCHEMA, tmp_path / f"in{k}")
        source = files(spark, SCHEMA, tmp_path / f"in{k}")
        sides = (source.where("id % 2 = 0"), source.where("id % 2 = 1")) if two else (source, None)
        out = sj.stream_outputs(*sides, threshold=0.1, dim=2, window_s=15, centroids=4, initial=start)
        sj.write_outputs(out, str(tmp_path / f"out{k}"), str(tmp_path / f"state{k}")).awaitTermination()
        if k == 0:
            lead = sj.exported_leaders(spark, str(tmp_path / "state0")).select("group_id", F.col("part").alias("space_id"), "machine", F.lit(7).alias("new_machine"))
            sj.migrated(sj.exported_state(spark, str(tmp_path / "state0")), lead).write.parquet(str(tmp_path / "start"))
            start, known = spark.read.parquet(str(tmp_path / "start")), {(r["space_id"], r["group_id"]) for r in lead.collect()}
    after = outputs(spark, tmp_path / "out1", "results").collect()
    got = sorted((r["left_id"], r["right_id"]) for r in [*outputs(spark, tmp_path / "out0", "results").collect(), *after])
    df = spark.createDataFrame(records, SCHEMA)
    l, r = (df.where("id % 2 = 0"), df.where("id % 2 = 1")) if two else (df, None)
    assert got == sorted(map(tuple, batch.similarity_join(l, r, threshold=0.1, dim=2, window=15_000, strategy="brute").select("left_id", "right_id").collect()))
    assert got and any((r["part"], r["group_id"]) in known for r in after)
    assert all((r["machine"] == 7) == ((r["part"], r["group_id"]) in known) for r in after)


def test_running_costs_and_running_values_over_batches(spark, tmp_path):
    sj.with_state_store(spark)
    r = random.Random(3)
    rows = [(k * 10_000 + r.randrange(10_000), r.randrange(2), r.randrange(3), 0, r.choice(["inner", "outer", "outlier"]), r.randrange(99), r.random() < 0.5, 8) for k in range(8) for _ in range(30)]
    for k in range(0, 240, 80):
        written(spark, rows[k : k + 80], EVENTS, tmp_path / "in")
    records = lambda: monitor.timed(files(spark, EVENTS, tmp_path / "in"), 10)
    metrics = {
        "cost": monitor.running_costs(records(), 10).drop("at"),
        "total": monitor.running(monitor.per_window(records(), 10, "machine", total=F.sum("latency")), "machine", "total").drop("at"),
        "late": monitor.with_lateness(files(spark, EVENTS, tmp_path / "in"), 10, 0),
    }
    for name, df in metrics.items():
        df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    last = max(x[0] for x in rows)
    closed = lambda df: df.where(F.col("window_start") + 10_000 <= last - 20_000)
    df = stats.windowed(spark.createDataFrame(rows, EVENTS), "ts", 10)
    keys = ["group_id", "machine", "space_id"]
    want = closed(stats.join_costs(stats.record_counts(df, ["window_start", *keys, "gtype"]), keys))
    plain = lambda d, *c: sorted(map(tuple, d.select(*c).collect()))
    assert plain(spark.read.parquet(str(tmp_path / "cost")), "window_start", *keys, "cost") == plain(want, "window_start", *keys, "cost") != []
    sums = stats.latency_sums(df, ["window_start", "machine"])
    want = closed(stats.running(sums, ["machine"], "window_start", "total", "so_far"))
    assert plain(spark.read.parquet(str(tmp_path / "total")), "window_start", "machine", "total") == plain(want, "window_start", "machine", "so_far")
    assert spark.read.parquet(str(tmp_path / "late")).count() == len(rows)


def test_late_monitored_rows_are_told_apart(spark, tmp_path):
    sj.with_state_store(spark)
    row = lambda ts: (ts, ts % 2, 0, 0, "inner", 1, True, 8)
    for some in ([1000, 2001], [50_000, 51_001], [1500, 52_000, 49_000]):
        written(spark, [row(t) for t in some], EVENTS, tmp_path / "in")
    from nearspan.streaming.sinks import to_each

    to_each(monitor.with_lateness(files(spark, EVENTS, tmp_path / "in"), 10, 0), monitor.split_late(), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    times = lambda n: sorted(r["ts"] for r in outputs(spark, tmp_path / "out", n).collect())
    assert times("late") == [1500, 49_000] and times("on_time") == [1000, 2001, 50_000, 51_001, 52_000]


def test_the_barrier_opens_once(spark, tmp_path):
    sj.with_state_store(spark)
    m = control.METRICS
    batches = [[(x, 0) for x in m[:3]], [(m[3], 0), (m[0], 0), (m[0], 60), ("other", 60)], [(x, 0) for x in m] + [(x, 60) for x in m[1:]], [(x, 60) for x in m]]
    for k, rows in enumerate(batches):
        written(spark, rows, "metric string, window_start long", tmp_path / "in")
    fired = []
    df = monitor.barrier(files(spark, "metric string, window_start long", tmp_path / "in"), m)
    df.writeStream.foreachBatch(lambda b, n: fired.extend((n, r[0]) for r in b.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(w for _, w in fired) == [0, 60] and len({n for n, _ in fired}) == 2


def test_the_whole_loop(spark, tmp_path, records):
    """Join, statistics, barrier, rebalancing, migration, and the join again."""
    sj.with_state_store(spark)
    written(spark, records[:40], SCHEMA, tmp_path / "in0")
    written(spark, records[40:], SCHEMA, tmp_path / "in1")
    out = sj.stream_outputs(files(spark, SCHEMA, tmp_path / "in0"), threshold=0.1, dim=2, window_s=15, centroids=4, every=1)
    sj.write_outputs(out, str(tmp_path / "out0"), str(tmp_path / "state0")).awaitTermination()
    # in_ts is the id here, so the statistics' windows are of ten milliseconds' worth; one of a second holds all.
    side = outputs(spark, tmp_path / "out0", "group_side")
    scaled = {"results": outputs(spark, tmp_path / "out0", "results").withColumns({"in_ts": F.col("in_ts") * 1000, "out_ts": F.col("in_ts") * 1000 + F.col("machine") + 5}), "group_side": side, "throughput": outputs(spark, tmp_path / "out0", "throughput").withColumn("ingest_ts", F.col("ingest_ts") * 1000)}
    for name, df in scaled.items():
        df.drop("batch").coalesce(1).write.parquet(str(tmp_path / f"told/{name}/batch=0"))
    messages = control.monitored(control.file_reader(spark, str(tmp_path / "told")), str(tmp_path), 15)
    windows = control.complete_windows(spark, messages, str(tmp_path))
    assert windows == [0, 15_000] and control.complete_windows(spark, messages, str(tmp_path)) == windows
    sent = spark.read.parquet(f"{messages}/*")
    plan = control.assignment(sent, 15_000)
    total = side.where("ts < 30000").agg(F.sum("bytes")).first()[0]
    assert plan.agg(F.sum("size")).first()[0] == total and plan.count() == side.where("ts < 30000").select("space_id", "group_id").distinct().count()
    assert control.rebalanced(spark, messages, 15_000, str(tmp_path / "state0"), str(tmp_path), tolerance=1e9) is None
    start = control.rebalanced(spark, messages, 15_000, str(tmp_path / "state0"), str(tmp_path), tolerance=0.2, names=["greedy"])
    assert start is not None and start.where("kind = 'leader'").count() == sj.exported_leaders(spark, str(tmp_path / "state0")).count()
    assert start.select("machine").distinct().count() > 1
    out = sj.stream_outputs(files(spark, SCHEMA, tmp_path / "in1"), threshold=0.1, dim=2, window_s=15, centroids=4, initial=start)
    sj.write_outputs(out, str(tmp_path / "out1"), str(tmp_path / "state1")).awaitTermination()
    got = sorted((r["left_id"], r["right_id"]) for k in (0, 1) for r in outputs(spark, tmp_path / f"out{k}", "results").where("match").collect())
    want = batch.similarity_join(spark.createDataFrame(records, SCHEMA), threshold=0.1, dim=2, window=15_000, strategy="brute")
    assert got == sorted(map(tuple, want.select("left_id", "right_id").collect()))


@pytest.mark.parametrize("policy", ["min", "max"])
def test_an_idle_input_under_either_policy(spark, tmp_path, policy):
    """Under 'min' the right input, long silent, holds back the left one's windows; under 'max' it does not."""
    written(spark, [(k * 10_000, "l") for k in range(6)], "ts long, side string", tmp_path / "left")
    written(spark, [(0, "r")], "ts long, side string", tmp_path / "right")
    control.watermark_policy(spark, policy)
    try:
        l, r = (spark.readStream.schema("ts long, side string").parquet(str(tmp_path / s)).withColumn("at", F.timestamp_millis("ts")).withWatermark("at", "0 seconds") for s in ("left", "right"))
        both = l.unionByName(r).groupBy(F.window("at", "10 seconds")).count().select(F.unix_millis("window.start").alias("w"), "count")
        both.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    finally:
        control.watermark_policy(spark, "min")
    got = {r["w"]: r["count"] for r in spark.read.schema("w long, count long").parquet(str(tmp_path / "out")).collect()}
    assert got == ({} if policy == "min" else {0: 2, 10_000: 1, 20_000: 1, 30_000: 1, 40_000: 1})


def test_rates_are_gathered_by_a_listener(spark, tmp_path):
    for k in range(3):
        written(spark, [(k * 5 + i, "x") for i in range(5)], "ts long, side string", tmp_path / "in")
    rates = control.Rates()
    spark.streams.addListener(rates)
    try:
        files(spark, "ts long, side string", tmp_path / "in").writeStream.format("noop").queryName("rated").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        assert rates.until_ended(1)
    finally:
        spark.streams.removeListener(rates)
    rows = rates.table(spark).where("name = 'rated' AND rows > 0").orderBy("batch").collect()
    assert [r["rows"] for r in rows] == [5, 5, 5] and all(r["processed_rate"] > 0 for r in rows)


def test_statistics_tell_of_every_window_to_the_end(spark):
    """The last windows of a stream that ends are told of as well, and nothing of the mark that closes them."""
    from nearspan.plans.catalog import QUERIES, WINDOW_S, table

    d = "/root/testdata/sf0.001"
    got = {r[0] for r in QUERIES["stream_statistics"](spark, d).where("metric = 'throughput'").select("window_start").collect()}
    want = {r[0] for r in table(spark, d, "events").selectExpr(f"div(timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts), {WINDOW_S * 1000}) * {WINDOW_S * 1000}").distinct().collect()}
    assert got == want


def test_a_streams_partitions_are_small(spark):
    """What a record meets in the running join is a hundredth of the stream, not a tenth or more."""
    from nearspan.operators.space import random_centroids, space_partition
    from nearspan.plans.catalog import LOW, STREAM_POINTS, vectors

    rows = vectors(spark, "/root/testdata/sf0.1", 2)
    sizes = [r["count"] for r in space_partition(rows, random_centroids(STREAM_POINTS, 2), LOW).groupBy("part").count().collect()]
    assert max(sizes) < rows.count() / 20 and sum(n * n for n in sizes) < rows.count() ** 2 / 50


@pytest.mark.parametrize("two", [False, True])
def test_a_high_dimensional_stream_is_joined_by_cells(spark, tmp_path, two):
    """Over several batches, windows and one or two inputs, and in matrix products: 1,500 vectors of 64 dimensions a window."""
    sj.with_state_store(spark)
    r = random.Random(4)
    rows = [(i, i, i, [r.gauss(0, 1) + (k == i % 49) * 7 for k in range(64)] if i % 97 else [0.0] * 64) for i in range(3000)]
    for k in range(0, 3000, 1000):
        written(spark, rows[k : k + 1000], SCHEMA, tmp_path / "in")
    source = files(spark, SCHEMA, tmp_path / "in").withColumns({"event_ts": F.col("event_ts") * 10})
    sides = (source.where("id % 2 = 0"), source.where("id % 2 = 1")) if two else (source, None)
    out = sj.stream_brute(*sides, threshold=0.3, window_s=15, blocks=3)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("win", "left_id", "right_id", "in_ts").collect()))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"event_ts": F.col("event_ts") * 10})
    l, r = (df.where("id % 2 = 0"), df.where("id % 2 = 1")) if two else (df, None)
    want = batch.similarity_join(l, r, threshold=0.3, dim=64, window=15_000, strategy="brute").select("win", "left_id", "right_id", "in_ts")
    assert got == sorted(map(tuple, want.collect())) and len(got) > 100
    # Of closed windows nothing is held.
    assert {x["win"] for x in sj._state(spark, str(tmp_path / "state"), "held").select("key.win").distinct().collect()} == {1}


def test_many_windows_cost_few_calls_of_the_running_join(spark, tmp_path):
    """400 windows of one batch: a key for each slot of groups, not for each group of a window, and one timer a key."""
    sj.with_state_store(spark)
    r = random.Random(9)
    rows = [(i * 1000, i, i, [r.gauss(0, 1), r.gauss(0, 1)]) for i in range(2000)]
    written(spark, rows, SCHEMA, tmp_path / "in")
    out = sj.stream_outputs(files(spark, SCHEMA, tmp_path / "in"), threshold=0.05, dim=2, window_s=5, centroids=4, every=1)
    query = sj.write_outputs(out, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    first = query.recentProgress[0]["stateOperators"]
    # What is kept of each key: the list of its records, the list of its counts, and a timer or two.
    assert sum(x["numRowsTotal"] for x in first) < 20_000 and sum(x["customMetrics"].get("numRegisteredTimers", 0) for x in first) <= sj.SLOTS + 4
    got = outputs(spark, tmp_path / "out", "results")
    df = batch.with_window(batch.tagged(spark.createDataFrame(rows, SCHEMA), None), 5000)
    pairs = batch.grouped_pairs(batch.grouped_rows(df, 0.05, 2, 4), True, 2)
    columns = ["in_ts", "left_id", "right_id", "machine", "part", "group_id", "match"]
    plain = lambda d: sorted(map(tuple, d.collect()))
    assert plain(got.select(*columns)) == plain(batch.result_rows(pairs, 0.05, 1).select(*columns)) != []
    seen = pairs.groupBy("l_win", "l_part", "l_group_id", (F.col("distance") < 0.05).alias("match")).count().where("l_win < 399")
    assert plain(outputs(spark, tmp_path / "out", "compared").select("win", "part", "group_id", "match", "n")) == plain(seen)


def test_many_groups_cost_few_calls_of_the_running_costs(spark, tmp_path):
    """Groups over two batches and a restart, some without a number: a key for each slot of groups, not for each group."""
    sj.with_state_store(spark)
    r = random.Random(5)
    rows = [(k * 10_000 + r.randrange(10_000), g % 10, g if g % 97 else None, g % 10, r.choice(["inner", "outer", "outlier"]), 1, True, 8) for k in range(8) for g in range(3000) for _ in range(r.randrange(3))]
    for some in (lambda k: k < 4, lambda k: k >= 4):
        written(spark, [x for x in rows if some(x[0] // 10_000)], EVENTS, tmp_path / "in")
        out = monitor.running_costs(monitor.timed(files(spark, EVENTS, tmp_path / "in"), 10, late_s=0), 10).drop("at")
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        [kept] = [x["numRowsTotal"] for x in query.recentProgress[-1]["stateOperators"] if x["operatorName"].startswith("transformWithState")]
        assert 0 < kept <= monitor.SLOTS
    keys = ["group_id", "machine", "space_id"]
    df = stats.windowed(spark.createDataFrame(rows, EVENTS), "ts", 10)
    want = stats.join_costs(stats.record_counts(df, ["window_start", *keys, "gtype"]), keys).where("window_start < 70000")
    plain = lambda d: sorted(map(str, d.select("window_start", *keys, "cost").collect()))
    assert plain(spark.read.parquet(str(tmp_path / "out"))) == plain(want) != []
