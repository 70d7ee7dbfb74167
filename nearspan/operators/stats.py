"""Windowed monitoring of a join: latencies, comparisons, sizes, costs, throughput, imbalance.

Everything is a grouped aggregation with map-side partial sums, or a window function over
already aggregated rows. Windows are tumbling, by event time in milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
#: A sampled failed comparison stands for so many.
FAILURE_WEIGHT = 10_000


def window_start(ts: Column, seconds: int) -> Column:
    width = seconds * 1000
    return (F.floor(ts / width) * width).cast("long")


def windowed(df: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Adds window_start, in milliseconds."""
    return df.withColumn("window_start", window_start(F.col(ts), seconds))


def bernoulli(df: DataFrame, p: float, seed: int = 0, key: str | None = None) -> DataFrame:
    """Rows kept with probability p, by a hash of the row: the same rows at every run.

    With ``key`` by the MD5 of that column and the seed, which other engines compute alike.
    """
    if key is not None:
        return df.where(F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(seed))), 1, 8), 16, 10).cast("long") < int(p * (1 << 32)))
    return df.where(F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(1_000_000)) < int(p * 1_000_000))


def result_ticks(results: DataFrame) -> DataFrame:
    """One (out_ts, machine, 1) for every result, to be summed by the monitor."""
    return results.select("out_ts", "machine", F.lit(1).alias("n"))


def percentiles(latency: str = "latency") -> Column:
    """All nearest-rank percentiles as one array: one buffer of values and counts a key, merged from the tasks' own."""
    ranks = ", ".join(f"{p}D" for p in PERCENTILES.values())
    return F.expr(f"percentile_disc(array({ranks})) WITHIN GROUP (ORDER BY {latency})")


def percentile_columns(array: str) -> list[Column]:
    return [F.get(array, F.lit(i)).cast("long").alias(n) for i, n in enumerate(PERCENTILES)]


def latency_percentiles(df: DataFrame, keys: list[str], latency: str = "latency", sample: float | None = None) -> DataFrame:
    """Nearest-rank percentiles; with ``sample`` of a fixed pseudo-random share of the rows."""
    if sample is not None:
        df = bernoulli(df, sample)
    return df.groupBy(*keys).agg(percentiles(latency).alias("__p")).select(*keys, *percentile_columns("__p"))


def latency_sums(df: DataFrame, keys: list[str], latency: str = "latency") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(latency).alias("total"), F.count("*").alias("n"))


def average_latency(sums: DataFrame, key: str, order: str) -> DataFrame:
    """Running integer average (milliseconds, and whole seconds) per key over its windows."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    ms = F.expr("div(run_total, run_n)")
    return sums.withColumn("run_total", F.sum("total").over(w)).withColumn("run_n", F.sum("n").over(w)).select(key, order, ms.alias("avg_ms"), F.expr("div(div(run_total, run_n), 1000)").alias("avg_s"))


def weighted_comparisons(df: DataFrame, keys: list[str], match: str = "match") -> DataFrame:
    """Comparisons: a match counts once, a sampled failure for all it stands for."""
    return df.groupBy(*keys).agg(F.sum(F.when(F.col(match), 1).otherwise(FAILURE_WEIGHT)).cast("long").alias("comparisons"))


def collected(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """All rows of a window in one sorted list (there are as many as machines or groups)."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias("items"))


def group_bytes(df: DataFrame, keys: list[str], size: str = "bytes") -> DataFrame:
    """Bytes routed, with the first record type."""
    return df.groupBy(*keys).agg(F.sum(size).cast("long").alias("bytes"), F.min("gtype").alias("gtype"))


def record_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def running(df: DataFrame, keys: list[str], order: str, value: str, alias: str) -> DataFrame:
    """Adds the running total of a value per key over windows."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(alias, F.sum(value).over(w))


def join_costs(counts: DataFrame, keys: list[str], window: str = "window_start") -> DataFrame:
    """Distance computations of each group and window, from counts by gtype.

    New inner (i), outer (o) and outlier (l) records meet what the group holds (I, O, L) and
    each other: l(O+L+I) + o(I+L) + i(O+L) + l(o+i) + oi + l(l-1)/2.
    """
    wide = counts.groupBy(window, *keys).agg(*[F.sum(F.when(F.col("gtype") == t, F.col("n")).otherwise(0)).alias(c) for c, t in (("i", "inner"), ("o", "outer"), ("l", "outlier"))])
    before = W.partitionBy(*keys).orderBy(window).rowsBetween(W.unboundedPreceding, -1)
    for c in "iol":
        wide = wide.withColumn(f"s{c}", F.coalesce(F.sum(c).over(before), F.lit(0)))
    cost = F.expr("l * (so + sl + si) + o * (si + sl) + i * (so + sl) + l * (o + i) + o * i + div(l * (l - 1), 2)")
    return wide.select(window, *keys, cost.cast("long").alias("cost"))


def throughput(df: DataFrame, seconds: int) -> DataFrame:
    return df.groupBy("window_start").agg(F.expr(f"div(count(*), {seconds})").alias("rate"))


def candidate_nodes(loads: DataFrame, key: str = "machine", load: str = "load") -> DataFrame:
    """Each node's load and the integer average, with its class: under 0.8, over 1.2 times it, or even."""
    average = loads.agg(F.expr(f"div(sum({load}), count(*))").alias("average"))
    ratio = F.when(F.col(load) < 0.8 * F.col("average"), "under").when(F.col(load) > 1.2 * F.col("average"), "over").otherwise("even")
    # One row on the other side.
    return loads.crossJoin(F.broadcast(average)).select(key, load, "average", ratio.alias("class"))


def densified(loads: DataFrame, machines: list[int], key: str = "machine", load: str = "load") -> DataFrame:
    """A load for every machine, 0 where none was seen."""
    spark = loads.sparkSession
    every = spark.createDataFrame([(m,) for m in machines], f"{key} int")
    return every.join(loads.select(F.col(key).cast("int").alias(key), load), key, "left").select(key, F.coalesce(load, F.lit(0)).cast("long").alias(load))


def machine_labels(parallelism: int, slots: int = 128) -> list[int]:
    return [(g * slots + parallelism - 1) // parallelism for g in range(parallelism)]


def match_counts(df: DataFrame, keys: list[str], match: str = "match") -> DataFrame:
    """True and false comparisons per key: per physical or logical partition, or pair of them."""
    return df.groupBy(*keys).agg(F.count_if(F.col(match)).alias("matches"), F.count_if(~F.col(match)).alias("failures"))


def type_counts(df: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def between_partitions(pairs: DataFrame) -> DataFrame:
    """Comparisons of a record at home with a copy: (home of the one, home of the other, match)."""
    l_home = F.col("l_ptype") == "pInner"
    one = pairs.where(l_home != (F.col("r_ptype") == "pInner"))
    return one.select(F.when(l_home, F.col("l_part")).otherwise(F.col("r_part")).alias("part"), F.when(l_home, F.col("r_home_part")).otherwise(F.col("l_home_part")).alias("other_part"), "match")


def between_groups(pairs: DataFrame) -> DataFrame:
    """Comparisons, both records at home, of an inner with an outer one: (partition, group, the other's group, match)."""
    l_in = F.col("l_gtype") == "inner"
    r_in = F.col("r_gtype") == "inner"
    one = pairs.where((F.col("l_ptype") == "pInner") & (F.col("r_ptype") == "pInner") & ((l_in & (F.col("r_gtype") == "outer")) | (r_in & (F.col("l_gtype") == "outer"))))
    return one.select("part", "group_id", F.when(l_in, F.col("r_home_group")).otherwise(F.col("l_home_group")).alias("other_group"), "match")


def group_numbers(df: DataFrame, order: str = "window_start") -> DataFrame:
    """The number of groups a partition has had up to each window."""
    per = df.groupBy("part", order).agg(F.max("group_id").alias("groups"))
    return per.withColumn("groups", F.max("groups").over(W.partitionBy("part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def latest(df: DataFrame, keys: list[str], order: str, *values: str) -> DataFrame:
    """Each key's values in its last window."""
    return df.groupBy(*keys).agg(*[F.max_by(v, order).alias(v) for v in values])


def by_machine(df: DataFrame, machines: list[int], value: str, order: str = "window_start", key: str = "machine") -> DataFrame:
    """One row a window, one column m<machine> each, 0 where nothing was measured."""
    return df.groupBy(order).agg(*[F.coalesce(F.max(F.when(F.col(key) == m, F.col(value))), F.lit(0)).alias(f"m{m}") for m in machines])


def across_machines(df: DataFrame, value: str, order: str = "window_start") -> DataFrame:
    return df.groupBy(order).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))


def window_costs(groups: DataFrame, rates: DataFrame) -> DataFrame:
    """Cost of mapping records to groups: groups times records, per window and partition."""
    return groups.join(rates, ["window_start", "part"]).select("window_start", "part", (F.col("groups") * F.col("n")).alias("mapping_cost"))


def total_costs(mapping: DataFrame, joining: DataFrame) -> DataFrame:
    return mapping.join(joining, ["window_start", "part"]).select("window_start", "part", (F.col("mapping_cost") + F.col("cost")).alias("total_cost"))


def imbalance_by_percentile(df: DataFrame, value: str = "p99", tolerance: float = 0.2) -> DataFrame:
    """Windows in which two machines' values differ by more than the tolerance (of the smaller or larger).

    Extremes decide: some pair differs if and only if the largest and the smallest do.
    """
    e = df.groupBy("window_start").agg(F.max(F.coalesce(value, F.lit(0))).alias("high"), F.min(F.coalesce(value, F.lit(0))).alias("low"))
    return e.select("window_start", ((F.col("high") > (1 + tolerance) * F.col("low")) | (F.col("low") < (1 - tolerance) * F.col("high"))).alias("imbalanced"))


def imbalance_by_average(sums: DataFrame, tolerance: float = 0.2) -> DataFrame:
    """Windows in which a machine's average lies outside the tolerance around that of all records."""
    w = W.partitionBy("window_start")
    one = sums.withColumn("own", F.col("total") / F.col("n")).withColumn("all", F.sum("total").over(w) / F.sum("n").over(w))
    off = (F.col("own") > (1 + tolerance) * F.col("all")) | (F.col("own") < (1 - tolerance) * F.col("all"))
    return one.groupBy("window_start").agg(F.bool_or(off).alias("imbalanced"))


def barrier(window: str, *metrics: DataFrame) -> DataFrame:
    """The windows for which every metric has arrived."""
    out = metrics[0].select(window).distinct()
    for m in metrics[1:]:
        out = out.join(m.select(window).distinct(), window)
    return out


def balancer_input(sizes: DataFrame, costs: DataFrame) -> DataFrame:
    """machine, group_id, origin_machine, space_id, load (0 where unknown) and size of every group."""
    key = ["machine", "group_id", "space_id"]
    return sizes.join(costs.select(*key, F.col("cost").alias("load")), key, "left").select(
        F.col("machine").cast("int").alias("machine"), "group_id", F.col("machine").cast("int").alias("origin_machine"), "space_id", F.coalesce("load", F.lit(0)).cast("long").alias("load"), F.col("bytes").cast("long").alias("size")
    )
