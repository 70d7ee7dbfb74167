"""Joins against brute force: golden fixtures, random data, any order of arrival, no duplicates."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearspan.operators.grouping import Grouper, Units, group_leaders
from nearspan.operators.join import grouped_rows, similarity_join, tagged, with_window
from nearspan.operators.space import Lcg, random_centroids, space_partition

LEFT = [(0, [0.0, 1.0]), (2, [0.27482, 0.96192]), (4, [0.37958, 0.92516]), (6, [-0.46788, 0.88379]), (8, [-0.38719, 0.92200])]
RIGHT = [(1, [0.04685, 0.9989]), (3, [0.44407, 0.89599]), (5, [-0.19612, 0.98058]), (7, [-0.31649, 0.94859]), (9, [0.52212, 0.85287])]
GOLDEN = {(8, 7), (8, 5), (6, 7), (6, 5), (4, 9), (4, 3), (2, 9), (2, 3), (2, 1), (0, 5), (0, 1)}


def frame(spark, rows):
    return spark.createDataFrame([(i, i, i, v) for i, v in rows], "event_ts long, ingest_ts long, id long, vec array<double>")


def brute(rows, t, window=None):
    d = lambda a, b: math.acos(max(-1, min(1, np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)))) / math.pi
    return {(i, j) for i, a in rows for j, b in rows if i > j and (window is None or i // window == j // window) and d(a, b) < t}


def found(df):
    rows = [(r["left_id"], r["right_id"]) for r in df.collect()]
    assert len(rows) == len(set(rows)), "a pair came twice"
    return set(rows)


@pytest.mark.parametrize("strategy", ["brute", "partitioned", "grouped"])
def test_two_way_golden(spark, strategy):
    assert found(similarity_join(frame(spark, LEFT), frame(spark, RIGHT), threshold=0.1, dim=2, strategy=strategy)) == GOLDEN


@pytest.mark.parametrize("strategy", ["brute", "partitioned", "grouped"])
@pytest.mark.parametrize("window", [None, 25])
def test_self_join_equals_brute_force(spark, strategy, window):
    r = random.Random(1000)
    rows = [(i, [r.random() * 2 - 1, r.random() * 2 - 1]) for i in range(120)]
    rows += [(120 + k, list(rows[k][1])) for k in range(10)]
    assert found(similarity_join(frame(spark, rows), threshold=0.05, dim=2, strategy=strategy, window=window)) == brute(rows, 0.05, window)


def test_more_dimensions_and_zero_vectors(spark):
    g = np.random.default_rng(3)
    rows = [(i, g.normal(size=5).tolist()) for i in range(80)]
    df = frame(spark, [*rows, (98, [0.0] * 5), (99, [0.0] * 5)])
    want = brute(rows, 0.2)
    for strategy in ("brute", "partitioned", "grouped"):
        assert found(similarity_join(df, threshold=0.2, dim=5, strategy=strategy)) == want


def test_empty_input(spark):
    for strategy in ("brute", "partitioned", "grouped"):
        assert found(similarity_join(frame(spark, []), threshold=0.2, dim=2, strategy=strategy)) == set()


def test_router_sends_each_pair_of_partitions_one_way(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1), r.gauss(0, 1)]) for i in range(200)]
    out = space_partition(frame(spark, rows), random_centroids(10, 2), 0.1).collect()
    ways = {(x["home_part"], x["part"]) for x in out if x["ptype"] == "pOuter"}
    assert all((b, a) not in ways for a, b in ways)
    assert sum(x["ptype"] == "pInner" for x in out) == 200


def test_centroids_follow_the_public_generator():
    assert [round(x, 6) for x in random_centroids(10, 2)[0]] == [0.455127, 0.366447]
    g = Lcg(1000)
    assert all(0 <= g.below(80) < 80 for _ in range(100))


@pytest.mark.parametrize("seed", range(5))
def test_kernel_in_any_order_of_arrival(seed):
    r = random.Random(seed)
    t = 0.05
    rows = [{"id": i, "vec": [r.gauss(0, 1), r.gauss(0, 1)], "ptype": "pInner" if i % 5 else "pOuter"} for i in range(60)]
    r.shuffle(rows)
    g = Grouper(t)
    sent = [x for row in rows for x in g.add(row)]
    pairs = []
    for k, (a, ga, ta, _) in enumerate(sent):
        for b, gb, tb, _ in sent[:k]:
            if ga == gb and not ta == tb == "outer" and a["id"] != b["id"]:
                u, v = Units.of(a["vec"]), Units.of(b["vec"])
                if math.acos(max(-1, min(1, float(u @ v)))) / math.pi < t:
                    pairs.append((max(a["id"], b["id"]), min(a["id"], b["id"])))
    inner = {x["id"] for x in rows if x["ptype"] == "pInner"}
    want = {p for p in brute([(x["id"], x["vec"]) for x in rows], t) if p[0] in inner or p[1] in inner}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_leaders_lie_apart(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1), r.gauss(0, 1)]) for i in range(150)]
    df = with_window(tagged(frame(spark, rows), None), None)
    lead = group_leaders(grouped_rows(df, 0.05, 2, 4)).collect()
    by = {}
    for x in lead:
        by.setdefault(x["part"], []).append((x["id"], list(x["centroid"])))
    assert lead and all(not brute(v, 0.05) for v in by.values())


def test_plan_prunes_with_an_equi_join(spark):
    df = similarity_join(frame(spark, LEFT), threshold=0.1, dim=2, strategy="partitioned")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_comparisons_of_a_record_do_not_grow_with_the_table(spark):
    """Reference points are taken from the data, as many as they ask for."""
    from nearspan.operators.join import _routed

    each = []
    for n in (5_000, 50_000):
        some = [F.rand(k) * 2 - 1 for k in (1, 2, 3)]
        df = spark.range(n).select("id", F.col("id").alias("event_ts"), F.col("id").alias("ingest_ts"), F.array(*some).alias("vec"))
        sizes = [r["n"] for r in _routed(with_window(tagged(df, None), None), 0.005, 3, None).groupBy("win", "part").agg(F.count("*").alias("n")).collect()]
        each.append(sum(x * x for x in sizes) / n)
    assert each[1] < 2 * each[0]


@pytest.mark.parametrize("dim", [2, 5])
def test_routing_by_product_equals_routing_by_expressions(spark, dim, monkeypatch):
    from nearspan.operators import space

    g = np.random.default_rng(dim)
    rows = frame(spark, [(i, g.normal(size=dim).tolist()) for i in range(300)] + [(300, [0.0] * dim)])
    made = {}
    for k in (0, 99):
        monkeypatch.setattr(space, "WRITTEN_OUT", k)
        made[k] = sorted(tuple(r) for r in space_partition(rows, random_centroids(12, dim), 0.03).select("id", "home_part", "part", "ptype", "machine").collect())
    assert made[0] == made[99] and {r[0] for r in made[0]} == set(range(300))


def test_groups_live_on_across_windows(spark):
    """A leader of the first window draws the records of later ones; a stored copy reaches only its own window."""
    rows = [(0, [1.0, 0.0]), (11, [1.0, 0.001]), (12, [0.0, 1.0]), (25, [1.0, 0.002]), (26, [0.0, -1.0])]
    df = with_window(tagged(frame(spark, rows), None), 10)
    got = grouped_rows(df, 0.05, 2, 1).where("ptype = 'pInner' AND home_group = group_id").select("id", "win", "group_id").collect()
    of = {r["id"]: r["group_id"] for r in got}
    assert of[0] == of[11] == of[25] and len({of[0], of[12], of[26]}) == 3
    assert {r["id"] for r in group_leaders(grouped_rows(df, 0.05, 2, 1)).collect()} == {0, 12, 26}


def test_one_output_row_has_the_later_ingest_time(spark):
    df = similarity_join(frame(spark, LEFT), frame(spark, RIGHT), threshold=0.1, dim=2, strategy="brute")
    assert all(r["in_ts"] == max(r["left_id"], r["right_id"]) for r in df.select("in_ts", "left_id", "right_id", F.lit(1)).collect())


@pytest.mark.parametrize("two", [False, True])
@pytest.mark.parametrize("strategy", ["brute", "partitioned"])
def test_blocks_of_homes_and_copies_give_each_pair_once(spark, two, strategy, monkeypatch):
    from nearspan.operators import join

    for name, value in (("CELL_ROWS", 16), ("PART_ROWS", 16), ("TILE_ROWS", 5), ("BLOCKS", 3)):
        monkeypatch.setattr(join, name, value)
    g = np.random.default_rng(9)
    rows = [(i, g.normal(size=20).tolist()) for i in range(150)]
    l, r = (rows[::2], rows[1::2]) if two else (rows, rows)
    want = {(i, j) for i, a in l for j, b in r if (two or i > j) and math.acos(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) / math.pi < 0.45}
    assert found(similarity_join(frame(spark, l), frame(spark, r) if two else None, threshold=0.45, dim=20, strategy=strategy)) == want


def test_what_a_record_is_sent_to_does_not_grow_with_the_table(spark):
    """Neither the cells of the grid nor, where nothing is pruned, the copies and their cells."""
    from nearspan.operators import join

    for strategy in ("brute", "partitioned"):
        each = []
        for n in (30_000, 120_000):
            near = F.array(*[F.lit(1.0) + F.rand(k) / 9 for k in range(join.HIGH_DIMENSION)])
            df = with_window(tagged(spark.range(n).select("id", F.col("id").alias("event_ts"), F.col("id").alias("ingest_ts"), near.alias("vec")), None), None).withColumn("copy", F.lit(False))
            dealt = join._blocks_of_keys(df, ["win"], join.CELL_ROWS, join.BLOCKS) if strategy == "brute" else join._blocks_of_keys(df.withColumn("copy", F.rand(1) < 0.9), ["win"], join.PART_ROWS, 2)
            each.append(dealt.agg(F.avg(F.expr("homes + IF(block < homes, copies, 0)"))).collect()[0][0])
        assert each[1] < 1.5 * each[0]


def test_no_key_brings_all_records_of_a_window_together(spark):
    """The number of a window's blocks is told by broadcast; no join or shuffle has the window as its key."""
    rows = frame(spark, [(i, [1.0, i / 50]) for i in range(50)])
    plan = similarity_join(rows, rows, threshold=0.1, dim=2, strategy="brute")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_points_of_a_table_of_copies(spark):
    """Reference points are found however few of the vectors differ."""
    from nearspan.operators.space import sampled_points

    df = spark.range(20_000).select(F.array(F.lit(1.0), (F.col("id") % 40).cast("double")).alias("vec"))
    assert len(sampled_points(df, 39, 20_000)) == 39


def test_a_small_window_is_one_key(spark):
    from nearspan.operators.join import reference_points

    rows = [(i, [1.0, i / 9]) for i in range(300)]
    assert len(reference_points(with_window(tagged(frame(spark, rows), None), 100), 2, None)) == 1
    assert len(reference_points(with_window(tagged(frame(spark, rows), None), 100), 2, None, lasting=True)) == 10


def test_sampled_results_are_those_of_all_candidate_pairs(spark, monkeypatch):
    """Blocks of a partition, copies, ids of several lengths, one and two inputs: no pair leaves its cell but those asked for."""
    import hashlib
    import random

    import numpy as np

    from nearspan.functions.pairhash import Digits, md5_heads
    from nearspan.operators import join

    ids = np.array([0, 7, 10, 99, 12345, 2**62, 999_999, 1_000_000])
    digits = Digits(ids)
    for k, a in enumerate(ids):
        heads = md5_heads(digits.first(np.array([k])), digits.second(np.arange(len(ids)), int(digits.lengths[k])))[0]
        assert heads.tolist() == [int(hashlib.md5(f"{a}:{b}".encode()).hexdigest()[:8], 16) for b in ids]
    monkeypatch.setattr(join, "PART_ROWS", 64)
    r, schema = random.Random(8), "event_ts long, ingest_ts long, id long, vec array<double>"
    rows = spark.createDataFrame([(i, i, i * 7, [r.gauss(0, 1), r.gauss(0, 1)]) for i in range(400)], schema)
    columns = ["in_ts", "left_id", "right_id", "machine", "part", "match"]
    for right in (None, rows):
        df = join.with_window(join.tagged(rows, right), None)
        got = join.result_rows(join.partitioned_results(df, right is None, 0.02, 2, 3, 5), 0.02, 1).select(*columns).collect()
        want = join.result_rows(join.partitioned_pairs(df, right is None, 0.02, 2, 3), 0.02, 5).select(*columns).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {x["match"] for x in got} == {True, False}
