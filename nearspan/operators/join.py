"""Vector similarity joins: all pairs within an angular distance, each exactly once.

``brute`` deals both sides over a grid of cells (every pair of records meets in one cell),
so that the quadratic work of a join without a key is spread evenly and nothing is
broadcast; a cell is one matrix product. ``partitioned`` and ``grouped`` prune with the triangle inequality; they are
equi-joins on the partition. There are as many reference points as the input asks
for, taken from the input itself, and a partition that holds more than a block is dealt into
pairs of blocks, so that a dense place is shared by many tasks. ``auto`` takes
``partitioned`` for low dimensions and ``brute`` where the inequality prunes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearspan.functions.pairhash import Digits, md5_heads
from nearspan.functions.vectors import machine_label, record_bytes, unit, unit_distance
from nearspan.operators.grouping import assign_groups
from nearspan.operators.space import random_centroids, sampled_points, space_partition
from nearspan.shipping import ship

#: Dimensions from which reference points no longer prune at useful thresholds.
HIGH_DIMENSION = 16
#: Records of one block of the grid, at least, and its blocks, at most.
CELL_ROWS, BLOCKS = 512, 24
#: Records of either side of one matrix product.
TILE_ROWS = 1024
#: Records of either side of one block of pairs that are hashed.
HASHED_ROWS = (16, 1024)
#: Records of one block of a partition; a partition with more is dealt into pairs of blocks.
PART_ROWS = 2048
#: Reference points: one for every so many records, at least and at most so many.
POINT_ROWS, POINTS = 512, (10, 4096)
#: Every how manieth failed comparison is kept in sampled mode.
SAMPLE_EVERY = 10_001


def with_window(df: DataFrame, window: int | None) -> DataFrame:
    """Adds win, the number of the tumbling window; all rows share one without a length."""
    return df.withColumn("win", F.lit(0).cast("long") if window is None else F.floor(F.col("event_ts") / window).cast("long"))


def tagged(left: DataFrame, right: DataFrame | None) -> DataFrame:
    """Both sides as one table with their origin; a self-join has the origin 'single'."""
    if right is None:
        return left.withColumn("origin", F.lit("single"))
    return left.withColumn("origin", F.lit("left")).unionByName(right.withColumn("origin", F.lit("right")))


def _sides(df: DataFrame, self_join: bool) -> tuple[DataFrame, DataFrame]:
    l, r = (df, df) if self_join else (df.where("origin = 'left'"), df.where("origin = 'right'"))
    return l.select(*[F.col(c).alias(f"l_{c}") for c in df.columns]), r.select(*[F.col(c).alias(f"r_{c}") for c in df.columns])


def _distance(dim: int | None) -> Column:
    return unit_distance(F.col("l_unit"), F.col("r_unit"), dim)


_PAIRS = T.StructType([T.StructField(n, t) for n, t in (("win", T.LongType()), ("left_id", T.LongType()), ("right_id", T.LongType()), ("distance", T.DoubleType()), ("in_ts", T.LongType()))])


def _close_pairs(cell: pa.Table, threshold: float, self_join: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of one cell within the threshold: a matrix product a tile, angles only where they may matter."""
    side, ids, copy, came = (cell[c].to_numpy() for c in ("side", "id", "copy", "ingest_ts"))
    units = cell["unit"].combine_chunks().flatten().to_numpy().reshape(cell.num_rows, -1)
    diagonal = self_join and cell["cell_l"][0] == cell["cell_r"][0]
    l, r = (np.arange(len(ids)),) * 2 if diagonal else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    least, win = np.cos(np.pi * min(threshold, 1.0)) - 1e-9, cell["win"][0].as_py()
    for top in range(0, len(l), TILE_ROWS):
        for start in range(0, min(top + 1, len(r)) if diagonal else len(r), TILE_ROWS):
            x, y = l[top : top + TILE_ROWS], r[start : start + TILE_ROWS]
            cos = units[x] @ units[y].T
            i, j = np.nonzero(cos >= least)
            d, i, j = np.arccos(np.clip(cos[i, j], -1, 1)) / np.pi, x[i], y[j]
            stay = (d < threshold) & ~(copy[i] & copy[j])
            if self_join:
                stay &= (ids[i] != ids[j]) & ((i > j) if diagonal else True)
            i, j, d = i[stay], j[stay], d[stay]
            a, b = ids[i], ids[j]
            left, right = (np.maximum(a, b), np.minimum(a, b)) if self_join else (a, b)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(d), win), left, right, d, np.maximum(came[i], came[j]))], names=_PAIRS.names)


def in_blocks(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Adds n, the number of blocks of about so many rows that a record's keys ask for, and its block."""
    # Only keys of more than a block are listed, one row for so many records: their list can always be
    # broadcast, so that the records of a key, however many, never have to meet in one task.
    many = df.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias("n")).where("n > 1")
    df = df.join(F.broadcast(many), keys, "left").withColumn("n", F.coalesce("n", F.lit(1)))
    return df.withColumn("block", F.pmod(F.xxhash64("id", "origin"), F.col("n")).cast("int"))


def _blocks_of_keys(df: DataFrame, keys: list[str], rows: int, most: int) -> DataFrame:
    """Adds homes and copies, the numbers of a key's blocks of either kind, and a record's block.

    A block holds so many rows, or more where a key would have more than ``most`` blocks of records
    at home or four times as many of copies: what is sent to the cells of a key grows no faster than its records.
    """
    counts = df.groupBy(*keys).agg(F.count_if(~F.col("copy")).alias("h"), F.count_if("copy").alias("c")).where(F.col("h") + F.col("c") > rows)
    blocks = lambda n, limit: F.least(F.ceil(F.col(n) / rows), F.lit(limit)).cast("int")
    many = counts.select(*keys, F.greatest(blocks("h", most), F.lit(1)).alias("homes"), blocks("c", 4 * most).alias("copies"))
    df = df.join(F.broadcast(many), keys, "left").withColumns({"homes": F.coalesce("homes", F.lit(1)), "copies": F.coalesce("copies", F.lit(0))})
    return df.withColumn("block", F.expr("IF(copy AND copies > 0, homes + pmod(xxhash64(id, origin), copies), pmod(xxhash64(id, origin), homes))").cast("int"))


_RESULTS = T.StructType([*_PAIRS.fields, T.StructField("part", T.IntegerType())])


def _results(cell: pa.Table, threshold: float, self_join: bool, every: int) -> Iterator[pa.RecordBatch]:
    """What one cell compares: the matches, and of the rest those whose pair has a hash divisible by ``every``."""
    cell = cell.sort_by("id")
    side, ids, copy, came = (cell[c].to_numpy() for c in ("side", "id", "copy", "ingest_ts"))
    units = cell["unit"].combine_chunks().flatten().to_numpy().reshape(cell.num_rows, -1)
    diagonal = self_join and cell["cell_l"][0] == cell["cell_r"][0]
    digits, win, part = Digits(ids), cell["win"][0].as_py(), cell["part"][0].as_py()
    least = np.cos(np.pi * min(threshold, 1.0)) - 1e-9

    def found(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of left records x and right ones y, either sorted by their ids."""
        cos = units[x] @ units[y].T
        hit = np.empty(cos.shape, bool)
        for n in np.unique(digits.lengths[x]):  # where the right number stands depends on the left one's length
            some = digits.lengths[x] == n
            hit[some] = md5_heads(digits.first(x[some]), digits.second(y, int(n))) % np.uint32(every) == 0
        i, j = np.nonzero(hit | (cos >= least))
        d, hit, i, j = np.arccos(np.clip(cos[i, j], -1, 1)) / np.pi, hit[i, j], x[i], y[j]
        stay = (hit | (d < threshold)) & ~(copy[i] & copy[j])
        if self_join:
            stay &= ids[i] > ids[j]
        i, j, d = i[stay], j[stay], d[stay]
        if len(d):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(d), win), ids[i], ids[j], d, np.maximum(came[i], came[j]), np.full(len(d), part, "i4"))], names=_RESULTS.names)

    one, other = (np.arange(len(ids)),) * 2 if diagonal else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    few, many = HASHED_ROWS
    for top in range(0, len(one), few):
        x = one[top : top + few]
        for start in range(0, len(other), many):
            y = other[start : start + many]
            # The greater id of a self-join is the left one, whichever block it is in.
            low, high = (y[ids[y] < ids[x[-1]]], y[ids[y] > ids[x[0]]] if not diagonal else y[:0]) if self_join else (y, y[:0])
            if len(low):
                yield from found(x, low)
            if len(high):
                yield from found(high, x)


def _cell_pairs(df: DataFrame, keys: list[str], self_join: bool, threshold: float, every: int | None = None) -> DataFrame:
    """Pairs of records with equal keys, at most one of them a copy, from the cells of a grid of blocks.

    Every pair of blocks is one cell (for a self-join those on and below the diagonal; two blocks of
    copies have none), and a record is sent to the cells of its block. ``every``: also that share of
    the failed comparisons, and the partition.
    """
    ship(df.sparkSession)
    one = df.withColumn("other", F.explode(F.expr("sequence(0, homes - 1 + IF(block < homes, copies, 0))")))
    if self_join:
        # In its own row of the grid a block is side 0, in another's side 1.
        dealt = one.withColumn("side", F.when(F.col("other") <= F.col("block"), 0).otherwise(1))
        dealt = dealt.withColumn("cell_l", F.greatest("block", "other")).withColumn("cell_r", F.least("block", "other"))
    else:
        dealt = one.withColumn("side", F.when(F.col("origin") == "left", 0).otherwise(1))
        dealt = dealt.withColumn("cell_l", F.when(F.col("side") == 0, F.col("block")).otherwise(F.col("other"))).withColumn("cell_r", F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("block")))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _close_pairs(pa.Table.from_batches(batches), threshold, self_join)

    dealt = dealt.select("win", *[k for k in keys if k != "win"], "cell_l", "cell_r", "side", "copy", "id", "unit", "ingest_ts")
    if every is None:
        return dealt.groupBy(*keys, "cell_l", "cell_r").applyInArrow(kernel, _PAIRS)

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _results(pa.Table.from_batches(batches), threshold, self_join, every)

    # Few bytes, but much work: so many tasks whatever the size of the table.
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)
    return dealt.repartition(tasks, *keys, "cell_l", "cell_r").groupBy(*keys, "cell_l", "cell_r").applyInArrow(results, _RESULTS)


def grid_join(df: DataFrame, self_join: bool, threshold: float, cells: int | None = None) -> DataFrame:
    """All pairs of a window within the threshold: win, left_id, right_id, distance, in_ts.

    Records are dealt to blocks by a hash of the id, ``CELL_ROWS`` of a window's records to one, or
    more beyond ``BLOCKS`` blocks, so that a record is sent to so many cells at most; no side is
    broadcast. ``cells`` sets the number of blocks of every window.
    """
    df = df.withColumn("unit", unit(F.col("vec"))).where("unit IS NOT NULL").withColumn("copy", F.lit(False)).select("win", "id", "unit", "ingest_ts", "origin", "copy")
    if cells is None:
        df = _blocks_of_keys(df, ["win"], CELL_ROWS, BLOCKS)
    else:
        df = df.withColumns({"homes": F.lit(cells), "copies": F.lit(0), "block": F.pmod(F.xxhash64("id", "origin"), F.lit(cells)).cast("int")})
    return _cell_pairs(df, ["win"], self_join, threshold)


def _found(pairs: DataFrame, threshold: float, *more: str) -> DataFrame:
    return pairs.where(F.col("distance") < threshold).select(F.col("l_win").alias("win"), F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), "distance", F.greatest("l_ingest_ts", "r_ingest_ts").alias("in_ts"), *more)


def reference_points(df: DataFrame, dim: int, points: int | None, lasting: bool = False) -> list[list[float]]:
    """So many random points, or else vectors of the table itself, one for every ``POINT_ROWS`` of it.

    Points taken from the data are dense where the data are, so a partition's records, and with
    them the comparisons of one record, do not grow with the table up to ``POINTS[1]`` points;
    beyond, partitions grow and are dealt into more pairs of blocks. In high dimensions a record has
    a copy in every other partition or so, so there are no more than ``BLOCKS`` of them. Windows of
    at most a block of records have one for all, unless partitions are ``lasting``, through all windows.
    """
    if points:
        return random_centroids(points, dim)
    rows, windows, largest = df.groupBy("win").count().agg(F.sum("count"), F.count("*"), F.max("count")).collect()[0]
    if windows > 1 and largest <= PART_ROWS and not lasting:
        return random_centroids(1, dim)
    rows = rows or 0
    most = POINTS[1] if dim < HIGH_DIMENSION else BLOCKS
    return sampled_points(df, min(max(-(-rows // POINT_ROWS), POINTS[0]), most), rows) or random_centroids(1, dim)


def _routed(df: DataFrame, threshold: float, dim: int, points: int | list[list[float]] | None) -> DataFrame:
    at = points if isinstance(points, list) else reference_points(df, dim, points)
    return space_partition(df, at, threshold, as_unit=True).select("win", "part", "ptype", "home_part", "machine", "id", "unit", "ingest_ts", "origin")


def partitioned_join(df: DataFrame, self_join: bool, threshold: float, dim: int, points: int | None) -> DataFrame:
    """The pairs of the partitioned join: routed once, then a matrix product for each pair of blocks of a partition."""
    at = reference_points(df, dim, points)
    # Where copies are many already, a partition is dealt into few blocks.
    most = BLOCKS if dim < HIGH_DIMENSION else max(2, BLOCKS // len(at))
    routed = _routed(df, threshold, dim, at).withColumn("copy", F.col("ptype") == "pOuter")
    return _cell_pairs(_blocks_of_keys(routed, ["win", "part"], PART_ROWS, most), ["win", "part"], self_join, threshold)


def partitioned_pairs(df: DataFrame, self_join: bool, threshold: float, dim: int, points: int | None) -> DataFrame:
    """All candidate pairs of the partitioned join, with their distance: what is compared, not only what matches."""
    l, r = _sides(in_blocks(_routed(df, threshold, dim, points), ["win", "part"], PART_ROWS), self_join)
    # Each pair of blocks is a key of its own: the left record goes along its row, the right one down its column.
    l = l.withColumn("l_other", F.explode(F.expr("sequence(0, l_n - 1)")))
    r = r.withColumn("r_other", F.explode(F.expr("sequence(0, r_n - 1)")))
    on = (F.col("l_win") == F.col("r_win")) & (F.col("l_part") == F.col("r_part")) & (F.col("l_block") == F.col("r_other")) & (F.col("l_other") == F.col("r_block"))
    on = on & ~((F.col("l_ptype") == "pOuter") & (F.col("r_ptype") == "pOuter"))
    return l.join(r, on & (F.col("l_id") > F.col("r_id")) if self_join else on).withColumn("distance", _distance(dim))


def partitioned_results(df: DataFrame, self_join: bool, threshold: float, dim: int, points: int, every: int = SAMPLE_EVERY) -> DataFrame:
    """The matches of the partitioned join and the sampled share of its failed comparisons, as columns of candidate pairs.

    What ``sampled_failures`` and ``result_rows`` take of all candidate pairs, of which none leaves its cell otherwise.
    """
    routed = _routed(df, threshold, dim, points).withColumn("copy", F.col("ptype") == "pOuter")
    found = _cell_pairs(_blocks_of_keys(routed, ["win", "part"], PART_ROWS, BLOCKS), ["win", "part"], self_join, threshold, every)
    return found.select(F.col("left_id").alias("l_id"), F.col("right_id").alias("r_id"), "distance", F.col("part").alias("l_part"), machine_label(F.col("part"), points).alias("l_machine"), F.col("in_ts").alias("l_ingest_ts"), F.col("in_ts").alias("r_ingest_ts"))


def grouped_rows(df: DataFrame, threshold: float, dim: int, centroids: int | None) -> DataFrame:
    """The routed and grouped records of a join."""
    return assign_groups(space_partition(df, reference_points(df, dim, centroids, lasting=True), threshold), threshold, window="win")


def grouped_pairs(grouped: DataFrame, self_join: bool, dim: int, trust_inner: bool = False) -> DataFrame:
    """Candidate pairs inside groups, with their distance.

    Two copies ('outer') never meet. With ``trust_inner`` two inner records count as a match
    unseen, which differs from the predicate only for pairs exactly at the threshold.
    """
    df = grouped.withColumn("unit", unit(F.col("vec")))
    l, r = _sides(df.select("win", "part", "group_id", "machine", "gtype", "ptype", "home_part", "home_group", "id", "unit", "ingest_ts", "origin"), self_join)
    on = (F.col("l_win") == F.col("r_win")) & (F.col("l_part") == F.col("r_part")) & (F.col("l_group_id") == F.col("r_group_id")) & ~((F.col("l_gtype") == "outer") & (F.col("r_gtype") == "outer"))
    pairs = l.join(r, on & (F.col("l_id") > F.col("r_id")) if self_join else on)
    distance = _distance(dim)
    if trust_inner:
        distance = F.when((F.col("l_gtype") == "inner") & (F.col("r_gtype") == "inner"), F.lit(0.0)).otherwise(distance)
    return pairs.withColumn("distance", distance)


def similarity_join(
    left: DataFrame,
    right: DataFrame | None = None,
    *,
    threshold: float,
    dim: int,
    window: int | None = None,
    strategy: str = "auto",
    centroids: int | None = None,
    cells: int | None = None,
) -> DataFrame:
    """(win, left_id, right_id, distance, in_ts) of every pair within the threshold, exactly once.

    Inputs have event_ts, ingest_ts, id and vec. A self-join names the greater id first.
    Without ``centroids`` there are as many reference points as the input asks for.
    """
    df, alone = with_window(tagged(left, right), window), right is None
    if strategy == "auto":
        strategy = "brute" if dim >= HIGH_DIMENSION else "partitioned"
    if strategy == "brute":
        return grid_join(df, alone, threshold, cells)
    if strategy == "partitioned":
        return partitioned_join(df, alone, threshold, dim, centroids)
    if strategy == "grouped":
        return _found(grouped_pairs(grouped_rows(df, threshold, dim, centroids), alone, dim), threshold)
    raise ValueError(f"no strategy {strategy!r}")


def pair_hash(a: str, b: str) -> Column:
    """32 bits of the MD5 of two columns, 'a:b', as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", a, b)), 1, 8), 16, 10).cast("long")


def sampled_failures(pairs: DataFrame, threshold: float, every: int = SAMPLE_EVERY) -> DataFrame:
    """A fixed share of the failed comparisons, chosen by a hash of the pair."""
    return pairs.where((F.col("distance") >= threshold) & (F.pmod(pair_hash("l_id", "r_id"), F.lit(every)) == 0))


def result_rows(pairs: DataFrame, threshold: float, every: int | None = None) -> DataFrame:
    """The rows of RESULT for candidate pairs of the partitioned or the grouped join.

    All matches, and with ``every`` that share of the failed comparisons, match being False;
    out_ts is when the rows are made, in_ts when the later record came.
    """
    group = F.col("l_group_id") if "l_group_id" in pairs.columns else F.lit(None).cast("int")
    match = F.col("distance") < threshold
    kept = match if every is None else F.lit(True) if every == 1 else match | (F.pmod(pair_hash("l_id", "r_id"), F.lit(every)) == 0)
    return pairs.where(kept).select(
        F.unix_millis(F.current_timestamp()).alias("out_ts"),
        F.greatest("l_ingest_ts", "r_ingest_ts").alias("in_ts"),
        F.col("l_id").alias("left_id"),
        F.col("r_id").alias("right_id"),
        F.col("l_machine").alias("machine"),
        F.col("l_part").alias("part"),
        group.alias("group_id"),
        match.alias("match"),
    )


def group_side(grouped: DataFrame) -> DataFrame:
    """The rows of GROUP_SIDE: what was routed to which group, with its bytes."""
    size = record_bytes(F.col("vec"), F.col("gtype"), F.col("ptype"))
    return grouped.select(F.col("event_ts").alias("ts"), "machine", F.col("part").alias("space_id"), "group_id", "gtype", size.alias("bytes"))


def throughput_ticks(records: DataFrame) -> DataFrame:
    """The rows of THROUGHPUT: one for every input record, either side."""
    return records.select("ingest_ts", F.lit(1).cast("long").alias("n"))


def split_matches(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matches, and for a side output all results with the time the later record came."""
    return results.where("match"), results.select(F.col("in_ts").alias("ts"), "match")
