"""Metric-space partitioning: reference points and the replicating router."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nearspan.functions.vectors import clamp, dot, machine_label, unit
from nearspan.shipping import ship

_MASK = (1 << 48) - 1


class Lcg:
    """The 48-bit linear congruential generator of the Java platform's public specification."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & _MASK

    def bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & _MASK
        return self.state >> (48 - n)

    def double(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) / (1 << 53)

    def below(self, n: int) -> int:
        if n & (n - 1) == 0:
            return (n * self.bits(31)) >> 31
        while True:
            u = self.bits(31)
            if u - u % n + (n - 1) < 1 << 31:
                return u % n


def random_centroids(k: int, dim: int, seed: int = 42) -> list[list[float]]:
    """k reference points with coordinates between -1 and 1, row by row from one generator."""
    g = Lcg(seed)
    return [[g.double() * 2 - 1 for _ in range(dim)] for _ in range(k)]


def centroid_distances(vec: Column, centroids: list[list[float]]) -> Column:
    """Angular distance of a unit vector (or null) to every reference point."""
    scaled = [[x / sum(y * y for y in c) ** 0.5 for x in c] for c in centroids]
    return F.array(*[F.acos(clamp(dot(vec, F.array(*[F.lit(x) for x in c]), len(c)))) / F.pi() for c in scaled])


def sampled_points(df: DataFrame, k: int, rows: int) -> list[list[float]]:
    """About k different vectors of a table of so many rows, chosen by a hash of the vector; never more than k.

    A table of many copies is read again for a larger share of the hashes until there are enough.
    The driver gets k rows at most, however large the table.
    """
    chosen = F.pmod(F.xxhash64("vec", F.lit(7)), F.lit(1 << 40))
    vecs, share = df.where(F.exists("vec", lambda x: x != 0)).select("vec", chosen.alias("h")), 2 * k / max(rows, 1)
    while True:
        some = vecs.where(F.col("h") < int((1 << 40) * min(1.0, share))).distinct().orderBy("h", "vec").limit(k).collect()
        if len(some) == k or share >= 1:
            return [r["vec"] for r in some]
        share *= 8


#: Reference points up to which distances are written out as expressions; with more they are one matrix product.
WRITTEN_OUT = 16
#: Rows that the router gives at once.
TAKEN_ROWS = 4096


def _routed_by_product(df: DataFrame, points: list[list[float]], threshold: float) -> DataFrame:
    """What ``space_partition`` adds, from products of blocks of records with all points.

    Cosines are compared, with slack for rounding: a copy too many meets no partner twice.
    """
    ship(df.sparkSession)
    p = np.array(points, float)
    p /= np.sqrt((p * p).sum(1))[:, None]
    rows, numbers = max(16, (1 << 21) // len(p)), np.arange(len(p))
    schema = T.StructType([*df.schema.fields, T.StructField("home_part", T.IntegerType()), T.StructField("part", T.IntegerType())])
    arrow, at = to_arrow_schema(schema), df.columns.index("__unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                b = batch.slice(start, rows)
                cos = np.clip(b.column(at).flatten().to_numpy().reshape(b.num_rows, -1) @ p.T, -1, 1)
                home = cos.argmax(1)
                reach = np.cos(np.minimum(np.arccos(cos.max(1)) + 2 * np.pi * threshold, np.pi)) - 1e-12
                one_way = (home[:, None] < numbers) != ((home[:, None] + numbers) % 2 == 1)
                i, j = np.nonzero((cos >= reach[:, None]) & one_way | (numbers == home[:, None]))
                for at_once in range(0, len(i), TAKEN_ROWS):  # a record may have many copies
                    k, to = i[at_once : at_once + TAKEN_ROWS], j[at_once : at_once + TAKEN_ROWS]
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array(k)).columns, pa.array(home[k], pa.int32()), pa.array(to, pa.int32())], schema=arrow)

    return df.mapInArrow(run, schema)


def space_partition(df: DataFrame, centroids: list[list[float]], threshold: float, keep_zero: bool = False, as_unit: bool = False) -> DataFrame:
    """One row per partition a record goes to: home_part, part, ptype and machine are added.

    The nearest reference point (the lowest number among equals) is home. Another partition
    gets a copy if a partner within the threshold may live there, and, of any two
    partitions, only in one direction, so that a pair of records meets exactly once.
    Zero vectors match nothing and are routed to no partition, or with ``keep_zero`` to a
    partition -1 of their own, for those who count records. With ``as_unit`` the rows have unit,
    the vector over its length, in place of vec; what is copied was then computed once.
    """
    k = len(centroids)
    if keep_zero:
        whole = df.withColumn("__zero", F.coalesce(~F.exists("vec", lambda x: x != 0), F.lit(True)))
        stand_in = F.when(F.col("__zero"), F.array(*[F.lit(1.0)] * len(centroids[0]))).otherwise(F.col("vec"))
        out = space_partition(whole.withColumns({"__vec": F.col("vec"), "vec": stand_in}), centroids, threshold).withColumn("vec", F.col("__vec"))
        out = out.where(~F.col("__zero") | (F.col("ptype") == "pInner"))
        return out.withColumns({c: F.when(F.col("__zero"), F.lit(-1)).otherwise(F.col(c)) for c in ("home_part", "part", "machine")}).drop("__zero", "__vec")
    usable = df.withColumn("__unit", unit(F.col("vec"))).where("__unit IS NOT NULL")
    given = [*df.drop("vec").columns, F.col("__unit").alias("unit")] if as_unit else df.columns
    if k > WRITTEN_OUT:
        out = _routed_by_product(usable.drop("vec") if as_unit else usable, centroids, threshold)
        return out.select(*given, "home_part", "part", F.when(F.col("part") == F.col("home_part"), "pInner").otherwise("pOuter").alias("ptype"), machine_label(F.col("part"), k).alias("machine"))
    routed = (
        usable.withColumn("__d", centroid_distances(F.col("__unit"), centroids))
        .withColumn("home_part", (F.array_position("__d", F.array_min("__d")) - 1).cast("int"))
        .withColumn(
            "__to",
            F.expr(
                f"filter(sequence(0, {k - 1}), i -> i = home_part OR (get(__d, i) <= get(__d, home_part) + 2 * {threshold!r}D "
                "AND (home_part < i) <> ((home_part + i) % 2 = 1)))"
            ),
        )
    )
    # explode_outer: the inner form would make the optimizer repeat the distances in a filter.
    return (
        routed.select(*given, "home_part", F.explode_outer("__to").alias("part"))
        .withColumn("ptype", F.when(F.col("part") == F.col("home_part"), "pInner").otherwise("pOuter"))
        .withColumn("machine", machine_label(F.col("part"), k))
    )
