"""Distances and other scalar expressions over vectors, all evaluated by the JVM.

With a known, small dimension a dot product is written out term by term, which whole-stage
code generation compiles to straight arithmetic; otherwise it is a higher-order function
(written out, many terms exceed what the compiler takes, and run several times slower).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Dimensions up to which a dot product is written out.
UNROLLED = 8


def parse_vector(s: Column) -> Column:
    """'[1.0, 2.0]' as an array of doubles."""
    return F.transform(F.split(F.regexp_replace(s, r"[\[\]\s]", ""), ","), lambda x: x.cast("double"))


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    if dim is not None and dim <= UNROLLED:
        return reduce(lambda x, y: x + y, (F.get(a, F.lit(i)) * F.get(b, F.lit(i)) for i in range(dim)))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(a: Column) -> Column:
    """The vector over its length; null for a zero vector, which therefore never matches."""
    n = norm(a)
    # Inside a transform the norm would be computed anew for every component.
    return F.when(n > 0, F.zip_with(a, F.array_repeat(n, F.size(a)), lambda x, y: x / y))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def cosine(a: Column, b: Column, dim: int | None = None) -> Column:
    """Cosine similarity within [-1, 1]; null where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, clamp(dot(a, b, dim) / n))


def cosine_distance(a: Column, b: Column, dim: int | None = None) -> Column:
    return 1 - cosine(a, b, dim)


def angle(c: Column) -> Column:
    """Angular distance, between 0 and 1, of a cosine."""
    return F.acos(c) / F.pi()


def angular_distance(a: Column, b: Column, dim: int | None = None) -> Column:
    return angle(cosine(a, b, dim))


def unit_distance(a: Column, b: Column, dim: int | None = None) -> Column:
    """Angular distance of vectors that are unit vectors (or null) already."""
    return angle(clamp(dot(a, b, dim)))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def skewed(gauss: Column, low: float, high: float, skew: float, bias: float) -> Column:
    """A standard normal value squashed between low and high, drawn to one side by the bias."""
    mid, e = low + (high - low) / 2, F.exp(F.lit(float(bias)))
    return mid + (high - low) * (e / (e + F.exp(-gauss / skew)) - 0.5)


def machine_label(part: Column, parallelism: int, slots: int = 128) -> Column:
    """Key group at which partition ``part`` of ``parallelism`` begins: the name of its machine."""
    return ((part.cast("long") * slots + (parallelism - 1)) / parallelism).cast("long").cast("int")


def record_bytes(vec: Column, *texts: Column) -> Column:
    """Size of a routed record: six ints, two longs, its doubles and its texts."""
    return reduce(lambda x, y: x + y, (F.octet_length(t) for t in texts), F.lit(40) + 8 * F.size(vec)).cast("long")


def latency(out_ts: Column, *in_ts: Column) -> Column:
    return out_ts - (F.greatest(*in_ts) if len(in_ts) > 1 else in_ts[0])


def register(spark: SparkSession, dim: int | None = None) -> None:
    """angular_distance(a, b) for SQL texts, as a SQL function (no Python in the plan)."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION angular_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN "
        "CASE WHEN aggregate(a, 0D, (s, x) -> s + x * x) > 0 AND aggregate(b, 0D, (s, x) -> s + x * x) > 0 THEN "
        "acos(greatest(-1D, least(1D, aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / "
        "sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))))) / pi() END"
    )
