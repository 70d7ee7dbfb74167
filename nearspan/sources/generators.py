"""Synthetic streams. Every record is a function of its number and the seed, so any part can be remade.

Generators that take a duration give the table of its ticks; with None they give an endless
stream of the same records, paced at ``rate`` a second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearspan.functions.vectors import skewed


def uniform(key: Column, seed: int, k: int | Column) -> Column:
    """A number in [0, 1) from a hash of the record, the seed and the coordinate."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), k), 11) / float(1 << 53)


def gauss(key: Column, seed: int, k: int | Column) -> Column:
    """A standard normal value (Box-Muller)."""
    j = (F.lit(k) if isinstance(k, int) else k) * 2
    return F.sqrt(-2 * F.log(1 - uniform(key, seed, j + 100_000))) * F.cos(2 * F.pi() * uniform(key, seed, j + 100_001))


def ticks(spark: SparkSession, rate: int, duration: int | None) -> DataFrame:
    """``rate`` records in each of ``duration`` ticks (None: without end): id, event_ts (the tick), ingest_ts."""
    if duration is None:
        records = spark.readStream.format("rate").option("rowsPerSecond", rate).load().withColumnRenamed("value", "id")
    else:
        records = spark.range(rate * duration)
    return records.select(F.col("id"), F.expr(f"div(id, {rate})").alias("event_ts"), F.expr(f"div(id, {rate}) * 1000").alias("ingest_ts"))


def _vectors(df: DataFrame, dim: int, value) -> DataFrame:
    return df.select("event_ts", "ingest_ts", "id", F.array(*[value(F.col("id"), k) for k in range(dim)]).alias("vec"))


def uniform_vectors(spark, rate: int, duration: int | None, dim: int = 2, seed: int = 42) -> DataFrame:
    return _vectors(ticks(spark, rate, duration), dim, lambda i, k: uniform(i, seed, k) * 2 - 1)


def benchmark_vectors(spark, rate: int, duration: int | None, dim: int = 2, seed: int = 42) -> DataFrame:
    """The benchmark source: event_ts is the record number."""
    return uniform_vectors(spark, rate, duration, dim, seed).withColumn("event_ts", F.col("id"))


def gaussian_vectors(spark, rate: int, duration: int | None, dim: int = 2, seed: int = 42) -> DataFrame:
    return _vectors(ticks(spark, rate, duration), dim, lambda i, k: gauss(i, seed, k) * 2 - 1)


def skewed_vectors(spark, rate: int, duration: int | None, seed: int = 42, skew: float = 10.0, bias: float = 5.0) -> DataFrame:
    return _vectors(ticks(spark, rate, duration), 2, lambda i, k: skewed(gauss(i, seed, k), 0.0, 1.0, skew, bias) * 2 - 1)


def pareto_vectors(spark, rate: int, duration: int | None, seed: int = 42, scale: float = 1.0, shape: float = 10.0) -> DataFrame:
    return _vectors(ticks(spark, rate, duration), 2, lambda i, k: scale / F.pow(1 - uniform(i, seed, k), F.lit(1 / shape)))


def _words(df: DataFrame, words: list[str], index: Column) -> DataFrame:
    return df.select("event_ts", "ingest_ts", "id", F.element_at(F.array(*map(F.lit, words)), index).alias("word"))


def uniform_words(spark, words: list[str], rate: int, duration: int | None, seed: int = 42) -> DataFrame:
    return _words(ticks(spark, rate, duration), words, F.floor(uniform(F.col("id"), seed, 0) * len(words)).cast("int") + 1)


def zipf_cumulated(n: int, exponent: float) -> list[float]:
    """Cumulated probabilities of ranks 1 to n."""
    weights = [1 / r**exponent for r in range(1, n + 1)]
    total, out, at = sum(weights), [], 0.0
    for w in weights:
        at += w / total
        out.append(at)
    return out


def zipf_words(spark, words: list[str], rate: int, duration: int | None, seed: int = 42, exponent: float = 2.0) -> DataFrame:
    """Rank r with probability proportional to r ** -exponent; rank 1 is the first word."""
    u, cumulated = uniform(F.col("id"), seed, 0), zipf_cumulated(len(words), exponent)
    below = F.size(F.filter(F.array(*map(F.lit, cumulated[:-1])), lambda c: c <= u))
    return _words(ticks(spark, rate, duration), words, below + 1)


def pareto_topics(spark, rate: int, duration: int | None, topics: int = 8, seed: int = 42, exponent: float = 1.0) -> DataFrame:
    """A mixture of Pareto clouds around ``topics`` corners, their shares by Zipf's law."""
    u, cumulated = uniform(F.col("id"), seed, 9), zipf_cumulated(topics, exponent)
    topic = F.size(F.filter(F.array(*map(F.lit, cumulated[:-1])), lambda c: c <= u))
    df = ticks(spark, rate, duration).withColumn("topic", topic)
    centre = lambda k: F.cos(2 * F.pi() * F.col("topic") / topics - (F.pi() / 2 if k else 0))
    spread = lambda i, k: (1 / F.pow(1 - uniform(i, seed, k), F.lit(0.1)) - 1) * F.when(uniform(i, seed, 20 + k) < 0.5, -1).otherwise(1)
    return df.select("event_ts", "ingest_ts", "id", F.array(*[centre(k) + spread(F.col("id"), k) for k in range(2)]).alias("vec"))


def jittered(spark, rate: int, duration: int, seed: int = 42) -> DataFrame:
    """Ticks of a rate that varies between 0.95 and 1.15 times the wanted one: event_ts, id, ingest_ts.

    Ids rise with time and leave gaps, so that no tick has to know those before it.
    """
    most = int(1.15 * rate) + 1
    n = F.floor(uniform(F.col("t"), seed, 0) * (0.2 * rate) + 0.95 * rate).cast("int")
    rows = spark.range(duration).withColumnRenamed("id", "t").withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.select(F.col("t").alias("event_ts"), (F.col("t") * most + F.col("k")).alias("id"), (F.col("t") * 1000).alias("ingest_ts"))


def embedding_stream(spark, vectors: DataFrame, rate: int, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Stored vectors replayed at a rate, in order of their key."""
    return vectors.select((F.col(key) / rate).cast("long").alias("event_ts"), (F.col(key) / rate).cast("long").alias("ingest_ts"), F.col(key).alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("vec"))
