"""Shared pieces of the llm operators: Arrow maps, the label fold, a small booster."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nearspan.shipping import ship

#: What a function gets of an Arrow batch at once. Texts may be megabytes long, so bytes are bounded too.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
#: Labelled rows a model is fitted on at most (a documented bound; scoring covers all rows).
MAX_TRAINING_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only in local mode where none is set (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        path = "/tmp/nearspan-checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read from there: what it holds no longer changes."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.parquet(folder)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table in the shared folder that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def usable_vectors(rows: DataFrame, vec: str, dim: int | None = None) -> DataFrame:
    """The rows whose vector is there, has an entry (``dim`` of them, if given) and only finite ones."""
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.where(v.isNotNull() & ((F.size(v) > 0) if dim is None else (F.size(v) == dim)) & F.coalesce(finite, F.lit(False)))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df does not have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is heavy when it holds more than this share of the rows.
HEAVY_SHARE = 1000


def join_heavy(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """The inner join of left with right by key, where one key may hold a third of left's rows.

    right has each key once and in ``count`` the number of left's rows with it, which add up to
    ``total`` at most. Keys with more than total / HEAVY_SHARE rows are fewer than HEAVY_SHARE,
    so their rows of right are broadcast; only the other keys are shuffled. ``count`` is dropped.
    """
    most = max(total // HEAVY_SHARE, 8)
    heavy, rest = (right.where(c).drop(count) for c in (F.col(count) > most, F.col(count) <= most))
    names = F.broadcast(heavy.select(key))
    return left.join(F.broadcast(heavy), key).unionByName(left.join(names, key, "left_anti").join(rest, key))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most BATCH_ROWS rows and, but for a single row, BATCH_BYTES bytes."""
    parts = [batch.slice(a, BATCH_ROWS) for a in range(batch.num_rows - 1 - (batch.num_rows - 1) % BATCH_ROWS, -1, -BATCH_ROWS)] if batch.num_rows else []
    while parts:
        part = parts.pop()
        if part.num_rows > 1 and part.nbytes > BATCH_BYTES:
            half = part.num_rows // 2
            parts += [part.slice(half), part.slice(0, half)]
        else:
            yield part


def map_rows(df: DataFrame, columns: Sequence[str], schema: T.StructType, fn: Callable[[dict], dict]) -> DataFrame:
    """mapInArrow over the named columns: ``fn`` gets python lists by column, returns lists by column."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn({c: part.column(i).to_pylist() for i, c in enumerate(columns)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


def replace_text(df: DataFrame, text: str, fn: Callable[[list], list], keep: bool = False) -> DataFrame:
    """Map only the text column, every other column passing through untouched.

    With ``keep`` the function returns booleans instead and rows with False go.
    """
    ship(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part.column(at).to_pylist())
                if keep:
                    yield part.filter(pa.array(out, pa.bool_()))
                else:
                    arrays = list(part.columns)
                    arrays[at] = pa.array(out, part.schema.field(at).type)
                    yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return df.mapInArrow(run, df.schema)


def held_out(doc_id: Column) -> Column:
    """The rows a model never learns from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def training_ids(labels: DataFrame, label: str, bound: int = MAX_TRAINING_ROWS) -> DataFrame:
    """At most ``bound`` labelled ids outside the held-out fold, by a fixed pseudo-random order.

    Null ids and null labels are no training rows; an id labelled twice takes its larger label.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64(F.col("doc_id"), F.lit(17)), "doc_id")
        .limit(bound)
    )


class Booster:
    """Gradient-boosted symmetric trees on quantile bins, logistic loss.

    Every level of a tree applies one split to all its leaves, so scoring is a few
    vectorised comparisons and one table lookup per tree.
    """

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 32, l2: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2 = rounds, depth, rate, bins, l2
        self.trees: list[tuple[list[int], list[float], np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Booster":
        n, d = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(d)]
        codes = [np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]
        rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            leaf, features, cuts = np.zeros(n, dtype=np.int64), [], []
            for level in range(self.depth):
                best = (1e-9, -1, 0)
                leaves = 1 << level
                for f in range(d):
                    width = len(edges[f]) + 1
                    if width < 2:
                        continue
                    at = leaf * width + codes[f]
                    gs = np.bincount(at, g, leaves * width).reshape(leaves, width)
                    hs = np.bincount(at, h, leaves * width).reshape(leaves, width)
                    gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                    gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                    gain = (gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)).sum(0)
                    cut = int(gain.argmax())
                    if gain[cut] > best[0]:
                        best = (float(gain[cut]), f, cut)
                if best[1] < 0:
                    break
                features.append(best[1])
                cuts.append(float(edges[best[1]][best[2]]))
                leaf = leaf * 2 + (codes[best[1]] > best[2])
            if not features:
                break
            size = 1 << len(features)
            value = self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.l2)
            self.trees.append((features, cuts, value))
            score += value[leaf]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for features, cuts, value in self.trees:
            leaf = np.zeros(len(x), dtype=np.int64)
            for f, cut in zip(features, cuts, strict=True):
                leaf = leaf * 2 + (x[:, f] > cut)
            out += value[leaf]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.score(x)))
