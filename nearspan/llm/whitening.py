"""Whitening of embeddings: one-sided Jacobi SVD of a blockwise QR factor.

1. Entries become integers; their number and exact sums are one aggregation.
2. Every task factors its centred rows block by block, R = qr(R over block), and hands on one
   triangle. Triangles meet in groups, a fixed number of groups at a time, until few are left.
3. Plane rotations make the columns of the last triangle orthogonal. Their lengths are the
   standard deviations times sqrt(n), the rotations' product holds the components. No
   covariance is formed, so small deviations keep their digits.
4. A second pass measures the whitened rows' covariance in the same way, the third writes them.

The driver and any one task see triangles (dimension squared), never rows.

Defined cases: vectors that are null or hold null or non-finite entries are left out; of the
others those that have the commonest length (the longer of equally common ones) are the fit
list, since a covariance needs one length; repeated rows count as often as they stand; null or
repeated ids pass through; a component without variance has whitened 0.0 and explained 0.0 and
takes no part in identity_error; a single vector gives rows without variance; an empty table
gives an empty result; other columns, of any name, are not read. Integers beyond 2**31 count as
2**31. A deviation that does not fit a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nearspan.llm.common import usable_vectors
from nearspan.shipping import ship

#: The production parameters: factor, offset, components returned.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Largest integer before the offset.
MOST = 1 << 31
#: Rows of a block of the factorisation.
BLOCK_ROWS = 1024
#: Groups in which partial results meet, level by level; the driver gets the last level's.
GROUPS = (1024, 32)
#: Cosine between two columns below which they count as orthogonal.
TOLERANCE = 1e-15

_PART = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("part", T.BinaryType())])
_ROWS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType())])


def blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of bounded length with a matrix of one column's lists."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            b = batch.slice(at, BLOCK_ROWS)
            yield b, b.column(column).flatten().to_numpy().reshape(b.num_rows, -1)


def gathered(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """One array for the whole table: ``partial`` makes one of a task's batches, ``merge`` one of two."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = partial(batches)
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([made.tobytes()], pa.binary())], schema=to_arrow_schema(_PART))

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        out = None
        for part in pdf.sort_values("at")["part"]:
            a = np.frombuffer(part)
            out = a if out is None else merge(out, a).ravel()
        return pd.DataFrame({"at": [int(pdf["at"].iloc[0])], "part": [np.ascontiguousarray(out).tobytes()]})

    parts = df.mapInArrow(first, _PART)
    for groups in GROUPS:
        parts = parts.groupBy(F.pmod(F.col("at"), F.lit(groups)).alias("g")).applyInPandas(together, _PART)
    out = None
    for r in sorted(parts.collect(), key=lambda r: (r["at"], bytes(r["part"]))):
        a = np.frombuffer(bytes(r["part"]))
        out = a if out is None else merge(out, a).ravel()
    return out


def stacked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The triangle of two triangles (given flat), padded to a square."""
    dim = int(len(a) ** 0.5)
    return triangle(np.vstack([a.reshape(dim, dim), b.reshape(dim, dim)]))


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a matrix's QR factorisation as a square, with zero rows where there are too few."""
    dim, r = rows.shape[1], np.linalg.qr(rows, mode="r")
    out = np.zeros((dim, dim))
    out[: len(r)] = r
    return out


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (columns) of a square matrix.

    One-sided rotations in rounds of disjoint pairs, as players of a tournament meet; every
    pair of columns meets once a sweep. A component's entry of largest size is positive.
    """
    a, dim = r.astype(float).copy(), r.shape[1]
    v, seats = np.eye(dim), list(range(dim + dim % 2))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(min(x, y), max(x, y)) for x, y in zip(seats[:half], reversed(seats[half:]), strict=True) if max(x, y) < dim]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            p, q = (np.array(x) for x in zip(*pairs, strict=True))
            alpha, beta, gamma = (a[:, p] ** 2).sum(0), (a[:, q] ** 2).sum(0), (a[:, p] * a[:, q]).sum(0)
            size = np.sqrt(alpha * beta)
            turn = abs(gamma) > TOLERANCE * size
            if not turn.any():
                continue
            p, q, alpha, beta, gamma, size = (x[turn] for x in (p, q, alpha, beta, gamma, size))
            worst = max(worst, (abs(gamma) / np.maximum(size, np.finfo(float).tiny)).max())
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
        if worst <= 4 * TOLERANCE:
            break
    sigma = np.sqrt((a**2).sum(0))
    order = np.argsort(-sigma, kind="stable")
    v = v[:, order] / np.sqrt((v[:, order] ** 2).sum(0))
    return sigma[order], v * np.where(v[abs(v).argmax(0), np.arange(dim)] < 0, -1.0, 1.0)


def whole_numbers(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """vec_id, x of the usable vectors."""
    x = F.transform(F.col(vec), lambda c: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), c.cast("double") * SCALE))) + OFFSET)
    return usable_vectors(rows, vec).select(F.col(key).cast("long").alias("vec_id"), x.alias("x"))


def scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: int64, or Python's integers where they are too large for it."""
    if n * int(abs(x).max(initial=0)) >= 1 << 61:
        return n * x.astype(object) - sums.astype(object)
    return n * x - sums


def deviations(y: np.ndarray) -> list[int | None]:
    """Sums of squares of exact rows; None where one does not fit a long."""
    if y.dtype != object and (y.astype(float) ** 2).sum(1).max(initial=0) < 9e18:
        return (y * y).sum(1).tolist()
    sums = [sum(int(v) ** 2 for v in row) for row in y]
    return [s if s < 1 << 63 else None for s in sums]


class Whitening:
    """n, the exact sums, components (columns), standard deviations and shares of a fit list."""

    def __init__(self, n: int, sums: list[int], r: np.ndarray, components: int):
        self.n, self.sums, dim = n, np.array(sums, np.int64), len(sums)
        sigma, v = jacobi(r)
        sd = sigma / np.sqrt(n)
        k = min(components, dim)
        varies = sd > dim * np.finfo(float).eps * max(sd.max(initial=0), np.finfo(float).tiny)
        self.components, self.deviation = v[:, :k], np.where(varies, sd, 0.0)[:k]
        total = (sd**2).sum()
        self.explained = self.deviation**2 / total if total > 0 else np.zeros(k)
        # Division by the deviation is part of the projection.
        self.projection = np.where(self.deviation > 0, self.components / np.where(self.deviation > 0, self.deviation, 1.0), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, subtracted before it is rounded."""
        return scaled(x, self.n, self.sums).astype(float) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.projection


def moments(w: np.ndarray) -> np.ndarray:
    """Number, mean and centred products of rows, in one flat array."""
    mean = w.mean(0)
    return np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])


def merged_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    k = next(k for k in range(len(a)) if 1 + k + k * k >= len(a))
    n, shift = a[0] + b[0], b[1 : k + 1] - a[1 : k + 1]
    return np.concatenate([[n], a[1 : k + 1] + shift * (b[0] / n), a[k + 1 :] + b[k + 1 :] + (np.outer(shift, shift) * (a[0] * b[0] / n)).ravel()])


def fit(x: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows of x (vec_id, x of length dim)."""
    ship(x.sparkSession)
    totals = x.agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(dim)]).collect()[0]
    n, sums = totals["n"], [totals[f"s{i}"] for i in range(dim)]
    if not n:
        return None
    exact = np.array(sums, np.int64)

    def factor(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        r = None
        for _, m in blocks(batches, 0):
            centred = scaled(m, n, exact).astype(float) / n
            r = triangle(centred if r is None else np.vstack([r, centred]))
        return r

    return Whitening(n, sums, gathered(x.select("x"), factor, stacked).reshape(dim, dim), components)


def identity_error(x: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, components with variance only."""

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out = None
        for _, m in blocks(batches, 0):
            own = moments(model.whitened(m))
            out = own if out is None else merged_moments(out, own)
        return out

    got, k = gathered(x.select("x"), part, merged_moments), len(model.deviation)
    varies = np.flatnonzero(model.deviation > 0)
    off = got[k + 1 :].reshape(k, k) / got[0] - np.eye(k)
    return float(abs(off[np.ix_(varies, varies)]).max(initial=0.0))


def whiten(rows: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    x = whole_numbers(rows, key, vec)
    common = x.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = common[0]["dim"] if common else 0
    x = x.where(F.size("x") == dim)
    model = fit(x, dim, components) if dim else None
    if model is None:
        return rows.sparkSession.createDataFrame([], T.StructType([*_ROWS.fields, T.StructField("identity_error", T.DoubleType())]))
    error, k, arrow = identity_error(x, model), len(model.deviation), to_arrow_schema(_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, m in blocks(batches, 1):
            rows_ = len(m)
            spread = np.repeat(np.arange(rows_), k)
            dev = pa.array(deviations(scaled(m, model.n, model.sums)), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(spread)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_)),
                    pa.array(np.full(rows_ * k, model.n)),
                    dev.take(pa.array(spread)),
                    pa.array(model.whitened(m).ravel()),
                    pa.array(np.tile(model.explained, rows_)),
                ],
                schema=arrow,
            )

    return x.mapInArrow(run, _ROWS).withColumn("identity_error", F.lit(error))
