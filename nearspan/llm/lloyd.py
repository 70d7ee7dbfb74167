"""Centroid clustering by delta Lloyd, in whole numbers.

Vectors become integers, floor(1024 * x). Every round writes each vector with its owner and the
distance to it to the shared folder, and the driver keeps the sum and the number of every
centroid's vectors. From one round to the next

* a vector whose owner stayed where it was is compared with the centroids that moved, no other;
  one whose owner moved is compared with all;
* vectors that changed hands are added to the new owner's sum and taken from the old one's: at
  most one row a centroid leaves a task, signed, and no sum is made anew.

A round in which no centroid moves ends the work, since all later ones would be alike.
Everything is exact, so neither the order of the rows nor a lost executor changes a result.

Defined cases: vectors that are null, of another length, or hold null or non-finite entries are
left out; with fewer vectors than centroids every vector is one; a null id never gives a first
centroid before an id does, repeated ids are rows of their own (the first centroids then go by
the vector, too); equal distances go to the smaller number; a centroid that owns nothing stays;
an empty table gives an empty result; other columns, of any name, are not read. Integers beyond
2**27 (entries beyond 131,072) count as 2**27, so that a distance fits a long.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nearspan.llm.common import checkpoint_dir, removed, usable_vectors
from nearspan.shipping import ship

#: The production parameters: components, factor, centroids, rounds.
DIM, SCALE, CENTROIDS, ROUNDS = 64, 1024, 8, 10
#: Largest integer of a component.
MOST = 1 << 27
#: Up to here a product of 64 terms is exact in doubles, so that one matrix product gives all distances.
EXACT = 1 << 22

_STATE = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("x", T.ArrayType(T.IntegerType())), T.StructField("was", T.IntegerType()), T.StructField("owner", T.IntegerType()), T.StructField("distance", T.LongType())])


def whole_numbers(vec: Column, scale: int = SCALE) -> Column:
    return F.transform(vec, lambda v: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), v.cast("double") * scale))).cast("int"))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of whole-number rows, exact: int64, a column for each centroid."""
    if not len(x) or not len(centroids):
        return np.zeros((len(x), len(centroids)), np.int64)
    if max(abs(x).max(), abs(centroids).max()) <= EXACT and x.shape[1] <= 64:
        a, b = x.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], axis=1)


def moved_owners(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and distance after the centroids marked in ``changed`` have moved; -1 owns nothing yet."""
    owner, distance = owner.copy(), distance.copy()
    lost = (owner < 0) | changed[owner]
    if lost.any():
        d = distances(x[lost], centroids)
        at = d.argmin(1)  # the smallest number of equals
        owner[lost], distance[lost] = at, d[np.arange(len(at)), at]
    rest, names = np.flatnonzero(~lost), np.flatnonzero(changed)
    if len(rest) and len(names):
        d = distances(x[rest], centroids[names])
        at = d.argmin(1)
        best, who = d[np.arange(len(at)), at], names[at]
        take = (best < distance[rest]) | ((best == distance[rest]) & (who < owner[rest]))
        owner[rest[take]], distance[rest[take]] = who[take], best[take]
    return owner, distance


def _assigned(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    arrow = to_arrow_schema(_STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                before = b.column(2).to_numpy(zero_copy_only=False)
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1).astype(np.int64)
                owner, distance = moved_owners(x, before, b.column(3).to_numpy(zero_copy_only=False), centroids, changed)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(owner, pa.int32()), pa.array(distance, pa.int64())], schema=arrow)

    return state.select("vec_id", "x", F.col("owner").alias("was"), "distance").mapInArrow(run, _STATE)


def transfers(state: DataFrame, dim: int) -> DataFrame:
    """What every centroid gains and loses, signed: centroid, n, and a sum for each component."""
    hands = F.inline(F.array(F.struct(F.col("owner").alias("centroid"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("centroid"), F.lit(-1).alias("sign"))))
    rows = state.where("owner <> was").select("x", hands).where("centroid >= 0")
    return rows.groupBy("centroid").agg(F.sum("sign").alias("n"), *[F.sum(F.col("sign") * F.get("x", F.lit(i)).cast("long")).alias(f"s{i}") for i in range(dim)])


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return [r["x"] for r in vectors.orderBy(order.asc_nulls_last(), "x").limit(k).select("x").collect()]


def delta_lloyd(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: str = "3:", key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector.

    ``rounds`` rounds of assigning and moving, then one more assignment. The result reads the
    last round's table in the shared folder; those of the rounds before are removed.
    """
    spark = rows.sparkSession
    ship(spark)
    kept = usable_vectors(rows, vec, dim).select(F.col(key).cast("long").alias("vec_id"), whole_numbers(F.col(vec), scale).alias("x"))
    folder = f"{checkpoint_dir(spark)}/lloyd-{uuid.uuid4().hex}"
    centroids = np.array(first_centroids(kept, k, salt), np.int64).reshape(-1, dim)
    sums, sizes = [[0] * dim for _ in centroids], [0] * len(centroids)
    changed = np.ones(len(centroids), bool)
    state, last = kept.withColumns({"owner": F.lit(-1), "distance": F.lit(0).cast("long")}), None
    for number in range(rounds + 1):
        path = f"{folder}/{number}"
        _assigned(state, centroids, changed).write.parquet(path)
        state = spark.read.schema(_STATE).parquet(path)
        if last:
            removed(spark, last)
        last = path
        if number == rounds:
            break
        for r in transfers(state, dim).collect():
            sizes[r["centroid"]] += r["n"]
            sums[r["centroid"]] = [s + r[f"s{i}"] for i, s in enumerate(sums[r["centroid"]])]
        new = np.array([[s // n for s in total] if n else list(c) for total, n, c in zip(sums, sizes, centroids.tolist(), strict=True)], np.int64).reshape(-1, dim)
        changed = (new != centroids).any(1)
        centroids = new
        if not changed.any():
            break
    inertias = {r["owner"]: int(r["d"]) for r in state.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    # As many rows as there are centroids.
    facts = spark.createDataFrame([(i, inertias.get(i, 0), sum(inertias.values()), digest(c)) for i, c in enumerate(centroids.tolist())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", F.col("owner").alias("cluster"), "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def lloyd_sql() -> str:
    """The same from the contract in SQL: every round compares every vector with every centroid."""
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT id, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT pos AS id, k, CAST(list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c) AS BIGINT) AS d FROM x, c{r}) GROUP BY id)""")
        if r < ROUNDS:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT k, list(f ORDER BY i) AS c FROM (SELECT k, i, CAST((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) / count(*) AS DOUBLE) AS f FROM (SELECT k, unnest(range(1, {DIM + 1})) AS i, CAST(unnest(v) AS HUGEINT) AS e FROM x JOIN a{r} ON x.pos = a{r}.id) GROUP BY k, i) GROUP BY k) m USING (k))""")
    return f"""WITH x AS MATERIALIZED (SELECT row_number() OVER () AS pos, vec_id, [floor({SCALE} * e::DOUBLE) for e in embedding] AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len([1 for e in embedding if e IS NULL OR NOT isfinite(e)]) = 0),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS INTEGER) AS k, v AS c FROM x ORDER BY k LIMIT {CENTROIDS}),
{', '.join(steps)},
t AS (SELECT k, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{ROUNDS} GROUP BY k)
SELECT vec_id, a.k AS cluster, d AS distance, cluster_inertia, (SELECT CAST(sum(d) AS BIGINT) FROM a{ROUNDS}) AS inertia, sha256(array_to_string([CAST(e AS BIGINT) for e in c.c], ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN x ON x.pos = a.id JOIN t ON t.k = a.k JOIN c{ROUNDS} c ON c.k = a.k"""
