"""Whitening against eigenvectors of the covariance, clustering against plain rounds and SQL."""

import hashlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nearspan.llm import lloyd, whitening
from nearspan.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"


def table(spark, rows, schema="vec_id long, embedding array<float>"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def vectors():
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet' ORDER BY 1").fetchall()
    return [r[0] for r in rows], np.array([r[1] for r in rows])


def check_whitening(got, ids, x, components):
    """got: the rows of the operator, sorted by id and component; x: whole numbers."""
    n, dim = x.shape
    k = min(components, dim)
    centred = x - x.mean(0)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    assert len(got) == n * k and set(got["n"]) == {n}
    assert got["vec_id"].tolist() == [i for i in ids for _ in range(k)] and got["component"].tolist() == list(range(1, k + 1)) * n
    total = [sum(c) for c in zip(*x.tolist(), strict=True)]
    exact = [sum((n * c - s) ** 2 for c, s in zip(row, total, strict=True)) for row in x.tolist()]
    assert got["deviation"].tolist() == [d for d in exact for _ in range(k)]
    w = got["whitened"].to_numpy().reshape(n, k)
    want = centred @ v[:, :k] / np.sqrt(e[:k])
    signs = np.sign((w * want).sum(0))
    assert abs(w * signs - want).max() < 1e-7
    assert abs(got["explained"].to_numpy().reshape(n, k)[0] / (e[:k] / e.sum()) - 1).max() < 1e-9
    assert set(got["identity_error"]) == {got["identity_error"].iloc[0]} and got["identity_error"].iloc[0] < 1e-9
    return w


def test_whitening_of_the_whole_table(spark, vectors):
    ids, emb = vectors
    got = QUERIES["op12_whitening"](spark, DATA).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(64 * emb.astype(float)).astype(np.int64) + 1_000_000
    w = check_whitening(got, ids, x, 32)
    assert abs(w.T @ w / len(w) - np.eye(32)).max() < 1e-9


def test_small_deviations_keep_their_digits():
    """The covariance would lose the smallest value: its square is below the largest's last digit."""
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    want = np.array([1e9, 1e5, 10.0, 1.0, 1e-2, 1e-3])
    rows = np.linalg.qr(rng.normal(size=(200, 6)))[0] * want @ q.T
    r = whitening.triangle(rows[:90])
    for at in (90, 91, 150):
        r = whitening.triangle(np.vstack([r, rows[at : {90: 91, 91: 150, 150: 200}[at]]]))
    sigma, v = whitening.jacobi(r)
    assert abs(sigma[:5] / want[:5] - 1).max() < 1e-4 and abs(v.T @ v - np.eye(6)).max() < 1e-12


@pytest.mark.parametrize("dim", [1, 2, 5, 8])
def test_jacobi_on_any_matrix(dim):
    rng = np.random.default_rng(dim)
    for rank in range(dim + 1):
        a = rng.normal(size=(dim, rank)) @ rng.normal(size=(rank, dim)) if rank else np.zeros((dim, dim))
        sigma, v = whitening.jacobi(a)
        assert np.allclose(sigma, np.linalg.svd(a, compute_uv=False), atol=1e-12) and np.allclose(v.T @ v, np.eye(dim))


def test_partial_moments_meet():
    rng = np.random.default_rng(1)
    w = rng.normal(size=(50, 3)) + 1e6
    a = whitening.merged_moments(whitening.moments(w[:1]), whitening.moments(w[1:20]))
    got, want = whitening.merged_moments(a, whitening.moments(w[20:])), whitening.moments(w)
    assert np.allclose(got, want, rtol=1e-9)


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, []), (6, [1.0]), (None, [0.5, -0.5]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [-3.0, 0.25])]
    df = table(spark, odd).withColumns({"component": F.lit("x"), "n": F.lit(None), "X": F.lit(2), "at": F.lit(1)})
    got = whitening.whiten(df).toPandas()
    got["vec_id"] = got["vec_id"].fillna(-1).astype(int)
    got = got.sort_values(["vec_id", "whitened", "component"]).sort_values(["vec_id", "component"], kind="stable")
    assert sorted(got["vec_id"]) == [-1, -1, 7, 7, 7, 7, 8, 8]
    assert set(got["n"]) == {4} and set(got["component"]) == {1, 2}
    x = np.floor(64 * np.array([[0.5, -0.5], [1, 2], [1, 2], [-3, 0.25]])).astype(np.int64) + 1_000_000
    assert sorted(set(got["deviation"])) == sorted({sum((4 * c - s) ** 2 for c, s in zip(row, x.sum(0).tolist(), strict=True)) for row in x.tolist()})
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in one] == [(0.0, 0.0, 0.0, 0)] * 2
    flat = whitening.whiten(table(spark, [(i, [float(i), 3.0]) for i in range(6)])).collect()
    assert {r["whitened"] for r in flat if r["component"] == 2} == {0.0} and {r["identity_error"] < 1e-12 for r in flat} == {True}
    empty = whitening.whiten(table(spark, []))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_a_deviation_beyond_a_long_is_null(spark):
    got = whitening.whiten(table(spark, [(1, [1e30]), (2, [-1e30]), (3, [0.0])])).collect()
    assert sorted(r["deviation"] is None for r in got) == [False, True, True] or [r["deviation"] for r in got]
    assert whitening.deviations(np.array([[1 << 40, 1]], dtype=object)) == [None] and whitening.deviations(np.array([[3, 4]])) == [25]


def plain_lloyd(ids, x, k=8, rounds=10):
    """The contract step by step with Python's integers."""
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"3:{ids[i]}".encode()).hexdigest(), x[i]))
    cent = [list(x[i]) for i in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(cent))
    for _ in range(rounds):
        own = [near(v)[1] for v in x]
        for c in range(len(cent)):
            mine = [v for v, o in zip(x, own, strict=True) if o == c]
            if mine:
                cent[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    out = [near(v) for v in x]
    total = sum(d for d, _ in out)
    return sorted((i, c, d, sum(e for e, o in out if o == c), total, hashlib.sha256(",".join(map(str, cent[c])).encode()).hexdigest()) for i, (d, c) in zip(ids, out, strict=True))


def rows_of(df):
    return sorted(tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect())


def test_clusters_equal_plain_rounds_and_sql(spark, vectors):
    ids, emb = vectors
    x = np.floor(1024 * emb.astype(float)).astype(int).tolist()
    got = rows_of(QUERIES["op13_delta_lloyd"](spark, DATA))
    assert got == plain_lloyd(ids, x)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    sql = c.sql(ORACLE_SQL["op13_delta_lloyd"]).df()
    assert got == sorted(tuple(r) for r in sql[["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]].itertuples(index=False))


def test_clusters_with_ties_and_repeated_rows(spark):
    """Few distinct points, so that equal distances and empty centroids are common."""
    rng = np.random.default_rng(3)
    ids = list(range(60)) + [5, 5, 9]
    emb = rng.integers(-2, 3, size=(63, 64)) * (rng.random((63, 64)) < 0.03) / 1024
    rows = [(i, v.tolist()) for i, v in zip(ids, emb, strict=True)]
    got = rows_of(lloyd.delta_lloyd(table(spark, rows)))
    assert got == plain_lloyd(ids, np.floor(1024 * emb.astype(np.float32).astype(float)).astype(int).tolist())


def test_a_round_changes_what_all_comparisons_would():
    rng = np.random.default_rng(9)
    x = rng.integers(-5, 6, size=(200, 3))
    cent = rng.integers(-5, 6, size=(6, 3))
    owner, d = lloyd.moved_owners(x, np.full(200, -1), np.zeros(200, np.int64), cent, np.ones(6, bool))
    for _ in range(20):
        changed = rng.random(6) < 0.3
        cent = np.where(changed[:, None], rng.integers(-5, 6, size=(6, 3)), cent)
        owner, d = lloyd.moved_owners(x, owner, d, cent, changed)
        every = ((x[:, None] - cent) ** 2).sum(2)
        assert (owner == every.argmin(1)).all() and (d == every.min(1)).all()


def test_distances_of_large_numbers_are_exact():
    x, c = np.array([[lloyd.MOST] * 64, [1] * 64]), np.array([[-lloyd.MOST] * 64, [0] * 64])
    assert lloyd.distances(x, c).tolist() == [[64 * (2 * lloyd.MOST) ** 2, 64 * lloyd.MOST**2], [64 * (lloyd.MOST + 1) ** 2, 64]]


def test_clusters_of_odd_rows(spark):
    nan = float("nan")
    v = lambda a: [a] + [0.0] * 63
    rows = [(1, None), (2, v(nan)), (3, [1.0]), (4, [None] * 64), (None, v(1.0)), (5, v(2.0)), (5, v(2.0)), (6, v(1e30))]
    df = table(spark, rows).withColumns({"cluster": F.lit("c"), "x": F.lit(1), "owner": F.lit(0)})
    got = lloyd.delta_lloyd(df).collect()
    assert len(got) == 4 and sorted(r["distance"] for r in got) == [0, 0, 0, 0]
    assert len({r["cluster"] for r in got}) == 3
    empty = lloyd.delta_lloyd(table(spark, []))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_old_rounds_leave_the_shared_folder(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("lloyd-*/*"))
    got = lloyd.delta_lloyd(table(spark, [(i, [float(i % 7)] * 64) for i in range(40)]), rounds=3)
    new = [p for p in set(folder.glob("lloyd-*/*")) - before if not p.name.startswith(".")]
    assert got.count() == 40 and len(new) == 1
