"""Queries of texts over whole tables, where the capped ones return less."""

import duckdb
import pytest

from nearspan.plans.catalog import ORACLE_SQL, QUERIES

from .test_catalog import plain

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def agrees(spark, duck, name):
    """The rows of a query, once they equal those of its SQL."""
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
    return got


def test_cleaning_looks_at_every_document(spark, duck):
    got = agrees(spark, duck, "clean_dataset")
    first = duck.sql("SELECT max(doc_id) FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 500)").fetchall()[0][0]
    assert (got["id"] > first).any()


def test_mean_vectors_have_all_coordinates(spark, duck):
    got = agrees(spark, duck, "text_embedding_whole")
    assert [c for c in got.columns if c[0] == "v"] == [f"v{i}" for i in range(64)]
    assert len(got) == 1000 and all(got[f"v{i}"].any() for i in range(64))


def test_a_dataset_is_embedded_whole(spark, duck):
    got = agrees(spark, duck, "embed_dataset")
    assert len(got) > 500 and len(got.columns) == 65
