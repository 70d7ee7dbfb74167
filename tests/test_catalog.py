"""Every registered query of the library against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from nearspan.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(repr([None if pd.isna(x) else round(float(x), 5) if isinstance(x, (int, float)) or hasattr(x, "item") else x for x in r]) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        want = duck.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
    else:
        assert len(got) and len(got.columns)
    if name.startswith("rebalance_"):
        # Every group is somewhere, once, with the load and size it had; the fullest machine carries no more than before.
        given = QUERIES["lb_input"](spark, DATA).toPandas()
        same = ["group_id", "origin_machine", "space_id", "load", "size"]
        assert sorted(map(tuple, got[same].values.tolist())) == sorted(map(tuple, given[same].values.tolist()))
        assert set(got["machine"]) <= set(given["machine"])
        assert got.groupby("machine")["load"].sum().max() <= given.groupby("machine")["load"].sum().max()
