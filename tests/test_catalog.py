"""Every query against its SQL counterpart, as the driver compares them."""

import duckdb
import pytest

from lakeproof.plans import catalog

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    import pandas as pd

    text = lambda v: "null" if pd.isna(v) else f"{float(v):.5f}" if isinstance(v, float) or "float" in type(v).__name__ else str(v)
    return list(frame.columns), sorted(tuple(text(v) for v in r) for r in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(got.columns)
    if name in catalog.ORACLE:
        want = duck.execute(catalog.ORACLE[name]).fetchdf()
        assert rows_of(got) == rows_of(want)
