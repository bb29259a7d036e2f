"""Every query with SQL gives the SQL's rows on the small tables."""

import duckdb
import pytest

from goldleaf.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, sf_dir, duck, name):
    assert rows(catalogue.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(catalogue.ORACLES[name]).df())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
