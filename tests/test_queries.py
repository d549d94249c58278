"""Every registered query of this library against its SQL; rows-only ones against plain loops."""

import duckdb
import pytest

from vecspark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, sf, con, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), con.execute(catalogue.ORACLES[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    text = lambda x: sorted(map(tuple, x[names].astype(object).where(x[names].notna(), None).map(lambda v: str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)).values.tolist()))
    assert text(got) == text(want)
