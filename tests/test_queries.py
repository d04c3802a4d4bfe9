"""Each query of the catalog against its SQL in DuckDB."""

import os

import duckdb
import pytest

from plotweave.plans import catalog
from tests.conftest import SF


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None):
        out.append(str(tuple(round(v, 6) if isinstance(v, float) else v for v in (float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r))))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_names(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
