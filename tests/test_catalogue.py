"""Every archive query against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lumenarc.plans import arriving, catalogue, discovery, entities, loose, refinement, runs, tags  # noqa: F401 - registers its queries

DIR = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "labels", "conversations", "events", "orders", "lineitem"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def cells(frame, columns):
    return sorted(tuple("" if pd.isna(v) else str(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, db, name):
    got, want = catalogue.QUERIES[name](spark, DIR).toPandas(), db.sql(catalogue.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert cells(got, columns) == cells(want, columns)
