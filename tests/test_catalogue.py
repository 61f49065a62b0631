"""Every registered relational query against its SQL."""

import math
from pathlib import Path

import duckdb
import pytest

from millrace.plans import catalogue
from millrace.plans.registry import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not Path(SF).exists():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(pdf):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("<NA>", "NaT"):
            return "~"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(plain(x) for x in r) for r in pdf.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, con, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
