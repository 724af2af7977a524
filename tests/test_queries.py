"""Every registered query with SQL against DuckDB, the others for their rows."""

import math
import os

import duckdb
import pandas as pd
import pytest

from quillstone.plans import registry


@pytest.fixture(scope="module")
def db(sf_dir):
    found = duckdb.connect()
    for f in os.listdir(sf_dir):
        found.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return found


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return None
    x = x.item() if hasattr(x, "item") else x
    return round(x, 9) if isinstance(x, float) else x


def rows(df):
    return sorted(tuple(repr(plain(x)) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, db, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), db.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    as_float = [c for c in got.columns if str(got[c].dtype).startswith("float") and not str(want[c].dtype).startswith("float")]
    assert rows(got.astype({c: "Int64" for c in as_float}) if as_float else got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_has_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
