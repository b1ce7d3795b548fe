"""Every query of the catalogue against its oracle in DuckDB."""

import datetime
import math

import duckdb
import pytest
from kinfold.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool | int | float):
        return (1, round(float(v), 9) + 0.0)
    if isinstance(v, datetime.datetime):
        return (2, v.replace(tzinfo=None).isoformat())
    return (2, str(v))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name not in catalogue.ORACLES:
        assert mine
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    other = con.sql(catalogue.ORACLES[name])
    assert sorted(other.columns) == names
    at = [other.columns.index(c) for c in names]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in other.fetchall())
