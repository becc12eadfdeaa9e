"""Every registered query of the engine against its SQL twin, over whole small tables."""

import glob
import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from coverlet.plans import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """A value that does not depend on which engine made it; whole numbers stay whole."""
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() and value.as_tuple().exponent >= 0 else round(float(value), 6)
    return value


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.collect()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    made = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in made.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, got) == rows(names, made.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 40
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
