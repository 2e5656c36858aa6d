"""Every registered query against its SQL on DuckDB; those without SQL must give rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
QUERIES = {k: f for k, f in entry.queries().items() if not (k.startswith("op") and k[2].isdigit()) and k != "pipeline"}
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canon(rows):
    def cell(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v):.6f}".replace("-0.000000", "0.000000")
        if hasattr(v, "tzinfo") and v.tzinfo:
            return str(v.replace(tzinfo=None))
        return str(list(v)) if isinstance(v, (list, tuple)) else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    assert got
    if name in ORACLES:
        rel = duck.execute(ORACLES[name])
        names = [x[0] for x in rel.description]
        want = rel.fetchall()
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert canon(got) == canon([tuple(r[i] for i in at) for r in want])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
