"""Corpus queries against their SQL on DuckDB, and the shape of all of them."""

import glob
import os

import duckdb
import pytest

from tessella.llm import queries

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    rel = con.execute(queries.ORACLES[name])
    cols = sorted(x[0] for x in rel.description)
    at = [[x[0] for x in rel.description].index(c) for c in cols]
    none_first = lambda r: tuple((x is not None, x) for x in r)
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=none_first)
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == cols
    assert sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=none_first) == want


def test_every_operator_is_registered():
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
