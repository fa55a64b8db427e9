"""Queries with SQL against DuckDB on the smallest tables: columns, row counts and values."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from tallybox.plans import load

SF = "/root/testdata/sf0.001"
REG = load()


def rows(df):
    df = df[sorted(df.columns)]
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple(None if pd.isna(v) else round(float(v), 5) if isinstance(v, (int, float)) or hasattr(v, "dtype") or type(v).__name__ == "Decimal" else str(v) for v in r))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables, with line items made unique: two of them share a box id, which breaks ties at random."""
    path = tmp_path_factory.mktemp("tables")
    for f in os.listdir(SF):
        if f != "lineitem.parquet":
            os.symlink(f"{SF}/{f}", path / f)
    duckdb.connect().execute(f"COPY (SELECT DISTINCT ON (l_orderkey, l_linenumber, l_partkey, l_suppkey) * FROM '{SF}/lineitem.parquet') TO '{path}/lineitem.parquet' (FORMAT parquet)")
    return str(path)


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return c


SOME = [n for n in sorted(REG.SQL) if n.split("_")[0] in {"p1", "p16", "p17", "p18", "p25", "p26", "a1", "a2", "a4", "a6", "a9", "a11", "a12", "a13", "a14", "m1", "m3", "m4", "m5", "m7", "m8", "m10", "j1", "j5", "j13", "j14", "j15",
                                                          "t1", "t5", "t9", "t13", "w1", "w2", "w3", "w5", "w6", "w7", "k2", "k3", "u2", "u5", "l5", "g1", "g6", "g7", "g13", "g15", "g4", "g5", "g11", "g17", "j12", "j20", "m16", "m20", "m25", "m26", "s5", "s6", "s12", "s13", "w9", "d1", "d3", "d4", "d9", "d11", "s1", "s4", "s7", "s10", "s11", "r2", "r3", "r4", "r5"}]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, folder, duck, name):
    got, want = REG.QUERIES[name](spark, folder).toPandas(), duck.execute(REG.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 9
