"""Every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = [k for k in entry.queries() if k in entry.registry.QUERIES]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", [k for k in OWN if k in entry.oracle_sql()])
def test_query_equals_sql(spark, con, tmp_path, name):
    entry.queries()[name](spark, SF).write.parquet(str(tmp_path / name))
    con.execute(f"create or replace temp table got as select * from '{tmp_path}/{name}/*.parquet'")
    con.execute(f"create or replace temp table want as {entry.oracle_sql()[name]}")
    cols = sorted(c[0] for c in con.execute("describe got").fetchall())
    assert cols == sorted(c[0] for c in con.execute("describe want").fetchall())
    listed = ", ".join(f'"{c}"' for c in cols)
    for a, b in (("got", "want"), ("want", "got")):
        assert con.execute(f"select {listed} from {a} except all select {listed} from {b} limit 3").fetchall() == []


@pytest.mark.parametrize("name", [k for k in OWN if k not in entry.oracle_sql()])
def test_kernel_query_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
