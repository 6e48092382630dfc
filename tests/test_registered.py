"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def comparable(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return value.isoformat() if hasattr(value, "isoformat") else value


def ordered(rows):
    return sorted((tuple(comparable(v) for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(contract.queries()) & set(contract.oracle_sql())))
def test_query_equals_its_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    result = duck.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    rows = df.select(*[f"`{c}`" for c in columns]).collect()
    assert ordered(rows) == ordered(result.fetchall())


def test_queries_without_sql(spark):
    without = set(contract.queries()) - set(contract.oracle_sql())
    models = {"yield_model_score", "model_compare", "joint_outputs"}
    assert all(name.startswith("op") or name == "pipeline" or name in models for name in without)
    empty = contract.queries()["empty_scan"](spark, SF_DIR)
    assert empty.count() == 0 and empty.columns == ["element", "mesh_code", "lat", "lon", "date", "value"]


def test_entry(spark):
    assert contract.entry(spark).count() > 0
