"""Keys that repeat, tie or lack an order are rejected, also where a plan reads no values."""

import datetime as dt

import pytest

from harvestgrid.functions.mesh import Box, rows_in_cell_box
from harvestgrid.functions.timegrid import DayRange
from harvestgrid.operators import anomaly, merge, panel, quality, sequences, spatial
from harvestgrid.sources import grids

DAY = dt.date(2016, 5, 1)


def raises(df, text):
    with pytest.raises(Exception, match=text):
        df.count()
    with pytest.raises(Exception, match=text):
        df.collect()


def test_update_given_twice(spark):
    table = spark.createDataFrame([(1, 2016, DAY, 5.0)], "place long, year int, date date, VP double")
    updates = spark.createDataFrame([(1, 2016, DAY, 6.0), (1, 2016, DAY, 7.0)], "place long, year int, date date, VP double")
    with pytest.raises(Exception, match="update given twice"):
        merge.update_merge(table, updates).collect()
    assert merge.update_merge(table, updates.limit(1)).first()["VP"] == 6.0


def test_updates_by_station(spark):
    table = spark.createDataFrame([("a", 1, 2016, DAY), ("b", 1, 2016, DAY)], "station string, place long, year int, date date")
    sheet = spark.createDataFrame([("a", DAY, 1.0), ("b", DAY, 2.0)], "station string, date date, VP double")
    new = merge.season_updates(sheet, table, on=["station"])
    got = merge.update_merge(table, new, on=["station"]).collect()
    assert {(r["station"], r["VP"]) for r in got} == {("a", 1.0), ("b", 2.0)}


def test_orders_without_a_last_row(spark):
    kinds = "loc_id long, year int, yield double, src_order int"
    raises(panel.keep_last(spark.createDataFrame([(1, 2000, 1.0, None)], kinds), "src_order"), "no order among")
    raises(panel.keep_last(spark.createDataFrame([(1, 2000, 1.0, 3), (1, 2000, 2.0, 3)], kinds), "src_order"), "no order among")
    rows = [(1, 2000, 1.0, 3), (1, 2000, 2.0, 4), (1, 2000, 2.0, 4), (2, 2000, None, 1)]
    got = panel.keep_last(spark.createDataFrame(rows, kinds), "src_order").collect()
    assert {(r["loc_id"], r["yield"]) for r in got} == {(1, 2.0), (2, None)}


def test_repeated_year_in_a_run(spark):
    years = [2000, 2001, 2002, 2003, 2003]
    df = spark.createDataFrame([(1, y, 5.0, [1.0, 2.0, 3.0]) for y in years], "loc_id long, year int, yield double, features array<double>")
    scalars = panel.year_scalars(df, 2010)
    raises(sequences.training_sequences(df, scalars, 2010, (1, 1, 1)), "repeated year")


def test_conflicting_pieces_without_reading_values(spark):
    one = spark.createDataFrame([("e", "m", 1, 2.0)], "element string, mesh_code string, ts int, value double")
    two = spark.createDataFrame([("e", "m", 1, 3.0)], one.schema)
    raises(grids.merge_pieces([one, two]).select("mesh_code"), "conflicting values")
    assert grids.merge_pieces([one, one]).first()["value"] == 2.0


def test_repeated_elements(spark):
    grid = spark.createDataFrame([("e", 1.0)], "element string, value double")
    kinds = "element string, long_name string, unit string"
    assert grids.with_names(grid, spark.createDataFrame([("e", "n", "u"), ("e", "n", "u")], kinds)).count() == 1
    with pytest.raises(Exception, match="two names"):
        grids.with_names(grid, spark.createDataFrame([("e", "n", "u"), ("e", "n", "v")], kinds)).count()


def test_fill_of_either_width(spark):
    import numpy as np

    wide = float(np.float32(9.96921e36))
    for kind in ("double", "float"):
        df = spark.createDataFrame([(9.96921e36,), (wide,), (2.5,)], f"v {kind}")
        assert [r.v for r in quality.sentinel_to_null(df, ["v"]).collect()] == [None, None, 2.5]


def test_raster_of_a_quarter_degree(spark):
    points = [(40.0 + 0.25 * r, 140.0 + 0.25 * c) for r, c in ((0, 0), (1, 1), (2, 3))]
    df = spark.createDataFrame([("a", y, x, 1.0) for y, x in points], "layer string, lat double, lon double, value double")
    got = spatial.raster_cells(df, "layer").collect()
    assert {(r["row"], r["column"], r["height"], r["width"], r["pixel_x"], r["pixel_y"]) for r in got} == {
        (2, 0, 3, 4, 0.25, 0.25), (1, 1, 3, 4, 0.25, 0.25), (0, 3, 3, 4, 0.25, 0.25)
    }
    odd = spark.createDataFrame([("a", 40.0, 140.0, 1.0), ("a", 41.0, 141.0, 1.0), ("a", 42.3, 142.0, 1.0)], df.schema)
    with pytest.raises(Exception, match="no regular axis"):
        spatial.raster_cells(odd, "layer").collect()
    one = spatial.raster_cells(df.limit(1), "layer").first()
    assert (one["row"], one["height"], one["pixel_y"]) == (0, 1, None)


def partition_filters(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in text.splitlines() if "PartitionFilters" in line]


def test_grid_reads_are_pruned(spark, tmp_path):
    rows = [("e", k, 2016, dt.date(2016, 5, 1), 36.1 + d, 140.1) for k in ("observed", "normal") for d in range(3)]
    cells = spark.createDataFrame(rows, "element string, kind string, year int, date date, lat double, lon double")
    grids.write_grid(grids.with_cell(cells).selectExpr("*", "1D AS value"), str(tmp_path / "g"), "daily")
    grid = grids.read_grid(spark, str(tmp_path / "g"), "daily")
    box, days = Box(36.0, 36.5, 140.0, 140.5), DayRange.of("2016-04-01", "2016-06-01")
    for df, words in (
        (grids.extract_cells(grid, "e", box, -1.0, days, kind="observed"), ("element", "kind", "year", "block")),
        (rows_in_cell_box(grid, box), ("block",)),
        (anomaly.both_kinds(grid, days), ("kind", "year")),
    ):
        scans = partition_filters(df)
        assert len(scans) == 1 and all(w in scans[0].split("PartitionFilters")[1].split("]")[0] for w in words), scans
    assert anomaly.both_kinds(grid, days).count() == 3 and rows_in_cell_box(grid, box).count() == 2


def test_stand_ins_agree_with_sql_when_customers_share_cells(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as contract

    spark.range(1, 60_001).selectExpr(
        "id AS c_custkey", "concat('c', id) AS c_name", "id % 25 AS c_nationkey", "CAST(id % 977 AS DOUBLE) AS c_acctbal", "'X' AS c_mktsegment"
    ).selectExpr(*schema_casts("customer")).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(40_000).selectExpr(
        "id AS event_id", "timestamp_seconds(1704067200 + (id * 7919) % 2500000) AS ts", "1 + (id * 26400) % 52801 + id % 5 AS user_id",
        "element_at(array('click', 'error', 'purchase', 'signup', 'view'), CAST(id % 5 AS INT) + 1) AS event_type", "CAST(id % 1000 AS DOUBLE) / 7 AS value"
    ).selectExpr(*schema_casts("events")).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    for name in ("customer", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("site_weather_wide", "mesh_pivot", "anomaly", "merge_pieces", "hourly_scan", "scenario_scan", "raster_cells"):
        df = contract.queries()[name](spark, str(tmp_path))
        result = con.execute(contract.oracle_sql()[name])
        columns = [f"`{c[0]}`" for c in result.description]
        from tests.test_registered import ordered

        assert ordered(df.select(*columns).collect()) == ordered(result.fetchall()), name


def schema_casts(name):
    from harvestgrid.plans.standins import SCHEMAS
    from pyspark.sql.types import StructType

    schema = SCHEMAS[name]
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    made = {"customer": {"c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"}, "events": {"event_id", "ts", "user_id", "event_type", "value"}}[name]
    return [
        f"CAST({f.name if f.name in made else 'NULL'} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema.fields
    ]
