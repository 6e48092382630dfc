import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from harvestgrid.functions import mesh
from harvestgrid.functions.timegrid import DayRange, HourRange
from harvestgrid.sources import grids as G

POINT = (36.0566, 140.125)


@pytest.fixture(scope="module")
def daily(spark, tmp_path_factory):
    """Two tiles' worth of cells around a tile corner, two elements, over a new year; stored by partition."""
    path = str(tmp_path_factory.mktemp("grid") / "daily")
    cells = spark.range(40).select((F.lit(35.9) + F.col("id") / 200.0).alias("lat")).crossJoin(
        spark.range(30).select((F.lit(139.9) + F.col("id") / 120.0).alias("lon"))
    )
    rows = (
        G.with_cell(cells).dropDuplicates(["mesh_code"])
        .withColumn("date", F.explode(F.expr("sequence(date'2015-12-25', date'2016-01-10')")))
        .withColumn("element", F.explode(F.array(F.lit("TMP_mea"), F.lit("RH"))))
        .withColumn("kind", F.explode(F.array(F.lit("observed"), F.lit("normal"))))
        .withColumns({"year": F.year("date"), "value": F.dayofyear("date") + F.col("lat")})
    )
    G.write_grid(rows, path, "daily")
    return G.read_grid(spark, path, "daily")


def test_tile_stays_text(daily):
    assert dict(daily.dtypes)["tile"] == "string"
    assert {r.tile for r in daily.select("tile").distinct().collect()} == {"5339", "5340", "5439", "5440"}


def test_point_scan_is_one_cell_for_129_days(spark):
    code = mesh.mesh_code(F.lit(POINT[0]), F.lit(POINT[1]))
    rows = (
        spark.range(1)
        .select(F.explode(F.expr("sequence(date'2015-01-01', date'2016-12-31')")).alias("date"))
        .withColumns({"lat": F.lit(POINT[0]), "lon": F.lit(POINT[1]), "element": F.lit("TMP_mea"), "value": F.lit(1.0)})
        .withColumns({"kind": F.lit("observed"), "year": F.year("date")})
    )
    grid = G.with_cell(rows)
    box = mesh.Box(POINT[0], POINT[0], POINT[1], POINT[1])
    got = G.scan_daily(grid, "TMP_mea", DayRange.around(dt.date(2016, 1, 1), 64), box)
    assert got.count() == 129
    assert {r.mesh_code for r in got.select("mesh_code").distinct().collect()} == {spark.range(1).select(code).head()[0]}
    squeezed = G.scan_daily(grid, "TMP_mea", DayRange.of("2016-01-01", "2016-01-01"), box, squeeze=True)
    assert squeezed.columns == ["element", "mesh_code", "value"] and squeezed.count() == 1


def test_box_holds_the_cells_of_its_bounds(daily):
    box = mesh.Box(35.95, 36.0, 139.95, 140.02)
    got = G.scan_daily(daily, "RH", DayRange.of("2016-01-01", "2016-01-01"), box)
    every = daily.where("element = 'RH' and kind = 'observed' and date = date'2016-01-01'")
    r0, r1 = mesh.row_value(35.95), 36 * 120 - 1
    c0, c1 = mesh.column_value(139.95), mesh.column_value(140.02)
    want = every.where(mesh.cell_row(F.col("lat")).between(r0, r1) & mesh.cell_column(F.col("lon")).between(c0, c1))
    assert got.count() == want.count() > 0
    assert got.join(want, "mesh_code", "left_anti").count() == 0


def test_area_scan_reads_past_a_tile_edge(daily):
    days = DayRange.of("2016-01-01", "2016-01-01")
    by_tile = G.scan_daily(daily, "RH", days, mesh.Box(35.95, 36.0, 139.95, 140.0))
    by_area = G.scan_daily(daily, "RH", days, mesh.Box(35.95, 36.0, 139.95, 140.0), by_area=True)
    north = by_area.agg(F.max("lat")).head()[0]
    assert north > 36.0 > by_tile.agg(F.max("lat")).head()[0]


def test_partitions_are_pruned(spark, daily):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10000)
    box = mesh.Box(POINT[0], POINT[0], POINT[1], POINT[1])
    plan = G.scan_daily(daily, "RH", DayRange.of("2016-01-02", "2016-01-05"), box)._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    for column in ("element", "kind", "year", "block"):
        assert column in filters
    assert "In(tile, [" in plan[plan.index("PushedFilters"):] or "EqualTo(tile," in plan[plan.index("PushedFilters"):]
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThan(lat" in pushed and "GreaterThanOrEqual(date" in pushed
    assert "Exchange" not in plan and "Python" not in plan


def test_range_over_new_year_and_normals(daily):
    box = mesh.Box(35.9, 36.05, 139.9, 140.1)
    days = DayRange.of("2015-12-30", "2016-01-02")
    got = G.scan_daily(daily, "TMP_mea", days, box, kind="normal")
    assert {r.date.isoformat() for r in got.select("date").distinct().collect()} == {"2015-12-30", "2015-12-31", "2016-01-01", "2016-01-02"}


def test_empty_scan_keeps_the_schema(daily):
    box = mesh.Box(35.9, 36.05, 139.9, 140.1)
    empty = G.scan_daily(daily, "none", DayRange.of("2016-01-01", "2016-01-02"), box)
    assert empty.count() == 0
    assert empty.schema == G.scan_daily(daily, "RH", DayRange.of("2016-01-01", "2016-01-02"), box).schema


def test_names(spark, daily):
    elements = spark.createDataFrame([("RH", "humidity", "%")], "element string, long_name string, unit string")
    got = G.scan_daily(daily, "RH", DayRange.of("2016-01-01", "2016-01-01"), mesh.Box(35.95, 35.95, 139.95, 139.95), elements=elements)
    assert (got.head().long_name, got.head().unit) == ("humidity", "%")


def test_hourly_scan(spark, tmp_path):
    rows = spark.createDataFrame(
        [("2022-12-31 15:00:00", 0.25), ("2022-12-31 16:00:00", 0.35), ("2023-01-01 15:00:00", 1.0)], "t string, value double"
    )
    utc = F.col("t").cast("timestamp_ntz")
    rows = G.with_cell(rows.withColumns({"lat": F.lit(POINT[0]), "lon": F.lit(POINT[1])})).select(
        F.lit("TMP").alias("element"), F.lit("observed").alias("kind"), "tile", "mesh_code", "lat", "lon", "value",
        utc.alias("ts_utc"), (utc + F.expr("interval 9 hours")).alias("ts_local"),
    )
    rows = rows.withColumn("storage_year", F.year(F.col("ts_local") - F.expr("interval 1 hour")))
    G.write_grid(rows, str(tmp_path / "h"), "hourly")
    grid = G.read_grid(spark, str(tmp_path / "h"), "hourly")
    box = mesh.Box(POINT[0], POINT[0], POINT[1], POINT[1])
    got = G.scan_hourly(grid, "TMP", HourRange.of("2022-12-31", "2022-12-31"), box).collect()
    assert [(r.ts_local, r.value) for r in got] == [(dt.datetime(2023, 1, 1, 0), 0.2)]
    got = G.scan_hourly(grid, "TMP", HourRange.of("2023-01-01T01", "2023-01-01T01"), box, squeeze=True).collect()
    assert [r.asDict() for r in got] == [{"element": "TMP", "mesh_code": got[0].mesh_code, "value": 0.4}]


def test_scenario_and_static_scans(spark, daily):
    box = mesh.Box(35.9, 36.05, 139.9, 140.1)
    scenario = daily.drop("kind").withColumns({"model": F.lit("MIROC5"), "scenario": F.lit("RCP8.5")})
    days = DayRange.of("2015-12-31", "2016-01-01")
    assert G.scan_scenario(scenario, "RH", days, box, "MIROC5", "RCP8.5").count() > 0
    assert G.scan_scenario(scenario, "RH", days, box, "MIROC5", "RCP2.6").count() == 0
    assert G.scan_scenario(scenario, "RH", days, box, "MIROC5", "RCP8.5", by_area=True).count() > 0
    static = daily.where("date = date'2016-01-01'").select("element", "tile", "mesh_code", "lat", "lon", "value")
    assert "date" not in G.scan_static(static, "RH", box).columns
    assert G.scan_static(static, "RH", mesh.Box(36.0, 36.0, 140.0, 140.0), squeeze=True).columns == ["element", "mesh_code", "value"]


def test_extract_turns_fill_into_missing(spark):
    df = spark.createDataFrame([("A", 35.0, 135.0, -999.0), ("A", 35.1, 135.0, 2.0)], "element string, lat double, lon double, value double")
    got = G.extract_cells(df, "A", mesh.Box(34.0, 36.0, 134.0, 136.0), fill=-999.0)
    assert sorted(r.value or -1 for r in got.collect()) == [-1, 2.0]


def test_merge_pieces(spark):
    schema = "element string, mesh_code string, ts int, value double"
    a = spark.createDataFrame([("A", "1", 1, 5.0), ("A", "1", 2, None), ("A", "1", 4, math.nan)], schema)
    b = spark.createDataFrame([("A", "1", 1, 5.0), ("A", "1", 2, 7.0), ("A", "1", 3, 8.0)], schema)
    assert {r.ts: r.value for r in G.merge_pieces([a, b]).collect()} == {1: 5.0, 2: 7.0, 3: 8.0, 4: None}
    clash = spark.createDataFrame([("A", "1", 1, 6.0)], schema)
    with pytest.raises(PySparkException, match="conflicting values for A 1 1"):
        G.merge_pieces([a, clash]).collect()


def test_union_by_name_keeps_duplicates(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([("y", 1), ("y", 1)], "b string, k int")
    got = G.union_by_name(a, b)
    assert got.columns == ["k", "a", "b"] and got.count() == 3


def test_tiles_are_listed_beside_the_table(spark, daily, tmp_path):
    path = str(tmp_path / "grid")
    G.write_grid(daily.where("tile <> '5440' and element = 'RH'"), path, "daily")
    assert {r.tile for r in G.read_tiles(spark, path).collect()} == {"5339", "5340", "5439"}
    G.write_grid(daily.where("tile = '5440' and element = 'RH'"), path, "daily", mode="append")
    asked = spark.createDataFrame([("5440",), ("5441",)], "tile string")
    assert [r.tile for r in mesh.listed_tiles(asked, G.read_tiles(spark, path)).collect()] == ["5440"]


@pytest.mark.parametrize(("lat", "lon"), [(35.97, 139.97), (36.0, 140.0), (36.4, 139.2), (20.0, 120.0)])
def test_nearest_coordinate_reads_the_tiles_around_it(daily, lat, lon):
    """Inside the grid, on a tile corner, beside the grid and far from it: the same cells as without tiles."""
    days = DayRange.of("2016-01-01", "2016-01-01")
    got = G.extract_cells(daily, "RH", mesh.Box(lat, lat, lon, lon), -1.0, days, kind="observed")
    want = G.extract_cells(daily.drop("tile"), "RH", mesh.Box(lat, lat, lon, lon), -1.0, days, kind="observed")
    assert [r.mesh_code for r in got.collect()] == [r.mesh_code for r in want.collect()]
    assert got.count() == 1
    if lat > 30:
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "substring(block" in plan[plan.index("PartitionFilters") :] and "ubquery" not in plan
