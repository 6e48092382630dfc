import math
import random

import pytest
from pyspark.sql import functions as F

from harvestgrid.functions import mesh


def digits_one_by_one(lat, lon):
    """The standard's definition, digit by digit."""
    out = []
    for scaled in (lat * 1.5, lon - 100):
        tile = math.floor(scaled)
        rest = 8 * (scaled - tile)
        block = math.floor(rest)
        out.append((tile, block, math.floor(10 * (rest - block))))
    return out


def points():
    rng = random.Random(5)
    for _ in range(3000):
        yield rng.uniform(20, 50), rng.uniform(120, 150)
        yield rng.randint(2400, 6000) / 120, rng.randint(9600, 12000) / 80
        yield round(rng.uniform(20, 50), 2), round(rng.uniform(120, 150), 2)


def test_codes_equal_the_digit_definition(spark):
    pts = list(points())
    df = spark.createDataFrame(pts, "lat double, lon double")
    lat, lon = F.col("lat"), F.col("lon")
    rows = df.select("lat", "lon", mesh.mesh_code(lat, lon).alias("c"), mesh.tile_code(lat, lon).alias("t")).collect()
    for r in rows:
        (p, q, a), (u, v, b) = digits_one_by_one(r.lat, r.lon)
        assert r.c == f"{p}{u}{q}{v}{a}{b}"
        assert r.t == f"{p}{u}"
        assert mesh.row_value(r.lat) == p * 80 + q * 10 + a


def test_centre_gives_the_same_code_back(spark):
    df = spark.createDataFrame(list(points()), "lat double, lon double")
    code = mesh.mesh_code(F.col("lat"), F.col("lon"))
    df = df.select(code.alias("c")).distinct()
    lat, lon = mesh.mesh_latitude(F.col("c")), mesh.mesh_longitude(F.col("c"))
    assert df.where(mesh.mesh_code(lat, lon) != F.col("c")).count() == 0
    centre = df.select(lat.alias("a"), mesh.row_centre(mesh.cell_row(lat)).alias("b"))
    assert centre.where(F.abs(F.col("a") - F.col("b")) > 1e-12).count() == 0


def test_points_off_the_standard_have_no_code(spark):
    rows = [(6.6, 140.0), (66.7, 140.0), (35.0, 109.9), (35.0, None), (float("nan"), 140.0)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    assert df.where(mesh.mesh_code(F.col("lat"), F.col("lon")).isNotNull()).count() == 0
    assert df.where(mesh.tile_code(F.col("lat"), F.col("lon")).isNotNull()).count() == 0


def test_code_of_wrong_length(spark):
    df = spark.createDataFrame([("5339452",), ("533945212",), (None,)], "c string")
    assert df.where(mesh.mesh_latitude(F.col("c")).isNotNull() | mesh.mesh_longitude(F.col("c")).isNotNull()).count() == 0


def test_known_code(spark):
    r = spark.range(1).select(
        mesh.mesh_code(F.lit(36.0566), F.lit(140.125)).alias("c"), mesh.mesh_latitude(F.lit("54400160")).alias("lat")
    ).head()
    assert r.c == "54400160"
    assert r.lat == pytest.approx(36.0 + 6 / 120 + 1 / 240)


@pytest.mark.parametrize(
    "bounds, tiles",
    [
        ((36.0566, 36.0566, 140.125, 140.125), ["5440"]),
        ((36.0, 36.0, 140.0, 140.0), ["5440"]),
        ((35.5, 36.0, 139.5, 140.0), ["5339"]),
        ((35.5, 36.1, 139.5, 140.5), ["5339", "5340", "5439", "5440"]),
    ],
)
def test_tiles_of_a_box(spark, bounds, tiles):
    box = mesh.Box(*bounds)
    assert box.tiles() == tiles
    column = spark.range(1).select(mesh.tiles_of_box(*[F.lit(b) for b in bounds]).alias("t")).head().t
    assert column == tiles


def test_point_box_is_one_cell():
    box = mesh.Box(36.0566, 36.0566, 140.125, 140.125)
    assert box.rows()[0] == box.rows()[1] and box.columns()[0] == box.columns()[1]
    edge = mesh.Box(36.0, 36.0, 140.0, 140.0)
    assert edge.rows() == (54 * 80, 54 * 80) and edge.columns() == (3200, 3200)


def test_northern_bound_on_a_tile_edge_adds_no_row():
    assert mesh.Box(35.5, 36.0, 139.5, 140.0).rows()[1] == 54 * 80 - 1
    assert mesh.Box(35.5, 36.0, 139.5, 140.0).columns()[1] == 40 * 80 - 1


def test_box_validation():
    for bad in ((36, 35, 140, 141), (35, 36, 141, 140)):
        with pytest.raises(ValueError):
            mesh.Box(*bad)
    with pytest.raises(ValueError):
        mesh.Box(35, 36, 140, 141, area="Area9")
    with pytest.raises(ValueError):
        mesh.Box(10, 11, 140, 141).find_area()


def test_area_cell_counts():
    assert [a.last_row_offset for a in mesh.AREAS] == [799, 879, 799, 479, 799, 799]
    assert [a.last_column_offset for a in mesh.AREAS] == [559, 479, 559, 639, 399, 799]


def test_first_area_wins(spark):
    cases = [
        ((40.0, 41.0, 140.0, 141.0), 1),
        ((35.0, 36.0, 136.0, 137.0), 3),
        ((24.0, 88 / 3, 122.0, 132.0), 6),
        ((32.0, 33.0, 130.0, 137.0), None),
    ]
    for bounds, number in cases:
        got = spark.range(1).select(mesh.area_number(*[F.lit(b) for b in bounds]).alias("n")).head().n
        assert got == number
        if number:
            assert mesh.Box(*bounds).find_area().num == number
        else:
            with pytest.raises(ValueError):
                mesh.Box(*bounds).find_area()


def test_area_offsets(spark):
    kanto = mesh.AREAS[2]
    box = mesh.Box(31.0, 33.0, 135.5, 150.0)
    rows, columns = box.within(kanto)
    assert rows == (kanto.first_row, kanto.first_row + 120)
    assert columns == (kanto.first_column + 40, kanto.first_column + 559)
    r = spark.range(1).select(
        mesh.area_row_offset(F.lit(31.0), kanto, False).alias("a"),
        mesh.area_row_offset(F.lit(33.0), kanto, True).alias("b"),
        mesh.area_column_offset(F.lit(135.5), kanto, False).alias("c"),
        mesh.area_column_offset(F.lit(150.0), kanto, True).alias("d"),
    ).head()
    assert tuple(r) == (0, 120, 40, 559)


def test_tile_offsets_are_clamped(spark):
    r = spark.range(1).select(
        mesh.tile_row_offset(F.lit(36.0), F.lit("5339"), True).alias("a"),
        mesh.tile_row_offset(F.lit(40.0), F.lit("5339"), True).alias("b"),
        mesh.tile_row_offset(F.lit(30.0), F.lit("5339"), False).alias("c"),
        mesh.tile_row_offset(F.lit(35.5), F.lit("5339"), False).alias("d"),
        mesh.tile_column_offset(F.lit(139.5), F.lit("5339"), False).alias("e"),
    ).head()
    assert tuple(r) == (79, 79, 0, 20, 40)


def test_nearest_coordinate_tie_takes_the_lower(spark):
    df = spark.createDataFrame([(1.0, 10.0), (3.0, 10.0), (5.0, 20.0)], "lat double, lon double")
    assert mesh.nearest_coordinate(df, "lat", 2.0).head().lat == 1.0
    got = mesh.in_centre_box(df, "lat", "lon", mesh.Box(2.0, 2.0, 0.0, 15.0)).collect()
    assert [tuple(r) for r in got] == [(1.0, 10.0)]


def test_axis(spark):
    r = spark.range(1).select(
        mesh.axis_rows(F.lit(36.0), F.lit(36.02)).alias("a"),
        mesh.axis_columns(F.lit(140.0), F.lit(140.0)).alias("b"),
    ).head()
    assert r.a == pytest.approx([36 + 0.5 / 120, 36 + 1.5 / 120, 36 + 2.5 / 120])
    assert r.b is None


def test_mercator(spark):
    r = spark.range(1).select(mesh.mercator_x(F.lit(139.7)).alias("x"), mesh.mercator_y(F.lit(35.6)).alias("y")).head()
    assert r.x == pytest.approx(6378137 * math.radians(139.7))
    assert r.y == pytest.approx(6378137 * math.asinh(math.tan(math.radians(35.6))), rel=1e-12)
