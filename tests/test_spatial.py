import datetime as dt
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from harvestgrid.functions import mesh
from harvestgrid.operators import anomaly, nearest, spatial
from harvestgrid.sources.grids import with_cell, write_bucketed


def site_grid(spark):
    days = F.explode(F.array(*[F.lit(dt.date.fromisoformat(x)) for x in ("2016-03-31", "2016-04-01", "2017-03-24", "2017-03-25")]))
    points = spark.createDataFrame([(36.0566, 140.125), (35.0, 135.0)], "lat double, lon double")
    rows = with_cell(points).withColumn("date", days).withColumn("element", F.explode(F.array(F.lit("TMP_mea"), F.lit("RH"))))
    value = F.when((F.col("element") == "RH") & (F.month("date") == 3), None).otherwise(F.dayofyear("date").cast("double"))
    return rows.withColumns({"kind": F.lit("observed"), "year": F.year("date"), "value": value})


def test_sites_take_their_cell_and_season(spark):
    sites = spark.createDataFrame(
        [("C01", 2016, 36.0566, 140.125), ("C02", 2016, 36.0567, 140.126), ("C03", 2015, 35.0, 135.0), ("C04", 2016, 1.0, 1.0)],
        "place string, year int, lat double, lon double",
    )
    got = spatial.site_weather(site_grid(spark), sites, ["TMP_mea", "RH"])
    rows = {(r.place, r.date.isoformat()): (r.TMP_mea, r.RH) for r in got.collect()}
    assert rows == {(p, d): v for p in ("C01", "C02") for d, v in (("2016-04-01", (92.0, 92.0)), ("2017-03-24", (83.0, None)))}
    assert got.columns == ["year", "place", "date", "TMP_mea", "RH"]


def test_mesh_pivot(spark):
    schema = "mesh_code string, lat double, lon double, t int, value double"
    rows = [("a", 1.0, 1.0, 1, 5.0), ("a", 1.0, 1.0, 2, 9.96921e36), ("b", 2.0, 1.0, 1, None), ("b", 2.0, 1.0, 2, math.nan)]
    df = spark.createDataFrame(rows, schema)
    kept = spatial.mesh_pivot(df, "t", [1, 2])
    assert [tuple(r) for r in kept.collect()] == [("a", 5.0, None)]
    full = spatial.south_first(spatial.mesh_pivot(df, "t", [2, 1], with_centre=True, drop_missing=False))
    assert [tuple(r) for r in full.collect()] == [("a", 1.0, 1.0, None, 5.0), ("b", 2.0, 1.0, None, None)]
    assert full.columns == ["mesh_code", "lat", "lon", "2", "1"]


@pytest.mark.parametrize("count, slots", [(1, 64), (30, 7), (64, 64), (65, 64), (8784, 64)])
def test_series_of_any_number_of_steps(spark, count, slots):
    cells = spark.range(5).select(F.concat(F.lit("c"), "id").alias("mesh_code"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("t"))
    df = cells.withColumn("value", F.when(F.pmod(F.xxhash64("mesh_code", "t"), F.lit(3)) > 0, F.col("t") + 0.5))
    df = df.unionByName(df.where("t = 0").withColumn("t", F.lit(-1))).where("mesh_code <> 'c4' OR t < 0")
    want = {}
    for r in df.where("t >= 0").collect():
        want.setdefault(r.mesh_code, [None] * count)[r.t] = r.value
    for drop in (True, False):
        series = spatial.mesh_series(df, "t", list(range(count)), drop_missing=drop, slots=slots)
        got = {r.mesh_code: r["values"] for r in series.collect()}
        kept = {k: v for k, v in want.items() if any(x is not None for x in v)}
        assert got == (kept if drop else {**want, "c4": [None] * count})


def test_series_plan_does_not_grow_with_the_steps(spark):
    df = spark.range(10).selectExpr("cast(id AS string) AS mesh_code", "cast(id AS int) AS t", "1.0D AS value").repartition(2)
    plans = [spatial.mesh_series(df, "t", list(range(n)))._jdf.queryExecution().optimizedPlan().toString() for n in (128, 8784)]
    sizes = [len([line for line in p.splitlines() if "LocalRelation" not in line]) for p in plans]
    assert sizes[0] == sizes[1] and plans[1].count("max(") <= 2 * spatial.SLOTS


def test_lines_of_the_wide_table(spark):
    series = spark.createDataFrame([("a", [1.5, None]), ("b", [None, 2.0])], "mesh_code string, values array<double>")
    header, lines = spatial.mesh_lines(series, ["x", "y"], ";")
    assert header == "mesh_code;x;y" and [r.value for r in lines.collect()] == ["a;1.5;", "b;;2.0"]


@pytest.mark.parametrize("hot", [False, True])
def test_bucketed_grid_is_not_shuffled_for_its_sites(spark, tmp_path, hot):
    cells = spark.range(60).select((F.lit(35.004) + F.col("id") / 100).alias("lat"), F.lit(139.3).alias("lon"))
    grid = (
        with_cell(cells)
        .withColumn("date", F.explode(F.expr("sequence(date'2015-04-01', date'2015-04-05')")))
        .withColumn("element", F.explode(F.array(F.lit("RH"), F.lit("SD"))))
        .withColumns({"kind": F.lit("observed"), "year": F.year("date"), "value": F.dayofmonth("date") + F.col("lat")})
    )
    name = f"bucketed_{'hot' if hot else 'even'}"
    write_bucketed(grid, name, "daily", 4, str(tmp_path / name))
    sites = spark.range(300).select(
        F.concat(F.lit("s"), "id").alias("place"), (F.lit(2014) + F.col("id") % 2).cast("int").alias("year"),
        (F.lit(35.004) + (F.lit(7) if hot else F.col("id") % 70) / 100).alias("lat"), F.lit(139.3).alias("lon"),
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = spatial.site_weather(spark.table(name), sites, ["RH", "SD"], broadcast_rows=0)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = sorted(tuple(r) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted(tuple(r) for r in spatial.site_weather(grid, sites, ["RH", "SD"]).collect()) and got
    plan = plan.split("== Initial Plan ==")[-1]
    # Each scan of the grid reaches its join without an exchange: those that there are stand above the sites' scans.
    lines = plan.splitlines()
    scans = [k for k, line in enumerate(lines) if "Scan parquet" in line and name in line]
    for k in scans:
        above = []
        depth = len(lines[k]) - len(lines[k].lstrip(" :+-"))
        for line in reversed(lines[:k]):
            here = len(line) - len(line.lstrip(" :+-"))
            if here < depth:
                above.append(line)
                depth = here
        assert not any("Exchange" in line for line in above), plan
    assert scans
    spark.sql(f"DROP TABLE {name}")


def lattice(spark, rows, columns):
    lat = [36 + (i + 0.5) / 120 for i in range(rows)]
    lon = [140 + (i + 0.5) / 80 for i in range(columns)]
    return spark.createDataFrame([("L", a, b, a + b) for a in lat for b in lon], "layer string, lat double, lon double, value double")


def test_raster(spark):
    got = spatial.raster_cells(lattice(spark, 3, 4), "layer").collect()
    assert {(r.row, r.column) for r in got} == {(i, j) for i in range(3) for j in range(4)}
    top = next(r for r in got if (r.row, r.column) == (0, 0))
    assert top.value == pytest.approx(36 + 2.5 / 120 + 140 + 0.5 / 80)
    assert (top.height, top.width) == (3, 4)
    assert (top.west, top.south, top.east, top.north) == pytest.approx((140.0, 36.0, 140.05, 36.025))
    flat = spatial.raster_cells(lattice(spark, 1, 4), "layer").head()
    assert flat.pixel_y is None and flat.north is None and flat.pixel_x == pytest.approx(1 / 80)


def test_extent(spark):
    r = spatial.extent(lattice(spark, 3, 4)).head()
    assert (r.count_lat, r.count_lon) == (3, 4)
    assert (r.step_lat, r.step_lon, r.lower_lat, r.upper_lon) == pytest.approx((1 / 120, 1 / 80, 36.0, 140.05))
    assert spatial.extent(lattice(spark, 1, 1)).head().step_lat is None


def test_map_classes(spark):
    df = spark.createDataFrame([("a", 36.0, 140.0, v) for v in (0.0, 4.9, 5.0, 10.0, None, -1.0, 11.0)], "mesh_code string, lat double, lon double, value double")
    got = {r.value: r.value_class for r in spatial.map_cells(df, 2, (0.0, 10.0)).collect()}
    assert got == {0.0: 1, 4.9: 1, 5.0: 2, 10.0: 2, None: None, -1.0: 0, 11.0: 3}
    constant = spatial.map_cells(df.where("value = 5.0"), 4).head()
    assert constant.value_class == 4
    days = df.limit(1).withColumn("value", F.lit(dt.date(2018, 8, 27)))
    assert spatial.map_cells(days, limits=(dt.date(2018, 8, 25), dt.date(2018, 9, 5))).head().value_class == 2


def test_areas(spark):
    boxes = spark.createDataFrame([(35.0, 36.0, 136.0, 137.0), (0.0, 1.0, 0.0, 1.0)], "south double, north double, west double, east double")
    assert [r.area_num for r in spatial.with_area(boxes).orderBy("south").collect()] == [None, 3]
    with pytest.raises(PySparkException, match="no area holds"):
        spatial.require_area(boxes).collect()


def test_anomalies(spark):
    schema = "element string, mesh_code string, date date, value double"
    day = [dt.date(2024, 1, i) for i in range(1, 6)]
    obs = spark.createDataFrame([("T", "1", day[0], 5.0), ("T", "1", day[1], 4.0), ("T", "1", day[2], None), ("T", "1", day[3], 1.0)], schema)
    normal = spark.createDataFrame([("T", "1", day[0], 5.0), ("T", "1", day[1], 5.0), ("T", "1", day[2], 5.0), ("T", "1", day[4], 1.0)], schema)
    got = {r.date: (r.sign, r.is_today) for r in anomaly.anomalies(anomaly.observed_and_normal(obs, normal), day[1]).collect()}
    assert got == {day[0]: (0, False), day[1]: (-1, True), day[2]: (None, False)}
    assert anomaly.date_table(anomaly.observed_and_normal(obs, normal)).columns == ["Date", "Normal", "Obs."]


def brute_force(points, places):
    lat1, lon1 = np.radians(points[:, :1]), np.radians(points[:, 1:2])
    lat2, lon2 = np.radians(places[:, 0])[None], np.radians(places[:, 1])[None]
    h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    return 2 * nearest.EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(h, 1)))


@pytest.mark.parametrize("case", ["city beside empty land", "date line and poles"])
def test_nearest_place_equals_brute_force(spark, case):
    rng = np.random.default_rng(11)
    if case.startswith("city"):
        places = np.r_[rng.normal((35.6, 139.7), 0.01, (400, 2)), rng.uniform((20, 120), (50, 150), (40, 2))]
        points = np.r_[rng.normal((35.6, 139.7), 0.03, (150, 2)), rng.uniform((15, 110), (55, 160), (150, 2))]
    else:
        places = np.c_[rng.uniform(-90, 90, 60), rng.uniform(175, 185, 60)]
        points = np.c_[rng.uniform(-90, 90, 200), rng.uniform(170, 190, 200)]
        places[:, 1] = (places[:, 1] + 180) % 360 - 180
        points[:, 1] = (points[:, 1] + 180) % 360 - 180
    gazetteer = spark.createDataFrame(
        [(i, f"n{i}", f"p{i % 7}", float(a), float(b)) for i, (a, b) in enumerate(places)],
        "place_id long, name string, admin1 string, lat double, lon double",
    )
    asked = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "k int, lat double, lon double")
    got = {r.k: r for r in nearest.nearest_place(asked, gazetteer, per_cell=8).collect()}
    distances = brute_force(points, places)
    assert len(got) == len(points)
    for k, row in enumerate(distances):
        assert got[k].distance_m == pytest.approx(row.min(), abs=0.01)
        assert row[int(got[k].city[1:])] == pytest.approx(row.min(), abs=0.01)


def test_nearest_place_edges(spark):
    gazetteer = spark.createDataFrame(
        [(5, "east", "a", 0.0, 11.0), (3, "west", "b", 0.0, 9.0), (7, "copy", "c", 0.0, 9.0), (8, "nowhere", "d", None, 1.0)],
        "place_id long, name string, admin1 string, lat double, lon double",
    )
    points = spark.createDataFrame([(1, 0.0, 9.0), (2, 0.0, 10.0), (3, 0.0, 10.0), (4, None, 10.0), (5, 60.0, -171.0)], "k int, lat double, lon double")
    got = {r.k: (r.city, r.prefecture, r.distance_m) for r in nearest.nearest_place(points, gazetteer).collect()}
    assert got[1] == ("west", "b", 0.0)
    assert got[2][:2] == got[3][:2] == ("west", "b")  # equally far: the lower id
    assert got[4] == (None, None, None)
    assert got[5][0] == "east"
    empty = nearest.nearest_place(points, gazetteer.limit(0)).collect()
    assert len(empty) == 5 and {r.city for r in empty} == {None}


def test_many_points_in_one_spot_and_a_shuffled_lookup(spark, monkeypatch):
    """Copies of a point are searched once; the same answers come without broadcasts."""
    monkeypatch.setattr(nearest, "BROADCAST_ROWS", 0)
    gazetteer = spark.range(300).select(
        F.col("id").alias("place_id"), F.concat(F.lit("n"), F.col("id")).alias("name"), F.lit("p").alias("admin1"),
        (F.lit(35.0) + F.col("id") / 3000).alias("lat"), (F.lit(139.0) + (F.col("id") % 17) / 100).alias("lon"),
    )
    spot = F.when(F.col("id") % 3 == 0, 35.05).otherwise(F.lit(35.0) + F.col("id") / 9000)
    points = spark.range(900).select(F.col("id").alias("k"), spot.alias("lat"), F.lit(139.05).alias("lon"))
    found = nearest.nearest_place(points, gazetteer, per_cell=8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    rows = found.orderBy("k").collect()
    places = np.array([(r.lat, r.lon) for r in gazetteer.orderBy("place_id").collect()])
    distances = brute_force(np.array([(r.lat, r.lon) for r in rows]), places)
    for r, row in zip(rows, distances):
        assert r.distance_m == pytest.approx(row.min(), abs=0.01)
        assert row[int(r.city[1:])] == pytest.approx(row.min(), abs=0.01)


def test_site_weather_with_shuffled_sites(spark, monkeypatch):
    sites = spark.createDataFrame(
        [("C01", 2016, 36.0566, 140.125), ("C02", 2016, 36.0567, 140.126)], "place string, year int, lat double, lon double"
    )
    few = spatial.site_weather(site_grid(spark), sites, ["TMP_mea", "RH"]).collect()
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", 0)
    many = spatial.site_weather(site_grid(spark), sites, ["TMP_mea", "RH"]).collect()
    assert sorted(map(str, few)) == sorted(map(str, many)) and len(few) == 4


def test_coarse_levels_are_broadcast_and_equal_distances_stay_open(spark, monkeypatch):
    """Many places equally far from one point, a point with clashing columns, and no shuffle of the coarse levels."""
    monkeypatch.setattr(nearest, "BROADCAST_ROWS", 0)
    angle = F.radians(F.col("id") * 3.0)
    ring = spark.range(120).select(
        F.col("id").alias("place_id"), F.concat(F.lit("n"), F.col("id")).alias("name"), F.lit("p").alias("admin1"),
        (F.sin(angle) * 0.5).alias("lat"), (F.cos(angle) * 0.5).alias("lon"),
    )
    points = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 0.4, 0.3, "b")], "key int, lat double, lon double, name string")
    found = nearest.nearest_place(points, ring, per_cell=60)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= nearest.COARSE_LEVELS
    rows = {r.key: r for r in found.collect()}
    distances = brute_force(np.array([(0.0, 0.0), (0.4, 0.3)]), np.array([(r.lat, r.lon) for r in ring.orderBy("place_id").collect()]))
    for key, row in ((1, distances[0]), (2, distances[1])):
        assert rows[key].distance_m == pytest.approx(row.min(), abs=0.01)
    assert rows[1].name == "a" and rows[2].city == f"n{int(distances[1].argmin())}"
