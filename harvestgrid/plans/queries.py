"""The registered queries: each runs library operators over whole given tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestgrid.functions import mesh
from harvestgrid.functions import timegrid as tg
from harvestgrid.functions.numeric import label, nearest_int, round_even
from harvestgrid.operators import anomaly as an
from harvestgrid.operators import merge
from harvestgrid.operators import panel as P
from harvestgrid.operators import quality as ql
from harvestgrid.operators import sequences as Q
from harvestgrid.operators import spatial as sp
from harvestgrid.operators.metrics import regression_metrics, weighted_loss
from harvestgrid.operators.nearest import nearest_place as nearest
from harvestgrid.operators.rows import first_rows, shuffled
from harvestgrid.plans import standins as S
from harvestgrid.plans import joint_model as J
from harvestgrid.plans import yield_model as M
from harvestgrid.plans.jobs import stored, train_and_score
from harvestgrid.session import new_table_path
from harvestgrid.sources import grids as G
from harvestgrid.sources import sinks
from harvestgrid.sources.tables import read_panel, read_sheet, read_table
from harvestgrid.sources.text import decode_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BOX = mesh.Box(30.0, 36.0, 125.0, 140.5)


def _query(function: Query) -> Query:
    """Register a query; whole numbers leave it as BIGINT."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = function(spark, sf_dir)
        whole = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegerType, T.ShortType))]
        return df.withColumns({c: F.col(f"`{c}`").cast("long") for c in whole})

    QUERIES[function.__name__] = run
    return run


def _r(value: Column | str, digits: int = 6) -> Column:
    """Rounded, and never negative zero."""
    return F.round(value, digits) + F.lit(0.0)


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.prepare_panel(S.panel(spark, sf_dir), S.CUT_YEAR)


# --- panel and sequences ------------------------------------------------------------------------


@_query
def panel_zscore(spark, sf_dir):
    z = [_r(F.element_at("features", i)).alias(f"z{i}") for i in (1, 2, 3, 4)]
    return _prepared(spark, sf_dir).select("loc_id", "year", "yield", *z)


@_query
def vec_zscore(spark, sf_dir):
    vectors = S.vector_panel(spark, sf_dir)
    scaled = P.standardise(vectors, P.feature_stats(vectors, S.CUT_YEAR))
    long = scaled.select("src_order", "loc_id", "year", F.posexplode("features").alias("pos", "z"))
    return long.withColumns({"pos": F.col("pos") + 1, "z": _r("z")})


@_query
def year_stats(spark, sf_dir):
    scalars = P.year_scalars(_prepared(spark, sf_dir), S.HOLDOUT_YEAR + 1)
    return scalars.select("year", _r("avg_yield").alias("avg_yield"), _r("ybar").alias("ybar"))


def _long_panel_steps(sequences: DataFrame, digits: int | None) -> DataFrame:
    def first(group, i):
        return _r(F.element_at(group, i))

    steps = Q.long_steps(sequences)
    return steps.select(
        "loc_id", "last_year", "step", "year",
        first("e", 1).alias("e1"), first("e", 2).alias("e2"), first("s", 1).alias("s1"), first("p", 1).alias("p1"),
        _r("ybar").alias("ybar"),
        (_r("step_yield", digits) if digits else F.col("step_yield")).alias("step_yield"),
        "y_last",
    )


def _stored_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prepared panel; the raw one is stored too, as its statistics take two passes before the one that scales it."""
    return stored(P.prepare_panel(stored(S.panel(spark, sf_dir), "panel"), S.CUT_YEAR), "prepared_panel")


def _training(prepared: DataFrame) -> DataFrame:
    return Q.training_sequences(prepared, P.year_scalars(prepared, S.HOLDOUT_YEAR), S.HOLDOUT_YEAR, S.PANEL_SIZES)


def _holdout(prepared: DataFrame) -> DataFrame:
    scalars = P.year_scalars(prepared, S.HOLDOUT_YEAR)
    means = P.mean_year_steps(prepared, scalars, S.MEAN_YEARS, sum(S.PANEL_SIZES))
    return Q.holdout_sequences(prepared, scalars, means, S.HOLDOUT_YEAR, S.PANEL_SIZES)


@_query
def train_sequences(spark, sf_dir):
    return _long_panel_steps(_training(_stored_panel(spark, sf_dir)), None)


@_query
def holdout_sequences(spark, sf_dir):
    return _long_panel_steps(_holdout(_stored_panel(spark, sf_dir)), 6)


@_query
def dedupe_last(spark, sf_dir):
    last = P.keep_last(S.vector_panel(spark, sf_dir), "src_order")
    return last.select("loc_id", "year", "yield", F.posexplode("features").alias("entry", "feature"))


@_query
def feature_groups(spark, sf_dir):
    groups = Q.feature_groups(F.col("features"), S.VECTOR_SIZES)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("entries")) for n, c in groups.items()])).alias("g")
    rows = S.vector_panel(spark, sf_dir).select("src_order", each)
    return rows.select("src_order", F.col("g.name").alias("feature_group"), F.posexplode("g.entries").alias("entry", "feature"))


@_query
def feature_ablation(spark, sf_dir):
    unique = P.keep_last(S.vector_panel(spark, sf_dir), "src_order")
    scalars = P.year_scalars(unique, S.HOLDOUT_YEAR)
    steps = Q.long_steps(Q.training_sequences(unique, scalars, S.HOLDOUT_YEAR, S.VECTOR_SIZES, keep=("e",)))
    return steps.select(
        "loc_id", "last_year", "step", "year",
        F.element_at("e", 1).alias("e_first"), F.element_at("e", -1).alias("e_last"), F.size("e").alias("e_size"),
        _r("ybar").alias("ybar"), "step_yield", "y_last",
    )


@_query
def weekly_reshape(spark, sf_dir):
    e = Q.feature_groups(F.col("features"), S.VECTOR_SIZES)["e"]
    rows = S.vector_panel(spark, sf_dir).select("src_order", F.posexplode(Q.reshape(e, 4, 13)).alias("pos", "weekly"))
    return rows.select(
        "src_order", (F.col("pos") + 1).alias("variable"), F.posexplode("weekly").alias("week", "feature")
    )


@_query
def keyed_lookup(spark, sf_dir):
    panel = _prepared(spark, sf_dir).select("loc_id", "year", "yield")
    following = panel.select("loc_id", (F.col("year") - 1).alias("year"), F.col("yield").alias("next_yield"))
    held = panel.where(F.col("year") == S.HOLDOUT_YEAR)
    return Q.with_existing_key(Q.keyed_lookup(panel, following), held, ["loc_id"])


@_query
def rows_per_year(spark, sf_dir):
    return P.rows_per_year(_prepared(spark, sf_dir))


@_query
def distinct_years(spark, sf_dir):
    return P.distinct_years(S.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")))


@_query
def panel_csv_load(spark, sf_dir):
    """The raw panel written as a wide CSV and read back; missing features stay missing."""
    path = new_table_path(spark, "panel_csv")
    wide = S.panel(spark, sf_dir)
    features = [F.element_at("features", i).alias(f"f{i}") for i in (1, 2, 3, 4)]
    sinks.write_csv(wide.select("loc_id", "year", "yield", *features), path)
    back = P.keep_last(read_panel(spark, path, feature_count=4), "src_order")
    return back.select("loc_id", "year", "yield", *features)


# --- completeness -------------------------------------------------------------------------------

_RECORD = ("record_id", "place", "year", "lat", "lon")


@_query
def complete_records(spark, sf_dir):
    return ql.complete_records(S.field_records(spark, sf_dir), select=_RECORD)


@_query
def complete_blank(spark, sf_dir):
    return ql.complete_records(S.field_records(spark, sf_dir), ql.COMPLETE_AFTER_BLANKS, blank_is_missing=True, select=_RECORD)


@_query
def null_profile(spark, sf_dir):
    return ql.null_profile(S.field_records(spark, sf_dir))


@_query
def merge_drifted(spark, sf_dir):
    """Two overlapping halves of the grid without cell codes, the later one's coordinates off by some 1e-6 degrees."""
    grid = S.grid_observed(spark, sf_dir).select("element", "lat", "lon", "date", "value")
    early = grid.where(F.col("date") <= dt.date(2024, 1, 20))
    drift = {"lat": F.col("lat") + 1e-6, "lon": F.col("lon") - F.lit(1e-6) * (F.dayofmonth("date") % 3)}
    late = grid.where(F.col("date") >= dt.date(2024, 1, 10)).withColumns(drift)
    steps = (1 / mesh.ROWS_PER_DEGREE, 1 / mesh.COLUMNS_PER_DEGREE)
    return _short(G.merge_on_axes([early, late], steps=steps))


@_query
def sentinel_round_trip(spark, sf_dir):
    wide = S.weather_wide(spark, sf_dir).select("place", "date", "click", "error")
    filled = ql.null_to_sentinel(wide.withColumn("click_filled", F.col("click")), ["click_filled"])
    back = ql.sentinel_to_null(filled.withColumn("click", F.col("click_filled")), ["click"])
    return ql.masked_to_null(back.withColumn("error_masked", F.col("error")), "error_masked", F.col("error") > 50).drop("error")


# --- mesh and time ------------------------------------------------------------------------------


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    far_south = F.when(key % 13 == 0, 20.0).otherwise(0.0)
    return S.table(spark, sf_dir, "customer").select(key, (S.lat_of(key) - far_south).alias("lat"), S.lon_of(key).alias("lon"))


@_query
def mesh_encode(spark, sf_dir):
    lat, lon = F.col("lat"), F.col("lon")
    return _points(spark, sf_dir).select(
        "c_custkey", mesh.mesh_code(lat, lon).alias("mesh_code"), mesh.tile_code(lat, lon).alias("tile"),
        mesh.cell_row(lat).alias("row"), mesh.cell_column(lon).alias("column"),
    )


@_query
def mesh_decode(spark, sf_dir):
    coded = _points(spark, sf_dir).select("c_custkey", mesh.mesh_code(F.col("lat"), F.col("lon")).alias("mesh_code"))
    lat, lon = mesh.mesh_latitude(F.col("mesh_code")), mesh.mesh_longitude(F.col("mesh_code"))
    return coded.where(F.col("mesh_code").isNotNull()).select(
        "c_custkey", "mesh_code", F.round(lat, 9).alias("lat"), F.round(lon, 9).alias("lon"),
        mesh.mesh_code(lat, lon).alias("again"), mesh.mesh_latitude(F.substring("mesh_code", 1, 7)).alias("short_lat"),
    )


@_query
def grid_axis(spark, sf_dir):
    key = F.col("c_custkey")
    boxes = S.table(spark, sf_dir, "customer").select(key.alias("box_id"), S.lat_of(key).alias("s"), S.lon_of(key).alias("w"))
    lats = mesh.axis_rows(F.col("s"), F.col("s") + (F.col("box_id") % 7) * 0.05)
    lons = mesh.axis_columns(F.col("w"), F.col("w") + (F.col("box_id") % 5) * 0.05)
    axes = F.create_map(F.lit("lat"), lats, F.lit("lon"), lons)
    return boxes.select("box_id", F.explode(axes).alias("axis", "centres")).select("box_id", "axis", F.explode("centres").alias("centre"))


@_query
def day_axis(spark, sf_dir):
    orders = S.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    end = F.date_add("d", (F.col("o_orderkey") % 4).cast("int"))
    return orders.select("o_orderkey", F.explode(tg.day_axis(F.col("d"), end)).alias("day"))


@_query
def parse_dates(spark, sf_dir):
    kind = F.col("o_orderkey") % 5
    text = F.when(kind == 4, "no date")
    for i, separator in enumerate(tg.DAY_SEPARATORS):
        text = text.when(kind == i, F.date_format("o_orderdate", f"yyyy{separator}MM{separator}dd"))
    day = tg.parse_day(F.col("text"))
    return S.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).select(
        "o_orderkey", day.alias("day"), tg.day_text(day).alias("day_text")
    )


@_query
def parse_hours(spark, sf_dir):
    kind, day = F.col("event_id") % 6, F.date_format("ts", "yyyy/MM/dd")
    text = (
        F.when(kind == 0, day)
        .when(kind == 1, F.concat(day, F.date_format("ts", "'T'HH")))
        .when(kind == 2, F.concat(day, F.date_format("ts", "'T'HH:mm:ss")))
        .when(kind == 3, F.concat(day, F.lit("T24")))
        .when(kind == 4, F.concat(day, F.lit("T25")))
        .otherwise("no hour")
    )
    return S.table(spark, sf_dir, "events").select("event_id", text.alias("text")).select(
        "event_id", tg.parse_hour(F.col("text")).alias("start_hour"), tg.parse_hour(F.col("text"), is_end=True).alias("end_hour")
    )


@_query
def year_split(spark, sf_dir):
    orders = S.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("s"))
    end = F.date_add("s", (F.col("o_orderkey") % 800).cast("int"))
    return orders.select("o_orderkey", F.explode(tg.year_slices(F.col("s"), end)).alias("y")).select("o_orderkey", "y.*")


def _event_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "events").select("event_id", F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("h"))


@_query
def hourly_year(spark, sf_dir):
    back = F.make_dt_interval(F.lit(0), ((F.col("event_id") % 3) * 8784).cast("int"))
    hour = F.col("h")
    return _event_hours(spark, sf_dir).withColumn("h", hour - back).select(
        "event_id", tg.storage_year(hour).alias("storage_year"), tg.storage_hour(hour).alias("storage_hour"),
        tg.is_leap(F.year("h")).alias("leap"),
    )


@_query
def hour_split(spark, sf_dir):
    ahead = F.make_dt_interval(F.lit(0), ((F.col("event_id") % 30) * 500).cast("int"))
    slices = tg.hour_slices(F.col("h"), F.col("h") + ahead)
    return _event_hours(spark, sf_dir).select("event_id", F.explode(slices).alias("y")).select("event_id", "y.*")


@_query
def local_time(spark, sf_dir):
    events = S.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    local = events.withColumn("ts_local", tg.utc_to_local(F.col("ts"), F.lit("Asia/Tokyo")))
    return local.select(
        "event_id", "ts_local", tg.local_to_utc(F.col("ts_local"), F.lit("Asia/Tokyo")).alias("ts_utc"),
        tg.utc_to_local(F.col("ts"), F.lit(None).cast("string")).alias("no_zone"),
    )


@_query
def round_half_even(spark, sf_dir):
    v = (F.col("o_orderkey") % 801 - 400) / F.lit(8.0)
    return S.table(spark, sf_dir, "orders").select(
        "o_orderkey", v.alias("v"), (round_even(v, 1) + F.lit(0.0)).alias("tenth"), nearest_int(v).alias("whole")
    )


@_query
def season_filter(spark, sf_dir):
    day = F.col("date")
    return S.ship_days(spark, sf_dir).where(tg.season_year(day).isin(1996, 1997, 1998)).select(
        "date", "lines", tg.season_year(day).alias("season_year"), tg.day_of_season(day).alias("season_day"),
        tg.in_season(day, F.lit(1997)).alias("in_1997"),
    )


# --- boxes and areas ----------------------------------------------------------------------------


@_query
def cell_box(spark, sf_dir):
    inside = mesh.in_cell_box(F.col("lat"), F.col("lon"), mesh.Box(30.0, 36.0, 130.0, 140.5))
    return S.grid_static(spark, sf_dir).where(inside).select("element", "mesh_code", "value")


@_query
def centre_box(spark, sf_dir):
    box = mesh.Box(30.0, 36.0, 130.0, 140.5)
    return mesh.in_centre_box(S.grid_static(spark, sf_dir), "lat", "lon", box).select("element", "mesh_code", "value")


@_query
def nearest_coord(spark, sf_dir):
    box = mesh.Box(33.333, 33.333, 122.0, 150.0)
    near = mesh.in_centre_box(S.grid_static(spark, sf_dir), "lat", "lon", box)
    return near.select("element", "mesh_code", F.round("lat", 9).alias("lat"), "value")


@_query
def box_tiles(spark, sf_dir):
    bounds = [F.col(c) for c in ("south", "north", "west", "east")]
    touched = S.boxes(spark, sf_dir).withColumn("tile", F.explode(mesh.tiles_of_box(*bounds)))
    kept = mesh.listed_tiles(touched, S.grid_static(spark, sf_dir))
    tile = F.col("tile")
    return kept.select(
        "box_id", "tile",
        mesh.tile_row_offset(F.col("south"), tile, False).alias("row0"), mesh.tile_row_offset(F.col("north"), tile, True).alias("row1"),
        mesh.tile_column_offset(F.col("west"), tile, False).alias("col0"), mesh.tile_column_offset(F.col("east"), tile, True).alias("col1"),
    )


@_query
def area_lookup(spark, sf_dir):
    kanto = mesh.AREAS[2]
    return sp.with_area(S.boxes(spark, sf_dir)).select(
        "box_id", "area_num", "area_name",
        mesh.area_row_offset(F.col("south"), kanto, False).alias("row0"), mesh.area_row_offset(F.col("north"), kanto, True).alias("row1"),
        mesh.area_column_offset(F.col("west"), kanto, False).alias("col0"), mesh.area_column_offset(F.col("east"), kanto, True).alias("col1"),
    )


# --- grid scans ---------------------------------------------------------------------------------


def _point_of(key: int) -> mesh.Box:
    """The point of a customer or user, as in the stand-in tables."""
    lat, lon = 24.0037 + key * 37 % 2200 / 100, 122.0041 + key * 53 % 2400 / 100
    return mesh.Box(lat, lat, lon, lon)


def _short(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("lat", "lon")})


@_query
def grid_scan_daily(spark, sf_dir):
    days = tg.DayRange.of("2024-01-05", "2024/01/20")
    found = G.scan_daily(S.grid_daily(spark, sf_dir), "click", days, BOX, elements=S.elements(spark, sf_dir))
    return _short(found).withColumn("label", label(F.col("long_name"), F.col("unit")))


@_query
def stored_grid_scan(spark, sf_dir):
    """The static grid written as a partitioned table, then scanned by element, block, tile and box."""
    return _short(G.scan_static(_stored_grid(spark, S.grid_static(spark, sf_dir), "static"), "altitude", BOX))


def _stored_grid(spark: SparkSession, grid: DataFrame, layout: str) -> DataFrame:
    path = new_table_path(spark, f"grid_{layout}")
    G.write_grid(grid, path, layout)
    return G.read_grid(spark, path, layout)


@_query
def stored_daily_scan(spark, sf_dir):
    """The daily grid, observed and normal, written as a partitioned table, then scanned."""
    days = tg.DayRange.of("2024-01-05", "2024-01-20")
    return _short(G.scan_daily(_stored_grid(spark, S.grid_daily(spark, sf_dir), "daily"), "view", days, BOX))


@_query
def stored_hourly_scan(spark, sf_dir):
    """The hourly grid written as a partitioned table, then scanned."""
    hours = tg.HourRange.of("2024-01-03T12:31", "2024-01-21")
    return _short(G.scan_hourly(_stored_grid(spark, S.grid_hourly(spark, sf_dir), "hourly"), "purchase", hours, BOX))


@_query
def co_located_weather(spark, sf_dir):
    """Site weather past the broadcast limit, on a grid bucketed by cell."""
    name = f"grid_{uuid.uuid4().hex}"
    G.write_bucketed(S.grid_observed(spark, sf_dir), name, "daily", 8, new_table_path(spark, name))
    found = stored(sp.site_weather(spark.table(name), S.sites(spark, sf_dir), S.EVENT_TYPES, broadcast_rows=0), "site_weather")
    spark.sql(f"DROP TABLE {name}")
    return found


@_query
def mesh_hours(spark, sf_dir):
    """All 8,784 hours of 2024 in one row per cell, then the hours with a value by their place in the year."""
    first = dt.datetime(2024, 1, 1, 1)
    steps = [first + dt.timedelta(hours=k) for k in range(8784)]
    series = sp.mesh_series(S.grid_hourly(spark, sf_dir).where(F.col("element") == "click"), "ts_local", steps)
    placed = series.select("mesh_code", F.size("values").alias("steps"), F.posexplode("values").alias("hour", "value"))
    return placed.where(F.col("value").isNotNull())


@_query
def grid_scan_point(spark, sf_dir):
    days = tg.DayRange.of("2024-01-01", "2024-01-31")
    return G.scan_daily(S.grid_daily(spark, sf_dir), "view", days, _point_of(7), squeeze=True)


@_query
def grid_scan_normal(spark, sf_dir):
    days = tg.DayRange.of("2024.01.10", "2024 1 25")
    return _short(G.scan_daily(S.grid_daily(spark, sf_dir), "view", days, BOX, kind="normal"))


@_query
def grid_scan_area(spark, sf_dir):
    box = mesh.Box(33.0, 36.5, 131.0, 137.0, area="Area4")
    days = tg.DayRange.of("2024-01-01", "2024-01-31")
    return _short(G.scan_daily(S.grid_daily(spark, sf_dir), "error", days, box, by_area=True))


@_query
def scenario_scan(spark, sf_dir):
    days = tg.DayRange.of("2024-01-05", "2024-01-20")
    return _short(G.scan_scenario(S.grid_scenario(spark, sf_dir), "click", days, BOX, "MIROC5", "RCP8.5"))


@_query
def scenario_scan_area(spark, sf_dir):
    box = mesh.Box(33.0, 36.5, 131.0, 137.0)
    days = tg.DayRange.of("2024-01-01", "2024-01-31")
    return _short(G.scan_scenario(S.grid_scenario(spark, sf_dir), "error", days, box, "MIROC5", "RCP2.6", by_area=True))


@_query
def scenario_scan_point(spark, sf_dir):
    grid, days = S.grid_scenario(spark, sf_dir), tg.DayRange.of("2024-01-01", "2024-01-31")
    return G.scan_scenario(grid, "view", days, _point_of(7), "MIROC5", "RCP8.5", squeeze=True)


@_query
def geo_scan_area(spark, sf_dir):
    return _short(G.scan_static(S.grid_static(spark, sf_dir), "landuse", mesh.Box(33.0, 36.5, 131.0, 137.0), by_area=True))


@_query
def geo_scan_point(spark, sf_dir):
    return G.scan_static(S.grid_static(spark, sf_dir), "altitude", _point_of(7), squeeze=True)


@_query
def hourly_scan_point(spark, sf_dir):
    hours = tg.HourRange.of("2024-01-01", "2024-01-31")
    return G.scan_hourly(S.grid_hourly(spark, sf_dir), "click", hours, _point_of(7), squeeze=True)


@_query
def extract_cells(spark, sf_dir):
    """Cells with their centre in a box; values over 200 stand for the fill value."""
    grid = S.grid_observed(spark, sf_dir).withColumn("value", F.when(F.col("value") > 200, -999.0).otherwise(F.col("value")))
    box, days = mesh.Box(30.0, 36.0, 125.0, 140.5), tg.DayRange.of("2024-01-05", "2024-01-20")
    found = G.extract_cells(grid, "click", box, -999.0, days, S.elements(spark, sf_dir))
    return found.select("element", "mesh_code", "date", "value", "long_name", "unit")


@_query
def geo_scan(spark, sf_dir):
    return _short(G.scan_static(S.grid_static(spark, sf_dir), "altitude", BOX))


@_query
def hourly_scan(spark, sf_dir):
    hours = tg.HourRange.of("2024-01-03T12:31", "2024-01-21")
    return _short(G.scan_hourly(S.grid_hourly(spark, sf_dir), "purchase", hours, BOX))


@_query
def empty_scan(spark, sf_dir):
    days = tg.DayRange.of("1980-01-01", "1980-12-31")
    return G.scan_daily(S.grid_daily(spark, sf_dir), "click", days, BOX)


@_query
def merge_pieces(spark, sf_dir):
    """Two overlapping halves of the grid, one of them with gaps where the other has values."""
    grid = S.grid_observed(spark, sf_dir).select("element", "mesh_code", "date", "value")
    early = grid.where(F.col("date") <= dt.date(2024, 1, 20))
    late = grid.where(F.col("date") >= dt.date(2024, 1, 10))
    gaps = late.withColumn("value", F.when(F.col("date") > dt.date(2024, 1, 20), F.col("value")))
    return G.merge_pieces([early, gaps], ["element", "mesh_code", "date"])


# --- weather tables -----------------------------------------------------------------------------


@_query
def site_weather_wide(spark, sf_dir):
    return sp.site_weather(S.grid_daily(spark, sf_dir), S.sites(spark, sf_dir), S.EVENT_TYPES)


@_query
def union_by_name(spark, sf_dir):
    wide = S.weather_wide(spark, sf_dir)
    return G.union_by_name(wide.select("place", "date", "click", "error"), wide.select("place", "error", "signup", "date"))


@_query
def prefix_rename(spark, sf_dir):
    wide = S.weather_wide(spark, sf_dir).select(
        F.col("click").alias("mean click (degC)"), F.col("error").alias("OPR label (mm)"), F.col("purchase").alias("OPR label ()"),
        "place", "date", "year", F.lit("C").alias("source"),
    )
    return sinks.keys_first(sinks.rename_by_prefix(wide, {"TMP_mea": "mean click", "OPR": "OPR label"}), ["year", "place", "date"])


@_query
def backfill_column(spark, sf_dir):
    wide = S.weather_wide(spark, sf_dir).select(
        "place", "date", (F.lit(2010) + F.col("place") % 15).cast("int").alias("year"),
        F.col("click").alias("OPR"), F.col("error").alias("OPRori"),
    )
    return merge.backfill_column(wide)


@_query
def update_merge(spark, sf_dir):
    """Days moved to March 2024: season 2023 has updates up to 24 March, season 2024 has none yet."""
    season = (F.lit(2023) + F.col("place") % 2).cast("int")
    wide = S.weather(spark, sf_dir).groupBy("place", F.date_add("date", 60).alias("date"), season.alias("year")).agg(
        F.max(F.when(F.col("element") == "click", F.col("value"))).alias("click"), F.max("value").alias("VP")
    )
    counts = S.table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("d")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sheet = counts.select(F.date_add("d", 60).alias("date"), F.when(F.dayofmonth("d") % 5 != 0, F.col("n")).alias("VP"))
    key = F.col("c_custkey")
    targets = S.table(spark, sf_dir, "customer").where(F.col("c_nationkey") < 20).select(
        key.alias("place"), (F.lit(2023) + key % 2).cast("int").alias("year")
    )
    return merge.merge_vapour_pressure(wide, sheet, targets, mark="matched")


@_query
def period_updates(spark, sf_dir):
    """Shipping days in every customer's own period; periods overlap and last from a day to two years."""
    key = F.col("c_custkey")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (key * 13 % 2200).cast("int"))
    length = F.when(key % 5 == 0, key % 700).otherwise(key % 40).cast("int")
    targets = S.table(spark, sf_dir, "customer").select(key.alias("place"), start.alias("start"), F.date_add(start, length).alias("end"))
    return merge.period_updates(S.ship_days(spark, sf_dir), targets, "lines")


@_query
def new_column_merge(spark, sf_dir):
    """Vapour pressure merged into a table that has no such column yet."""
    wide = S.weather_wide(spark, sf_dir).select("place", "date", "year", "click")
    counts = S.table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("date")).agg(F.count(F.lit(1)).cast("double").alias("VP"))
    key = F.col("c_custkey")
    targets = S.table(spark, sf_dir, "customer").where(key % 3 == 0).select(key.alias("place"), F.lit(2023).alias("year"))
    return merge.merge_vapour_pressure(wide, counts, targets)


@_query
def table_swap(spark, sf_dir):
    """A table replaced by rows that are read from it: the weather table, then the same with clicks doubled."""
    name = f"weather_{uuid.uuid4().hex}"
    sinks.swap_table(S.weather_wide(spark, sf_dir), name, ["year"])
    last = sinks.swap_table(spark.table(name).withColumn("click", F.col("click") * 2), name, ["year"])
    found = spark.read.schema(spark.table(name).schema).parquet(spark.sql(f"DESCRIBE EXTENDED {last}").where("col_name = 'Location'").first()["data_type"])
    spark.sql(f"DROP VIEW {name}")
    sinks.drop_versions(spark, name)
    return found


@_query
def rows_updated(spark, sf_dir):
    """How many rows an update touched, per season."""
    merged = QUERIES["update_merge"](spark, sf_dir)
    return P.rows_per_year(merged.where("matched"))


@_query
def mesh_csv(spark, sf_dir):
    """The wide cell table written with a tab between fields and read back."""
    path = new_table_path(spark, "mesh_csv")
    wide = QUERIES["mesh_pivot"](spark, sf_dir)
    sinks.write_csv(wide, path, delimiter="\t")
    return read_table(spark, path, fmt="csv", schema=wide.schema, options={"header": "true", "sep": "\t"})


@_query
def table_round_trip(spark, sf_dir):
    """A table written partitioned by season, read back in part, sent through CSV and read again."""
    wide = S.weather_wide(spark, sf_dir).select(
        "place", "date", "click", "error", "signup", (F.lit(2023) + F.col("place") % 2).cast("int").alias("year")
    )
    path, sheet = new_table_path(spark, "weather_table"), new_table_path(spark, "weather_sheet")
    sinks.write_parquet(wide, path, ["year"])
    part = read_table(spark, path, fmt="parquet", schema=wide.schema, where=F.col("click") > 20)
    sinks.write_csv(part, sheet)
    return read_sheet(spark, sheet, T.StructType([f for f in part.schema.fields]))


# --- anomaly and output tables ------------------------------------------------------------------


@_query
def anomaly(spark, sf_dir):
    today = dt.date(2024, 1, 15)
    return an.anomalies(an.both_kinds(S.grid_daily(spark, sf_dir), tg.DayRange.around(today, 64)), today)


@_query
def date_table(spark, sf_dir):
    grid, days, point = S.grid_daily(spark, sf_dir), tg.DayRange.around("2024-01-15"), _point_of(7)
    observed, normal = (G.scan_daily(grid, "click", days, point, kind=k) for k in ("observed", "normal"))
    return an.date_table(an.observed_and_normal(observed, normal))


@_query
def mesh_pivot(spark, sf_dir):
    cells = S.grid_observed(spark, sf_dir).where(F.col("element") == "click")
    steps = [dt.date(2024, 1, d) for d in range(1, 31)]
    return _short(sp.mesh_pivot(cells, "date", steps, with_centre=True, names=[f"d{s.day:02}" for s in steps]))


@_query
def extent(spark, sf_dir):
    found = sp.extent(S.grid_static(spark, sf_dir))
    return found.withColumns({c: F.round(c, 9) for c, kind in found.dtypes if kind == "double"})


@_query
def raster_cells(spark, sf_dir):
    cells = sp.raster_cells(S.grid_static(spark, sf_dir), "element", steps=(1 / mesh.ROWS_PER_DEGREE, 1 / mesh.COLUMNS_PER_DEGREE))
    return cells.withColumns({c: F.round(c, 9) for c in ("pixel_x", "pixel_y", "west", "south", "east", "north")})


@_query
def map_classes(spark, sf_dir):
    cells = sp.map_cells(S.grid_static(spark, sf_dir).where(F.col("element") == "altitude"), classes=10)
    return cells.withColumns({"x": F.round("x", 3), "y": F.round("y", 3)})


@_query
def map_days(spark, sf_dir):
    first = S.grid_observed(spark, sf_dir).where(F.col("element") == "click").groupBy("mesh_code", "lat", "lon").agg(F.min("date").alias("value"))
    return sp.map_cells(first, limits=(dt.date(2024, 1, 1), dt.date(2024, 1, 30))).drop("x", "y")


@_query
def nearest_place(spark, sf_dir):
    found = nearest(S.sites(spark, sf_dir).drop("year"), S.gazetteer(spark, sf_dir))
    return found.withColumn("distance_m", F.round("distance_m", 1))


# --- metrics, models, rows ----------------------------------------------------------------------


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed prediction per location and year, from its mean order."""
    raw = S.panel(spark, sf_dir).where(F.col("yield") >= 5)
    guess = F.lit(10) + F.lit(5) * F.col("yield") / F.element_at("features", 1)
    return raw.select("loc_id", "year", F.col("yield").alias("y_true"), guess.alias("y_pred"))


@_query
def metrics_by_year(spark, sf_dir):
    found = regression_metrics(_scored(spark, sf_dir), by=["year"])
    return found.withColumns({c: _r(c) for c in ("rmse", "pearson", "mae", "huber")})


@_query
def loss_of_outputs(spark, sf_dir):
    scored = _scored(spark, sf_dir).withColumns(
        {"prev_true": F.array(F.col("y_true"), F.col("y_true") / 2), "prev_pred": F.array("y_pred", "y_pred")}
    )
    return weighted_loss(scored, previous=("prev_true", "prev_pred"), weights=(0.75, 0.25)).select(_r("loss").alias("loss"))


# Rounds without a gain after which the registered fits stop, and the trees' step.
PATIENCE, STEP = 5, 0.5


def _model_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training and hold-out sequences of one prepared panel."""
    prepared = _stored_panel(spark, sf_dir)
    return stored(_training(prepared), "training"), stored(_holdout(prepared), "holdout")


@_query
def yield_model_score(spark, sf_dir):
    """The training job: trees that stop on the year before the hold-out, saved, loaded and scored on the hold-out."""
    prepared = _stored_panel(spark, sf_dir)
    training, holdout = _training(prepared), stored(_holdout(prepared), "holdout")  # the job stores the training rows itself
    path, out = new_table_path(spark, "yield_model"), new_table_path(spark, "predictions")
    train_and_score(training, holdout, path, out, validation_year=S.HOLDOUT_YEAR - 1, patience=PATIENCE, step=STEP)
    trees = M.load_model(path).stages[0].getNumTrees
    return spark.read.parquet(out).withColumn("trees", F.lit(trees))


@_query
def yield_model_keys(spark, sf_dir):
    """The training job without a validation year, on the first group alone: what its stored predictions were made for."""
    prepared = _stored_panel(spark, sf_dir)
    training, holdout = _training(prepared), stored(_holdout(prepared), "holdout")  # the job stores the training rows itself
    path, out = new_table_path(spark, "yield_model"), new_table_path(spark, "predictions")
    train_and_score(training, holdout, path, out, keep=("e",))
    return spark.read.parquet(out).where(F.col("y_pred").isNotNull()).select("loc_id", "year", "y_true")


@_query
def model_compare(spark, sf_dir):
    """Metrics of the linear fits on all groups and on the first one alone."""
    return M.compare_models(*_model_tables(spark, sf_dir))


@_query
def joint_outputs(spark, sf_dir):
    """Last and earlier yields from one joint fit that stops on the year before the hold-out, scored on the hold-out."""
    training, holdout = _model_tables(spark, sf_dir)
    last = F.element_at("years", -1) == S.HOLDOUT_YEAR - 1
    fit = J.fit_joint(training.where(~last), training.where(last), weights=(0.75, 0.25), patience=PATIENCE)
    return J.joint_predictions(fit, holdout).withColumn("rounds", F.lit(fit.stop.best))


@_query
def multi_encoding_load(spark, sf_dir):
    """Whole document texts as bytes, half of them with a byte-order mark, decoded again: all are UTF-8, so without Python."""
    mark = F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit("")))
    content = F.concat(mark, F.encode("text", "utf-8"))
    return decode_rows(S.table(spark, sf_dir, "documents").select("doc_id", content.alias("content")))


@_query
def four_encodings(spark, sf_dir):
    """Customers' names behind two Japanese letters, as bytes of four encodings, decoded again.

    The first letter is the katakana at U+30A1 + key mod 60, the second U+73F1, which no longer lets EUC-JP pass for CP932.
    """
    key = F.col("c_custkey") % 60

    def letters(lead: str, first: int, second: str) -> Column:
        return F.concat(F.unhex(F.lit(lead)), F.unhex(F.hex(key + first)), F.unhex(F.lit(second)))

    low = F.unhex(F.hex(F.pmod(key + 0x21, F.lit(64)) + 0x80))
    utf8 = F.concat(F.unhex(F.lit("E3")), F.unhex(F.hex(F.lit(0x82) + F.floor((key + 0x21) / 64))), low, F.unhex(F.lit("E78FB1")))
    kind = F.col("c_custkey") % 4
    content = (
        F.when(kind == 0, F.concat(F.unhex(F.lit("EFBBBF")), utf8))
        .when(kind == 1, utf8)
        .when(kind == 2, letters("83", 0x40, "E0FC"))
        .otherwise(letters("A5", 0xA1, "E0FE"))
    )
    rows = S.table(spark, sf_dir, "customer").select("c_custkey", F.concat(content, F.encode("c_name", "utf-8")).alias("content"))
    return decode_rows(rows)


@_query
def top_rows(spark, sf_dir):
    orders = S.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return first_rows(orders, [F.desc("o_totalprice"), "o_orderkey"], 15)


@_query
def sample_shuffle(spark, sf_dir):
    return shuffled(S.table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_custkey"], seed=11)
