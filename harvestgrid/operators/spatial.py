"""Sites on the grid, areas, extents, and the raster and map tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestgrid.functions import mesh
from harvestgrid.functions.timegrid import season_year
from harvestgrid.operators.quality import sentinel_to_null
from harvestgrid.operators.sizes import BROADCAST_ROWS
from harvestgrid.sources.sinks import stored

# The daily elements of the site weather table and their labels.
DAILY_ELEMENTS = {
    "TMP_mea": "日平均気温",
    "TMP_max": "日最高気温",
    "TMP_min": "日最低気温",
    "APCPRA": "日積算降水量",
    "OPR": "1mm以上の降水の有無",
    "SSD": "日照時間",
    "GSR": "全天日射量",
    "DLR": "下向き長波放射量",
    "RH": "日平均相対湿度",
    "WIND": "日平均風速",
    "SD": "積雪深",
    "SWE": "積雪相当水量",
    "SFW": "日降雪相当水量",
}


# --- sites --------------------------------------------------------------------------------------


def site_cells(sites: DataFrame) -> DataFrame:
    """Sites (place, year, lat, lon) with their own cell and tile; sites outside the grid drop out."""
    code = mesh.mesh_code(F.col("lat"), F.col("lon"))
    return (
        sites.select("place", F.col("year").cast("int").alias("season_year"), code.alias("mesh_code"))
        .where(F.col("mesh_code").isNotNull())
        .distinct()
    )


def site_weather(
    grid: DataFrame, sites: DataFrame, elements: Sequence[str] = tuple(DAILY_ELEMENTS), broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Observed weather at each site's own cell for its season: place, year, date, one column per element.

    The sites' tiles (at most 90 x 90 codes exist) and first and last season are looked up first and
    prune the grid's partitions. The grid is then cut to the cells and seasons that some site needs
    and pivoted once per cell, so sites that share a cell share the work and only finished rows fan
    out to them. A site year is a season, so the join is an equi-join on (cell, season). Sites up to
    ``broadcast_rows`` are broadcast, so only rows at sites are shuffled, for the pivot; more are joined by cell
    (``_site_weather_by_cell``), without a shuffle of a bucketed grid.
    """
    wanted = stored(site_cells(sites), "site_cells")
    tiles, first, last, count = wanted.agg(
        F.collect_set(F.substring("mesh_code", 1, 4)), F.min("season_year"), F.max("season_year"), F.count(F.lit(1))
    ).head()
    daily = mesh.in_listed_tiles(grid, tiles).where(
        F.col("element").isin(list(elements))
        & (F.col("kind") == "observed")
        & F.col("year").between(F.lit(first), F.lit(last) + 1)
    ).withColumn("season_year", season_year(F.col("date")))
    if count > broadcast_rows:
        return _site_weather_by_cell(daily, wanted, elements)
    wanted = F.broadcast(wanted)
    needed = F.broadcast(wanted.select("mesh_code", "season_year").distinct())
    per_cell = _pivoted(daily.join(needed, ["mesh_code", "season_year"], "left_semi"), elements)
    return wanted.join(per_cell, ["mesh_code", "season_year"]).select(
        F.col("season_year").alias("year"), "place", "date", *elements
    )


def _pivoted(daily: DataFrame, elements: Sequence[str]) -> DataFrame:
    return daily.groupBy("mesh_code", "season_year", "date").agg(
        *[F.first(F.when(F.col("element") == e, F.col("value")), ignorenulls=True).alias(e) for e in elements]
    )


def _site_weather_by_cell(daily: DataFrame, wanted: DataFrame, elements: Sequence[str]) -> DataFrame:
    """Site weather for more sites than a broadcast holds: every step keeps the grid's rows where their cell is.

    The cell code alone is the join key, so rows that are together by cell serve the semi-join, the pivot and the
    fan-out; a grid from ``sources.grids.write_bucketed`` lies so already and is not shuffled. Seasons are
    compared by their difference, which Spark does not take for a second key: it would shuffle by both.
    """
    same_season = F.col("w.season_year") - F.col("d.season_year") == 0
    needed = wanted.select("mesh_code", "season_year").distinct()
    both = [F.col("w.mesh_code") == F.col("d.mesh_code"), same_season]
    per_cell = _pivoted(daily.alias("d").join(needed.alias("w"), both[0] & both[1], "left_semi"), elements)
    return wanted.alias("w").join(per_cell.alias("d"), both[0] & both[1]).select(
        F.col("w.season_year").alias("year"), "place", "date", *elements
    )


# --- wide mesh table ----------------------------------------------------------------------------


# Steps that one expression of the pivot's aggregate covers.
SLOTS = 64


def mesh_series(
    df: DataFrame, time: str, steps: Sequence, with_centre: bool = False, drop_missing: bool = True, slots: int = SLOTS
) -> DataFrame:
    """One row per cell with ``values``, an array with a place for each of any number of steps; the sentinel is missing.

    Rows are tagged with their step's position by a broadcast of the asked steps, shuffled once by cell, set
    into blocks of ``slots`` places, and the blocks are strung together. So the plan is the same for a month of days and a year of
    hours. Of several values for a cell and step the greatest counts. ``drop_missing`` leaves out cells that are
    missing at all steps; rows of other steps are not read further, so a cell that has only those drops out or stays empty.
    """
    keys = ["mesh_code", *(["lat", "lon"] if with_centre else [])]
    kind = df.schema[time].dataType
    asked = df.sparkSession.createDataFrame(
        [(step, k) for k, step in enumerate(steps)], T.StructType([T.StructField(time, kind), T.StructField("_at", T.IntegerType())])
    )
    known = sentinel_to_null(df, ["value"]).select(*keys, time, "value").join(
        F.broadcast(asked), time, "inner" if drop_missing else "left"
    )
    block, place = (F.col("_at") / slots).cast("int"), F.col("_at") % slots
    blocks = -(-len(steps) // slots)
    in_blocks = (
        known.repartition(*keys)
        .groupBy(*keys, block.alias("_block"))
        .agg(F.array(*[F.max(F.when(place == k, F.col("value"))) for k in range(min(slots, len(steps)))]).alias("_values"))
    )
    by_block = F.map_from_entries(F.collect_list(F.when(F.col("_block").isNotNull(), F.struct("_block", "_values"))))
    empty = F.array_repeat(F.lit(None).cast("double"), min(slots, len(steps)))
    strung = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.coalesce(F.try_element_at("_blocks", k), empty)))
    series = in_blocks.groupBy(*keys).agg(by_block.alias("_blocks"))
    series = series.select(*keys, F.slice(strung, 1, len(steps)).alias("values"))
    return series.where(F.exists("values", lambda v: v.isNotNull())) if drop_missing else series


def mesh_pivot(
    df: DataFrame, time: str, steps: Sequence, with_centre: bool = False, drop_missing: bool = True, names: Sequence[str] | None = None
) -> DataFrame:
    """``mesh_series`` with one column per step in place of the array. ``names`` names the columns."""
    names = list(names or [str(s) for s in steps])
    series = mesh_series(df, time, steps, with_centre, drop_missing)
    return series.select(*[c for c in series.columns if c != "values"], *[F.col("values")[k].alias(n) for k, n in enumerate(names)])


def mesh_lines(series: DataFrame, names: Sequence[str], delimiter: str = ",") -> tuple[str, DataFrame]:
    """The header and the lines of the wide cell table as text, from ``mesh_series``; a missing value is an empty field.

    A line is one expression, so a table of thousands of steps is written without thousands of columns.
    """
    keys = [c for c in series.columns if c != "values"]
    cells = F.transform("values", lambda v: F.coalesce(v.cast("string"), F.lit("")))
    line = F.concat_ws(delimiter, *[F.col(k).cast("string") for k in keys], F.array_join(cells, delimiter))
    return delimiter.join([*keys, *names]), series.select(line.alias("value"))


def south_first(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows from south to north, then west to east; a sort, for output only."""
    return df.orderBy(lat, lon)


# --- extent, raster, map ------------------------------------------------------------------------


def extent(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One row: bounds of the coordinates, their count and step, and the outer edges.

    Step = (last - first) / (count - 1), missing for a single row or column; edges lie half a step out.
    """
    out = df.agg(
        *[f(c).alias(f"{n}_{c}") for c in (lat, lon) for n, f in (("min", F.min), ("max", F.max), ("count", F.count_distinct))]
    )
    for c in (lat, lon):
        low, high = F.col(f"min_{c}"), F.col(f"max_{c}")
        step = F.try_divide(high - low, (F.col(f"count_{c}") - 1).cast("double"))
        out = out.withColumns({f"step_{c}": step})
        out = out.withColumns({f"lower_{c}": low - F.col(f"step_{c}") / 2, f"upper_{c}": high + F.col(f"step_{c}") / 2})
    return out


# Coordinates are told apart to so many digits, and may lie so many steps off a regular axis.
AXIS_DIGITS, AXIS_SLACK = 9, 0.01


def regular_axis(name: str, given: float | None) -> dict[str, Column]:
    """``first``, ``last``, ``step`` and ``n`` of a regular axis, from its sorted coordinates in the array column ``name``.

    Without a given step it is the smallest gap; a coordinate off the steps raises.
    """
    at = F.col(f"`{name}`")
    gaps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), at, lambda b, a: b - a)
    step = F.array_min(F.filter(gaps, lambda g: g.isNotNull())) if given is None else F.lit(given)
    first, last = F.element_at(at, 1), F.element_at(at, -1)
    steps = F.coalesce(F.rint(F.try_divide(last - first, step)), F.lit(0.0))
    exact = F.try_divide(last - first, steps)
    off = F.exists(at, lambda x: F.abs((x - first) / exact - F.rint((x - first) / exact)) > AXIS_SLACK)
    checked = F.when(F.coalesce(off, F.lit(False)), F.raise_error(F.lit(f"no regular axis: {name}")).cast("double")).otherwise(exact)
    return {"first": first, "last": last, "step": checked, "n": steps + 1}


def raster_cells(
    df: DataFrame,
    layer: str,
    lat: str = "lat",
    lon: str = "lon",
    value: str = "value",
    steps: tuple[float, float] | None = None,
) -> DataFrame:
    """Raster table: layer, row (north first), column, value, and the affine metadata on each row.

    Rows and columns follow from the axes, which must be regular: a coordinate off the steps raises. ``steps`` names
    the steps in latitude and longitude; without it they are the smallest gaps between the data's own
    coordinates. So a row without data keeps its place. Only the distinct
    coordinates of the axes are gathered. Pixel size = (last - first) / (n - 1), missing for a single row
    or column. Coordinates are EPSG:4326 and missing values stay NULL.
    """
    axes = df.agg(*[F.array_sort(F.collect_set(F.round(F.col(c), AXIS_DIGITS))).alias(c) for c in (lat, lon)])

    of_lat, of_lon = (regular_axis(c, steps[k] if steps else None) for k, c in enumerate((lat, lon)))
    bounds = axes.select(
        F.struct(
            *[v.alias(f"lat_{k}") for k, v in of_lat.items()], *[v.alias(f"lon_{k}") for k, v in of_lon.items()]
        ).alias("b")
    ).select(
        F.struct(
            F.col("b.lat_first").alias("south"), F.col("b.lat_last").alias("north"), F.col("b.lon_first").alias("west"),
            F.col("b.lon_last").alias("east"), F.col("b.lat_n").alias("height"), F.col("b.lon_n").alias("width"),
            F.col("b.lat_step").alias("step_y"), F.col("b.lon_step").alias("step_x"),
        ).alias("b")
    )
    height, width = F.col("b.height"), F.col("b.width")
    size_y, size_x = F.col("b.step_y"), F.col("b.step_x")
    return df.withColumn("b", bounds.scalar()).select(
        F.col(layer).alias("layer"),
        F.coalesce(F.rint((F.col("b.north") - F.col(lat)) / size_y), F.lit(0.0)).cast("int").alias("row"),
        F.coalesce(F.rint((F.col(lon) - F.col("b.west")) / size_x), F.lit(0.0)).cast("int").alias("column"),
        F.col(value).alias("value"),
        height.cast("int").alias("height"),
        width.cast("int").alias("width"),
        size_x.alias("pixel_x"),
        size_y.alias("pixel_y"),
        (F.col("b.west") - size_x / 2).alias("west"),
        (F.col("b.south") - size_y / 2).alias("south"),
        (F.col("b.east") + size_x / 2).alias("east"),
        (F.col("b.north") + size_y / 2).alias("north"),
    )


def map_cells(df: DataFrame, classes: int = 256, limits: tuple | None = None, value: str = "value") -> DataFrame:
    """Cells in Web Mercator with a value class, for drawing on a map.

    Classes 1..``classes`` cover the limits, the data's own if none are given; 0 lies below and
    ``classes`` + 1 above. The upper limit belongs to the last class. Dates have one class per day,
    counted from 0 at the lower limit. Missing values have no class.
    """
    is_date = dict(df.dtypes)[value] == "date"
    if limits is None:
        ends = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias("l"))
        df = df.withColumn("_limits", ends.scalar())
    else:
        df = df.withColumn("_limits", F.struct(F.lit(limits[0]).alias("low"), F.lit(limits[1]).alias("high")))
    low, high, v = F.col("_limits.low"), F.col("_limits.high"), F.col(value)
    if is_date:
        number = F.datediff(v, low)
    else:
        bucket = F.width_bucket(v, low, high, F.lit(classes))
        number = F.when((v == high) | (low == high) & (v == low), F.lit(classes).cast("long")).otherwise(bucket)
    return df.select(
        "mesh_code",
        mesh.mercator_x(F.col("lon")).alias("x"),
        mesh.mercator_y(F.col("lat")).alias("y"),
        v.alias(value),
        number.cast("int").alias("value_class"),
    )


def with_area(boxes: DataFrame) -> DataFrame:
    """Boxes (south, north, west, east) with the number and name of the first area that holds each.

    Both are NULL for a box out of order or in no area; ``require_area`` raises on those.
    """
    number = mesh.area_number(*[F.col(c) for c in ("south", "north", "west", "east")])
    return boxes.withColumn("area_num", number).withColumn("area_name", mesh.area_name(F.col("area_num")))


def require_area(boxes: DataFrame) -> DataFrame:
    """``with_area`` that raises on a box in no area."""
    text = F.concat_ws(" ", F.lit("no area holds"), *[F.col(c).cast("string") for c in ("south", "north", "west", "east")])
    found = with_area(boxes)
    return found.withColumn("area_num", F.coalesce("area_num", F.raise_error(text).cast("int")))
