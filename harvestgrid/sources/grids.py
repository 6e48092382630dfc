"""Gridded weather as long tables, laid out so that a request reads only its blocks of tiles and years.

Layouts (partition columns first). A block is 10 x 10 tiles, so the number of folders is bounded by the earth, not by the
rows; inside files, rows lie by tile, place and time, and row-group statistics do the rest.
daily     element, kind, year, block | tile, mesh_code, lat, lon, date, value
scenario  element, model, scenario, year, block | tile, mesh_code, lat, lon, date, value
hourly    element, kind, storage_year, block | tile, mesh_code, lat, lon, ts_utc, ts_local, value
static    element, block | tile, mesh_code, lat, lon, value
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestgrid.functions import mesh
from harvestgrid.functions.numeric import nan_to_null, round_even
from harvestgrid.functions.timegrid import DayRange, HourRange
from harvestgrid.operators.quality import sentinel_to_null
from harvestgrid.operators.sizes import broadcast_if_small
from harvestgrid.operators.spatial import AXIS_DIGITS, AXIS_SLACK, regular_axis

PARTITIONS = {
    "daily": ("element", "kind", "year", "block"),
    "scenario": ("element", "model", "scenario", "year", "block"),
    "hourly": ("element", "kind", "storage_year", "block"),
    "static": ("element", "block"),
}
TIME_COLUMNS = {"daily": ("date",), "scenario": ("date",), "hourly": ("ts_utc", "ts_local"), "static": ()}

_TYPES = {
    "year": T.IntegerType(),
    "storage_year": T.IntegerType(),
    "lat": T.DoubleType(),
    "lon": T.DoubleType(),
    "value": T.DoubleType(),
    "date": T.DateType(),
    "ts_utc": T.TimestampNTZType(),
    "ts_local": T.TimestampNTZType(),
}


def grid_schema(layout: str) -> T.StructType:
    names = ("tile", "mesh_code", "lat", "lon", *TIME_COLUMNS[layout], "value", *PARTITIONS[layout])
    return T.StructType([T.StructField(n, _TYPES.get(n, T.StringType())) for n in names])


def read_grid(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """A grid table. The explicit schema keeps ``block`` a string; inference would make it a number."""
    return spark.read.schema(grid_schema(layout)).parquet(path)


def with_cell(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add ``tile`` and ``mesh_code`` and move the point to its cell's centre."""
    row, column = F.col("_row"), F.col("_column")
    numbered = df.withColumns({"_row": mesh.cell_row(F.col(lat)), "_column": mesh.cell_column(F.col(lon))})
    celled = numbered.withColumns(
        {"mesh_code": mesh.code_of_cell(row, column), "lat": mesh.row_centre(row), "lon": mesh.column_centre(column)}
    )
    return celled.withColumn("tile", F.substring("mesh_code", 1, 4)).drop("_row", "_column")


def _laid_out(df: DataFrame, layout: str) -> DataFrame:
    return df.withColumn("block", mesh.tile_block(F.col("tile"))).select(*[f.name for f in grid_schema(layout)])


def write_grid(df: DataFrame, path: str, layout: str, mode: str = "overwrite") -> None:
    """Write a grid table with rows sorted by tile, place and time inside each file.

    Rows are rebalanced by partition: adaptive execution splits a partition that is too large for
    one task over several tasks and files, and packs small ones together.
    """
    parts = list(PARTITIONS[layout])
    order = [*parts, "tile", "lat", "lon", *TIME_COLUMNS[layout]]
    rows = _laid_out(df, layout).hint("rebalance", *parts)
    rows.sortWithinPartitions(*order).write.mode(mode).partitionBy(*parts).parquet(path)


def write_bucketed(df: DataFrame, name: str, layout: str, buckets: int, path: str | None = None) -> None:
    """Write a grid as a catalog table whose files hold buckets of cells; joins by ``mesh_code`` read them without a shuffle.

    A bucket of a partition is one file, written by one task: the rows are dealt by the same hash first.
    """
    parts = list(PARTITIONS[layout])
    rows = _laid_out(df, layout).repartition(buckets, "mesh_code")
    writer = rows.write.mode("overwrite").partitionBy(*parts)
    writer = writer.bucketBy(buckets, "mesh_code").sortBy("mesh_code", *TIME_COLUMNS[layout])
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """The codes of the tiles of a written grid table. Only that column is read, which sorted files hold in a few bytes a tile."""
    return spark.read.schema("tile string").parquet(path).select("tile").distinct()


# --- scans --------------------------------------------------------------------------------------


def _area_tiles(rows: tuple[int, int], columns: tuple[int, int]) -> list[str]:
    side = mesh.CELLS_PER_TILE_SIDE
    return [
        f"{p}{u}"
        for p in range(rows[0] // side, rows[1] // side + 1)
        for u in range(columns[0] // side, columns[1] // side + 1)
    ]


def _constant_axes(rows, columns, time: str | None, one_step: bool) -> list[str]:
    axes = []
    if rows[0] == rows[1]:
        axes.append("lat")
    if columns[0] == columns[1]:
        axes.append("lon")
    if time and one_step:
        axes.append(time)
    return axes


def _scan(
    grid: DataFrame,
    box: mesh.Box,
    filters: Sequence[Column],
    time: str | None,
    one_step: bool,
    by_area: bool,
    elements: DataFrame | None,
    squeeze: bool,
) -> DataFrame:
    if by_area:
        rows, columns = box.within(box.find_area())
        tiles = _area_tiles(rows, columns)
    else:
        rows, columns, tiles = box.rows(), box.columns(), box.tiles()
    wanted = [*filters, mesh.cells_between(F.col("lat"), F.col("lon"), rows, columns)]
    df = reduce(lambda frame, condition: frame.where(condition), wanted, mesh.in_listed_tiles(grid, tiles))
    df = df.select("element", "mesh_code", "lat", "lon", *([time] if time else []), "value")
    if elements is not None:
        df = with_names(df, elements)
    return df.drop(*_constant_axes(rows, columns, time, one_step)) if squeeze else df


def scan_daily(
    grid: DataFrame,
    element: str,
    days: DayRange,
    box: mesh.Box,
    kind: str = "observed",
    by_area: bool = False,
    elements: DataFrame | None = None,
    squeeze: bool = False,
) -> DataFrame:
    """Cells of a box on the days of a range, observed or normal.

    Element, kind, years and blocks of tiles are partition filters; tiles, box and days reach the files. With
    ``by_area`` the box is read inside its area. ``elements`` adds name and unit. ``squeeze`` leaves
    out coordinates that the request makes constant. Nothing found means no rows.
    """
    filters = [F.col("element") == element, F.col("kind") == kind, F.col("year").isin(days.years), days.holds(F.col("date"))]
    return _scan(grid, box, filters, "date", days.first == days.last, by_area, elements, squeeze)


def scan_scenario(
    grid: DataFrame,
    element: str,
    days: DayRange,
    box: mesh.Box,
    model: str,
    scenario: str,
    by_area: bool = False,
    elements: DataFrame | None = None,
    squeeze: bool = False,
) -> DataFrame:
    """``scan_daily`` on a climate-scenario table, for one model and scenario."""
    filters = [
        F.col("element") == element,
        F.col("model") == model,
        F.col("scenario") == scenario,
        F.col("year").isin(days.years),
        days.holds(F.col("date")),
    ]
    return _scan(grid, box, filters, "date", days.first == days.last, by_area, elements, squeeze)


def scan_static(
    grid: DataFrame,
    element: str,
    box: mesh.Box,
    by_area: bool = False,
    elements: DataFrame | None = None,
    squeeze: bool = False,
) -> DataFrame:
    """Cells of a box of a layer without time, such as altitude or land use."""
    return _scan(grid, box, [F.col("element") == element], None, False, by_area, elements, squeeze)


def scan_hourly(
    grid: DataFrame,
    element: str,
    hours: HourRange,
    box: mesh.Box,
    kind: str = "observed",
    elements: DataFrame | None = None,
    squeeze: bool = False,
) -> DataFrame:
    """Cells of a box on the local hours of a range; values rounded to one decimal, half to even."""
    filters = [
        F.col("element") == element,
        F.col("kind") == kind,
        F.col("storage_year").isin(hours.years),
        hours.holds(F.col("ts_local")),
    ]
    df = _scan(grid, box, filters, "ts_local", hours.first == hours.last, False, elements, squeeze)
    return df.withColumn("value", round_even(F.col("value"), 1))


def extract_cells(
    grid: DataFrame,
    element: str,
    box: mesh.Box,
    fill: float,
    days: DayRange | None = None,
    elements: DataFrame | None = None,
    kind: str | None = None,
) -> DataFrame:
    """Cells with their centre in the box, fill values as NULL, with name and unit if given.

    Element, kind, years and blocks of tiles are partition filters. Equal bounds ask for the nearest coordinate, which is looked
    for in the tiles around them first.
    """
    df = grid.where(F.col("element") == element)
    if kind is not None:
        df = df.where(F.col("kind") == kind)
    if days is not None:
        df = df.where(F.col("year").isin(days.years)) if "year" in df.columns else df
        df = df.where(days.holds(F.col("date")))
    if box.south < box.north and box.west < box.east:
        df = mesh.in_tiles(df, box)
    df = sentinel_to_null(mesh.in_centre_box(df, "lat", "lon", box), ["value"], fill)
    return with_names(df, elements) if elements is not None else df


def with_names(df: DataFrame, elements: DataFrame) -> DataFrame:
    """Add ``long_name`` and ``unit`` of each element.

    There are few elements and many rows of each, so a shuffle by element is to be avoided. An element
    may be listed several times with one name and unit; two different ones raise.
    """
    label = F.struct("long_name", "unit")
    once = elements.groupBy("element").agg(F.min(label).alias("_label"), F.max(label).alias("_other"))
    clash = F.raise_error(F.concat(F.lit("two names or units of element "), F.col("element"))).cast("boolean")
    once = once.where(F.when(F.col("_label").eqNullSafe(F.col("_other")), True).otherwise(clash))
    return df.join(broadcast_if_small(once.select("element", "_label.*")), "element", "left")


# --- pieces -------------------------------------------------------------------------------------


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows of all frames; columns absent from one become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_pieces(pieces: Sequence[DataFrame], keys: Sequence[str] = ("element", "mesh_code", "ts"), value: str = "value") -> DataFrame:
    """Outer combination of pieces on their keys.

    A value fills a missing one; two different values for one key raise. Copies meet in the
    map-side half of the aggregate, so a tile repeated many times does not load one task.
    """
    known = nan_to_null(F.col(value).cast("double"))
    low, high = F.min(known).alias("_low"), F.max(known).alias("_high")
    merged = union_by_name(*pieces).groupBy(*keys).agg(low, high)
    clash = F.concat_ws(" ", F.lit("conflicting values for"), *[F.col(k).cast("string") for k in keys])
    agree = F.coalesce(F.col("_low") == F.col("_high"), F.lit(True))
    checked = merged.where(F.when(agree, True).otherwise(F.raise_error(clash).cast("boolean")))
    return checked.select(*keys, F.col("_low").alias(value))


def align_axes(
    pieces: Sequence[DataFrame],
    axes: Sequence[str] = ("lat", "lon"),
    steps: Sequence[float] | None = None,
    tolerance: float = AXIS_SLACK,
) -> list[DataFrame]:
    """The pieces with their coordinates on the first piece's axes.

    Pieces of other years may hold the same coordinates a little off. Each coordinate goes to the nearest step of the first piece's
    regular axis, on which it may lie further out; one that is off by more than ``tolerance`` steps raises. ``steps`` names the steps; without it
    they are the smallest gaps in the first piece, of whose coordinates alone the distinct ones are gathered.
    """
    seen = pieces[0].agg(*[F.array_sort(F.collect_set(F.round(F.col(c), AXIS_DIGITS))).alias(c) for c in axes])
    found = [regular_axis(c, steps[k] if steps else None) for k, c in enumerate(axes)]
    shape = seen.select(
        F.struct(*[F.struct(a["first"].alias("first"), a["step"].alias("step")).alias(c) for c, a in zip(axes, found, strict=True)]).alias("a")
    )

    def snapped(c: str) -> Column:
        first, step, x = F.col(f"_axes.{c}.first"), F.col(f"_axes.{c}.step"), F.col(c)
        number = F.coalesce(F.try_divide(x - first, step), F.when(x == first, 0.0))
        off = F.raise_error(F.concat(F.lit(f"{c} off the axis: "), x.cast("string"))).cast("double")
        near = F.abs(number - F.rint(number)) <= tolerance
        return F.when(x.isNull(), x).when(near, first + F.rint(number) * F.coalesce(step, F.lit(0.0))).otherwise(off)

    return [
        piece.withColumn("_axes", shape.scalar()).withColumns({c: snapped(c) for c in axes}).drop("_axes") for piece in pieces
    ]


def merge_on_axes(
    pieces: Sequence[DataFrame],
    keys: Sequence[str] = ("element", "lat", "lon", "date"),
    axes: Sequence[str] = ("lat", "lon"),
    steps: Sequence[float] | None = None,
    value: str = "value",
) -> DataFrame:
    """``merge_pieces`` of grids without cell codes: their coordinates are brought onto the first piece's axes before."""
    return merge_pieces(align_axes(pieces, axes, steps), keys, value)
