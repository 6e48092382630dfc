"""Grid-square arithmetic (JIS X 0410): points, cells, tiles, boxes and areas.

A first-order square (tile) spans 2/3 degree of latitude and 1 degree of longitude and holds
80 x 80 third-order squares (cells). Every row, column, offset and tile below comes from the same
digits as the cell code, so a point never falls into two cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_DEGREE = 120
COLUMNS_PER_DEGREE = 80
CELLS_PER_TILE_SIDE = 80
TILE_ROWS_PER_DEGREE = 1.5
WEST_ORIGIN = 100


# --- digits -------------------------------------------------------------------------------------


# Nested floors of a position give the digits: tile, then eighths, then tenths. Eight times a double
# and the fraction of a double are exact, so the cell number below equals the digits read one by one
# while it holds the position only twice; digits follow from it by integer arithmetic.


def _number_column(scaled: Column) -> Column:
    eighths = scaled * F.lit(8)
    return F.floor(eighths) * 10 + F.floor(F.pmod(eighths, F.lit(1.0)) * 10)


def _number_value(scaled: float) -> int:
    eighths = scaled * 8
    return math.floor(eighths) * 10 + math.floor(eighths % 1.0 * 10)


def _digits(number: Column) -> tuple[Column, Column, Column]:
    return F.floor(number / CELLS_PER_TILE_SIDE), F.floor(number / 10) % 8, number % 10


def row_value(lat: float) -> int:
    return _number_value(lat * TILE_ROWS_PER_DEGREE)


def column_value(lon: float) -> int:
    return _number_value(lon - WEST_ORIGIN)


def _has_two_digit_tile(row: Column, column: Column) -> Column:
    low, high = 10 * CELLS_PER_TILE_SIDE, 100 * CELLS_PER_TILE_SIDE - 1
    return row.between(low, high) & column.between(low, high)


def _as_text(*numbers: Column) -> Column:
    return F.concat(*[n.cast("string") for n in numbers])


# --- points to codes and back -------------------------------------------------------------------


def cell_row(lat: Column) -> Column:
    """Row number of a cell, counted northwards over all tiles."""
    return _number_column(lat.cast("double") * F.lit(TILE_ROWS_PER_DEGREE))


def cell_column(lon: Column) -> Column:
    """Column number of a cell, counted eastwards from 100 degrees east."""
    return _number_column(lon.cast("double") - F.lit(WEST_ORIGIN))


def code_of_cell(row: Column, column: Column) -> Column:
    """8-digit code of a cell; NULL where the standard gives no 8-digit code."""
    (p, q, r), (u, v, w) = _digits(row), _digits(column)
    return F.when(_has_two_digit_tile(row, column), _as_text(p, u, q, v, r, w))


def mesh_code(lat: Column, lon: Column) -> Column:
    """8-digit cell code of a point; NULL where the standard gives no 8-digit code."""
    return code_of_cell(cell_row(lat), cell_column(lon))


def tile_code(lat: Column, lon: Column) -> Column:
    """4-digit tile code of a point; NULL where ``mesh_code`` is NULL."""
    row, column = cell_row(lat), cell_column(lon)
    return F.when(_has_two_digit_tile(row, column), _as_text(_digits(row)[0], _digits(column)[0]))


def row_centre(row: Column) -> Column:
    """Latitude of the centre of a row of cells."""
    p, q, r = _digits(row)
    return p / F.lit(1.5) + q / F.lit(12.0) + r / F.lit(120.0) + F.lit(1 / 240.0)


def column_centre(column: Column) -> Column:
    """Longitude of the centre of a column of cells."""
    u, v, w = _digits(column)
    return u + F.lit(WEST_ORIGIN) + v / F.lit(8.0) + w / F.lit(80.0) + F.lit(1 / 160.0)


def _code_digits(code: Column, start: int, length: int = 1) -> Column:
    return F.substring(code, start, length).try_cast("int")


def mesh_latitude(code: Column) -> Column:
    """Latitude of a cell's centre; NULL unless the code has 8 characters."""
    south = (
        _code_digits(code, 1, 2) / F.lit(1.5)
        + _code_digits(code, 5) / F.lit(12.0)
        + _code_digits(code, 7) / F.lit(120.0)
    )
    return F.when(F.length(code) == 8, south + F.lit(1 / 240.0))


def mesh_longitude(code: Column) -> Column:
    """Longitude of a cell's centre; NULL unless the code has 8 characters."""
    west = (
        _code_digits(code, 3, 2)
        + F.lit(WEST_ORIGIN)
        + _code_digits(code, 6) / F.lit(8.0)
        + _code_digits(code, 8) / F.lit(80.0)
    )
    return F.when(F.length(code) == 8, west + F.lit(1 / 160.0))


# --- offsets inside a tile or an area -----------------------------------------------------------


def _offset(value: Column, low: Column, high: Column, index: Column, first: Column, last, upper: bool):
    inside = F.least(F.greatest(index - first, F.lit(0)), F.lit(last)).cast("int")
    return F.when(value.between(low, high), inside).otherwise(F.lit(last if upper else 0))


def tile_row_offset(lat: Column, tile: Column, upper: bool) -> Column:
    """Row 0..79 of a box bound inside a tile; a bound outside gives the tile's own edge."""
    number = F.substring(tile, 1, 2).cast("int")
    south = number / F.lit(TILE_ROWS_PER_DEGREE)
    first = number * CELLS_PER_TILE_SIDE
    return _offset(lat, south, south + F.lit(40 / 60), cell_row(lat), first, CELLS_PER_TILE_SIDE - 1, upper)


def tile_column_offset(lon: Column, tile: Column, upper: bool) -> Column:
    """Column 0..79 of a box bound inside a tile; a bound outside gives the tile's own edge."""
    number = F.substring(tile, 3, 2).cast("int")
    west = number + F.lit(WEST_ORIGIN)
    first = number * CELLS_PER_TILE_SIDE
    return _offset(lon, west, west + F.lit(1), cell_column(lon), first, CELLS_PER_TILE_SIDE - 1, upper)


@dataclass(frozen=True)
class Area:
    """A named box with its own cell numbering from the south-west corner."""

    num: int
    name: str
    south: float
    north: float
    west: float
    east: float
    last_row_offset: int
    last_column_offset: int

    @property
    def first_row(self) -> int:
        return round(self.south * ROWS_PER_DEGREE)

    @property
    def first_column(self) -> int:
        return round((self.west - WEST_ORIGIN) * COLUMNS_PER_DEGREE)

    def holds(self, box: "Box") -> bool:
        return (
            self.south <= box.south
            and box.north <= self.north
            and self.west <= box.west
            and box.east <= self.east
        )


# Number, name, south, north, west, east, last row and last column of the six areas.
# Area 6 has rows beyond its northern bound.
AREAS = (
    Area(1, "北海道", 118 / 3, 46.0, 139.0, 146.0, 799, 559),
    Area(2, "東北", 208 / 6, 42.0, 137.0, 143.0, 879, 479),
    Area(3, "関東北陸", 32.0, 232 / 6, 135.0, 142.0, 799, 559),
    Area(4, "西日本", 196 / 6, 220 / 6, 130.0, 138.0, 479, 639),
    Area(5, "九州", 172 / 6, 106 / 3, 128.0, 133.0, 799, 399),
    Area(6, "西南諸島", 24.0, 88 / 3, 122.0, 132.0, 799, 799),
)


def area_row_offset(lat: Column, area: Area, upper: bool) -> Column:
    return _offset(
        lat, F.lit(area.south), F.lit(area.north), cell_row(lat), F.lit(area.first_row), area.last_row_offset, upper
    )


def area_column_offset(lon: Column, area: Area, upper: bool) -> Column:
    return _offset(
        lon, F.lit(area.west), F.lit(area.east), cell_column(lon), F.lit(area.first_column), area.last_column_offset, upper
    )


def area_number(south: Column, north: Column, west: Column, east: Column) -> Column:
    """Number of the first area that holds the box, NULL if none does.

    Six constant tests in one expression: no join, whatever the number of boxes.
    """
    tests = [
        F.when(
            (south >= a.south) & (north <= a.north) & (west >= a.west) & (east <= a.east), F.lit(a.num)
        )
        for a in sorted(AREAS, key=lambda a: a.num)
    ]
    return F.coalesce(*tests)


def area_name(number: Column) -> Column:
    return F.coalesce(*[F.when(number == a.num, F.lit(a.name)) for a in AREAS])


# --- boxes --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Box:
    """A request box; equal bounds ask for one point. Raises ValueError on bounds out of order."""

    south: float
    north: float
    west: float
    east: float
    area: str | None = None

    def __post_init__(self):
        if self.south > self.north:
            raise ValueError(f"south {self.south} lies north of {self.north}")
        if self.west > self.east:
            raise ValueError(f"west {self.west} lies east of {self.east}")
        if self.area is not None and self.area not in {f"Area{a.num}" for a in AREAS}:
            raise ValueError(f"unknown area name: {self.area}")

    def find_area(self) -> Area:
        """The named area, else the first one that holds the box; ValueError if none does."""
        for area in AREAS:
            if (self.area == f"Area{area.num}") if self.area else area.holds(self):
                return area
        raise ValueError(f"no area holds {self}")

    def _tile_span(self, low: float, high: float) -> tuple[int, int]:
        first = math.floor(low)
        return first, max(math.ceil(high) - 1, first)

    @property
    def tile_rows(self) -> tuple[int, int]:
        return self._tile_span(self.south * TILE_ROWS_PER_DEGREE, self.north * TILE_ROWS_PER_DEGREE)

    @property
    def tile_columns(self) -> tuple[int, int]:
        return self._tile_span(self.west - WEST_ORIGIN, self.east - WEST_ORIGIN)

    def tiles(self) -> list[str]:
        """Codes of the tiles the box touches; a northern or eastern bound on an edge adds none."""
        (p0, p1), (u0, u1) = self.tile_rows, self.tile_columns
        return [f"{p}{u}" for p in range(p0, p1 + 1) for u in range(u0, u1 + 1)]

    def rows(self) -> tuple[int, int]:
        """First and last cell row: the cells that contain the two bounds, both included."""
        first = row_value(self.south)
        last = row_value(self.north)
        return first, min(last, (self.tile_rows[1] + 1) * CELLS_PER_TILE_SIDE - 1)

    def columns(self) -> tuple[int, int]:
        first = column_value(self.west)
        last = column_value(self.east)
        return first, min(last, (self.tile_columns[1] + 1) * CELLS_PER_TILE_SIDE - 1)

    def within(self, area: Area) -> tuple[tuple[int, int], tuple[int, int]]:
        """Rows and columns inside an area; a bound outside the area falls back to its edge."""

        def clamp(value, low, high, index, first, last, upper):
            offset = min(max(index - first, 0), last) if low <= value <= high else (last if upper else 0)
            return first + offset

        def span(values, indices, low, high, first, last):
            return tuple(
                clamp(v, low, high, i, first, last, upper) for v, i, upper in zip(values, indices, (False, True))
            )

        rows = span(
            (self.south, self.north),
            [row_value(v) for v in (self.south, self.north)],
            area.south, area.north, area.first_row, area.last_row_offset,
        )
        columns = span(
            (self.west, self.east),
            [column_value(v) for v in (self.west, self.east)],
            area.west, area.east, area.first_column, area.last_column_offset,
        )
        return rows, columns


def cells_between(lat: Column, lon: Column, rows: tuple[int, int], columns: tuple[int, int]) -> Column:
    """Filter on cell centres, equal to an index filter and pushed down to the scan.

    The limits are cell edges, half a cell away from any centre, so rounding cannot move a cell.
    """
    return (
        (lat > rows[0] / ROWS_PER_DEGREE)
        & (lat < (rows[1] + 1) / ROWS_PER_DEGREE)
        & (lon > columns[0] / COLUMNS_PER_DEGREE + WEST_ORIGIN)
        & (lon < (columns[1] + 1) / COLUMNS_PER_DEGREE + WEST_ORIGIN)
    )


def in_cell_box(lat: Column, lon: Column, box: Box) -> Column:
    """Cells that contain the box bounds, and all between them."""
    return cells_between(lat, lon, box.rows(), box.columns())


def tile_block(tile: Column) -> Column:
    """The block of 10 x 10 tiles that a tile lies in: the tens of its two numbers."""
    return F.concat(F.substring(tile, 1, 1), F.substring(tile, 3, 1))


def in_listed_tiles(df: DataFrame, tiles: Sequence[str]) -> DataFrame:
    """Rows in the given tiles, found by partition (``block``) and row group (``tile``) of a stored grid; a frame
    without these columns is filtered by what it has."""
    if "block" in df.columns:
        df = df.where(F.col("block").isin(sorted({t[0] + t[2] for t in tiles})))
    return df.where(F.col("tile").isin(list(tiles))) if "tile" in df.columns else df


def in_tiles(df: DataFrame, box: Box) -> DataFrame:
    """Rows in the tiles that a box touches; all rows of a frame without ``tile``."""
    return in_listed_tiles(df, box.tiles())


def rows_in_cell_box(df: DataFrame, box: Box, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``in_cell_box`` on a frame, reading only the tiles of the box."""
    return in_tiles(df, box).where(in_cell_box(F.col(lat), F.col(lon), box))


def in_centre_box(df: DataFrame, lat: str, lon: str, box: Box) -> DataFrame:
    """Rows whose centre lies in the box; equal bounds pick the nearest coordinate, the lower on a tie.

    On a frame with ``tile`` (and ``block``) the nearest coordinate is looked up in the three rows (or columns) of tiles around the
    bound, and in all of the frame only if none lies within a tile's side of it.
    """
    inside = F.lit(True)
    for name, low, high, digit, per_degree, origin in (
        (lat, box.south, box.north, 1, TILE_ROWS_PER_DEGREE, 0.0),
        (lon, box.west, box.east, 3, 1.0, WEST_ORIGIN),
    ):
        if low == high:
            found = None
            if "tile" in df.columns:
                around = math.floor((low - origin) * per_degree)
                near = df.where(_numbered(df, digit, range(around - 1, around + 2)))
                found = nearest_coordinate(near, name, low).head()[0]
            if found is not None and abs(found - low) * per_degree < 1:
                inside = inside & (F.col(name) == found) & _numbered(df, digit, [math.floor((found - origin) * per_degree)])
            else:
                inside = inside & (F.col(name) == nearest_coordinate(df, name, low).scalar())
        else:
            inside = inside & F.col(name).between(low, high)
    return df.where(inside)


def _numbered(df: DataFrame, digit: int, numbers: Sequence[int]) -> Column:
    """Tiles whose number from ``digit`` on is one of ``numbers``; on a stored grid a partition filter on their blocks too."""
    held = F.substring("tile", digit, 2).cast("int").isin(list(numbers))
    if "block" in df.columns:
        held = held & F.substring("block", (digit + 1) // 2, 1).isin(sorted({str(n // 10) for n in numbers}))
    return held


def nearest_coordinate(df: DataFrame, name: str, value: float) -> DataFrame:
    """One row: the coordinate closest to ``value``, the lower one on a tie."""
    return df.agg(F.min(F.struct(F.abs(F.col(name) - F.lit(value)).alias("gap"), F.col(name).alias("at"))).alias("near")).select(
        F.col("near.at").alias(name)
    )


def _axis(low: Column, high: Column, per_degree: int) -> Column:
    numbers = F.sequence(F.floor(low * per_degree), F.floor(high * per_degree))
    return F.when(low < high, F.transform(numbers, lambda i: (i + F.lit(0.5)) / F.lit(float(per_degree))))


def axis_rows(south: Column, north: Column) -> Column:
    """Centre latitudes of the cells from ``south`` to ``north``; NULL unless south < north."""
    return _axis(south, north, ROWS_PER_DEGREE)


def axis_columns(west: Column, east: Column) -> Column:
    """Centre longitudes of the cells from ``west`` to ``east``; NULL unless west < east."""
    return _axis(west, east, COLUMNS_PER_DEGREE)


def tiles_of_box(south: Column, north: Column, west: Column, east: Column) -> Column:
    """Codes of the tiles a box touches, as an array column."""

    def span(low: Column, high: Column) -> Column:
        first = F.floor(low)
        return F.sequence(first, F.greatest(F.ceil(high) - 1, first))

    rows = span(south * F.lit(TILE_ROWS_PER_DEGREE), north * F.lit(TILE_ROWS_PER_DEGREE))
    columns = span(west - F.lit(WEST_ORIGIN), east - F.lit(WEST_ORIGIN))
    return F.flatten(F.transform(rows, lambda p: F.transform(columns, lambda u: _as_text(p, u))))


def listed_tiles(tiles: DataFrame, listed: DataFrame, column: str = "tile") -> DataFrame:
    """Keep the tiles that a grid table really has, such as ``sources.grids.read_tiles`` lists. At most 90 x 90 codes exist."""
    codes = listed.select(column).where(F.col(column).rlike("^[1-9][0-9][1-9][0-9]$")).distinct()
    return tiles.join(F.broadcast(codes), column, "left_semi")


# --- projection ---------------------------------------------------------------------------------

EARTH_RADIUS_M = 6378137.0


def mercator_x(lon: Column) -> Column:
    """EPSG:3857 x of a longitude."""
    return F.lit(EARTH_RADIUS_M) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    """EPSG:3857 y of a latitude."""
    return F.lit(EARTH_RADIUS_M) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
