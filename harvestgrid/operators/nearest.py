"""Exact nearest-place join by great-circle distance.

Places are grouped into ever finer degree cells, each with one of its places and their number. A
point starts with the coarse cells that can matter to it, keeps those that can still beat its best
place so far, and looks at the finer cells inside them. Levels are joins on the cell key and
windows per point over one row per open cell, so no point ever meets all places, and neither a dense
city, nor many points in one spot, nor many places equally far form a group that has to be held at once.

Positions are unit vectors: straight-line distances order points as great circles do and need no
trigonometry per pair. Distances equal to the millimetre are ties; the lowest place id wins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harvestgrid.operators.sizes import BROADCAST_ROWS, broadcast_if_small
from harvestgrid.sources.sinks import stored

EARTH_RADIUS_M = 6371008.8

# Cell sizes in degrees. The first has at most 12 x 23 cells on the whole earth.
CELL_SIZES = tuple(16.0 / 4**level for level in range(11))
# Levels that are always broadcast: at most 276 x 16^2 cells of some 100 bytes, whatever the gazetteer holds.
COARSE_LEVELS = 2
KEY_SHIFT = 1 << 26

# Key of a distinct point.
SPOT = ("spot", "lat", "lon")

# Straight-line margin, in earth radii, that covers rounding and the millimetre rule.
MARGIN = 1e-9


def _cell_key(lat: Column, lon: Column, size: float) -> Column:
    row = F.floor((lat + 90.0) / size)
    column = F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / size)
    return row * KEY_SHIFT + column


def _position(lat: Column, lon: Column, prefix: str = "") -> list[Column]:
    """Unit vector of a point as three columns."""
    phi, lam = F.radians(lat), F.radians(lon)
    axes = (F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))
    return [axis.alias(prefix + name) for axis, name in zip(axes, "xyz")]


def _cell_position(key: Column, size: float, prefix: str) -> list[Column]:
    lat = (F.floor(key / F.lit(float(KEY_SHIFT))) + 0.5) * size - 90.0
    lon = (F.pmod(key, F.lit(KEY_SHIFT)) + 0.5) * size - 180.0
    return _position(lat, lon, prefix)


def _spot() -> Column:
    return F.xxhash64("lat", "lon")


def _cell_radius(size: float) -> float:
    """No point of a cell is farther from its centre, in earth radii."""
    return math.radians(size) * math.sqrt(0.5)


def _chord(left: str, right: str) -> Column:
    dx, dy, dz = (F.col(left + axis) - F.col(right + axis) for axis in "xyz")
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def _rated(chord: Column, place: str) -> Column:
    """A place with its distance, ordered by millimetre and id; NULL without a place."""
    metres = F.round(F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(chord / 2, F.lit(1.0))), 3)
    rated = F.struct(metres.alias("dist"), F.col(place).alias("place"), chord.alias("chord"))
    return F.when(F.col(place).isNotNull(), rated)


# --- gazetteer ----------------------------------------------------------------------------------


def _known(df: DataFrame) -> DataFrame:
    return df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def _places(gazetteer: DataFrame) -> DataFrame:
    """One place per position, the one with the lowest id; its names stay apart until the end."""
    named = _known(gazetteer).groupBy("lat", "lon").agg(F.min(F.struct("place_id", "name", "admin1")).alias("p"))
    place = F.struct(F.col("p.place_id").alias("place_id"), "lat", "lon")
    return named.select(
        "lat", "lon", place.alias("place"), "p.name", "p.admin1", *_position(F.col("lat"), F.col("lon"), "place_")
    )


def _depth(places: DataFrame, per_cell: int) -> tuple[int, int]:
    """Index of the coarsest size at which no cell holds more places than ``per_cell``; number of places."""
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("level"), _cell_key(F.col("lat"), F.col("lon"), s).alias("key"))
            for i, s in enumerate(CELL_SIZES)
        ]
    )
    fullest = (
        places.select(F.explode(cells).alias("c"))
        .groupBy("c.level", "c.key")
        .count()
        .groupBy("level")
        .agg(F.max("count").alias("fullest"), F.sum("count").alias("places"))
    )
    fits, count = fullest.agg(F.min(F.when(F.col("fullest") <= per_cell, F.col("level"))), F.max("places")).head()
    return (len(CELL_SIZES) - 1 if fits is None else fits), count or 0


def _all_cells(places: DataFrame, last: int) -> DataFrame:
    """Cells of all levels in one pass: level, parent cell, key, number of places, and the place with the lowest id."""
    lat, lon = F.col("lat"), F.col("lon")
    own = [
        F.struct(
            F.lit(level).alias("level"),
            _cell_key(lat, lon, CELL_SIZES[max(level - 1, 0)]).alias("parent"),
            _cell_key(lat, lon, CELL_SIZES[level]).alias("key"),
        )
        for level in range(last + 1)
    ]
    sample = F.struct("place", "place_x", "place_y", "place_z")
    return (
        places.select(F.explode(F.array(*own)).alias("c"), sample.alias("sample"))
        .groupBy("c.level", "c.parent", "c.key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("sample").alias("sample"))
    )


def _cells(cells: DataFrame, level: int) -> DataFrame:
    """Cells of a level with their centres."""
    own = cells.where(F.col("level") == level)
    return own.select("parent", "key", "n", *_cell_position(F.col("key"), CELL_SIZES[level], "cell_"), "sample.*")


def _starts(spots: DataFrame, cells: DataFrame) -> DataFrame:
    """Per coarse cell with points in it: the coarse cells that can matter to any of them.

    Both sides are coarse cells, at most 276 of each, so the result has at most 276 x 276 rows.
    """
    size, radius = CELL_SIZES[0], _cell_radius(CELL_SIZES[0])
    coarse = _cells(cells, 0).drop("parent")
    gathered = coarse.agg(F.collect_list(F.struct(*coarse.columns)).alias("all"))
    own = spots.select(_cell_key(F.col("lat"), F.col("lon"), size).alias("parent")).distinct()
    pairs = (
        own.withColumn("all", gathered.scalar())
        .select("parent", *_cell_position(F.col("parent"), size, "own_"), F.explode("all").alias("cell"))
        .select("parent", "own_x", "own_y", "own_z", "cell.*")
    )
    farthest = F.min(_chord("own_", "place_") + radius).over(W.partitionBy("parent"))
    near = _chord("own_", "cell_") - 2 * radius <= F.col("farthest") + MARGIN
    return pairs.withColumn("farthest", farthest).where(near).select("parent", *coarse.columns)


# --- search -------------------------------------------------------------------------------------


def _alone() -> Column:
    """A key that no cell has, so that points without an open cell spread over the join's partitions."""
    return -1 - F.pmod(F.xxhash64("lat", "lon"), F.lit(1 << 40))


def _within_reach(chord: Column) -> Column:
    return F.col("best").isNull() | (chord <= F.col("best.chord") + MARGIN)


def _narrow(found: DataFrame, cells: DataFrame, level: int) -> DataFrame:
    """One row per point and finer cell that may hold a better place than the best one seen, or one row without a cell.

    Only cells that can still matter leave the join. The window spills; its rows need not fit in memory.
    """
    chord = _chord("", "place_")
    gap = _chord("", "cell_") - _cell_radius(CELL_SIZES[level])
    useful = _within_reach(chord) | ((F.col("n") > 1) & _within_reach(gap))
    placed = found.select("*", *_position(F.col("lat"), F.col("lon")))
    rated = placed.join(cells, (F.col("node") == F.col("parent")) & useful, "left").select(
        *SPOT, F.least("best", _rated(chord, "place")).alias("best"), "key", F.when(F.col("n") > 1, gap).alias("gap")
    )
    nearest_first = W.partitionBy(*SPOT).orderBy(F.col("gap").asc_nulls_last())
    whole = nearest_first.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = rated.select(
        *SPOT, "key", "gap", F.min("best").over(whole).alias("best"), F.row_number().over(nearest_first).alias("rank")
    )
    is_open = F.coalesce(F.col("gap") <= F.col("best.chord") + MARGIN, F.lit(False))
    node = F.when(is_open, F.col("key")).otherwise(_alone())
    return ranked.where(is_open | (F.col("rank") == 1)).select(*SPOT, "best", node.alias("node"))


def nearest_place(points: DataFrame, gazetteer: DataFrame, per_cell: int = 64) -> DataFrame:
    """``points`` with ``city``, ``prefecture`` and ``distance_m`` of the nearest place.

    ``gazetteer`` has place_id, name, admin1, lat, lon. Equal points are searched once. Points
    without coordinates, and all points if there are no places, get NULLs. Coarse levels are always broadcast, finer
    ones up to a counted limit of places; so far the search runs without a shuffle once the points are unique.
    """
    places = stored(_places(gazetteer), "places")
    last, count = _depth(places, per_cell)
    cells = stored(_all_cells(places, last), "place_cells", ("level",))
    small = count <= BROADCAST_ROWS
    # Points are few bytes and much work, so their number of tasks is set, not left to their size.
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spots = _known(points.select("lat", "lon")).distinct().withColumn("spot", _spot()).repartition(tasks, "spot")

    no_best = "struct<dist:double,place:struct<place_id:bigint,lat:double,lon:double>,chord:double>"
    own_cell = _cell_key(F.col("lat"), F.col("lon"), CELL_SIZES[0])
    found = spots.select(*SPOT, F.lit(None).cast(no_best).alias("best"), own_cell.alias("node"))
    found = _narrow(found, F.broadcast(_starts(spots, cells)), 0)
    for level in range(1, last + 1):
        finer = _cells(cells, level)
        found = _narrow(found, F.broadcast(finer) if small or level <= COARSE_LEVELS else finer, level)

    key = _cell_key(F.col("lat"), F.col("lon"), CELL_SIZES[last])
    in_cells = places.select(key.alias("parent"), "place", "place_x", "place_y", "place_z")
    chord = _chord("", "place_")
    best = (
        found.select("*", *_position(F.col("lat"), F.col("lon")))
        .join(F.broadcast(in_cells) if small else in_cells, (F.col("node") == F.col("parent")) & _within_reach(chord), "left")
        .groupBy(*SPOT)
        .agg(F.min(F.least("best", _rated(chord, "place"))).alias("best"))
    )
    names = places.select("place", F.col("name").alias("_city"), F.col("admin1").alias("_prefecture"))
    answers = best.select(*SPOT, F.col("best.place").alias("place"), F.col("best.dist").alias("_dist")).join(
        broadcast_if_small(names, BROADCAST_ROWS), "place", "left"
    )
    # Answers lie by spot alone, so this join shuffles both sides and a hot spot can be split.
    return points.withColumn("spot", _spot()).join(answers.drop("place"), [*SPOT], "left").select(
        *points.columns,
        F.col("_city").alias("city"),
        F.col("_prefecture").alias("prefecture"),
        F.col("_dist").alias("distance_m"),
    )
