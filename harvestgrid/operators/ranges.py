"""Join of points with ranges that hold them, as an equi-join on bins with an exact check of the ends.

A range's bins are as wide as the least power of two that is not below its length, so it lies in at most two of them; a point
looks into one bin per width that occurs. Long and short ranges may be mixed: no range is cut into many rows,
no point is compared with ranges far away, and each pair meets in one bin only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _position(df: DataFrame, name: str) -> Column:
    """Dates as days and timestamps as microseconds since 1970; whole numbers as they are."""
    kind = dict(df.dtypes)[name]
    if kind == "date":
        return F.unix_date(name).cast("long")
    if kind == "timestamp":
        return F.unix_micros(F.col(name))
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(name).cast("long")
    raise ValueError(f"no range join on a {kind}")


def range_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, on: Sequence[str] = ()) -> DataFrame:
    """Every pair of a point and a range with ``start <= at <= end`` (and equal ``on``): the ``on`` columns, then those of both.

    Points and ranges may repeat and ranges may overlap; a missing bound or point, and a range that ends before it
    starts, match nothing. Other columns of the two frames must have different names.
    """
    low, high = _position(ranges, start), _position(ranges, end)
    # ceil(log2(length + 1)) from the length's binary digits: exact for all lengths.
    width = F.when(high == low, F.lit(0)).otherwise(F.length(F.bin(high - low))).cast("int")
    sized = ranges.where(low <= high).withColumns({"_low": low, "_high": high, "_width": width})
    # At most 64 widths exist.
    widths = sorted(r["_width"] for r in sized.select("_width").distinct().collect())
    first, last = F.expr("shiftright(_low, _width)"), F.expr("shiftright(_high, _width)")
    binned = sized.withColumn("_bin", F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last))))
    levels = F.lit(widths) if widths else F.array().cast("array<int>")
    looking = points.where(F.col(at).isNotNull()).withColumn("_at", _position(points, at)).withColumn("_width", F.explode(levels))
    looking = looking.withColumn("_bin", F.expr("shiftright(_at, _width)"))
    met = looking.join(binned, [*on, "_width", "_bin"]).where(F.col("_at").between(F.col("_low"), F.col("_high")))
    rest = [c for c in points.columns if c not in on] + [c for c in ranges.columns if c not in on]
    return met.select(*on, *rest)
