"""Small numeric and text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def round_even(value: Column, digits: int = 1) -> Column:
    """Round half to even at a decimal place."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def nearest_int(value: Column) -> Column:
    return F.rint(value).cast("int")


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return F.try_divide(value - mean, std)


def anomaly_sign(observed: Column, normal: Column) -> Column:
    """1 above, -1 below, 0 at the normal; NULL if either is missing."""
    return F.signum(observed - normal).cast("int")


def label(name: Column, unit: Column, opening: str = " (", closing: str = ")") -> Column:
    return F.concat(name, F.lit(opening), unit, F.lit(closing))
