"""Observed values against climate normals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestgrid.functions.numeric import anomaly_sign
from harvestgrid.functions.timegrid import DayRange

KEYS = ("element", "mesh_code", "date")


def observed_and_normal(observed: DataFrame, normal: DataFrame) -> DataFrame:
    """``element, mesh_code, date, normal, obs`` for the keys on both sides."""
    left = observed.select(*KEYS, F.col("value").alias("obs"))
    right = normal.select(*KEYS, F.col("value").alias("normal"))
    return left.join(right, list(KEYS)).select(*KEYS, "normal", "obs")


def both_kinds(grid: DataFrame, days: DayRange) -> DataFrame:
    """``element, mesh_code, date, normal, obs`` for the keys that a grid table has of both kinds, in one scan.

    Years and days are filters of the scan; both kinds meet in one aggregate. A key has one value of each kind.
    """
    asked = grid.where(F.col("kind").isin("observed", "normal") & F.col("year").isin(days.years) & days.holds(F.col("date")))

    def of(kind: str) -> tuple[Column, Column]:
        own = F.col("kind") == kind
        return F.max(F.when(own, F.col("value"))), F.count_if(own)

    (normal, normals), (obs, seen) = of("normal"), of("observed")
    pairs = asked.groupBy(*KEYS).agg(normal.alias("normal"), obs.alias("obs"), normals.alias("_normals"), seen.alias("_seen"))
    return pairs.where("_normals > 0 AND _seen > 0").select(*KEYS, "normal", "obs")


def anomalies(pairs: DataFrame, today: dt.date) -> DataFrame:
    """Both values of ``observed_and_normal`` or ``both_kinds``, their difference, its sign, a mark on the reference day."""
    return pairs.withColumns(
        {
            "anomaly": F.col("obs") - F.col("normal"),
            "sign": anomaly_sign(F.col("obs"), F.col("normal")),
            "is_today": F.col("date") == F.lit(today),
        }
    )


def date_table(pairs: DataFrame) -> DataFrame:
    """The table of one point: ``Date, Normal, Obs.`` in time order."""
    return pairs.orderBy("date").select(
        F.col("date").alias("Date"), F.col("normal").alias("Normal"), F.col("obs").alias("Obs.")
    )
