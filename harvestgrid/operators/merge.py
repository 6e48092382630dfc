"""Repairs of the weather table: column backfill and the update-merge of vapour pressure."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestgrid.functions.timegrid import season_year
from harvestgrid.operators.panel import bounded_year
from harvestgrid.operators.quality import ensure_columns, require_columns
from harvestgrid.operators.ranges import range_join
from harvestgrid.operators.sizes import broadcast_if_small
from harvestgrid.sources.sinks import rewrite_partitions

# The column that drifted, where its values went, and the first season affected.
DRIFTED, DRIFTED_TO, FIRST_DRIFTED_SEASON = "OPR", "OPRori", 2017

# A season holds up to 366 days, some 6 kB.
SEASON_ROWS = 5_000
SEASON_DAYS = 366
# Updates that a task makes and holds by key at a time, some 150 bytes each.
TASK_UPDATES = 2_000_000


def backfill_column(
    df: DataFrame, target: str = DRIFTED, source: str = DRIFTED_TO, condition: Column | None = None, season: str = "year"
) -> DataFrame:
    """Copy ``source`` over ``target`` where the condition holds, missing values included."""
    late = F.col(season) >= FIRST_DRIFTED_SEASON if condition is None else condition
    return require_columns(df, [target, source]).withColumn(target, F.when(late, F.col(source)).otherwise(F.col(target)))


def season_updates(sheet: DataFrame, targets: DataFrame, value: str = "VP", on: Sequence[str] = ()) -> DataFrame:
    """``on, place, year, date, value`` for every target and every sheet day in its season.

    Seasons do not overlap, so this is an equi-join on the season. The sheet becomes one row per
    season (and source) of at most 366 days before it meets the targets; a day given twice raises.
    ``on`` names further key columns, such as a station, that both inputs carry. Targets are few bytes for the days they
    become, so they are dealt to as many tasks as their updates need, not as their bytes do.
    """
    day = F.concat(F.lit("date given twice: "), F.col("date").cast("string"))
    once = (
        sheet.where(F.col("date").isNotNull())
        .groupBy(*on, "date")
        .agg(F.any_value(value).alias(value), F.count(F.lit(1)).alias("_n"))
        .withColumn("_n", F.when(F.col("_n") == 1, F.col("_n")).otherwise(F.raise_error(day).cast("long")))
    )
    seasons = (
        once.where(F.col("_n") == 1)
        .withColumn("year", season_year(F.col("date")))
        .where(F.col("year").isNotNull())
        .groupBy(*on, "year")
        .agg(F.collect_list(F.struct("date", value)).alias("_days"))
    )
    wanted = targets.select(*on, "place", F.col("year").cast("int").alias("year")).distinct()
    tasks = ceil(targets.count() * SEASON_DAYS / TASK_UPDATES)
    if tasks > 1:
        wanted = wanted.repartition(tasks, *on, "place", "year")
    return (
        wanted.join(broadcast_if_small(seasons, SEASON_ROWS), [*on, "year"])
        .select(*on, "place", "year", F.explode("_days").alias("_day"))
        .select(*on, "place", "year", "_day.date", F.col(f"_day.{value}").alias(value))
    )


def period_updates(sheet: DataFrame, targets: DataFrame, value: str = "VP", on: Sequence[str] = ()) -> DataFrame:
    """``on, place, start, end, date, value`` for every target and every sheet day from its ``start`` to its ``end``.

    Unlike seasons, periods may overlap and differ from target to target, so this is a range join. A target given twice counts once; a
    day given twice comes twice.
    """
    wanted = targets.select(*on, "place", "start", "end").distinct()
    return range_join(sheet.select(*on, "date", value), wanted, "date", "start", "end", on).select(
        *on, "place", "start", "end", "date", value
    )


def _unique_updates(updates: DataFrame, keys: Sequence[str], value: str, flag: str) -> DataFrame:
    """One row per key; a key given twice raises, also where only other columns are read."""
    name = F.concat_ws(" ", F.lit("update given twice:"), *[F.col(k).cast("string") for k in keys])
    once = updates.groupBy(*keys).agg(F.any_value(value).alias("_new"), F.count(F.lit(1)).alias("_n"))
    checked = once.where(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(name).cast("boolean")))
    return checked.select(*keys, "_new", F.lit(True).alias(flag))


def update_merge(
    df: DataFrame, updates: DataFrame, value: str = "VP", mark: str | None = None, on: Sequence[str] = ()
) -> DataFrame:
    """Set ``value`` on the rows with an update for (on, place, year, date); all other rows stay as they are.

    Two updates for one key raise. A matched row takes a missing value too. The column is added if absent. ``mark`` keeps a boolean
    column that tells matched rows apart; counting it gives the rows affected. A few updates are
    broadcast, so the table itself is not shuffled for them.
    """
    keys = [*on, "place", "year", "date"]
    df = ensure_columns(df, {value: "double"})
    flag = mark or "_matched"
    new = _unique_updates(updates, keys, value, flag)
    joined = df.join(broadcast_if_small(new), keys, "left").withColumns(
        {
            value: F.when(F.col(flag), F.col("_new")).otherwise(F.col(value)),
            flag: F.coalesce(flag, F.lit(False)),
        }
    )
    return joined.select(*df.columns, *([flag] if mark else []))


def merge_vapour_pressure(weather: DataFrame, sheet: DataFrame, targets: DataFrame, mark: str | None = None) -> DataFrame:
    return update_merge(weather, season_updates(sheet, targets), "VP", mark)


def apply_vapour_pressure(weather: DataFrame, sheet: DataFrame, targets: DataFrame, path: str) -> None:
    """Update the stored table in place, rewriting only the seasons that have targets.

    ``weather`` is the table at ``path``, partitioned by ``year``, and already has a ``VP`` column.
    """
    require_columns(weather, ["VP"])
    years = targets.agg(F.collect_set(bounded_year(F.col("year").cast("int")))).head()[0]
    affected = weather.where(F.col("year").isin(years))
    rewrite_partitions(merge_vapour_pressure(affected, sheet, targets), path, ["year"])


def apply_backfill(weather: DataFrame, path: str, first_season: int = FIRST_DRIFTED_SEASON) -> None:
    """Backfill the stored table in place, reading and rewriting only the late seasons."""
    rewrite_partitions(backfill_column(weather.where(F.col("year") >= first_season), condition=F.lit(True)), path, ["year"])
