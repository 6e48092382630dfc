"""Five-step sequences for training and hold-out, and their feature groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harvestgrid.operators import panel as P
from harvestgrid.sources.tables import GROUP_SIZES

GROUP_NAMES = ("e", "s", "p")


def feature_groups(features: Column, sizes: Sequence[int] = GROUP_SIZES, names: Sequence[str] = GROUP_NAMES) -> dict[str, Column]:
    """Slices of a feature array by group name."""
    start, groups = 1, {}
    for name, size in zip(names, sizes):
        groups[name] = F.slice(features, start, size)
        start += size
    return groups


def reshape(values: Column, rows: int, columns: int) -> Column:
    """A flat array as ``rows`` arrays of ``columns`` values."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(values, i * columns + 1, columns))


def _step(features: Column, ybar: Column, sizes: Sequence[int], keep: Sequence[str]) -> Column:
    groups = feature_groups(features, sizes)
    return F.struct(*[groups[name].alias(name) for name in keep], ybar.alias("ybar"))


def training_sequences(
    panel: DataFrame,
    scalars: DataFrame,
    holdout_year: int,
    sizes: Sequence[int] = GROUP_SIZES,
    keep: Sequence[str] = GROUP_NAMES,
    length: int = 5,
) -> DataFrame:
    """Complete runs of ``length`` years per location, without the hold-out year.

    Years count as consecutive in the list of all years seen in the panel. The last yield is the
    target and the others stand in ``y_prev``. Columns: loc_id, years, steps, y_last, y_prev. With
    ``keep=('e',)`` the steps hold the environment group and ybar only. A repeated key raises.

    One shuffle, by location; a location has at most one row per year. A run that would hold the
    hold-out year is incomplete once that year's rows are gone, so they never reach the shuffle.
    """
    ranked = (
        panel.withColumns(
            {"_years": P.year_list(panel).scalar(), "_scalars": P.year_map(scalars).scalar()}
        )
        .where(F.col("year") != holdout_year)
        .select(
            "loc_id",
            "year",
            "yield",
            F.array_position("_years", F.col("year")).alias("_rank"),
            _step(F.col("features"), F.try_element_at("_scalars", F.col("year"))["ybar"], sizes, keep).alias("_step"),
        )
    )
    run = W.partitionBy("loc_id").orderBy("_rank").rangeBetween(1 - length, 0)
    entries = F.collect_list(F.struct("year", "yield", F.col("_step").alias("step"))).over(run)
    runs = ranked.select("loc_id", entries.alias("_run"))
    repeated = F.raise_error(F.concat(F.lit("repeated year at location "), F.col("loc_id").cast("string")))
    single = F.size(F.array_distinct("_run.year")) == F.size("_run")
    complete = runs.where(F.when(single, F.size("_run") == length).otherwise(repeated.cast("boolean")))
    return complete.select(
        "loc_id",
        F.col("_run.year").alias("years"),
        F.col("_run.step").alias("steps"),
        F.element_at("_run.yield", -1).alias("y_last"),
        F.slice("_run.yield", 1, length - 1).alias("y_prev"),
    )


def holdout_sequences(
    panel: DataFrame,
    scalars: DataFrame,
    means: DataFrame,
    holdout_year: int,
    sizes: Sequence[int] = GROUP_SIZES,
    keep: Sequence[str] = GROUP_NAMES,
) -> DataFrame:
    """One sequence per location with hold-out rows: the steps of ``mean_year_steps``, then its own year.

    ``y_prev`` holds the raw mean yields of the mean years, missing where a year has no rows. The
    mean steps are one small row read as a scalar subquery; no shuffle of the panel.
    """
    shared = F.transform("_means", lambda m: _step(m["features"], m["ybar"], sizes, keep))
    ybar = F.try_element_at("_scalars", F.col("year"))["ybar"]
    own = _step(F.col("features"), ybar, sizes, keep)
    return (
        panel.where(F.col("year") == holdout_year)
        .withColumns({"_means": means.scalar(), "_scalars": P.year_map(scalars).scalar()})
        .select(
            "loc_id",
            F.concat(F.col("_means.year"), F.array("year")).alias("years"),
            F.concat(shared, F.array(own)).alias("steps"),
            F.col("yield").alias("y_last"),
            F.col("_means.avg_yield").alias("y_prev"),
        )
    )


def keyed_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str] = P.KEYS) -> DataFrame:
    """Rows of ``left`` with the columns of ``right`` for the same key."""
    return left.join(right, list(keys), "inner")


def with_existing_key(left: DataFrame, right: DataFrame, keys: Sequence[str] = P.KEYS) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    return left.join(right.select(*keys), list(keys), "left_semi")


def long_steps(sequences: DataFrame) -> DataFrame:
    """One row per step: loc_id, last_year, step, year, the step's groups, step_yield and y_last."""
    yields = F.concat("y_prev", F.array("y_last"))
    zipped = F.arrays_zip(F.col("years").alias("year"), F.col("steps").alias("step"), yields.alias("step_yield"))
    exploded = sequences.select(
        "loc_id", F.element_at("years", -1).alias("last_year"), "y_last", F.posexplode(zipped).alias("pos", "entry")
    )
    return exploded.select(
        "loc_id", "last_year", (F.col("pos") + 1).alias("step"), "entry.year", "entry.step.*", "entry.step_yield", "y_last"
    )
