"""Yield panel: one row per (loc_id, year) with the features as one array.

Statistics are one-row results read as scalar subqueries, so the panel itself is never shuffled or
joined to be scaled. Sizes of what they hold are bounded: one entry per feature, or one per year, and
a year outside 1..9999 raises.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestgrid.functions.numeric import nan_to_null, z_score
from harvestgrid.operators.moments import entry_means, entry_moments
from harvestgrid.operators.sizes import broadcast_if_small

KEYS = ("loc_id", "year")


def bounded_year(year: Column) -> Column:
    """The year itself; raises outside 1..9999, which bounds how many years can be gathered."""
    message = F.concat(F.lit("year out of range: "), year.cast("string"))
    return F.when(year.isNull() | year.between(1, 9999), year).otherwise(F.raise_error(message).cast("int"))


# --- keys ---------------------------------------------------------------------------------------


def keep_last(df: DataFrame, order: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per key: the one with the greatest ``order`` value.

    A NULL order, and different rows that share the greatest order, raise. Without ``order`` a repeated
    key raises. Repeats are dropped in the map-side half of the
    aggregate, so a key with very many copies stays cheap.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    row = F.struct(*rest)
    text = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    if order is not None:
        # The greatest and the least print among the rows of the greatest order differ only on a tie.
        mark = F.xxhash64(row)
        kept = df.groupBy(*keys).agg(
            F.max_by(row, F.col(order)).alias("_row"),
            F.max(F.struct(F.col(order).alias("o"), mark.alias("h"))).alias("_high"),
            F.max(F.struct(F.col(order).alias("o"), F.bitwise_not(mark).alias("h"))).alias("_low"),
            F.count_if(F.col(order).isNull()).alias("_unordered"),
        )
        clear = (F.col("_unordered") == 0) & (F.col("_high.h") == F.bitwise_not("_low.h"))
        no_order = F.raise_error(F.concat(F.lit("no order among rows of key: "), text))
        kept = kept.where(F.when(clear, True).otherwise(no_order.cast("boolean")))
    else:
        repeated = F.raise_error(F.concat(F.lit("repeated key: "), text))
        kept = df.groupBy(*keys).agg(F.any_value(row).alias("_row"), F.count(F.lit(1)).alias("_n"))
        kept = kept.where(F.when(F.col("_n") == 1, True).otherwise(repeated.cast("boolean")))
    return kept.select(*keys, "_row.*")


def drop_repeats(df: DataFrame, order: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """What ``keep_last`` gives, for a stored frame that is read again at little cost.

    A count over the keys alone finds the repeated ones first, so only their rows are shuffled whole.
    """
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys])
    columns = [*keys, *[c for c in df.columns if c not in keys and c != order]]
    singles = df
    if order is not None:
        text = F.concat_ws(", ", F.lit("no order among rows of key:"), *[F.col(k).cast("string") for k in keys])
        singles = df.where(F.when(F.col(order).isNotNull(), True).otherwise(F.raise_error(text).cast("boolean")))
    if repeated.isEmpty():
        return singles.select(*columns)
    found = broadcast_if_small(repeated)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return (
        singles.join(found, same, "left_anti").select(*columns).union(keep_last(df.join(found, same, "left_semi"), order, keys).select(*columns))
    )


def distinct_years(panel: DataFrame) -> DataFrame:
    """Years seen anywhere, ascending."""
    return panel.select("year").distinct().orderBy("year")


def year_list(panel: DataFrame) -> DataFrame:
    """One row: all years seen anywhere as an ascending array ``years``."""
    years = panel.groupBy("year").agg(F.count(F.lit(1)).alias("_n"))
    return years.agg(F.array_sort(F.collect_list(bounded_year(F.col("year")))).alias("years"))


def rows_per_year(df: DataFrame, year: str = "year") -> DataFrame:
    return df.groupBy(year).agg(F.count(F.lit(1)).alias("rows"))


# --- scaling ------------------------------------------------------------------------------------


def feature_stats(panel: DataFrame, last_training_year: int) -> DataFrame:
    """One row: per feature (pos, mean, std) over the training years, as an array ``stats``.

    Sample deviation; missing values are skipped; a deviation of 0 becomes 1. Rows with a low yield
    count here. Partial sums of whole arrays are merged (``operators.moments``); no feature becomes a row.
    """
    moments = entry_moments(panel.where(F.col("year") <= last_training_year))
    return moments.select(
        F.transform(
            "moments",
            lambda m, k: F.struct(
                k.alias("pos"), m["mean"].alias("mean"), F.when(m["std"] == 0, F.lit(1.0)).otherwise(m["std"]).alias("std")
            ),
        ).alias("stats")
    )


def standardise(panel: DataFrame, stats: DataFrame) -> DataFrame:
    """Features as z-scores by the given statistics; missing stays missing."""
    scaled = F.zip_with(
        "features", "_stats", lambda x, s: (nan_to_null(x) - s["mean"]) / s["std"]
    )
    return panel.withColumn("_stats", stats.scalar()).withColumn("features", scaled).drop("_stats")


def fill_missing(panel: DataFrame) -> DataFrame:
    """Missing features and yields become 0."""
    zero = F.lit(0.0)
    return panel.withColumns(
        {
            "yield": F.coalesce(nan_to_null(F.col("yield")), zero),
            "features": F.transform("features", lambda x: F.coalesce(nan_to_null(x), zero)),
        }
    )


def keep_yields(panel: DataFrame, minimum: float = 5.0) -> DataFrame:
    """Rows with at least the minimum yield. A missing or NaN yield is dropped."""
    return panel.where((F.col("yield") >= minimum) & ~F.isnan("yield"))


def prepare_panel(panel: DataFrame, last_training_year: int = 2017, minimum_yield: float = 5.0) -> DataFrame:
    """Scale by the training years, fill, then drop low yields, in that order.

    A filled yield of 0 never reaches a minimum above 0, so the filter then runs first, on the stored
    column, where the scan can apply it.
    """
    scaled = standardise(panel, feature_stats(panel, last_training_year))
    if minimum_yield > 0:
        return fill_missing(keep_yields(scaled, minimum_yield))
    return keep_yields(fill_missing(scaled), minimum_yield)


# --- years --------------------------------------------------------------------------------------


def yearly_yield(panel: DataFrame) -> DataFrame:
    return panel.groupBy("year").agg(F.avg("yield").alias("avg_yield"))


def year_scalars(panel: DataFrame, holdout_year: int | None = None) -> DataFrame:
    """``year, avg_yield, ybar``: the mean yield and its z-score over the yearly means.

    If the hold-out year is absent and the year before is there, it takes that year's values.
    """
    entry = F.struct(bounded_year(F.col("year")).alias("year"), "avg_yield")
    gathered = yearly_yield(panel).agg(
        F.collect_list(entry).alias("years"),
        F.avg("avg_yield").alias("mean"),
        F.stddev_samp("avg_yield").alias("std"),
    )
    years = F.col("years")
    if holdout_year is not None:
        copied = F.transform(
            F.filter("years", lambda y: y["year"] == holdout_year - 1),
            lambda y: F.struct(F.lit(holdout_year).alias("year"), y["avg_yield"].alias("avg_yield")),
        )
        present = F.exists("years", lambda y: y["year"] == holdout_year)
        years = F.when(present, years).otherwise(F.concat(years, copied))
    return (
        gathered.select("mean", "std", F.explode(years).alias("y"))
        .select("y.year", "y.avg_yield", z_score(F.col("y.avg_yield"), F.col("mean"), F.col("std")).alias("ybar"))
    )


def year_map(scalars: DataFrame) -> DataFrame:
    """One row: map from year to (avg_yield, ybar)."""
    entry = F.struct(bounded_year(F.col("year")), F.struct("avg_yield", "ybar"))
    return scalars.agg(F.map_from_entries(F.collect_list(entry)).alias("by_year"))


def mean_vectors(panel: DataFrame, years: Sequence[int]) -> DataFrame:
    """``year, features``: the mean feature vector of each chosen year that has rows."""
    means = entry_means(panel.where(F.col("year").isin(list(years))), by=["year"])
    return means.select("year", F.transform("means", lambda m: m["mean"]).alias("features"))


def mean_year_steps(panel: DataFrame, scalars: DataFrame, years: Sequence[int], width: int) -> DataFrame:
    """One row: ``steps``, an array of (year, features, ybar, avg_yield) for the chosen years in order.

    A year without rows has zeros for features and ybar, and no mean yield.
    """
    asked = panel.sparkSession.range(1).select(F.explode(F.array(*[F.lit(int(y)) for y in years])).alias("year"))
    vectors = mean_vectors(panel, years)
    known = scalars.where(F.col("year").isin(list(years))).withColumnRenamed("year", "_year")
    step = F.struct(
        "year",
        F.coalesce("features", F.array_repeat(F.lit(0.0), width)).alias("features"),
        F.when(F.col("features").isNull(), 0.0).otherwise(F.col("ybar")).alias("ybar"),
        "avg_yield",
    )
    return (
        asked.join(vectors, "year", "left")
        .join(known, F.col("year") == F.col("_year"), "left")
        .agg(F.array_sort(F.collect_list(step)).alias("steps"))
    )
