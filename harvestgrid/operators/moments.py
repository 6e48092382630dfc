"""Moments of every entry of an array column, without a row per entry.

Rows become vectors (known values and a mark for each), which Spark's summarizer adds up entry by entry in partial sums.
The sums of partitions are merged in two levels, so no task takes in one from every partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestgrid.functions.numeric import nan_to_null

# Groups of partitions whose sums are merged first.
FIRST_LEVEL = 64


def _entry_sums(df: DataFrame, entries: Column, by: Sequence[str]) -> DataFrame:
    """``by, sums``: the sum of each entry of an array without nulls; no row for a group without rows."""
    vectors = df.select(*by, F.pmod(F.spark_partition_id(), F.lit(FIRST_LEVEL)).alias("_level"), array_to_vector(entries).alias("_v"))
    for keys in ([*by, "_level"], [*by, "_all"]):
        vectors = vectors.withColumn("_all", F.lit(0)).groupBy(*keys).agg(Summarizer.sum(F.col("_v")).alias("_v"))
    return vectors.select(*by, vector_to_array("_v").alias("sums"))


def entry_means(df: DataFrame, column: str = "features", by: Sequence[str] = ()) -> DataFrame:
    """``by, means``: an array of (n, mean) for the entries of ``column``, over their known values, per group.

    The arrays of all rows must have one length. A row without an array has no part; a group without rows has no row.
    """
    known = F.transform(column, lambda x: nan_to_null(x.cast("double")))
    filled = F.transform(known, lambda x: F.coalesce(x, F.lit(0.0)))
    marks = F.transform(known, lambda x: F.when(x.isNull(), 0.0).otherwise(1.0))
    summed = _entry_sums(df.where(F.col(column).isNotNull()), F.concat(filled, marks), by)
    width = (F.size("sums") / 2).cast("int")
    pairs = F.zip_with(
        F.slice("sums", 1, width),
        F.slice("sums", width + 1, width),
        lambda total, n: F.struct(n.cast("long").alias("n"), F.try_divide(total, n).alias("mean")),
    )
    return summed.select(*by, pairs.alias("means"))


def entry_moments(df: DataFrame, column: str = "features") -> DataFrame:
    """One row: ``moments``, an array of (n, mean, std) for the entries of ``column`` over all rows; empty without rows.

    The sample deviation comes from squared distances to the mean, in a second pass, so large offsets cost no digits.
    It is missing for fewer than two values.
    """
    means = entry_means(df, column).agg(F.first("means").alias("means"))
    gaps = F.zip_with(
        column, "_means", lambda x, m: F.coalesce(F.pow(nan_to_null(x.cast("double")) - m["mean"], F.lit(2.0)), F.lit(0.0))
    )
    squares = _entry_sums(df.where(F.col(column).isNotNull()).withColumn("_means", means.scalar()), gaps, [])
    found = squares.agg(F.first("sums").alias("sums")).withColumn("_means", means.scalar())
    moments = F.zip_with(
        "_means",
        "sums",
        lambda m, square: F.struct(
            m["n"].alias("n"), m["mean"].alias("mean"), F.when(m["n"] > 1, F.sqrt(square / (m["n"] - 1))).alias("std")
        ),
    )
    return found.select(F.coalesce(moments, F.array().cast("array<struct<n:bigint,mean:double,std:double>>")).alias("moments"))
