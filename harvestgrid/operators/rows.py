"""Row order and first rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shuffled(df: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """All rows in a random order that depends only on the keys and the seed.

    Copies of a key stand together, ordered by a second random number so that many of them do not
    fall into one sort task.
    """
    return df.orderBy(F.xxhash64(*keys, F.lit(seed)), F.rand(seed))


def first_rows(df: DataFrame, order: Sequence[str], count: int) -> DataFrame:
    """The first rows by an order; Spark keeps ``count`` rows per task, not a full sort."""
    return df.orderBy(*order).limit(count)
