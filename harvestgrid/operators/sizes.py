"""Broadcasts behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
# Rows are measured as JSON text, which takes about as much room as an executor's hash table of them.
BROADCAST_BYTES = 256 << 20


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame marked for broadcast if a measure, which stops past ``rows``, shows that it is small in rows and bytes.

    Otherwise it comes back unmarked and Spark joins it by shuffle, splitting hot keys adaptively.
    """
    size = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    found = df.limit(rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).head()
    return F.broadcast(df) if found.rows <= rows and found.bytes <= BROADCAST_BYTES else df
