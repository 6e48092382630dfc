"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame

from harvestgrid.session import shared_folder

# A row of ids takes some 16 bytes in a hash relation's key, so this is at most some 100 MB on an executor.
BROADCAST_IDS = 1_000_000


def cut(df: DataFrame) -> DataFrame:
    """Compute the frame once and keep it in the shared folder, so that later steps start from files there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; it is set only where that is unset.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def plain_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have."""
    name, taken = stem, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
