"""Writers. Spark writes a folder of part files; no byte-order mark and no row order is added."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from harvestgrid.session import new_table_path


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, skip_empty: bool = False) -> bool:
    """CSV with a header line; False and nothing written if there are no rows and ``skip_empty``."""
    if skip_empty and df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", header).option("sep", delimiter).csv(path)
    return True


def _by_partition(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of a partition brought together; adaptive execution splits a large one over several tasks."""
    return df.hint("rebalance", *partition_by) if partition_by else df


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), skip_empty: bool = False) -> bool:
    if skip_empty and df.isEmpty():
        return False
    _by_partition(df, partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return True


def stored(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """The frame written to the shared folder and read back: later steps reuse it, and a lost executor
    costs a re-read, not the whole lineage."""
    path = new_table_path(df.sparkSession, name)
    write_parquet(df, path, partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def replace_table(df: DataFrame, name: str, partition_by: Sequence[str] = ("year",), path: str | None = None) -> None:
    """Create or replace a catalog table; earlier repairs of the table are lost with it."""
    writer = _by_partition(df, partition_by).write.mode("overwrite").partitionBy(*partition_by)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def swap_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> str:
    """Replace what ``name`` shows by ``df`` in one step; gives the name of the table that now holds the rows.

    The rows go to a table of their own on a fresh path; only when all are written is the view ``name`` pointed at it. So ``df`` may
    read ``name`` itself, readers see the old rows or the new ones and never a mixture, and a write that fails leaves the old
    rows. Earlier versions stay until ``drop_versions``, for readers that began with them. ``name`` must not be a table.
    """
    spark = df.sparkSession
    version = f"{name}__{uuid.uuid4().hex}"
    writer = _by_partition(df, partition_by).write.mode("error").option("path", new_table_path(spark, name)).partitionBy(*partition_by)
    writer.saveAsTable(version)
    columns = ", ".join(f"`{c}`" for c in df.columns)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {columns} FROM {version}")
    return version


def drop_versions(spark: SparkSession, name: str, keep: str | None = None) -> list[str]:
    """Forget the versions of a swapped table, all but ``keep``; gives their names. Files stay where they are."""
    gone = sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(f"{name.lower()}__") and t.name != (keep or "").lower())
    for version in gone:
        spark.sql(f"DROP TABLE {version}")
    return gone


def rewrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str] = ("year",)) -> None:
    """Replace only the partitions that occur in ``df``; other partitions stay untouched.

    Files are swapped at commit, so ``df`` may be computed from the same table.
    """
    (
        _by_partition(df, partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


# --- column shaping -----------------------------------------------------------------------------


def keys_first(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, *[c for c in df.columns if c not in keys])


def rename_by_prefix(df: DataFrame, prefixes: Mapping[str, str]) -> DataFrame:
    """Rename the first column that starts with each prefix; later ones keep their names.

    ``prefixes`` maps the new name to the prefix.
    """
    names = {}
    for new, prefix in prefixes.items():
        found = next((c for c in df.columns if c.startswith(prefix)), None)
        if found is not None:
            names[found] = new
    return df.withColumnsRenamed(names)
