"""Missing values and completeness. NULL is the one missing value; all other forms become NULL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestgrid.functions.numeric import nan_to_null

# The missing-value number of the grid tables, and the columns of a complete record.
GRID_MISSING = 9.96921e36
COMPLETE_COLUMNS = ("place", "year", "lat", "lon", "yield", "seed_date", "harvest_date")
COMPLETE_AFTER_BLANKS = ("lat", "lon", "yield", "seed_date", "harvest_date")

# (?U) makes \s cover the ideographic space as well.
BLANK = r"(?U)^\s*$"


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def ensure_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add the columns that are absent, all NULL, with the given types."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def blank_to_null(df: DataFrame) -> DataFrame:
    """Text of white space only, in any text column, becomes NULL."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).rlike(BLANK), F.col(c)) for c in text})


def complete_records(
    df: DataFrame,
    required: Sequence[str] = COMPLETE_COLUMNS,
    blank_is_missing: bool = False,
    select: Sequence[str] = ("place", "year", "lat", "lon"),
) -> DataFrame:
    """Rows with a value in every required column."""
    require_columns(df, [*required, *select])
    df = blank_to_null(df) if blank_is_missing else df
    return df.dropna(subset=list(required)).select(*select)


def drop_rows_without_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows that are missing in all of the columns."""
    return df.dropna(how="all", subset=list(columns))


def nan_columns_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: nan_to_null(F.col(c)) for c in floats})


def sentinel_to_null(df: DataFrame, columns: Sequence[str], sentinel: float = GRID_MISSING) -> DataFrame:
    """The sentinel, as a double or as a float, and NaN become NULL."""
    narrow = F.lit(sentinel).cast("float").cast("double")
    return df.withColumns(
        {c: F.when((F.col(c) != F.lit(sentinel)) & (F.col(c) != narrow) & ~F.isnan(c), F.col(c)) for c in columns}
    )


def null_to_sentinel(df: DataFrame, columns: Sequence[str], sentinel: float = GRID_MISSING) -> DataFrame:
    return df.withColumns({c: F.coalesce(nan_to_null(F.col(c)), F.lit(sentinel)) for c in columns})


def masked_to_null(df: DataFrame, column: str, mask: Column) -> DataFrame:
    """Values under a true mask become NULL."""
    return df.withColumn(column, F.when(~F.coalesce(mask, F.lit(False)), F.col(column)))


def _is_missing(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def null_profile(df: DataFrame) -> DataFrame:
    """Missing values per column, with the total, the row count and the verdict; one pass."""
    fields = df.schema.fields
    counts = df.agg(
        F.count(F.lit(1)).alias("row_count"), *[F.count_if(_is_missing(f)).alias(f.name) for f in fields]
    )
    total = sum((F.col(f"`{f.name}`") for f in fields), F.lit(0).cast("long"))
    return (
        counts.withColumn("total_missing", total)
        .unpivot(["row_count", "total_missing"], [F.col(f"`{f.name}`") for f in fields], "column_name", "missing")
        .withColumn("complete", F.col("total_missing") == 0)
        .select("column_name", "missing", "total_missing", "row_count", "complete")
    )
