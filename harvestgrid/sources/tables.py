"""Readers for the yield panel, plain tables and staged sheets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestgrid.functions.numeric import nan_to_null

# Widths of the environment, soil and management groups of the yield panel.
GROUP_SIZES = (312, 66, 14)

FIELD_RECORD_SCHEMA = T.StructType(
    [
        T.StructField("place", T.StringType()),
        T.StructField("year", T.StringType()),
        T.StructField("lat", T.StringType()),
        T.StructField("lon", T.StringType()),
        T.StructField("yield", T.StringType()),
        T.StructField("seed_date", T.StringType()),
        T.StructField("harvest_date", T.StringType()),
    ]
)


def panel_from_columns(df: DataFrame) -> DataFrame:
    """``loc_id, year, yield`` from the first three columns, all others as one ``features`` array.

    One array instead of hundreds of columns keeps plans and generated code small. NaN becomes NULL.
    """
    loc, year, crop, *rest = [F.col(f"`{c}`") for c in df.columns]
    source = [F.col("src_order")] if "src_order" in df.columns else []
    rest = [c for c, name in zip(rest, df.columns[3:]) if name != "src_order"]
    return df.select(
        loc.alias("loc_id"),
        year.cast("int").alias("year"),
        nan_to_null(crop.cast("double")).alias("yield"),
        F.array(*[nan_to_null(c.cast("double")) for c in rest]).alias("features"),
        *source,
    )


def read_panel(
    spark: SparkSession,
    path: str,
    feature_count: int = sum(GROUP_SIZES),
    source_order: bool = True,
    loc_type: T.DataType = T.LongType(),
) -> DataFrame:
    """Yield panel from CSV with a header; a missing path raises.

    ``src_order`` orders rows as they stand in the files: file, split start, row within the split.
    """
    schema = T.StructType(
        [
            T.StructField("loc_id", loc_type),
            T.StructField("year", T.IntegerType()),
            T.StructField("yield", T.DoubleType()),
            *[T.StructField(f"f{i}", T.DoubleType()) for i in range(feature_count)],
        ]
    )
    df = spark.read.schema(schema).option("header", True).csv(path)
    if source_order:
        df = df.withColumn(
            "src_order",
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ),
        )
    return panel_from_columns(df)


def read_table(
    spark: SparkSession,
    name: str,
    columns: Sequence[str] | None = None,
    where: Column | str | None = None,
    fmt: str | None = None,
    schema: T.StructType | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A whole table, or chosen columns and rows of it; both choices reach the scan.

    ``fmt`` reads a path (or, with 'jdbc', what ``options`` name); without it ``name`` is a catalog table.
    """
    if fmt is None:
        df = spark.table(name)
    else:
        reader = spark.read.format(fmt).options(**(options or {}))
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.load() if fmt == "jdbc" else reader.load(name)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def read_sheet(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    columns: Sequence[str] | None = None,
    rename: Mapping[str, str] | None = None,
) -> DataFrame:
    """A sheet staged as CSV with a header, with chosen and renamed columns."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    df = df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df
    return df.withColumnsRenamed(dict(rename or {}))


def vapour_sheet(df: DataFrame, date_column: str = "年月日", value_column: str = "平均蒸気圧(hPa)") -> DataFrame:
    """``date, VP`` from a vapour-pressure sheet; the date may be text with or without a time."""
    return df.select(
        F.try_to_timestamp(F.col(f"`{date_column}`").cast("string")).cast("date").alias("date"),
        nan_to_null(F.col(f"`{value_column}`").cast("double")).alias("VP"),
    )


def field_records(df: DataFrame) -> DataFrame:
    """Field records with year, coordinates and yield as numbers; text that is no number is NULL."""

    def number(name: str, kind: str) -> Column:
        return F.trim(F.col(name).cast("string")).try_cast(kind)

    numbers = {"year": number("year", "int")}
    numbers |= {c: nan_to_null(number(c, "double")) for c in ("lat", "lon", "yield")}
    return df.withColumns({c: v for c, v in numbers.items() if c in df.columns})
