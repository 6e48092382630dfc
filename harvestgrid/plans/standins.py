"""Tables for the registered queries, derived by Spark from the given tables.

The given tables hold no weather or yield, so each stand-in maps one of them onto the library's
schemas. Money and event values become whole cents before they are summed, so that sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestgrid.functions import mesh
from harvestgrid.sources.grids import with_cell

CUT_YEAR, HOLDOUT_YEAR, MEAN_YEARS = 2000, 2001, (1997, 1998, 1999, 2000)
PANEL_SIZES = (2, 1, 1)
VECTOR_SIZES = (52, 8, 4)
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_shipdate timestamp_ntz",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "documents": "doc_id long, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the stated schema saves the job that would infer it."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def cents(value: Column) -> Column:
    return F.round(value * 100).cast("long")


def lat_of(key: Column) -> Column:
    """A latitude per key, off the cell edges."""
    return F.lit(24.0037) + F.pmod(key * 37, F.lit(2200)) / F.lit(100.0)


def lon_of(key: Column) -> Column:
    return F.lit(122.0041) + F.pmod(key * 53, F.lit(2400)) / F.lit(100.0)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """loc_id, year, yield, four features; the third is missing for a single order."""
    orders = table(spark, sf_dir, "orders")
    price = cents(F.col("o_totalprice"))
    grouped = orders.groupBy(F.col("o_custkey").alias("loc_id"), F.year("o_orderdate").alias("year")).agg(
        F.sum(price).alias("total"),
        F.count(F.lit(1)).alias("n"),
        F.min(price).alias("low"),
        F.max(price).alias("high"),
    )
    return grouped.select(
        "loc_id",
        "year",
        (F.col("total") / 1000000.0).alias("yield"),
        F.array(
            F.col("n").cast("double"),
            F.col("total") / 100.0 / F.col("n"),
            F.when(F.col("n") > 1, F.col("low") / 100.0),
            F.col("high") / 100.0,
        ).alias("features"),
    )


def vector_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """loc_id, year, yield, 64 features; keys repeat and ``src_order`` orders the repeats."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(
        F.col("label").cast("long").alias("loc_id"),
        (F.lit(1995) + F.col("vec_id") % 7).cast("int").alias("year"),
        (F.lit(5.0) + F.col("vec_id") % 11).alias("yield"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.col("vec_id").alias("src_order"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place, date, element, value: mean event value per user, day and type."""
    events = table(spark, sf_dir, "events")
    return (
        events.groupBy(F.col("user_id").alias("place"), F.col("ts").cast("date").alias("date"), F.col("event_type").alias("element"))
        .agg(F.sum(cents(F.col("value"))).alias("c"), F.count(F.lit(1)).alias("n"))
        .select("place", "date", "element", (F.col("c") / 100.0 / F.col("n")).alias("value"))
    )


def place_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place, tile, mesh_code, lat, lon: the cell of every customer; users are customers."""
    key = F.col("c_custkey")
    places = table(spark, sf_dir, "customer").select(key.alias("place"), lat_of(key).alias("lat"), lon_of(key).alias("lon"))
    return with_cell(places)


def _on_grid(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return df.join(place_cells(spark, sf_dir), "place")


def _cell_means(spark: SparkSession, sf_dir: str, *times: Column) -> DataFrame:
    """element, tile, mesh_code, lat, lon, the times, value: mean event value of all users in a cell.

    A user is a customer, and its number gives its cell; many users share a cell once there are some thousands.
    """
    key = F.col("user_id")
    events = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("element"),
        mesh.cell_row(lat_of(key)).alias("_row"),
        mesh.cell_column(lon_of(key)).alias("_column"),
        *times,
        cents(F.col("value")).alias("c"),
    )
    cell = [c for c in events.columns if c != "c"]
    means = events.groupBy(*cell).agg((F.sum("c") / 100.0 / F.count(F.lit(1))).alias("value"))
    row, column = F.col("_row"), F.col("_column")
    named = means.withColumns(
        {"mesh_code": mesh.code_of_cell(row, column), "lat": mesh.row_centre(row), "lon": mesh.column_centre(column)}
    )
    return named.withColumn("tile", F.substring("mesh_code", 1, 4)).drop("_row", "_column")


def grid_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily grid from the events, one value per element, cell and day."""
    daily = _cell_means(spark, sf_dir, F.col("ts").cast("date").alias("date"))
    return daily.select(
        "element", F.lit("observed").alias("kind"), F.year("date").alias("year"), "tile", "mesh_code", "lat", "lon", "date", "value"
    )


def grid_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals of the first 20 days: one mean per cell and element, the same on each of these days."""
    days = F.sequence(F.to_date(F.lit("2024-01-01")), F.to_date(F.lit("2024-01-20")))
    daily = _cell_means(spark, sf_dir).withColumn("date", F.explode(days))
    return daily.select(
        "element", F.lit("normal").alias("kind"), F.year("date").alias("year"), "tile", "mesh_code", "lat", "lon", "date", "value"
    )


def grid_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_observed(spark, sf_dir).unionByName(grid_normal(spark, sf_dir))


def grid_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scenarios: observed values plus 1.5 and plus 3."""
    shifts = F.array(
        *[F.struct(F.lit(name).alias("scenario"), F.lit(shift).alias("shift")) for name, shift in (("RCP2.6", 1.5), ("RCP8.5", 3.0))]
    )
    return (
        grid_observed(spark, sf_dir)
        .withColumn("s", F.explode(shifts))
        .select(
            "element", F.lit("MIROC5").alias("model"), "s.scenario", "year", "tile", "mesh_code", "lat", "lon", "date",
            (F.col("value") + F.col("s.shift")).alias("value"),
        )
    )


def grid_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Altitude and land use from the customers, each at its own cell."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"), "c_acctbal", F.col("c_nationkey").cast("double").alias("use"))
    layers = F.create_map(F.lit("altitude"), F.col("c_acctbal"), F.lit("landuse"), F.col("use"))
    return (
        _on_grid(customers, spark, sf_dir)
        .select("tile", "mesh_code", "lat", "lon", F.explode(layers).alias("element", "value"))
        .groupBy("element", "tile", "mesh_code", "lat", "lon")
        .agg(F.max("value").alias("value"))
    )


def grid_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour-ending means of the events: local time is UTC plus nine hours."""
    ends = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz") + F.expr("interval 1 hour")
    hourly = _cell_means(spark, sf_dir, ends.alias("ts_utc")).withColumn(
        "ts_local", F.convert_timezone(F.lit("UTC"), F.lit("Asia/Tokyo"), F.col("ts_utc"))
    )
    return hourly.select(
        "element",
        F.lit("observed").alias("kind"),
        F.year(F.col("ts_local") - F.expr("interval 1 hour")).alias("storage_year"),
        "tile", "mesh_code", "lat", "lon", "ts_utc", "ts_local", "value",
    )


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """element, long_name, unit: one row per event type."""
    types = table(spark, sf_dir, "events").select(F.col("event_type").alias("element")).distinct()
    return types.select("element", F.concat(F.lit("mean "), "element").alias("long_name"), F.lit("unit").alias("unit"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place, year, lat, lon: every customer, for the season that holds January 2024."""
    customers = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return customers.select(key.alias("place"), F.lit(2023).alias("year"), lat_of(key).alias("lat"), lon_of(key).alias("lon"))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place_id, name, admin1, lat, lon: every supplier."""
    suppliers = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return suppliers.select(
        key.alias("place_id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("region "), F.col("s_nationkey").cast("string")).alias("admin1"),
        (lat_of(key) + 0.0031).alias("lat"),
        (lon_of(key) + 0.0017).alias("lon"),
    )


def field_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field records from the orders: blanks in seed_date, missing yields and places."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return orders.select(
        F.when(key % 10 != 3, F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("place"),
        F.year("o_orderdate").alias("year"),
        lat_of(key).alias("lat"),
        lon_of(key).alias("lon"),
        F.when(key % 9 != 2, F.col("o_totalprice")).alias("yield"),
        F.when(key % 7 == 1, F.lit(" 　 ")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("seed_date"),
        F.when(key % 11 == 5, F.lit("")).otherwise(F.col("o_orderpriority")).alias("harvest_date"),
        key.alias("record_id"),
    )


def weather_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily table with one column per event type; calendar year stands for the season year here."""
    wide = weather(spark, sf_dir).groupBy("place", "date")
    return wide.agg(
        *[F.max(F.when(F.col("element") == e, F.col("value"))).alias(e) for e in EVENT_TYPES]
    ).withColumn("year", F.lit(2023))


def ship_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct shipping days, 1995 to 2001, with the number of lines."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("lines"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box around every customer's point, up to 6 degrees high and wide; some are points."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("box_id"),
        lat_of(key).alias("south"),
        (lat_of(key) + (key % 7) * 0.9).alias("north"),
        lon_of(key).alias("west"),
        (lon_of(key) + (key % 5) * 1.1).alias("east"),
    )


