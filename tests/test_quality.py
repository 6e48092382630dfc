import math

import pytest
from pyspark.sql import functions as F

from harvestgrid.functions.numeric import anomaly_sign, label, nearest_int, round_even
from harvestgrid.operators import quality as ql
from harvestgrid.sources.tables import field_records

RECORD = "place string, year string, lat string, lon string, `yield` string, seed_date string, harvest_date string"


def records(spark):
    return spark.createDataFrame(
        [
            ("a", "2015", "36", "140", "9", "05-01", "10-01"),
            ("b", "2015", "36", "140", "9", "", "10-01"),
            ("c", "2015", "36", "140", "9", " 　", "10-01"),
            (None, "2015", "36", "140", "9", "05-01", "10-01"),
            ("e", "2015", None, "140", "9", "05-01", "10-01"),
        ],
        RECORD,
    )


def test_complete_records_two_ways(spark):
    plain = {r.place for r in ql.complete_records(records(spark)).collect()}
    blanks = {r.place for r in ql.complete_records(records(spark), ql.COMPLETE_AFTER_BLANKS, True).collect()}
    assert plain == {"a", "b", "c"}
    assert blanks == {"a", None}


def test_missing_column_raises(spark):
    with pytest.raises(ValueError, match="yield"):
        ql.complete_records(records(spark).drop("yield"))


def test_field_records_cast(spark):
    df = spark.createDataFrame([("a", "x", " 36.5 ", "NaN", "9", "", "")], RECORD)
    r = field_records(df).head()
    assert (r.year, r.lat, r.lon, r["yield"]) == (None, 36.5, None, 9.0)


def test_sentinel_and_nan(spark):
    df = spark.createDataFrame([(9.96921e36,), (math.nan,), (1.0,), (None,)], "v double")
    assert [r.v for r in ql.sentinel_to_null(df, ["v"]).collect()] == [None, None, 1.0, None]
    assert [r.v for r in ql.null_to_sentinel(df, ["v"], -1.0).collect()] == [9.96921e36, -1.0, 1.0, -1.0]
    assert [r.v for r in ql.nan_columns_to_null(df).collect()] == [9.96921e36, None, 1.0, None]
    masked = ql.masked_to_null(df.withColumn("m", F.col("v") == 1.0), "v", F.col("m"))
    assert masked.where("v = 1").count() == 0


def test_null_profile(spark):
    df = spark.createDataFrame([(1.0, "a"), (math.nan, None), (None, "b")], "v double, s string")
    rows = {r.column_name: r for r in ql.null_profile(df).collect()}
    assert (rows["v"].missing, rows["s"].missing) == (2, 1)
    assert rows["v"].total_missing == 3 and rows["v"].row_count == 3 and not rows["v"].complete
    assert ql.null_profile(df.where("v = 1.0")).where("complete").count() == 2


def test_ensure_columns(spark):
    df = spark.createDataFrame([(1.0,)], "a double")
    out = ql.ensure_columns(df, {"a": "string", "VP": "double"})
    assert out.dtypes == [("a", "double"), ("VP", "double")]


def test_rounding(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (-0.25,), (None,)], "v double")
    assert [r[0] for r in df.select(round_even(F.col("v"))).collect()] == [0.2, 0.4, -0.2, None]
    ints = spark.createDataFrame([(0.5,), (1.5,), (-0.5,)], "v double").select(nearest_int(F.col("v")))
    assert [r[0] for r in ints.collect()] == [0, 2, 0]


def test_sign_and_label(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0), (None, 2.0)], "o double, n double")
    assert [r[0] for r in df.select(anomaly_sign(F.col("o"), F.col("n"))).collect()] == [-1, 0, 1, None]
    assert spark.range(1).select(label(F.lit("TMP"), F.lit("degC"))).head()[0] == "TMP (degC)"
