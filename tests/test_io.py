import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harvestgrid.operators.spatial import DAILY_ELEMENTS
from harvestgrid.plans import jobs
from harvestgrid.session import new_table_path, shared_folder
from harvestgrid.sources import sinks
from harvestgrid.sources.tables import FIELD_RECORD_SCHEMA, read_sheet, read_table
from harvestgrid.sources.text import decode_text, read_text_files


def test_text_files_in_four_encodings(spark, tmp_path):
    text = "年月日,平均蒸気圧\nアメダス"
    for name in ("utf-8-sig", "utf-8", "cp932", "euc-jp"):
        (tmp_path / f"{name}.csv").write_bytes(text.encode(name))
    got = read_text_files(spark, str(tmp_path))
    by_name = {r.path.rsplit("/", 1)[1]: r.content for r in got.collect()}
    # Some euc-jp bytes are valid cp932 too, and cp932 comes first.
    euc = text.encode("euc-jp")
    try:
        expected = euc.decode("cp932")
    except UnicodeDecodeError:
        expected = text
    assert by_name == {"utf-8-sig.csv": text, "utf-8.csv": text, "cp932.csv": text, "euc-jp.csv": expected}


def test_unreadable_text(spark):
    df = spark.createDataFrame([(bytearray(b"\x81"),), (None,)], "b binary")
    assert [r[0] for r in df.select(decode_text(F.col("b"), strict=False)).collect()] == [None, None]
    with pytest.raises(PySparkException, match="none of"):
        df.select(decode_text(F.col("b"))).collect()


def test_csv_and_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "k int, s string, v double")
    path = str(tmp_path / "c")
    assert sinks.write_csv(df, path, delimiter=";")
    back = spark.read.schema(df.schema).option("header", True).option("sep", ";").csv(path)
    assert sorted(back.collect()) == sorted(df.collect())
    assert not sinks.write_csv(df.limit(0), str(tmp_path / "none"), skip_empty=True)
    assert not sinks.write_parquet(df.limit(0), str(tmp_path / "none"), skip_empty=True)
    assert not (tmp_path / "none").exists()
    sinks.write_parquet(df, path, ["k"])
    assert read_table(spark, path, columns=["s"], where="k = 1", fmt="parquet").collect() == [("a",)]


def test_table_is_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1.0, 2015)], "v double, year int")
    sinks.replace_table(df.withColumn("VP", F.lit(1.0)), "weather_data", path=path)
    sinks.replace_table(df, "weather_data", path=path)
    assert sorted(read_table(spark, "weather_data").columns) == ["v", "year"]
    spark.sql("DROP TABLE weather_data")


def test_read_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text("年月日,平均蒸気圧(hPa),x\n2018-04-01,7.5,1\n", encoding="utf-8")
    schema = T.StructType([T.StructField("年月日", T.DateType()), T.StructField("平均蒸気圧(hPa)", T.DoubleType()), T.StructField("x", T.IntegerType())])
    got = read_sheet(spark, str(tmp_path / "s.csv"), schema, ["年月日", "平均蒸気圧(hPa)"], {"年月日": "date", "平均蒸気圧(hPa)": "VP"})
    assert got.columns == ["date", "VP"] and got.head().VP == 7.5


def test_prefix_rename(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["1mm以上の降水の有無 (mm)", "1mm以上の降水の有無 ()", "place"])
    got = sinks.keys_first(sinks.rename_by_prefix(df, {"OPR": "1mm以上の降水の有無", "SD": "積雪深"}), ["place"])
    assert got.columns == ["place", "OPR", "1mm以上の降水の有無 ()"]


def test_shared_folder(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert before is None or shared_folder(spark) == before
    assert new_table_path(spark, "x") != new_table_path(spark, "x")


def test_named_places(spark):
    records = spark.createDataFrame([("a", "2015", "36.0", "140.0", "9", "x", "y"), ("b", "2015", None, "140.0", "9", "x", "y")], FIELD_RECORD_SCHEMA)
    gazetteer = spark.createDataFrame([(1, "Tsukuba", "Ibaraki", 36.1, 140.1)], "place_id long, name string, admin1 string, lat double, lon double")
    got = jobs.named_places(records, gazetteer).collect()
    assert [(r.place, r.city, r.prefecture) for r in got] == [("a", "Tsukuba", "Ibaraki")]


def test_labels_and_back(spark):
    weather = spark.createDataFrame([(2015, "a", 1.0, 2.0)], "year int, place string, TMP_mea double, OPR double")
    elements = spark.createDataFrame([("TMP_mea", "degC"), ("other", "x")], "element string, unit string")
    labelled = jobs.labelled_weather(weather, elements)
    assert labelled.columns == ["year", "place", "日平均気温 (degC)", "1mm以上の降水の有無 ()"]
    assert sinks.rename_by_prefix(labelled, DAILY_ELEMENTS).columns == weather.columns
