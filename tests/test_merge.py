import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from harvestgrid.operators import merge
from harvestgrid.sources import sinks
from harvestgrid.sources.tables import vapour_sheet


def d(text):
    return dt.date.fromisoformat(text)


def weather(spark):
    rows = [
        ("C01", 2018, d("2018-03-31"), 1.0),
        ("C01", 2018, d("2018-04-01"), 1.0),
        ("C01", 2018, d("2019-03-24"), 1.0),
        ("C01", 2018, d("2019-03-25"), 1.0),
        ("C02", 2018, d("2018-04-01"), 2.0),
        ("C04", 2018, d("2018-04-01"), 3.0),
        ("C06", 2017, d("2018-04-01"), 4.0),
    ]
    return spark.createDataFrame(rows, "place string, year int, date date, VP double")


def sheet(spark):
    rows = [("2018-03-31", 9.0), ("2018-04-01", 10.0), ("2019-03-24", None), ("2019-03-25", 12.0)]
    return spark.createDataFrame([(d(a), b) for a, b in rows], "date date, VP double")


TARGETS = [("C01", 2018), ("C04", 2018), ("C09", 2020)]


def targets(spark):
    return spark.createDataFrame(TARGETS, "place string, year int")


def test_update_merge(spark):
    got = {(r.place, str(r.date)): (r.VP, r.hit) for r in merge.merge_vapour_pressure(weather(spark), sheet(spark), targets(spark), "hit").collect()}
    assert got == {
        ("C01", "2018-03-31"): (1.0, False),
        ("C01", "2018-04-01"): (10.0, True),
        ("C01", "2019-03-24"): (None, True),  # a matched row takes the missing value
        ("C01", "2019-03-25"): (1.0, False),
        ("C02", "2018-04-01"): (2.0, False),
        ("C04", "2018-04-01"): (10.0, True),
        ("C06", "2018-04-01"): (4.0, False),
    }


def test_empty_sheet_changes_nothing(spark):
    got = merge.merge_vapour_pressure(weather(spark), sheet(spark).limit(0), targets(spark))
    assert sorted(got.collect()) == sorted(weather(spark).select(*got.columns).collect())


def test_column_is_added(spark):
    got = merge.merge_vapour_pressure(weather(spark).drop("VP"), sheet(spark), targets(spark))
    assert got.where("VP is not null").count() == 2


def test_repeated_day_raises(spark):
    twice = sheet(spark).unionAll(sheet(spark))
    with pytest.raises(PySparkException, match="date given twice"):
        merge.merge_vapour_pressure(weather(spark), twice, targets(spark)).collect()


def test_stored_table_is_updated_in_place(spark, tmp_path):
    path = str(tmp_path / "w")
    sinks.write_parquet(weather(spark), path, ["year"])
    table = spark.read.schema(weather(spark).schema).parquet(path)
    merge.apply_vapour_pressure(table, sheet(spark), targets(spark), path)
    got = {(r.place, str(r.date)): r.VP for r in spark.read.schema(weather(spark).schema).parquet(path).collect()}
    assert len(got) == 7 and got["C01", "2018-04-01"] == 10.0 and got["C06", "2018-04-01"] == 4.0


def test_backfill_overwrites_with_missing(spark):
    df = spark.createDataFrame([(2016, 1.0, 5.0), (2017, 1.0, 5.0), (2018, 1.0, None)], "year int, OPR double, OPRori double")
    assert {r.year: r.OPR for r in merge.backfill_column(df).collect()} == {2016: 1.0, 2017: 5.0, 2018: None}
    with pytest.raises(ValueError):
        merge.backfill_column(df.drop("OPRori"))
    other = merge.backfill_column(df, condition=F.col("OPRori").isNotNull())
    assert {r.year: r.OPR for r in other.collect()} == {2016: 5.0, 2017: 5.0, 2018: 1.0}


def test_vapour_sheet(spark):
    raw = spark.createDataFrame([("2018-04-01 00:00:00", 7.5, "x"), ("2018-04-02", None, "y")], ["年月日", "平均蒸気圧(hPa)", "備考"])
    got = vapour_sheet(raw)
    assert got.columns == ["date", "VP"]
    assert {r.date: r.VP for r in got.collect()} == {d("2018-04-01"): 7.5, d("2018-04-02"): None}


def test_few_updates_do_not_shuffle_the_table(spark, tmp_path):
    path = str(tmp_path / "w")
    sinks.write_parquet(weather(spark), path, ["year"])
    table = spark.read.schema(weather(spark).schema).parquet(path)
    updates = merge.season_updates(sheet(spark), targets(spark))
    plan = merge.update_merge(table, updates)._jdf.queryExecution().executedPlan().toString()
    table_side = plan[:plan.index("BroadcastExchange")]
    assert "BroadcastHashJoin" in table_side and "Exchange hash" not in table_side


def test_stored_table_is_backfilled_in_place(spark, tmp_path):
    path = str(tmp_path / "w")
    df = spark.createDataFrame([(1.0, 5.0, 2016), (1.0, 5.0, 2017), (1.0, None, 2018)], "OPR double, OPRori double, year int")
    sinks.write_parquet(df, path, ["year"])
    merge.apply_backfill(spark.read.schema(df.schema).parquet(path), path)
    got = spark.read.schema(df.schema).parquet(path).collect()
    assert {r.year: r.OPR for r in got} == {2016: 1.0, 2017: 5.0, 2018: None}


def test_updates_of_many_targets_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(merge, "TASK_UPDATES", 50 * 366)
    many = spark.createDataFrame([(f"P{k}", 2018) for k in range(400)] * 2, "place string, year int")
    updates = merge.season_updates(sheet(spark), many)
    assert updates.count() == 800 and updates.distinct().count() == 800
    # Before, adaptive execution made the few bytes of all targets one task.
    rows = [len(p) for p in updates.rdd.glom().collect()]
    assert len(rows) > 8 and max(rows) < 400
