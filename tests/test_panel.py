import math
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from harvestgrid.operators import panel as P
from harvestgrid.operators import sequences as Q
from harvestgrid.sources.sinks import stored
from harvestgrid.sources.tables import read_panel

PANEL = "loc_id long, year int, `yield` double, features array<double>"


def test_statistics_and_order_of_steps(spark):
    nan = math.nan
    df = spark.createDataFrame(
        [
            (1, 2015, 10.0, [1.0, 7.0, None, 1.0]),
            (1, 2016, 4.0, [3.0, 7.0, nan, 2.0]),  # low yield: dropped, but counted in the statistics
            (1, 2017, 5.0, [8.0, 7.0, None, nan]),
            (1, 2018, None, [100.0, 8.0, 1.0, 4.0]),
            (2, 2018, 4.99, [100.0, 8.0, 1.0, 4.0]),
            (3, 2018, nan, [100.0, 8.0, 1.0, 4.0]),
            (4, 2018, 6.0, [100.0, 8.0, 1.0, 4.0]),
        ],
        PANEL,
    )
    got = {(r.loc_id, r.year): r.features for r in P.prepare_panel(df, 2017).collect()}
    assert set(got) == {(1, 2015), (1, 2017), (4, 2018)}
    mean, std = statistics.mean([1, 3, 8]), statistics.stdev([1, 3, 8])
    assert got[1, 2015] == pytest.approx([(1 - mean) / std, 0, 0, (1 - 1.5) / math.sqrt(0.5)])
    assert got[1, 2017][3] == 0.0
    assert got[4, 2018] == pytest.approx([(100 - mean) / std, 1.0, 0.0, (4 - 1.5) / math.sqrt(0.5)])


def test_single_training_row_gives_zeros(spark):
    df = spark.createDataFrame([(1, 2015, 9.0, [1.0]), (1, 2018, 9.0, [5.0])], PANEL)
    assert {tuple(r.features) for r in P.prepare_panel(df, 2017).collect()} == {(0.0,)}


def test_scaled_training_columns_have_mean_0_and_std_1(spark):
    df = spark.range(500).select(
        F.col("id").alias("loc_id"), F.lit(2010).alias("year"), F.lit(9.0).alias("yield"),
        F.array(F.rand(1) * 9, F.randn(2) + 4).alias("features"),
    )
    z = P.standardise(df, P.feature_stats(df, 2017)).select(F.posexplode("features"))
    for r in z.groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_samp("col").alias("s")).collect():
        assert r.m == pytest.approx(0, abs=1e-9) and r.s == pytest.approx(1)


def test_year_scalars_and_fallback(spark):
    rows = [(1, 2016, 10.0, []), (2, 2016, 20.0, []), (1, 2017, 25.0, [])]
    df = spark.createDataFrame(rows, PANEL)
    got = {r.year: (r.avg_yield, r.ybar) for r in P.year_scalars(df, 2018).collect()}
    spread = statistics.stdev([15, 25])
    assert got[2016] == pytest.approx((15, -5 / spread)) and got[2017] == pytest.approx((25, 5 / spread))
    assert got[2018] == got[2017]
    assert {r.year for r in P.year_scalars(df, 2020).collect()} == {2016, 2017}
    only = P.year_scalars(df.where("year = 2016")).head()
    assert only.avg_yield == 15 and only.ybar is None


def test_year_out_of_range_raises(spark):
    df = spark.createDataFrame([(1, 20170, 9.0, [])], PANEL)
    with pytest.raises(PySparkException, match="out of range"):
        P.year_list(df).collect()


def test_mean_steps_with_an_absent_year(spark):
    df = spark.createDataFrame([(1, 2016, 10.0, [1.0, 2.0]), (2, 2016, 20.0, [3.0, None]), (1, 2017, 25.0, [5.0, 6.0])], PANEL)
    steps = P.mean_year_steps(df, P.year_scalars(df), [2015, 2016, 2017], 2).head().steps
    assert [s.year for s in steps] == [2015, 2016, 2017]
    assert (steps[0].features, steps[0].ybar, steps[0].avg_yield) == ([0.0, 0.0], 0.0, None)
    assert steps[1].features == [2.0, 2.0] and steps[1].avg_yield == 15.0


def test_keep_last(spark):
    df = spark.createDataFrame([(1, 2015, 1.0, 0), (1, 2015, 2.0, 9), (1, 2015, 3.0, 5), (2, 2015, 4.0, 1)], "loc_id long, year int, `yield` double, src_order int")
    assert {(r.loc_id, r["yield"]) for r in P.keep_last(df, "src_order").collect()} == {(1, 2.0), (2, 4.0)}
    with pytest.raises(PySparkException, match="repeated key: 1, 2015"):
        P.keep_last(df.drop("src_order")).collect()
    assert P.keep_last(df.drop("src_order").where("loc_id = 2")).count() == 1


def sequence_panel(spark, years_by_loc):
    rows = [(loc, y, 10.0 + y - 2000 + loc, [float(y), float(loc), 1.0]) for loc, ys in years_by_loc.items() for y in ys]
    return spark.createDataFrame(rows, PANEL)


def test_years_count_in_the_list_of_years_seen(spark):
    df = sequence_panel(
        spark,
        {
            1: [2010, 2011, 2012, 2014, 2015],        # 2013 is absent everywhere: consecutive
            2: [2010, 2011, 2014, 2015, 2016, 2018],  # 2012 is absent here only: broken
            3: [2010, 2011, 2012, 2014],              # four years
            4: [2011, 2012, 2014, 2015, 2016, 2018],  # one run before the hold-out year
        },
    )
    got = Q.training_sequences(df, P.year_scalars(df, 2018), 2018, (1, 1, 1)).collect()
    assert {(r.loc_id, tuple(r.years)) for r in got} == {(1, (2010, 2011, 2012, 2014, 2015)), (4, (2011, 2012, 2014, 2015, 2016))}
    for r in got:
        assert len(r.steps) == 5 and 2018 not in r.years
        assert r.y_last == 10.0 + r.years[-1] - 2000 + r.loc_id
        assert r.y_prev == [10.0 + y - 2000 + r.loc_id for y in r.years[:-1]]
        assert [s.e[0] for s in r.steps] == [float(y) for y in r.years]


def test_only_the_environment_group(spark):
    df = sequence_panel(spark, {1: [1, 2, 3, 4, 5]})
    step = Q.training_sequences(df, P.year_scalars(df), 99, (1, 1, 1), keep=("e",)).head().steps[0]
    assert step.asDict().keys() == {"e", "ybar"}


def test_holdout_sequences(spark):
    df = sequence_panel(spark, {1: [2016, 2017, 2018], 2: [2016, 2018], 3: [2017]})
    scalars = P.year_scalars(df, 2018)
    means = P.mean_year_steps(df, scalars, [2014, 2015, 2016, 2017], 3)
    got = {r.loc_id: r for r in Q.holdout_sequences(df, scalars, means, 2018, (1, 1, 1)).collect()}
    assert set(got) == {1, 2}
    assert got[2].years == [2014, 2015, 2016, 2017, 2018]
    assert [s.e for s in got[2].steps] == [[0.0], [0.0], [2016.0], [2017.0], [2018.0]]
    assert got[1].y_prev == pytest.approx([None, None, 27.5, 29.0]) and got[1].y_last == 29.0
    assert got[2].steps[4].s == [2.0]


def test_reshape(spark):
    got = spark.range(1).select(Q.reshape(F.sequence(F.lit(1), F.lit(12)), 3, 4).alias("r")).head().r
    assert got == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12]]


def test_read_panel(spark, tmp_path):
    (tmp_path / "p.csv").write_text("loc_ID,year,yield,a,b\n1,2015,9.5,1.0,\n1,2015,8.5,NaN,2.0\n2,2016,,3,4\n")
    df = read_panel(spark, str(tmp_path / "p.csv"), feature_count=2)
    rows = {(r.loc_id, r["yield"]): r.features for r in df.collect()}
    assert rows == {(1, 9.5): [1.0, None], (1, 8.5): [None, 2.0], (2, None): [3.0, 4.0]}
    assert P.keep_last(df, "src_order").where("loc_id = 1").head()["yield"] == 8.5
    with pytest.raises(PySparkException):
        read_panel(spark, str(tmp_path / "absent.csv"), 2)


def test_a_key_with_many_copies(spark):
    """A third of all rows share one key: one row is kept, and the copies never meet in a window."""
    hot = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
    df = spark.range(3000).select(hot.alias("loc_id"), F.lit(2015).alias("year"), F.col("id").cast("double").alias("yield"), F.col("id").alias("src_order"))
    kept = P.keep_last(df, "src_order")
    assert kept.count() == 2001 and kept.where("loc_id = 0").head()["yield"] == 2997.0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max_by") > plan.index("Exchange") and "Window" not in plan


def test_repeats_are_dropped_with_one_shuffle_of_feature_rows(spark):
    years = {loc: [2010, 2011, 2012, 2013, 2014, 2018] for loc in range(6)}
    df = stored(sequence_panel(spark, years).withColumn("src_order", F.lit(1)), "panel")

    unique = P.drop_repeats(df, "src_order")
    training = Q.training_sequences(unique, P.year_scalars(df, 2018), 2018, (1, 1, 1))
    plan = training._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(loc_id") == 1 and training.count() == 6
    again = df.where("loc_id = 3").withColumns({"src_order": F.lit(2), "yield": F.lit(7.0)})
    both = stored(df.union(again).union(df.where("loc_id = 4").withColumn("loc_id", F.lit(None).cast("long"))), "panel")
    both = stored(both.union(both.where("loc_id IS NULL").withColumn("src_order", F.lit(5))), "panel")
    got, want = P.drop_repeats(both, "src_order"), P.keep_last(both, "src_order")
    assert got.columns == want.columns and got.count() == 42
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    with pytest.raises(PySparkException, match="repeated key"):
        P.drop_repeats(both).collect()
    with pytest.raises(PySparkException, match="no order among"):
        P.drop_repeats(df.withColumn("src_order", F.lit(None).cast("int")), "src_order").count()
