"""Moments without exploding, range joins, drifted axes, swapped tables, decoding by branch."""

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from harvestgrid.operators import panel as P
from harvestgrid.operators.moments import entry_means, entry_moments
from harvestgrid.operators.ranges import range_join
from harvestgrid.sources import grids as G
from harvestgrid.sources import sinks
from harvestgrid.sources.text import decode_rows

FEATURES = "year int, features array<double>"


def exploded(df):
    """The figures by a row per entry, as an independent way."""
    x = df.select(F.posexplode("features").alias("pos", "x")).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    found = x.groupBy("pos").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    return [tuple(r)[1:] for r in found.orderBy("pos").collect()]


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_moments_equal_exploded_rows(spark, offset):
    draw = np.random.default_rng(1)
    rows = [(2000 + k % 3, [offset + float(v) for v in draw.normal(size=4)]) for k in range(500)]
    for k in range(0, 500, 7):
        rows[k][1][1] = None if k % 2 else float("nan")
    rows += [(2001, [None, None, 5.0, None]), (2001, None)]
    for _, features in rows:
        if features:
            features[3] = offset if features is rows[1][1] else None
    df = spark.createDataFrame(rows, FEATURES).repartition(5)
    got = entry_moments(df).head().moments
    for g, (n, mean, std) in zip(got, exploded(df), strict=True):
        assert g.n == n and g["mean"] == pytest.approx(mean, rel=1e-9)
        assert g.std is None if std is None else g.std == pytest.approx(std, rel=1e-6)
    assert got[3].n == 1 and got[3].std is None
    by_year = {r.year: [(m.n, m["mean"]) for m in r.means] for r in entry_means(df, by=["year"]).collect()}
    for year, means in by_year.items():
        want = exploded(df.where(F.col("year") == year))
        assert [n for n, _ in means] == [n for n, _, _ in want]
        assert all(m == (w and pytest.approx(w, rel=1e-9)) for (_, m), (_, w, _) in zip(means, want, strict=True))


def test_moments_of_nothing(spark):
    none = spark.createDataFrame([], FEATURES)
    assert entry_moments(none).head().moments == [] and entry_means(none, by=["year"]).count() == 0
    assert P.standardise(none, P.feature_stats(none, 2017)).count() == 0


def test_moments_make_no_rows_of_entries(spark):
    df = spark.range(100).selectExpr("2000 AS year", "array(1.0D * id, 2.0D) AS features")
    for found in (P.feature_stats(df, 2017), P.mean_vectors(df, [2000])):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "Python" not in plan


DAY = dt.date(2015, 1, 1)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.integers(-40, 40), st.integers(0, 1)), max_size=25),
    st.lists(st.tuples(st.integers(-40, 40), st.sampled_from([-1, 0, 1, 2, 3, 7, 8, 40, 900]), st.integers(0, 1)), max_size=12),
)
def test_range_join_equals_all_pairs(spark, points, ranges):
    at = spark.createDataFrame([(k, DAY + dt.timedelta(days=p), g) for k, (p, g) in enumerate(points)] + [(-1, None, 0)], "p int, at date, grp int")
    rows = [(k, DAY + dt.timedelta(days=s), DAY + dt.timedelta(days=s + n), g) for k, (s, n, g) in enumerate(ranges)]
    of = spark.createDataFrame([*rows, (-2, None, DAY, 0)], "r int, low date, high date, grp int")
    got = sorted((x.p, x.r) for x in range_join(at, of, "at", "low", "high", ["grp"]).collect())
    want = sorted(
        (k, j) for k, (p, g) in enumerate(points) for j, (s, n, h) in enumerate(ranges) if g == h and s <= p <= s + n
    )
    assert got == want


def test_range_join_of_mixed_lengths_has_no_nested_loop(spark):
    draw = random.Random(2)
    ranges = [(k, s := draw.randrange(10**6), s + draw.choice([0, 3, 100, 10**5, 10**6])) for k in range(400)]
    points = [(k, draw.randrange(10**6)) for k in range(500)] + [(600, 77)] * 50
    found = range_join(
        spark.createDataFrame(points, "p int, at long"), spark.createDataFrame(ranges, "r int, low long, high long"), "at", "low", "high"
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = sorted((p, r) for p, x in points for r, low, high in ranges if low <= x <= high)
    assert sorted((x.p, x.r) for x in found.collect()) == want
    with pytest.raises(ValueError, match="no range join"):
        range_join(spark.range(1).selectExpr("'a' AS at"), spark.range(1).selectExpr("1L AS low", "2L AS high"), "at", "low", "high")


CELLS = "element string, lat double, lon double, date date, value double"


def cells(spark, drift, rows=4, first=0):
    day = dt.date(2016, 1, 1)
    values = [("T", 35 + k / 120 + drift, 139 + (k % 2) / 80 - drift, day, float(k)) for k in range(first, first + rows)]
    return spark.createDataFrame(values, CELLS)


def test_drifted_pieces_become_one_grid(spark):
    pieces = [cells(spark, 0.0), cells(spark, 1e-6, 6, 2).withColumn("value", F.col("value"))]
    got = G.merge_on_axes(pieces, steps=(1 / 120, 1 / 80)).orderBy("lat").collect()
    assert [r.value for r in got] == [float(k) for k in range(8)]
    assert [r.lat for r in got] == pytest.approx([35 + k / 120 for k in range(8)], abs=1e-9)
    free = G.merge_on_axes(pieces).orderBy("lat").collect()
    assert [r.value for r in free] == [r.value for r in got]
    assert G.merge_pieces(pieces, ["element", "lat", "lon", "date"]).count() == 10


@pytest.mark.parametrize("drift", [0.5 / 120, 0.02 / 120])
def test_a_drift_beyond_the_tolerance_raises(spark, drift):
    pieces = [cells(spark, 0.0), cells(spark, 0.0).withColumn("lat", F.col("lat") + drift)]
    with pytest.raises(PySparkException, match="off the axis"):
        G.merge_on_axes(pieces, steps=(1 / 120, 1 / 80)).collect()


def test_one_coordinate_is_an_axis(spark):
    one = cells(spark, 0.0, 1)
    assert G.merge_on_axes([one, one]).count() == 1
    with pytest.raises(PySparkException, match="off the axis"):
        G.merge_on_axes([one, cells(spark, 0.0, 2)]).collect()


def test_swap_is_seen_whole(spark):
    name = "swapped"
    rows = spark.createDataFrame([("01", 1), ("02", 2)], "code string, v int")
    sinks.swap_table(rows, name, ["code"])
    before = spark.table(name)
    bad = F.when(F.col("v") == 2, F.raise_error(F.lit("broken row")).cast("int")).otherwise(F.lit(9))
    with pytest.raises(PySparkException, match="broken row"):
        sinks.swap_table(spark.table(name).withColumn("v", bad), name, ["code"])
    assert sorted(map(tuple, spark.table(name).collect())) == [("01", 1), ("02", 2)]
    last = sinks.swap_table(spark.table(name).withColumn("v", F.col("v") + 10), name, ["code"])
    assert sorted(map(tuple, spark.table(name).collect())) == [("01", 11), ("02", 12)]
    assert sorted(map(tuple, before.collect())) == [("01", 1), ("02", 2)]  # a reader that began before
    assert len(sinks.drop_versions(spark, name, keep=last)) >= 1 and spark.table(name).count() == 2
    spark.sql(f"DROP VIEW {name}")
    assert sinks.drop_versions(spark, name) == [last]


def test_python_only_for_rows_that_need_it(spark, tmp_path):
    texts = ["plain", "﻿mark", "ァ珱", None, ""]
    pure = [(k, None if t is None else t.encode()) for k, t in enumerate(texts)]
    mixed = [*pure, (5, "ァ珱".encode("cp932")), (6, "ァ珱".encode("euc-jp"))]
    for rows, python in ((pure, False), (mixed, True)):
        path = str(tmp_path / str(python))
        spark.createDataFrame(rows, "id int, content binary").write.parquet(path)
        found = decode_rows(spark.read.parquet(path))
        assert ("Python" in found._jdf.queryExecution().executedPlan().toString()) == python
        want = ["plain", "mark", "ァ珱", None, "", "ァ珱", "ァ珱"][: len(rows)]
        assert [r.content for r in found.orderBy("id").collect()] == want
    broken = spark.createDataFrame([(1, b"\xff\xff\xff")], "id int, content binary")
    assert decode_rows(broken, strict=False).count() == 1
