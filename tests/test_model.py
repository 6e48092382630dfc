import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestgrid.operators import panel as P
from harvestgrid.operators.metrics import regression_metrics, weighted_loss
from harvestgrid.operators.rows import first_rows, shuffled
from harvestgrid.plans import jobs
from harvestgrid.plans import joint_model as J
from harvestgrid.plans import yield_model as M

PAIR = "y_true double, y_pred double"


def test_metrics_by_hand(spark):
    rows = [(1.0, 2.0), (2.0, 2.5), (4.0, 1.0), (5.0, 6.0)]
    r = regression_metrics(spark.createDataFrame(rows, PAIR)).head()
    t, p = np.array(rows).T
    e = p - t
    assert r.n == 4
    assert r.rmse == pytest.approx(math.sqrt((e**2).mean()))
    assert r.pearson == pytest.approx(np.corrcoef(t, p)[0, 1])
    assert r.mae == pytest.approx(np.abs(e).mean())
    assert r.huber == pytest.approx((0.5 + 0.125 + 2.5 + 0.5) / 4)


@pytest.mark.parametrize("rows, n", [([], 0), ([(1.0, 2.0)], 1), ([(3.0, 1.0), (3.0, 2.0)], 2)])
def test_metrics_without_a_correlation(spark, rows, n):
    r = regression_metrics(spark.createDataFrame(rows, PAIR)).head()
    assert r.n == n and r.pearson is None
    assert (r.rmse is None) == (n == 0)


def test_weighted_loss(spark):
    df = spark.createDataFrame([(1.0, 2.0, [1.0, 5.0], [1.0, 2.0])], PAIR + ", a array<double>, b array<double>")
    assert weighted_loss(df).head().loss == 0.5
    assert weighted_loss(df, previous=("a", "b"), weights=(1.0, 2.0)).head().loss == 0.5 + 2 * 2.5 / 2


def test_shuffle_keeps_all_rows_and_repeats(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    once, again, other = ([r.k for r in shuffled(df, ["k"], s).collect()] for s in (1, 1, 2))
    assert once == again != other and sorted(once) == list(range(100)) and once != sorted(once)
    assert [r.k for r in first_rows(df, [F.desc("k")], 2).collect()] == [99, 98]


@pytest.fixture(scope="module")
def panel(spark):
    """30 locations, 2008 to 2018, a yield that follows the features; one key twice."""
    base = spark.range(30).select(F.col("id").alias("loc_id"), F.explode(F.sequence(F.lit(2008), F.lit(2018))).alias("year"))
    x = F.array(*[F.rand(i) for i in range(1, 7)])
    df = base.withColumn("features", x).withColumn("yield", F.lit(20.0) + 10 * F.element_at("features", 1) + F.col("loc_id") / 10)
    df = df.select("loc_id", "year", "yield", "features", F.monotonically_increasing_id().alias("src_order"))
    return df.unionByName(df.where("loc_id = 3 and year = 2018").withColumns({"yield": F.lit(99.0), "src_order": F.lit(1 << 60)}))


def test_job_from_panel_to_scores(spark, panel, tmp_path):
    training, holdout = jobs.panel_to_sequences(panel, sizes=(3, 2, 1))
    assert training.count() == 30 * 6 and holdout.count() == 30
    assert holdout.where("loc_id = 3").head().y_last == 99.0
    got = jobs.train_and_score(training, holdout.where("loc_id <> 3"), str(tmp_path / "m"), str(tmp_path / "p")).head()
    assert got.n == 29 and got.pearson > 0.5
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["loc_id", "year", "y_true", "y_pred"]
    assert jobs.train_and_score(training, holdout.limit(0), str(tmp_path / "m"), str(tmp_path / "q")) is None


@pytest.mark.parametrize(
    "losses, patience, found",
    [
        ([5, 4, 6, 6, 3, 7, 7, 7, 2], 3, (8, 5, True)),  # dips, rises, dips again: the second dip
        ([5, 4, 6, 6, 6, 3], 3, (5, 2, True)),  # the second dip comes too late
        ([5, 4, 3], 2, (3, 3, False)),
        ([5, 5, 5, 5], 3, (4, 1, True)),  # no gain over an equal loss
        ([float("nan"), 4, 5, 5], 2, (4, 2, True)),
        ([], 3, (0, 1, False)),
    ],
)
def test_patience(losses, patience, found):
    stop = M.patience_stop(losses, patience)
    assert (stop.rounds, stop.best, stop.ended) == found


def test_boosted_trees_keep_the_best_round(panel, tmp_path):
    training, holdout = jobs.panel_to_sequences(panel.where("loc_id <> 3"), sizes=(3, 2, 1))
    training, holdout = training.cache(), holdout.cache()
    full = M.fit_boosted(training, None, max_rounds=12, step=0.8)
    assert full.model.stages[0].getNumTrees == 12 and full.losses == ()
    curve = full.model.stages[0].evaluateEachIteration(M.model_rows(holdout), "squared")
    fit = M.fit_boosted(training, holdout, max_rounds=12, patience=2, step=0.8)
    want = M.patience_stop(curve, 2)
    assert fit.stop == want and want.ended and fit.stop.best < 12
    assert fit.losses == pytest.approx(curve[: want.rounds], rel=1e-6)
    kept = fit.model.stages[0]
    assert kept.getNumTrees == want.best and min(fit.losses) == fit.losses[want.best - 1]
    scored = M.predictions(fit.model, holdout)
    rmse = regression_metrics(scored).head().rmse
    assert rmse**2 == pytest.approx(fit.losses[want.best - 1], rel=1e-6)
    M.save_model(fit.model, str(tmp_path / "m"))
    again = M.predictions(M.load_model(str(tmp_path / "m")), holdout)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scored.collect()))


def test_stored_predictions_give_the_metrics(spark, panel, tmp_path):
    training, holdout = jobs.panel_to_sequences(panel.where("loc_id <> 3"), sizes=(3, 2, 1))
    out = str(tmp_path / "p")
    got = jobs.train_and_score(training, holdout, str(tmp_path / "m"), out, validation_year=2017, patience=3, step=0.5, max_rounds=30).head()
    rows = [(r.y_true, r.y_pred) for r in spark.read.parquet(out).collect()]
    t, p = np.array(rows).T
    e = np.abs(p - t)
    assert got.n == 29 == len(rows)
    assert (got.rmse, got.mae) == pytest.approx((math.sqrt((e**2).mean()), e.mean()))
    assert got.pearson == pytest.approx(np.corrcoef(t, p)[0, 1])
    assert got.huber == pytest.approx(np.where(e <= 1, e * e / 2, e - 0.5).mean())
    mean = np.sqrt(((t - np.mean([r.y_last for r in training.collect()])) ** 2).mean())
    assert got.rmse < mean


def plain_huber_fit(x, y, share, reg):
    """Iteratively reweighted least squares of one output: an independent way to the same minimum."""
    x = np.hstack([x, np.ones((len(x), 1))])
    pull = np.diag([reg] * (x.shape[1] - 1) + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(3000):
        error = np.abs(x @ w - y)
        bend = share / np.maximum(1.0, error)
        new = np.linalg.solve((x * bend[:, None]).T @ x + pull, (x * bend[:, None]).T @ y)
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    return w


@pytest.fixture(scope="module")
def small(spark):
    draw = np.random.default_rng(4)
    rows, x = [], draw.normal(size=(80, 5, 2))
    y = x.reshape(80, 10) @ draw.normal(size=(10, 5)) + draw.normal(size=(80, 5)) * 2 + 3
    for k in range(80):
        steps = [([float(x[k, t, 0])], float(x[k, t, 1])) for t in range(5)]
        rows.append((k, [2010 + t for t in range(5)], steps, float(y[k, 0]), [float(v) for v in y[k, 1:]]))
    schema = "loc_id int, years array<int>, steps array<struct<e array<double>, ybar double>>, y_last double, y_prev array<double>"
    return spark.createDataFrame(rows, schema).repartition(3), x.reshape(80, 10), y


@pytest.mark.parametrize("weights", [(1.0, 0.0), (0.75, 0.25)])
def test_joint_fit_equals_plain_fit(small, weights):
    sequences, x, y = small
    fit = J.fit_joint(sequences, weights=weights, keep=("e",), reg=0.01, tolerance=1e-7)
    want = [plain_huber_fit(x, y[:, 0], weights[0] / 80, 0.01)]
    for k in range(1, 5):
        want.append(plain_huber_fit(x, y[:, k], weights[1] / 320, 0.01) if weights[1] else np.zeros(11))
    assert np.abs(fit.coefficients - np.array(want).T).max() < 1e-5
    assert all(b <= a for a, b in zip(fit.losses, fit.losses[1:])) and fit.validation == ()
    scored = J.joint_predictions(fit, sequences, ("e",))
    guess = np.hstack([x, np.ones((80, 1))]) @ fit.coefficients
    for r in scored.collect():
        assert [r.y_pred, *r.prev_pred] == pytest.approx(list(guess[r.loc_id]))
    pulled = 0.005 * (fit.coefficients[:-1] ** 2).sum()
    loss = weighted_loss(scored, previous=("prev_true", "prev_pred"), weights=weights).head().loss
    assert loss + pulled == pytest.approx(fit.losses[-1])


def test_joint_fit_stops_by_patience(small):
    sequences, _, _ = small
    fit = J.fit_joint(sequences.where("loc_id < 14"), sequences.where("loc_id >= 14"), (0.5, 0.5), ("e",), patience=2)
    assert fit.stop.ended and len(fit.validation) == fit.stop.rounds
    assert fit.validation[fit.stop.best - 1] == min(fit.validation)
    scored = J.joint_predictions(fit, sequences.where("loc_id >= 14"), ("e",))
    loss = weighted_loss(scored, previous=("prev_true", "prev_pred"), weights=(0.5, 0.5)).head().loss
    assert loss == pytest.approx(min(fit.validation))
    with pytest.raises(ValueError, match="no training sequences"):
        J.fit_joint(sequences.limit(0), keep=("e",))


def test_joint_fit_passes_over_missing_outputs(small):
    sequences, x, y = small
    gaps = sequences.withColumn("y_prev", F.expr("transform(y_prev, (v, i) -> if(i = 1 AND loc_id < 40, NULL, v))"))
    fit = J.fit_joint(gaps, weights=(0.5, 0.5), keep=("e",), reg=0.01, tolerance=1e-7)
    want = plain_huber_fit(x[40:], y[40:, 2], 0.5 / 280, 0.01)
    assert np.abs(fit.coefficients[:, 2] - want).max() < 1e-5


def test_no_training_rows_stop(spark, panel):
    training, _ = jobs.panel_to_sequences(panel.where("year > 2015"), sizes=(3, 2, 1))
    with pytest.raises(ValueError, match="no training sequences"):
        M.fit_linear(training)


def test_compare_models(panel):
    training, holdout = jobs.panel_to_sequences(panel.where("loc_id <> 3"), sizes=(3, 2, 1))
    got = M.compare_models(training, holdout).collect()
    assert [r.model for r in got] == ["e+s+p+ybar", "e+ybar"] and all(r.n == 29 for r in got)


def test_prepared_panel_has_no_shuffle_or_python(spark, panel):
    plan = P.prepare_panel(panel, 2017)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main and "Python" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["yield_model_score", "yield_model_keys", "model_compare", "joint_outputs"])
def test_registered_fits_derive_the_panel_once(spark, monkeypatch, name):
    from harvestgrid.plans import queries

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("test tables absent")
    panel, written = queries.S.panel, []
    monkeypatch.setattr(queries.S, "panel", lambda *a: written.append(a) or panel(*a))

    def fit(*args, **kwargs):
        raise InterruptedError

    for where, what in ((queries, "train_and_score"), (queries.M, "compare_models"), (queries.J, "fit_joint")):
        monkeypatch.setattr(where, what, fit)
    with pytest.raises(InterruptedError):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(written) == 1
