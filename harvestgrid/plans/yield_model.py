"""Yield regression on sequences with Spark ML: fit, stop on a validation set, save, score, compare."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestgrid.operators.metrics import regression_metrics
from harvestgrid.operators.sequences import GROUP_NAMES


def flat_features(keep: Sequence[str] = GROUP_NAMES) -> Column:
    """All steps of a sequence as one array; a missing value becomes 0."""
    per_step = F.transform("steps", lambda s: F.concat(*[s[name] for name in keep], F.array(s["ybar"])))
    return F.transform(F.flatten(per_step), lambda x: F.coalesce(x, F.lit(0.0)))


def model_rows(sequences: DataFrame, keep: Sequence[str] = GROUP_NAMES) -> DataFrame:
    """``loc_id, year, label, features`` of each sequence, the year being its last."""
    return sequences.select(
        "loc_id",
        F.element_at("years", -1).alias("year"),
        F.col("y_last").alias("label"),
        array_to_vector(flat_features(keep)).alias("features"),
    )


def _require_rows(rows: DataFrame) -> DataFrame:
    if rows.isEmpty():
        raise ValueError("no training sequences")
    return rows


def fit_linear(sequences: DataFrame, keep: Sequence[str] = GROUP_NAMES, reg: float = 0.1, max_iter: int = 50) -> PipelineModel:
    """Linear regression under Huber loss. Stops with ValueError if there are no sequences."""
    rows = _require_rows(model_rows(sequences, keep))
    learner = LinearRegression(loss="huber", regParam=reg, maxIter=max_iter, solver="l-bfgs")
    return Pipeline(stages=[learner]).fit(rows)


@dataclass(frozen=True)
class Stop:
    """Where a fit with patience ends: ``rounds`` were judged, the model of round ``best`` (from 1) is the one to keep.

    ``ended`` tells whether patience ran out; otherwise the losses did.
    """

    rounds: int
    best: int
    ended: bool


def patience_stop(losses: Sequence[float], patience: int) -> Stop:
    """Stop after ``patience`` rounds in a row without a loss below the least one so far; keep that one's round.

    Of equal losses the first is kept. A missing loss (NaN) is no gain.
    """
    best, least = 0, math.inf
    for k, loss in enumerate(losses, 1):
        if loss < least:
            best, least = k, loss
        elif k - best >= patience:
            return Stop(k, max(best, 1), True)
    return Stop(len(losses), max(best, 1), False)


@dataclass(frozen=True)
class BoostedFit:
    """Boosted trees cut back to the best round, and the validation losses of the rounds that were judged."""

    model: PipelineModel
    losses: tuple[float, ...]
    stop: Stop


def first_trees(model: GBTRegressionModel, count: int) -> GBTRegressionModel:
    """The ensemble of the first ``count`` trees."""
    if count >= model.getNumTrees:
        return model
    context = SparkSession.active().sparkContext
    kinds = context._jvm.org.apache.spark.ml.regression
    trees = context._gateway.new_array(kinds.DecisionTreeRegressionModel, count)
    weights = context._gateway.new_array(context._jvm.double, count)
    for k in range(count):
        trees[k], weights[k] = model.trees[k]._java_obj, model.treeWeights[k]
    cut = GBTRegressionModel(kinds.GBTRegressionModel(model.uid, trees, weights, model.numFeatures))
    return cut.setFeaturesCol(model.getFeaturesCol()).setPredictionCol(model.getPredictionCol())


def fit_boosted(
    sequences: DataFrame,
    validation: DataFrame | None = None,
    keep: Sequence[str] = GROUP_NAMES,
    max_rounds: int = 200,
    patience: int = 20,
    step: float = 0.1,
    depth: int = 4,
    seed: int = 7,
) -> BoostedFit:
    """Boosted trees, a tree a round, that stop by ``patience`` on the validation loss and keep the best round.

    The loss (mean squared error) of every round comes from one pass over the validation rows. Rounds are built in
    doubling batches: the same rows and seed give the same first trees, so a longer fit goes on where a shorter one
    ended, and at most twice the rounds needed are built. The ensemble is then cut back to the best round. ``max_rounds`` holds
    if patience never runs out. Without validation rows all rounds are built and kept, and no losses are given.
    """
    rows = _require_rows(model_rows(sequences, keep))
    learner = GBTRegressor(maxDepth=depth, stepSize=step, seed=seed)
    if validation is None or validation.isEmpty():
        model = learner.setMaxIter(max_rounds).fit(rows)
        return BoostedFit(PipelineModel(stages=[model]), (), Stop(max_rounds, max_rounds, False))
    judged = model_rows(validation, keep)
    rounds = min(max_rounds, max(8, 4 * patience))
    while True:
        model = learner.setMaxIter(rounds).fit(rows)
        losses = model.evaluateEachIteration(judged, "squared")
        stop = patience_stop(losses, patience)
        if stop.ended or rounds >= max_rounds:
            return BoostedFit(PipelineModel(stages=[first_trees(model, stop.best)]), tuple(losses[: stop.rounds]), stop)
        rounds = min(max_rounds, 2 * rounds)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predictions(model: PipelineModel, sequences: DataFrame, keep: Sequence[str] = GROUP_NAMES) -> DataFrame:
    """``loc_id, year, y_true, y_pred``; no rows if there are no sequences."""
    return model.transform(model_rows(sequences, keep)).select(
        "loc_id", "year", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred")
    )


def compare_models(training: DataFrame, holdout: DataFrame, groups: Sequence[Sequence[str]] = (GROUP_NAMES, ("e",))) -> DataFrame:
    """Metrics of one linear fit per feature choice: model, n, rmse, pearson, mae, huber."""
    results = []
    for keep in groups:
        scored = predictions(fit_linear(training, keep), holdout, keep)
        results.append(regression_metrics(scored).select(F.lit("+".join(keep) + "+ybar").alias("model"), "*"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
