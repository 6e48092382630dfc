"""One linear fit of all outputs of a sequence under a weighted Huber loss: the last yield and those before it.

The loss is ``weights[0]`` times the mean Huber loss of the last yield plus ``weights[1]`` times that of all earlier ones. Each
round asks Spark for the loss and its gradient over all outputs at once: tasks give partial sums from Arrow batches, an aggregate by
position adds them, and one row per coefficient comes back. The driver holds coefficients and a few earlier
gradients only (L-BFGS), whatever the number of sequences.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestgrid.operators.metrics import HUBER_DELTA
from harvestgrid.operators.sequences import GROUP_NAMES
from harvestgrid.plans.yield_model import Stop, flat_features, patience_stop
from harvestgrid.sources.sinks import stored

MEMORY = 10


def joint_rows(sequences: DataFrame, keep: Sequence[str] = GROUP_NAMES) -> DataFrame:
    """``loc_id, year, outputs, features``: outputs are the last yield, then the earlier ones; some may be missing."""
    outputs = F.concat(F.array("y_last"), "y_prev")
    return sequences.select(
        "loc_id", F.element_at("years", -1).alias("year"), outputs.alias("outputs"), flat_features(keep).alias("features")
    )


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Equally long arrays as a matrix; a missing entry is NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1)


def loss_and_slope(features: np.ndarray, outputs: np.ndarray, coefficients: np.ndarray, delta: float = HUBER_DELTA):
    """Sums over rows of the Huber loss and its gradient, and the known outputs; each per output."""
    error = features @ coefficients[:-1] + coefficients[-1] - outputs
    known = ~np.isnan(error)
    error = np.where(known, error, 0.0)
    size = np.abs(error)
    loss = np.where(size <= delta, error * error / 2, (size - delta / 2) * delta).sum(0)
    pull = np.clip(error, -delta, delta)
    return loss, np.vstack([features.T @ pull, pull.sum(0)]), known.sum(0)


def _sums(rows: DataFrame, coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Training loss, its gradient, known outputs, and the loss and known outputs of the validation rows, each per output."""
    shared = rows.sparkSession.sparkContext.broadcast(coefficients)
    outputs = coefficients.shape[1]

    def partial(batches):
        at = shared.value
        total = np.zeros((at.shape[0] + 4, outputs))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (_matrix(batch.column(c), batch.num_rows) for c in ("features", "outputs"))
            judged = batch.column("judged").to_numpy(zero_copy_only=False).astype(bool)
            loss, slope, known = loss_and_slope(x[~judged], y[~judged], at)
            there, _, of = loss_and_slope(x[judged], y[judged], at)
            total += np.vstack([slope, loss, known, there, of])
        yield pa.record_batch(
            [pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["position", "amount"]
        )

    # A row per coefficient and output comes back.
    parts = rows.mapInArrow(partial, "position long, amount double").groupBy("position").agg(F.sum("amount").alias("amount"))
    total = np.zeros((coefficients.shape[0] + 4) * outputs)
    for row in parts.collect():
        total[row["position"]] = row["amount"]
    total = total.reshape(-1, outputs)
    shared.unpersist()
    return total[-4], total[:-4], total[-3], np.vstack([total[-2], total[-1]])


def _weighted(losses: np.ndarray, known: np.ndarray, weights: tuple[float, float]) -> float:
    """The weighted sum of the mean losses of the last output and of all earlier ones; none known is no loss."""
    last = losses[0] / known[0] if known[0] else 0.0
    before = losses[1:].sum() / known[1:].sum() if known[1:].sum() else 0.0
    return float(weights[0] * last + weights[1] * before)


@dataclass(frozen=True)
class JointFit:
    """Coefficients (a row per feature, then the constant; a column per output) of the best round, and the losses of all."""

    coefficients: np.ndarray
    losses: tuple[float, ...]
    validation: tuple[float, ...]
    stop: Stop


def _direction(slope: np.ndarray, steps: list[np.ndarray], bends: list[np.ndarray]) -> np.ndarray:
    """The quasi-Newton direction from the last steps and changes of slope (two-loop recursion)."""
    way, held = slope.copy(), []
    for s, y in zip(reversed(steps), reversed(bends)):
        a = (s @ way) / (y @ s)
        way -= a * y
        held.append(a)
    if steps:
        way *= (steps[-1] @ bends[-1]) / (bends[-1] @ bends[-1])
    for (s, y), a in zip(zip(steps, bends), reversed(held)):
        way += (a - (y @ way) / (y @ s)) * s
    return -way


def descend(
    value: Callable[[np.ndarray], tuple[float, np.ndarray, float | None]],
    start: np.ndarray,
    max_rounds: int,
    patience: int,
    tolerance: float,
) -> tuple[np.ndarray, list[float], list[float], Stop]:
    """L-BFGS with backtracking from ``start``; ``value`` gives loss, gradient and validation loss (None: none).

    With validation losses it stops by ``patience`` and gives back the best round's place; in any case it ends where the gradient's
    largest entry is at most ``tolerance`` or no step lowers the loss. A round is a step taken.
    """
    at, (loss, slope, judged) = start, value(start)
    best, losses, curve = at, [loss], [] if judged is None else [judged]
    steps: list[np.ndarray] = []
    bends: list[np.ndarray] = []
    while len(losses) <= max_rounds and np.abs(slope).max() > tolerance:
        way = _direction(slope, steps, bends)
        size = 1.0 if steps else min(1.0, 1.0 / max(1e-12, float(np.abs(slope).sum())))
        for _ in range(30):
            there = at + size * way
            new, new_slope, new_judged = value(there)
            if new <= loss + 1e-4 * size * float(slope @ way):
                break
            size /= 2
        else:
            break
        step, bend = there - at, new_slope - slope
        if step @ bend > 1e-12:
            steps, bends = [*steps, step][-MEMORY:], [*bends, bend][-MEMORY:]
        at, loss, slope = there, new, new_slope
        losses.append(loss)
        if new_judged is not None:
            if new_judged < min(curve):
                best = at
            curve.append(new_judged)
            if patience_stop(curve, patience).ended:
                break
    if not curve:
        return at, losses, [], Stop(len(losses), len(losses), False)
    return best, losses, curve, patience_stop(curve, patience)


def fit_joint(
    sequences: DataFrame,
    validation: DataFrame | None = None,
    weights: tuple[float, float] = (1.0, 0.0),
    keep: Sequence[str] = GROUP_NAMES,
    reg: float = 0.0,
    max_rounds: int = 200,
    patience: int = 20,
    tolerance: float = 1e-6,
) -> JointFit:
    """Fit all outputs at once: linear in the flat features, weighted Huber loss plus ``reg / 2`` times the squared coefficients.

    Missing outputs take no part. The constant is not drawn to zero. An output of weight 0 stays at zero. With validation sequences the
    weighted loss on them stops the fit by patience, and the best round is kept. No training sequences raise ValueError.
    """
    rows = joint_rows(sequences, keep).withColumn("judged", F.lit(False))
    if validation is not None:
        rows = rows.unionByName(joint_rows(validation, keep).withColumn("judged", F.lit(True)))
    rows = stored(rows.where("outputs IS NOT NULL").select("outputs", "features", "judged"), "joint_rows")
    first = rows.where("NOT judged").select(F.size("features").alias("width"), F.size("outputs").alias("outputs")).first()
    if first is None:
        raise ValueError("no training sequences")
    shape = (first["width"] + 1, first["outputs"])

    def value(flat: np.ndarray) -> tuple[float, np.ndarray, float | None]:
        at = flat.reshape(shape)
        losses, slope, known, judged = _sums(rows, at)
        share = np.concatenate([[weights[0] / max(1.0, known[0])], np.full(shape[1] - 1, weights[1] / max(1.0, known[1:].sum()))])
        pulled = at.copy()
        pulled[-1] = 0.0
        total = _weighted(losses, known, weights) + reg / 2 * float((pulled**2).sum())
        return total, (slope * share + reg * pulled).ravel(), _weighted(*judged, weights) if judged[1].any() else None

    best, losses, curve, stop = descend(value, np.zeros(shape[0] * shape[1]), max_rounds, patience, tolerance)
    return JointFit(best.reshape(shape), tuple(losses), tuple(curve), stop)


def joint_predictions(fit: JointFit, sequences: DataFrame, keep: Sequence[str] = GROUP_NAMES) -> DataFrame:
    """``loc_id, year, y_true, y_pred, prev_true, prev_pred``; the last two are arrays of the earlier outputs."""
    outputs = []
    for k in range(fit.coefficients.shape[1]):
        slopes = F.lit([float(c) for c in fit.coefficients[:-1, k]])
        products = F.zip_with("features", slopes, lambda x, c: x * c)
        outputs.append(F.aggregate(products, F.lit(float(fit.coefficients[-1, k])), lambda total, x: total + x))
    return joint_rows(sequences, keep).select(
        "loc_id",
        "year",
        F.element_at("outputs", 1).alias("y_true"),
        outputs[0].alias("y_pred"),
        F.slice("outputs", 2, len(outputs) - 1).alias("prev_true"),
        F.array(*outputs[1:]).alias("prev_pred"),
    )
