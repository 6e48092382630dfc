"""Regression metrics, all from one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: error size at which the Huber loss turns linear.
HUBER_DELTA = 1.0


def huber(error: Column, delta: float = HUBER_DELTA) -> Column:
    size = F.abs(error)
    return F.when(size <= delta, error * error / 2).otherwise((size - delta / 2) * delta)


def regression_metrics(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """n, rmse, pearson, mae and huber over all rows (per group of ``by``).

    Pearson is missing for fewer than two rows and for a constant side.
    """
    error = F.col(predicted) - F.col(truth)
    spread = F.stddev_pop(truth) * F.stddev_pop(predicted)
    return df.groupBy(*by).agg(
        F.count(error).alias("n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.when(F.count(error) >= 2, F.try_divide(F.covar_pop(truth, predicted), spread)).alias("pearson"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(huber(error)).alias("huber"),
    )


def weighted_loss(
    df: DataFrame,
    last: tuple[str, str] = ("y_true", "y_pred"),
    previous: tuple[str, str] | None = None,
    weights: tuple[float, float] = (1.0, 0.0),
) -> DataFrame:
    """Weighted sum of the mean Huber losses of the last step and of the previous steps.

    ``previous`` names two array columns, compared entry by entry; its loss is the mean over all entries.
    """
    error = F.col(last[1]) - F.col(last[0])
    if previous is None:
        return df.agg((F.lit(weights[0]) * F.avg(huber(error))).alias("loss"))
    losses = F.zip_with(previous[0], previous[1], lambda t, p: huber(p - t))
    total = F.aggregate(losses, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    known = F.size(F.filter(losses, lambda x: x.isNotNull()))
    return df.agg(
        (
            F.lit(weights[0]) * F.avg(huber(error))
            + F.lit(weights[1]) * F.try_divide(F.sum(total), F.sum(known).cast("double"))
        ).alias("loss")
    )
