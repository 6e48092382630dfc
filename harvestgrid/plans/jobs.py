"""The three jobs, end to end: yield panel to scores, field records to weather table, places to names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestgrid.operators import panel as P
from harvestgrid.operators import sequences as Q
from harvestgrid.operators.merge import backfill_column, merge_vapour_pressure
from harvestgrid.operators.metrics import regression_metrics
from harvestgrid.operators.nearest import nearest_place
from harvestgrid.operators.quality import COMPLETE_AFTER_BLANKS, complete_records, null_profile
from harvestgrid.operators.spatial import DAILY_ELEMENTS, site_weather
from harvestgrid.plans import yield_model as M
from harvestgrid.sources.sinks import stored, write_parquet
from harvestgrid.sources.tables import GROUP_SIZES, field_records


def panel_to_sequences(
    panel: DataFrame,
    order: str | None = "src_order",
    last_training_year: int = 2017,
    holdout_year: int = 2018,
    mean_years: Sequence[int] = (2014, 2015, 2016, 2017),
    sizes: Sequence[int] = GROUP_SIZES,
    keep: Sequence[str] = Q.GROUP_NAMES,
) -> tuple[DataFrame, DataFrame]:
    """Training and hold-out sequences from a raw panel.

    As in the panel's definition, statistics see all rows; repeated keys are dropped after scaling
    and filtering for the sequences, while yearly means still count every row. From the stored panel on, feature
    rows are shuffled once, by location; only rows of repeated keys are shuffled before that too.
    """
    prepared = stored(P.prepare_panel(panel, last_training_year), "prepared_panel")
    scalars = P.year_scalars(prepared, holdout_year)
    unique = P.drop_repeats(prepared, order)
    training = Q.training_sequences(unique, scalars, holdout_year, sizes, keep)
    means = P.mean_year_steps(prepared, scalars, mean_years, sum(sizes))
    holdout = Q.holdout_sequences(unique, scalars, means, holdout_year, sizes, keep)
    return training, holdout


def train_and_score(
    training: DataFrame,
    holdout: DataFrame,
    model_path: str,
    out_path: str,
    keep: Sequence[str] = Q.GROUP_NAMES,
    validation_year: int | None = None,
    **boosting: float,
) -> DataFrame | None:
    """Fit, save, reload, score and store the predictions; returns the metrics.

    Sequences that end in ``validation_year`` stop the boosted trees by patience and are not trained on; the hold-out never takes
    part. ``boosting`` goes to ``fit_boosted``. Without that year, or without sequences of it, the fit is linear. No training sequences stop the job; without hold-out sequences scoring is skipped.
    """
    training = stored(training, "training_sequences")
    last = F.element_at("years", -1)
    validation = training.where(last == validation_year) if validation_year is not None else None
    if validation is None or validation.isEmpty():
        M.save_model(M.fit_linear(training, keep), model_path)
    else:
        fit = M.fit_boosted(training.where(last != validation_year), validation, keep, **boosting)
        M.save_model(fit.model, model_path)
    if holdout.isEmpty():
        return None
    write_parquet(M.predictions(M.load_model(model_path), holdout, keep), out_path)
    return regression_metrics(training.sparkSession.read.parquet(out_path))


def weather_table(grid: DataFrame, records: DataFrame, elements: Sequence[str] = tuple(DAILY_ELEMENTS), years: Sequence[int] = (2015, 2016, 2017, 2018)) -> DataFrame:
    """Season weather of every complete field record of the given years."""
    sites = field_records(complete_records(records, COMPLETE_AFTER_BLANKS, blank_is_missing=True))
    return site_weather(grid, sites.where(sites["year"].isin(list(years))), elements)


def labelled_weather(weather: DataFrame, elements: DataFrame) -> DataFrame:
    """The weather table with each element column renamed to its label and unit, for an export."""
    known = elements.where(elements["element"].isin(list(DAILY_ELEMENTS))).select("element", "unit").distinct()
    units = {r["element"]: r["unit"] for r in known.collect()}
    return weather.withColumnsRenamed({code: f"{name} ({units.get(code, '')})" for code, name in DAILY_ELEMENTS.items()})


def repaired_weather(weather: DataFrame, sheet: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The weather table with the drifted column copied back and vapour pressure merged, and its null profile."""
    table = merge_vapour_pressure(backfill_column(weather), sheet, targets)
    return table, null_profile(table)


def named_places(records: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Complete field records with the nearest place's city and prefecture."""
    return nearest_place(field_records(complete_records(records)), gazetteer).drop("distance_m")
