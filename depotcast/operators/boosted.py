"""Global gradient-boosted forecast: fit, holdout error and recursive projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotcast.config import BoostedConfig
from depotcast.functions.numbers import from_log
from depotcast.operators.features import (
    COVARIATES,
    ENCODED_COLUMNS,
    OPERATIONAL_COVARIATES,
    SERIES,
    category_codes,
    complete_rows,
    encode,
    feature_names,
    lag_features,
    log_target,
    with_month_number,
)
from depotcast.operators.panel import recency_window
from depotcast.runtime import ensure_checkpoint_dir, materialize

# recursive steps planned together: keeps plans and generated code small
_STEPS_PER_WRITE = 6


# rows of a training partition: a tree is many short jobs, each with a task per partition
_ROWS_A_PART = 100_000


@dataclass(frozen=True)
class Training:
    """The encoded recent panel, its feature rows and its label dictionary, each written once."""

    recent: DataFrame
    features: DataFrame
    codes: DataFrame
    config: BoostedConfig


def prepare(panel: DataFrame, config: BoostedConfig, codes: DataFrame | None = None) -> Training:
    """Recent window, log target, codes and lags of a dense panel.

    With ``codes``, the stored label dictionary of a fitted model, the panel is encoded as that
    model's rows were, and labels it has not seen are marked.
    """
    recent = materialize(log_target(recency_window(panel, config.window_months)))
    known = materialize(category_codes(recent)) if codes is None else codes
    encoded = materialize(encode(recent, known, unseen="fail" if codes is None else "mark"))
    return Training(encoded, materialize(complete_rows(lag_features(encoded, config), config)), known, config)


def _cutoff(training: Training) -> Column:
    """First day of the month the holdout starts in."""
    latest = training.recent.agg(F.max("date")).scalar()
    return F.trunc(F.add_months(latest, -training.config.holdout_months), "MM")


def training_table(training: Training) -> DataFrame:
    """All feature rows, with the part each belongs to: ``train`` or ``holdout``."""
    return training.features.withColumn(
        "split", F.when(F.col("date") < _cutoff(training), "train").otherwise("holdout")
    )


def training_part(training: Training) -> DataFrame:
    return training.features.filter(F.col("date") < _cutoff(training))


def _check_history(training: Training) -> None:
    config = training.config
    span = training.recent.agg(
        F.months_between(F.trunc(F.max("date"), "MM"), F.trunc(F.min("date"), "MM")).alias("months")
    ).first()
    have = 0 if span["months"] is None else int(span["months"]) + 1
    # the lags, at least one training month, the cut-off month and the holdout after it
    need = config.target_lags + 1 + config.holdout_months + 1
    if have < need:
        raise ValueError(f"{have} months of history, {need} needed to train and validate")


def _assembler(config: BoostedConfig) -> VectorAssembler:
    return VectorAssembler(inputCols=feature_names(config), outputCol="features")


def fit(training: Training) -> GBTRegressionModel:
    """Train on the months before the cut-off month."""
    _check_history(training)
    config = training.config
    ensure_checkpoint_dir(training.features.sparkSession)
    rows = training_part(training)
    parts = -(-rows.count() // _ROWS_A_PART)
    regressor = GBTRegressor(
        featuresCol="features",
        labelCol="label",
        maxIter=config.trees,
        stepSize=config.learning_rate,
        maxDepth=config.max_depth,
        maxBins=config.max_bins,
        minInstancesPerNode=config.min_leaf,
        seed=config.seed,
    )
    # sorted, so that the same rows give the same trees whatever wrote them
    dealt = rows.repartitionByRange(max(1, parts), *SERIES, "date").sortWithinPartitions(*SERIES, "date")
    return regressor.fit(_assembler(config).transform(dealt).select("features", "label"))


def holdout_predictions(model: GBTRegressionModel, training: Training) -> DataFrame:
    """One-step forecasts from the cut-off month on, in units, beside what happened."""
    rows = training.features.filter(F.col("date") >= _cutoff(training))
    scored = model.transform(_assembler(training.config).transform(rows))
    return scored.select(
        *SERIES, "date", F.expm1("label").alias("actual"), F.expm1("prediction").alias("predicted")
    )


def series_errors(predictions: DataFrame) -> DataFrame:
    """Per series: mean absolute error in units and the number of months it is over."""
    error = F.abs(F.col("actual") - F.col("predicted"))
    return predictions.groupBy(*SERIES).agg(F.avg(error).alias("mae"), F.count(F.lit(1)).alias("months"))


def holdout_errors(model: GBTRegressionModel, training: Training) -> DataFrame:
    """Per series: mean absolute error, in units, of one-step forecasts from the cut-off month on."""
    return series_errors(holdout_predictions(model, training))


def overall_error(series_errors: DataFrame) -> DataFrame:
    """Mean over the series, each counting the same whatever its length."""
    return series_errors.agg(F.avg("mae").alias("mae"), F.count(F.lit(1)).alias("series"))


def _starting_state(training: Training) -> DataFrame:
    """One row per series: its last targets, its last covariates and what repeats from there."""
    config = training.config
    depth = max(config.target_lags, config.covariate_lags)
    latest = training.recent.agg(F.max("date")).scalar()
    tail = with_month_number(
        training.recent.filter(F.col("date") > F.add_months(F.last_day(latest), -depth))
    )
    # `depth` months per series, whatever the length of the panel
    row = F.struct("date", "value_log", *[F.col(c).cast("double").alias(c) for c in COVARIATES])
    codes = [f"{c}_code" for c in ENCODED_COLUMNS]
    grouped = tail.groupBy(*SERIES).agg(
        F.array_sort(F.collect_list(row)).alias("rows"), *[F.first(c).alias(c) for c in codes]
    )
    last = F.element_at("rows", -1)
    ahead = F.sequence(F.lit(1), F.lit(config.horizon))
    future = F.transform(
        ahead, lambda k: F.last_day(F.add_months(F.trunc(last["date"], "MM"), k))
    )

    def history(name: str):
        return F.transform("rows", lambda r: F.coalesce(r[name], F.lit(0.0)))

    extended = [
        F.concat(
            history(c), F.array_repeat(F.coalesce(last[c], F.lit(0.0)), config.horizon)
        ).alias(c)
        for c in OPERATIONAL_COVARIATES
    ]
    months = F.concat(
        history("month_number"), F.transform(future, lambda d: F.month(d).cast("double"))
    )
    return grouped.select(
        *SERIES,
        *codes,
        F.size("rows").alias("known"),
        future.alias("dates"),
        history("value_log").alias("targets"),
        *extended,
        months.alias("month_number"),
        last["population"].isNull().cast("double").alias("population_missing"),
    )


def _features_ahead(step: int, config: BoostedConfig) -> Column:
    """Feature vector of the given step, in the order of ``feature_names``: lag 1 first."""
    deep, wide = config.target_lags, config.covariate_lags
    position = F.col("known") + step
    parts = [F.reverse(F.slice("targets", -deep, deep))]
    parts += [F.reverse(F.slice(c, position - wide, wide)) for c in COVARIATES]
    parts.append(F.array(*[F.col(f"{c}_code").cast("double") for c in ENCODED_COLUMNS], F.col("population_missing")))
    return array_to_vector(F.concat(*parts))


def recursive_forecast(model: GBTRegressionModel, training: Training) -> DataFrame:
    """Project every series ``horizon`` months ahead, each step feeding the next.

    The state is one row per series that carries its own history as arrays, so a
    step is a row-wise transform: no shuffle and no window between the steps, and
    the predictions stay on the row until they are exploded at the end.
    """
    config = training.config
    state = materialize(_starting_state(training))
    columns = state.columns
    for step in range(1, config.horizon + 1):
        scored = model.transform(state.withColumn("features", _features_ahead(step, config)))
        state = scored.withColumn("targets", F.array_append("targets", F.col("prediction"))).select(
            *columns
        )
        if step % _STEPS_PER_WRITE == 0 and step < config.horizon:
            state = materialize(state)
    ahead = F.slice("targets", F.col("known") + 1, config.horizon)
    return state.select(
        *SERIES, F.explode(F.arrays_zip(F.col("dates").alias("date"), ahead.alias("log"))).alias("step")
    ).select("step.date", *SERIES, from_log(F.col("step.log")).alias("value"))
