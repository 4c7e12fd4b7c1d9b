"""Lagged features of the global model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depotcast.config import BoostedConfig
from depotcast.contracts import require
from depotcast.functions.numbers import to_log
from depotcast.operators.ranking import with_global_row_number

SERIES = ["branch", "product"]
ENCODED_COLUMNS = ("state", "city", "branch", "rank", "product", "urban_tier")
OPERATIONAL_COVARIATES = (
    "operational_total", "maintenance_total", "ready_total", "mech_total", "mech_present",
    "population",
)
COVARIATES = (*OPERATIONAL_COVARIATES, "month_number")
MISSING_LABEL = "nan"
# the code of a label that the dictionary does not have
UNSEEN = -1


def log_target(panel: DataFrame) -> DataFrame:
    return panel.withColumn("value_log", to_log(F.col("value")))


def category_codes(df: DataFrame, columns: Sequence[str] = ENCODED_COLUMNS) -> DataFrame:
    """The label dictionary of ``df``: (column, label, code), codes 0.. in the order of the labels.

    NULL is a label of its own. All columns are ranked in one global pass and each
    code is the distance to the first label of its column. Stored, the dictionary encodes
    and decodes later data as well.
    """
    labels = (
        df.select([F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LABEL)).alias(c) for c in columns])
        .unpivot([], list(columns), "column", "label")
        .distinct()
    )
    ranked = with_global_row_number(labels, ["column", "label"], "rank")
    starts = ranked.groupBy("column").agg(F.min("rank").alias("first"))
    return ranked.join(starts, "column").select(
        "column", "label", (F.col("rank") - F.col("first")).cast("long").alias("code")
    )


def encode(
    df: DataFrame, codes: DataFrame, columns: Sequence[str] = ENCODED_COLUMNS, unseen: str = "fail"
) -> DataFrame:
    """Add ``<column>_code`` for every encoded column, from a label dictionary.

    A label that the dictionary lacks fails the query with its name, or has the code
    ``UNSEEN`` if ``unseen`` is "mark". The labels are looked up on the distinct
    combinations, one per branch and product, and ``df`` is joined once by the whole
    combination: a join by a single label such as the product would put a third of the
    rows on one key.
    """
    if unseen not in ("fail", "mark"):
        raise ValueError(f"unseen labels either fail or are marked: {unseen}")
    combinations = df.select(*columns).distinct()
    for c in columns:
        own = codes.filter(F.col("column") == c).select(
            F.col("label").alias("_label"), F.col("code").alias("_code")
        )
        label = F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LABEL))
        missing = F.lit(UNSEEN).cast("long")
        if unseen == "fail":
            missing = F.raise_error(F.concat(F.lit(f"no code for the {c} "), label)).cast("long")
        combinations = (
            combinations.join(own, label == F.col("_label"), "left")
            .withColumn(f"{c}_code", F.coalesce("_code", missing)).drop("_label", "_code")
        )
    looked_up = combinations.withColumnsRenamed({c: f"_{c}" for c in columns})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    return df.join(looked_up, same, "left").drop(*[f"_{c}" for c in columns])


def decode(df: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """Replace ``<column>_code`` by its label; ``UNSEEN`` and other unknown codes have none (NULL)."""
    own = codes.filter(F.col("column") == column).select(
        F.col("label").alias(column), F.col("code").alias(f"{column}_code")
    )
    return df.drop(column).join(own, f"{column}_code", "left").drop(f"{column}_code")


def with_month_number(panel: DataFrame) -> DataFrame:
    return panel.withColumn("month_number", F.month("date"))


def feature_names(config: BoostedConfig) -> list[str]:
    return [
        *[f"value_lag_{k}" for k in range(1, config.target_lags + 1)],
        *[f"{c}_lag_{k}" for c in COVARIATES for k in range(1, config.covariate_lags + 1)],
        *[f"{c}_code" for c in ENCODED_COLUMNS],
        "population_missing",
    ]


def lag_features(encoded: DataFrame, config: BoostedConfig) -> DataFrame:
    """Target and covariate lags of every row, one window per series.

    ``encoded`` is the recent panel with ``value_log`` and the category codes. A
    window partition is one series of the recency window, so at most
    ``window_months + 1`` rows per product of a branch.
    """
    frame = with_month_number(encoded)
    require(frame, [*SERIES, "date", "value_log", *COVARIATES], "encoded panel")
    by_time = Window.partitionBy(*SERIES).orderBy("date")
    lags = [
        F.lag("value_log", k).over(by_time).alias(f"value_lag_{k}")
        for k in range(1, config.target_lags + 1)
    ]
    lags += [
        F.lag(c, k).over(by_time).cast("double").alias(f"{c}_lag_{k}")
        for c in COVARIATES
        for k in range(1, config.covariate_lags + 1)
    ]
    codes = [f"{c}_code" for c in ENCODED_COLUMNS]
    return frame.select(*SERIES, "date", "value", F.col("value_log").alias("label"), *lags, *codes)


def complete_rows(features: DataFrame, config: BoostedConfig) -> DataFrame:
    """Rows whose lags reach back far enough.

    A NULL population becomes 0 and is marked in ``population_missing``.
    """
    known = features.filter(F.col(f"value_lag_{config.target_lags}").isNotNull()).withColumn(
        "population_missing", F.col("population_lag_1").isNull().cast("double")
    )
    return known.na.fill(0, [f"population_lag_{k}" for k in range(1, config.covariate_lags + 1)])


def future_covariates(panel: DataFrame, horizon: int = 12) -> DataFrame:
    """The panel's covariates and ``horizon`` more months that repeat the last ones.

    The month number follows the calendar.
    """
    keep = [*SERIES, "date", *OPERATIONAL_COVARIATES]
    last = panel.groupBy(*SERIES).agg(
        F.max_by(F.struct("date", *OPERATIONAL_COVARIATES), "date").alias("last")
    )
    future = last.select(
        *SERIES, "last.*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("_ahead")
    ).withColumn("date", F.last_day(F.add_months(F.trunc("date", "MM"), F.col("_ahead"))))
    both = panel.select(*keep, F.lit(0).alias("is_future")).unionByName(
        future.select(*keep, F.lit(1).alias("is_future"))
    )
    return with_month_number(both)
