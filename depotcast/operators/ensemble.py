"""Three closed-form forecasts per (branch, product) and their mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depotcast.config import PRODUCTS, EnsembleConfig
from depotcast.contracts import require
from depotcast.functions.dates import month_ends
from depotcast.operators.rollups import to_products

_RENTED = {f"rented_{p}": p for p in PRODUCTS}


def monthly_series(wide: DataFrame) -> DataFrame:
    """Rented stock by (branch, product, first day of month)."""
    require(wide, ["month_end", "branch", *_RENTED], "wide table")
    monthly = (
        wide.filter(F.col("branch").isNotNull() & F.col("month_end").isNotNull())
        .groupBy("branch", F.trunc("month_end", "MM").alias("month"))
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in _RENTED])
    )
    return to_products(monthly, ["branch", "month"], _RENTED)


def _on_calendar(series: DataFrame) -> DataFrame:
    """Fill the months a series skips with 0, between its own first and last month."""
    keys = ["branch", "product"]
    spans = series.groupBy(*keys).agg(F.min("month").alias("first"), F.max("month").alias("last"))
    months = spans.select(
        *keys,
        F.explode(
            F.transform(month_ends(F.col("first"), F.col("last")), lambda d: F.trunc(d, "MM"))
        ).alias("month"),
    )
    return months.join(series, [*keys, "month"], "left").na.fill(0, ["value"])


def ensemble_forecast(wide: DataFrame, config: EnsembleConfig, calendar: bool = False) -> DataFrame:
    """Moving average, linear trend, exponential smoothing and their plain mean.

    A series is indexed by the position of its rows, so skipped months close up;
    ``calendar`` fills them with 0 instead. Series with a single month are left
    out. One shuffle by (branch, product) serves the window and the aggregation,
    and a group holds one row per month.
    """
    keys = ["branch", "product"]
    series = monthly_series(wide).filter(F.col("month") <= F.lit(config.cutoff))
    if calendar:
        series = _on_calendar(series)
    ordered = Window.partitionBy(*keys).orderBy("month")
    indexed = series.withColumn("i", F.row_number().over(ordered) - 1).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy(*keys))
    )
    i, n, value = F.col("i"), F.col("n"), F.col("value")
    window = F.when(n < config.window, F.greatest(F.lit(1), n - 1)).otherwise(F.lit(config.window))
    # weight of the i-th value in the last smoothed level, seeded with the first value
    decay = F.pow(F.lit(1 - config.alpha), n - 1 - i)
    weight = F.when(i == 0, decay).otherwise(F.lit(config.alpha) * decay)
    fitted = (
        indexed.filter(n >= 2)
        .groupBy(*keys)
        .agg(
            F.max("n").alias("n"),
            F.avg(F.when(i >= n - window, value)).alias("ma"),
            F.avg("value").alias("mean"),
            F.regr_slope(value, i.cast("double")).alias("slope"),
            F.regr_intercept(value, i.cast("double")).alias("intercept"),
            F.sum(weight * value).alias("es"),
        )
    )
    step = F.col("step")
    trend = F.when(n < 3, F.col("mean")).otherwise(
        F.greatest(F.col("intercept") + F.col("slope") * (n + step), F.lit(0.0))
    )
    first = F.add_months(F.trunc(F.lit(config.cutoff), "MM"), 1)
    return (
        fitted.select("*", F.explode(F.sequence(F.lit(0), F.lit(config.horizon - 1))).alias("step"))
        .select(
            "branch",
            F.date_format(F.add_months(first, step), "yyyy-MM").alias("period"),
            "product",
            "ma",
            trend.alias("lr"),
            "es",
        )
        .withColumn("ensemble", (F.col("ma") + F.col("lr") + F.col("es")) / 3)
    )


def ensemble_summary(forecast: DataFrame) -> DataFrame:
    return forecast.groupBy("period", "product").agg(F.sum("ensemble").alias("total"))


def ensemble_summary_table(summary: DataFrame) -> DataFrame:
    """Period x product with whole units, closed by a row of column totals.

    The totals add the exact values and are rounded once.
    """
    cells = [F.sum(F.when(F.col("product") == p, F.col("total"))).alias(p) for p in PRODUCTS]
    table = summary.rollup("period").agg(*cells, F.grouping("period").alias("_all"))

    def shown(product: str):
        value = F.coalesce(F.col(product), F.lit(0.0))
        return F.when(F.col("_all") == 1, F.round(value)).otherwise(value).cast("long").alias(product)

    return table.select(
        F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("period")).alias("period"),
        *[shown(p) for p in PRODUCTS],
    ).orderBy("period")
