"""Global row numbers and n-tiles that do not pull the whole input into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depotcast.runtime import materialize

_SLICE = "_slice"


def with_global_row_number(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """Add a 1-based rank over the whole of ``df``; ``order`` must be a total order.

    ``row_number`` without a partition key sorts everything in one task. Here the
    rows are range-partitioned, written once so that the ranges stay as they are,
    numbered inside each range and shifted by the size of the ranges before it.
    """
    return _number(_sliced(df, order), order, name)


def _sliced(df: DataFrame, order: Sequence[str]) -> DataFrame:
    ranged = df.repartitionByRange(*[F.col(c) for c in order])
    return materialize(ranged.withColumn(_SLICE, F.spark_partition_id()))


def _number(ranged: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    # one row per shuffle partition: bounded by spark.sql.shuffle.partitions whatever the input size
    offsets = (
        ranged.groupBy(_SLICE)
        .agg(F.count(F.lit(1)).alias("_size"))
        .select(
            _SLICE,
            F.coalesce(
                F.sum("_size").over(
                    Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_offset"),
        )
    )
    within = F.row_number().over(Window.partitionBy(_SLICE).orderBy(*order))
    return (
        ranged.join(F.broadcast(offsets), _SLICE)
        .withColumn(name, within + F.col("_offset"))
        .drop(_SLICE, "_offset")
    )


def with_global_ntile(df: DataFrame, buckets: int, order: Sequence[str], name: str = "bucket") -> DataFrame:
    """``ntile(buckets)`` over the whole of ``df``, for a total order."""
    ranged = _sliced(df, order)
    ranked = _number(ranged, order, "_rank")
    total = ranged.agg(F.count(F.lit(1))).scalar()
    k = F.lit(buckets)
    ranked = ranked.withColumn("_extra", total % k).withColumn(
        "_base", ((total - F.col("_extra")) / k).cast("long")
    )
    rank, base, extra = F.col("_rank"), F.col("_base"), F.col("_extra")
    # the first `extra` buckets hold one row more than the others
    in_larger = extra * (base + 1)
    bucket = F.when(
        rank <= in_larger, F.floor((rank - 1) / (base + 1)) + 1
    ).otherwise(extra + F.floor((rank - in_larger - 1) / F.greatest(base, F.lit(1))) + 1)
    return ranked.withColumn(name, bucket.cast("int")).drop("_rank", "_base", "_extra")
