"""Column catalogue of a set of tables, with the statistics of each column."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotcast.functions.measures import quoted

_NESTED = (T.ArrayType, T.MapType, T.StructType)
_FLOATING = (T.DoubleType, T.FloatType)
_LONG_VALUES = (*_NESTED, T.StringType, T.BinaryType)
_MOMENTS = (T.DateType, T.TimestampType, T.TimestampNTZType)

#: Columns whose distinct values share one exact count.
COLUMNS_AT_ONCE = 4
#: Size of a distinct sketch, as a power of two, and how far its count may be off (over 3 standard deviations).
SKETCH_BITS, SKETCH_TOLERANCE = 14, 0.03


def _text(value: str, kind: T.DataType) -> str:
    """Text of a value the way a sheet would show it; nested values have none."""
    if isinstance(kind, _NESTED):
        return "CAST(NULL AS STRING)"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return f"date_format({value}, 'yyyy-MM-dd HH:mm:ss')"
    return f"CAST({value} AS STRING)"


def _statistics(name: str, table: DataFrame) -> DataFrame:
    """Everything but the distinct counts: one scan and a one-row aggregate."""
    aggregates, rows = ["count(1) AS n"], []
    for i, field in enumerate(table.schema.fields):
        column, kind = f"`{field.name}`", field.dataType
        if isinstance(kind, _NESTED):
            least = most = length = "CAST(NULL AS STRING)"
        else:
            least, most = _text(f"min({column})", kind), _text(f"max({column})", kind)
            # other values than text are longest at one of their extremes
            length = (
                f"max(length({column}))"
                if isinstance(kind, _LONG_VALUES)
                else f"greatest(length({least}), length({most}))"
            )
        aggregates += [
            f"count({column}) AS present_{i}", f"{least} AS min_{i}", f"{most} AS max_{i}",
            f"CAST({length} AS BIGINT) AS length_{i}",
            *[
                (f"CAST({f}({column}) AS DOUBLE)" if isinstance(kind, _FLOATING) else "CAST(NULL AS DOUBLE)")
                + f" AS {f}_number_{i}"
                for f in ("min", "max")
            ],
        ]
        rows.append(
            f"named_struct('ordinal', {i + 1}L, 'column_name', {quoted(field.name)}, "
            f"'data_type', {quoted(kind.simpleString())}, 'null_count', n - present_{i}, "
            f"'min_value', min_{i}, 'max_value', max_{i}, 'max_text_length', length_{i}, "
            f"'min_number', min_number_{i}, 'max_number', max_number_{i})"
        )
    return table.selectExpr(*aggregates).selectExpr(
        f"{quoted(name)} AS table_name", f"inline(array({', '.join(rows)}))"
    )


def _exact_distinct_counts(table: DataFrame) -> DataFrame:
    """(ordinal, distinct_count), ``COLUMNS_AT_ONCE`` columns per scan and shuffle.

    A scan reads the columns of its group only, and a shuffle holds their distinct values only, so
    a wide table never has all its cells in one shuffle and a long text is not in each of them.
    """
    numbered = list(enumerate(table.schema.fields, 1))
    groups = [numbered[i : i + COLUMNS_AT_ONCE] for i in range(0, len(numbered), COLUMNS_AT_ONCE)]
    return reduce(DataFrame.unionAll, [_distinct_in_group(table, group) for group in groups])


def _distinct_in_group(table: DataFrame, fields: list[tuple[int, T.StructField]]) -> DataFrame:
    """A row becomes one (column, value) pair per column, with a slot for each type,
    and the pairs are deduplicated before the shuffle. Text and nested values,
    which may be long, travel as 256-bit digests.
    """

    def slot_type(kind: T.DataType) -> str:
        return "binary" if isinstance(kind, _LONG_VALUES) else kind.simpleString()

    def value(field: T.StructField) -> str:
        column = f"`{field.name}`"
        if not isinstance(field.dataType, _LONG_VALUES):
            return column
        text = f"to_json({column})" if isinstance(field.dataType, _NESTED) else column
        return f"unhex(sha2({text}, 256))"

    slots = list(dict.fromkeys(slot_type(f.dataType) for _, f in fields))
    pairs = [
        f"named_struct('ordinal', {i}L, "
        + ", ".join(
            f"'v{s}', " + (value(f) if slot == slot_type(f.dataType) else f"CAST(NULL AS {slot})")
            for s, slot in enumerate(slots)
        )
        + ")"
        for i, f in fields
    ]
    return (
        table.selectExpr(f"inline(array({', '.join(pairs)}))")
        .filter(" OR ".join(f"v{s} IS NOT NULL" for s in range(len(slots))))
        .distinct()
        .groupBy("ordinal")
        .agg(F.count(F.lit(1)).alias("distinct_count"))
    )


def _approximate_distinct_counts(table: DataFrame) -> DataFrame:
    names = table.columns
    rows = [f"named_struct('ordinal', {i + 1}L, 'distinct_count', d_{i})" for i in range(len(names))]
    return table.selectExpr(
        *[f"approx_count_distinct(`{c}`) AS d_{i}" for i, c in enumerate(names)]
    ).selectExpr(f"inline(array({', '.join(rows)}))")


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Schema, table, column, ordinal and type of every table and view that the catalogue lists.

    The listing itself is metadata, one entry per column, and is made by the driver.
    """
    database = database or spark.catalog.currentDatabase()
    entries = []
    for table in spark.catalog.listTables(database):
        name = f"`{table.name}`" if table.isTemporary else f"`{database}`.`{table.name}`"
        for ordinal, field in enumerate(spark.table(name).schema.fields, 1):
            entries.append((None if table.isTemporary else database, table.name, field.name, ordinal, field.dataType.simpleString()))
    schema = "table_schema string, table_name string, column_name string, ordinal int, data_type string"
    return spark.createDataFrame(sorted(entries, key=lambda e: (e[0] or "", e[1], e[3])), schema)


def column_profile(tables: Mapping[str, DataFrame], exact: bool = False) -> DataFrame:
    """Per table and column: position, type, NULLs, distinct values, extremes and text width.

    Extremes are text; floating-point columns have theirs as numbers, too. Text, binary and
    nested values are counted by digest, and the approximate count is off by 5% (one standard
    deviation) without ``exact``.
    """
    count = _exact_distinct_counts if exact else _approximate_distinct_counts
    statistics = [_statistics(n, t) for n, t in tables.items()]
    distincts = [
        count(t).selectExpr(f"{quoted(n)} AS table_name", "ordinal", "distinct_count")
        for n, t in tables.items()
    ]
    return (
        reduce(DataFrame.unionAll, statistics)
        .join(reduce(DataFrame.unionAll, distincts), ["table_name", "ordinal"], "left")
        # a column without any value has no pairs to count
        .na.fill(0, ["distinct_count"])
        .orderBy("table_name", "ordinal")
    )


# --- profiles in parts ------------------------------------------------------------------


def _slot(kind: T.DataType) -> str | None:
    """The slot that a type's extremes are kept in, where they compare as they are."""
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return "whole"
    if isinstance(kind, _FLOATING):
        return "number"
    if isinstance(kind, T.DecimalType):
        return "exact"
    if isinstance(kind, _MOMENTS):
        return "moment"
    return "text" if isinstance(kind, T.StringType) else None


_SLOTS = {"whole": "bigint", "number": "double", "exact": "decimal(38,18)", "moment": "timestamp_ntz", "text": "string"}


def profile_part(tables: Mapping[str, DataFrame]) -> DataFrame:
    """What a part of each table adds to its profile: one row per column, in a form that merges.

    Counts, extremes in slots by type, the longest text and a distinct sketch; one scan and one
    one-row aggregate per table. Write it once per part (a day's files, a partition), and
    ``merged_profile`` gives the profile of any set of parts without reading them again.
    """
    return reduce(DataFrame.unionAll, [_part_of(n, t) for n, t in tables.items()])


def _part_of(name: str, table: DataFrame) -> DataFrame:
    aggregates, rows = ["count(1) AS n"], []
    for i, field in enumerate(table.schema.fields):
        column, kind, own = f"`{field.name}`", field.dataType, _slot(field.dataType)
        value = f"xxhash64({f'to_json({column})' if isinstance(kind, _NESTED) else column})"
        aggregates += [
            f"count({column}) AS present_{i}",
            f"hll_sketch_agg(CASE WHEN {column} IS NOT NULL THEN {value} END, {SKETCH_BITS}) AS sketch_{i}",
            ("max(length(" + column + "))" if isinstance(kind, (T.StringType, T.BinaryType)) else "CAST(NULL AS INT)")
            + f" AS longest_{i}",
        ]
        slots = []
        for f in ("min", "max"):
            if own:
                aggregates.append(f"{f}({column}) AS {f}_{i}")
            slots += [
                f"'{f}_{slot}', " + (f"CAST({f}_{i} AS {sql})" if slot == own else f"CAST(NULL AS {sql})")
                for slot, sql in _SLOTS.items()
            ]
        rows.append(
            f"named_struct('ordinal', {i + 1}L, 'column_name', {quoted(field.name)}, "
            f"'data_type', {quoted(kind.simpleString())}, 'n_rows', n, 'present', present_{i}, "
            f"'longest', longest_{i}, 'sketch', sketch_{i}, {', '.join(slots)})"
        )
    return table.selectExpr(*aggregates).selectExpr(
        f"{quoted(name)} AS table_name", f"inline(array({', '.join(rows)}))"
    )


def _shown(extreme: str) -> Column:
    """An extreme as text, from the slot of its column's type."""
    kind = F.col("data_type")
    whole, moment = F.col(f"{extreme}_whole"), F.col(f"{extreme}_moment")
    return (
        F.when(kind == "boolean", (whole == 1).cast("string"))
        .when(kind == "date", moment.cast("date").cast("string"))
        .when(kind.startswith("timestamp"), F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == "float", F.col(f"{extreme}_number").cast("float").cast("string"))
        .when(kind == "double", F.col(f"{extreme}_number").cast("string"))
        .when(kind.startswith("decimal"), F.col(f"{extreme}_exact").cast("string"))
        .when(kind == "string", F.col(f"{extreme}_text"))
        .otherwise(whole.cast("string"))
    )


def merged_profile(parts: DataFrame) -> DataFrame:
    """The profile of tables from the profiles of their parts.

    Extremes, NULLs and lengths are exact. Distinct values are counted from the united sketches, off
    by less than ``SKETCH_TOLERANCE``; a value that is in several parts counts once.
    """
    merged = parts.groupBy("table_name", "ordinal", "column_name", "data_type").agg(
        F.sum("n_rows").alias("n_rows"),
        (F.sum("n_rows") - F.sum("present")).alias("null_count"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_count"),
        F.max("longest").alias("longest"),
        *[getattr(F, f)(f"{f}_{slot}").alias(f"{f}_{slot}") for f in ("min", "max") for slot in _SLOTS],
    )
    shown = merged.withColumns({"min_value": _shown("min"), "max_value": _shown("max")})
    return shown.select(
        "table_name", "ordinal", "column_name", "data_type", "n_rows", "null_count", "distinct_count", "min_value", "max_value",
        F.coalesce("longest", F.greatest(F.length("min_value"), F.length("max_value"))).cast("long").alias("max_text_length"),
    ).orderBy("table_name", "ordinal")
