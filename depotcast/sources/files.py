"""Readers and writers around the operators."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from depotcast.contracts import conform


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; ``path`` may be a folder or a glob and files may start with a BOM.

    Columns are found by name. Everything is read as text and, given a contract,
    parsed to it; what does not parse becomes NULL.
    """
    raw = spark.read.csv(path, header=True, enforceSchema=False, multiLine=False)
    return raw if schema is None else conform(raw, schema, path)


def run_sql(spark: SparkSession, text: str, args: Mapping[str, Any] | None = None) -> DataFrame:
    """SQL with named parameters (``:name``), never with values pasted into the text."""
    return spark.sql(text, args=dict(args or {}))


def run_sql_file(spark: SparkSession, path: str, args: Mapping[str, Any] | None = None) -> DataFrame:
    return run_sql(spark, Path(path).read_text(encoding="utf-8"), args)


def write_parquet(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite"
) -> DataFrame:
    """Write and read back: later steps start from the written table."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if not partition_by else (
        df.sparkSession.read.parquet(path)
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)
