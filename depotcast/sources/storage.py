"""Small files and folder entries on whatever store Spark's paths name."""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _open(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    store, where = _open(spark, path)
    return store.exists(where)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if it does not exist."""
    store, where = _open(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(where)) if store.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    store, where = _open(spark, path)
    store.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    store, where = _open(spark, path)
    stream = store.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that is seen whole or not at all: under another name first, then renamed."""
    store, where = _open(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = store.create(draft)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    store.delete(where, False)
    if not store.rename(draft, where):
        raise OSError(f"could not rename to {path}")


def listing(df: DataFrame) -> str:
    """What the files behind ``df`` are: their number, bytes and a digest of names, sizes and times.

    Sizes and times come from Spark's listing of the files, not from their content. Data without
    files (made in memory, or computed) is told apart by its plan, which holds for one session.
    """
    files = df.inputFiles()
    if not files:
        return f"plan {df.semanticHash()}"
    found = df.sparkSession.read.format("binaryFile").load(files)
    row = found.agg(
        F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"),
        F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("digest"),
    ).first()
    return f"{row['n']} files, {row['bytes']} bytes, {row['digest'] & (1 << 64) - 1:016x}"
