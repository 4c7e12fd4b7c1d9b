"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

import depotcast
from depotcast.runtime import ensure_checkpoint_dir

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per application, in case it is not installed there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(depotcast.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="depotcast-"), "depotcast.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)  # the driver serves it to the executors
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], base: str) -> str:
    """A column name that none of ``taken`` has (Spark compares names without case)."""
    used = {x.lower() for x in taken}
    name, n = base, 0
    while name.lower() in used:
        n += 1
        name = f"{base}_{n}"
    return name


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the one that the cluster shares (``spark.checkpoint.dir``)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        ensure_checkpoint_dir(spark)  # local sessions without the setting, as in tests
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: How tables are written: a query's shuffle files go when it has ended, and a batch of rows for
#: Python holds about 8 MB of long texts (Spark's own bound is 64 MB).
_WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for a while; what was set before comes back."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Unlike a checkpoint it keeps column pruning and pushed filters for its readers. The shuffle
    files behind it are no longer needed then and go at once.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, purpose)
    with settings(spark, _WHILE_WRITING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STORED[id(out)] = (out, path)
    return out


#: Written tables that are still needed: the table itself (which keeps its id in use) and its folder.
_STORED: dict[int, tuple[DataFrame, str]] = {}


def forget(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote for these very tables, once nothing reads them any more."""
    for df in tables:
        _, path = _STORED.pop(id(df))
        jvm = df.sparkSession._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
