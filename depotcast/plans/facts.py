"""What is known about fact tables before they are read: their span, and copies by month."""

from __future__ import annotations

import json
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotcast.functions.dates import MONTH_PARTITION
from depotcast.plans.run_log import RunLog, digest
from depotcast.runtime import shared_folder
from depotcast.sources import storage

Span = tuple[date, date]


def day_span(facts: DataFrame, moment: str) -> Span | None:
    """First and last day of a fact table: a scan of one column. None without any moment."""
    day = F.col(moment).cast("date")
    first, last = facts.agg(F.min(day), F.max(day)).first()
    return None if first is None else (first, last)


def recorded_span(facts: DataFrame, moment: str, root: str | None = None) -> Span | None:
    """``day_span``, scanned once for a set of files and on record below ``root`` from then on.

    The record is known by the listing of the files (names, sizes, times), so new or changed
    files are scanned again. Data without files is scanned every time.
    """
    spark = facts.sparkSession
    files = storage.listing(facts)
    if files.startswith("plan "):
        return day_span(facts, moment)
    log = RunLog(spark, root or shared_folder(spark, "spans"), shared=True)
    name = f"span-{digest(files, moment)[:24]}"

    def write(path: str) -> None:
        span = day_span(facts, moment)
        storage.write_text(spark, f"{path}/span.json", json.dumps(None if span is None else [x.isoformat() for x in span]))

    span = json.loads(storage.read_text(spark, f"{log.folder(log.artifact(name, write))}/span.json"))
    return None if span is None else (date.fromisoformat(span[0]), date.fromisoformat(span[1]))


def by_month(facts: DataFrame, moment: str) -> DataFrame:
    """``facts`` ready to be written partitioned by ``MONTH_PARTITION``, in time order within files.

    Rows meet by month before they are written, so a month is a few files; adaptive execution
    splits a month with very many rows and joins small ones. Rows without a moment are in a partition
    of their own.
    """
    month = F.trunc(F.col(moment).cast("date"), "MM")
    return facts.withColumn(MONTH_PARTITION, month).hint("rebalance", MONTH_PARTITION).sortWithinPartitions(MONTH_PARTITION, moment)


def monthly_copy(facts: DataFrame, moment: str, name: str, root: str | None = None) -> DataFrame:
    """A copy of a fact table partitioned by month, made once for a set of files.

    It pays for tables that are read for a few months or days again and again. The operators use
    the partition column wherever they know which months they need.
    """
    spark = facts.sparkSession
    files = storage.listing(facts)
    log = RunLog(spark, root or shared_folder(spark, "facts"), shared=True)
    key = digest(files, moment, facts.schema.json())[:24]
    return log.table(f"{name}-{key}", lambda: by_month(facts, moment), [moment], {name: files}, partition_by=(MONTH_PARTITION,))
