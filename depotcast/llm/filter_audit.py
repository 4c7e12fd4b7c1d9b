"""Interaction audit of quality filters (operator 11): which filter removes what, in every order.

A document's failures are a bit mask over the filters, so a part of the corpus shrinks to one cell
per mask. A Gray code walks all subsets of the filters, one toggle at a time: every cell counts the
active filters it fails, and when that counter leaves or reaches zero the cell leaves or rejoins
the running survivors. The survivors of each subset are kept; what a filter removes at any step of any
order is the difference of two of them.

Masks and cells are built by Spark with partial aggregation; the walk sees cells only, 2^n of them
for n filters and part, whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotcast.llm.common import ship_package

#: Most filters of one audit: there are n! orders of n filters.
MOST_FILTERS = 7
#: Parts whose orders are written in one Arrow batch.
PARTS_AT_ONCE = 16
#: Rows without a key are spread over so many join keys; none of them has a label.
KEYLESS = 1024

#: What every cell counts: documents, those labelled good, those labelled toxic.
_COUNTS = ("n", "good", "toxic")
_BLANKS = " \t\n\x0b\x0c\r"


def standard_filters(text: str = "text") -> dict[str, Column]:
    """Failure conditions over whole texts (null: empty). Words are the longest runs of characters
    other than blank, tab, newline, vertical tab, form feed and return.

    A: under 50 words; B: under 65 different words in 100; C: over 5 capitals A-Z in 100 code points;
    D: any of ``#$%&*|``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.trim(body, F.lit(_BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))
    capitals = F.length(body) - F.length(F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * F.length(body).cast("long"),
        "D": body.rlike("[#$%&*|]"),
    }


def _labelled(labels: DataFrame, key: str) -> DataFrame:
    """One row per labelled key: whether any of its rows says good, or toxic."""
    known = labels.where(F.col(key).isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
    return known.groupBy(F.col(key).alias("key"), F.lit(0).cast("long").alias("salt")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
    )


def failure_cells(
    docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], repeats: str | None = None,
    *, part: str = "source", key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters they fail, bit i for the i-th filter.

    ``repeats`` names a last filter that fails a text identical to one of a smaller key anywhere in the
    table. All rows of one text fail the other filters alike, so a group of copies is one row per part
    and label before its smallest key is looked for.
    """
    bits = [F.coalesce(fails, F.lit(False)).cast("int") * (1 << i) for i, fails in enumerate(filters.values())]
    mask = sum(bits[1:], bits[0]) if bits else F.lit(0)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("key"),
        F.when(F.col(key).isNull(), 1 + F.monotonically_increasing_id() % KEYLESS).otherwise(F.lit(0)).cast("long").alias("salt"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        mask.cast("int").alias("mask"),
        (F.unhex(F.sha2(body, 256)) if repeats else F.lit(None).cast("binary")).alias("digest"),
    )
    marked = rows.join(_labelled(labels, key), ["key", "salt"], "left").na.fill(0, ["good", "toxic"])
    if not repeats:
        return _cells(marked.withColumn("n", F.lit(1)))
    same = ["digest", "part", "mask", "good", "toxic"]
    # keys of one group differ from here on, so the smallest one's count stands beside it
    by_key = marked.groupBy("key", "salt", *same).agg(F.count(F.lit(1)).alias("n"))
    first = F.when(F.col("key").isNotNull(), F.struct("key", "n"))
    groups = by_key.groupBy(*same).agg(
        F.min(first).alias("first"), F.sum("n").alias("n"),
        F.sum(F.when(F.col("key").isNull(), F.col("n")).otherwise(0)).alias("keyless"),
    )
    least = groups.groupBy("digest").agg(F.min("first.key").alias("least"))
    judged = groups.join(least, "digest").withColumn(
        "clean", F.col("keyless") + F.when(F.col("first.key") == F.col("least"), F.col("first.n")).otherwise(0)
    )
    bit = 1 << len(filters)
    split = judged.select(
        "part", "good", "toxic",
        F.inline(F.array(
            F.struct(F.col("mask"), F.col("clean").alias("n")),
            F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("clean")).alias("n")),
        )),
    )
    return _cells(split)


def _cells(counted: DataFrame) -> DataFrame:
    return counted.groupBy("part", "mask").agg(
        F.sum("n").cast("long").alias("n"),
        F.sum(F.col("n") * F.col("good")).cast("long").alias("good"),
        F.sum(F.col("n") * F.col("toxic")).cast("long").alias("toxic"),
    )


def subset_survivors(cells: np.ndarray) -> np.ndarray:
    """Survivors of every subset of filters, by a Gray-code walk.

    ``cells`` counts by (part, failure mask, ...); the result by (part, subset, ...).
    """
    size = cells.shape[1]
    states = np.empty_like(cells)
    failing = np.zeros(size, np.int64)  # active filters that a mask fails
    masks = np.arange(size)
    survivors = cells.sum(axis=1)
    states[:, 0] = survivors
    subset = 0
    for step in range(1, size):
        toggled = step & -step  # the only bit in which the next subset differs
        subset ^= toggled
        hit = masks[masks & toggled != 0]
        if subset & toggled:
            leaving = hit[failing[hit] == 0]
            failing[hit] += 1
            survivors = survivors - cells[:, leaving].sum(axis=1)
        else:
            failing[hit] -= 1
            survivors = survivors + cells[:, hit[failing[hit] == 0]].sum(axis=1)
        states[:, subset] = survivors
    return states


class Steps:
    """Every step of every order of some filters, as subsets before and after."""

    def __init__(self, names: list[str]):
        size = len(names)
        self.orders, self.steps, at, before = [], [], [], []
        for order in permutations(range(size)):
            taken = 0
            for step, i in enumerate(order, 1):
                self.orders.append("".join(names[k] for k in order))
                self.steps.append(step)
                at.append(i)
                before.append(taken)
                taken |= 1 << i
        self.at, self.before = np.array(at, np.int64), np.array(before, np.int64)
        self.after = self.before | 1 << self.at
        self.bits, self.whole = 1 << np.arange(size), (1 << size) - 1

    def rows(self, parts: list[str], cells: np.ndarray) -> pa.RecordBatch:
        states = subset_survivors(cells)
        here = states[:, self.before] - states[:, self.after]
        removed = here[:, :, 0]
        failing = states[:, [0], 0] - states[:, self.bits, 0]
        alone = states[:, self.whole ^ self.bits, 0] - states[:, [self.whole], 0]
        shapley = np.stack([removed[:, self.at == i].sum(axis=1) for i in range(len(self.bits))], axis=1)
        n = len(self.at)
        columns = {
            "part": np.repeat(np.array(parts, object), n),
            "filter_order": self.orders * len(parts),
            "step": np.tile(np.array(self.steps, np.int32), len(parts)),
            "kept": states[:, self.after, 0], "removed": removed, "redundant": failing[:, self.at] - removed,
            "unique_fails": alone[:, self.at], "good_lost": here[:, :, 1], "toxic_lost": here[:, :, 2],
            "shapley": shapley[:, self.at],
        }
        return pa.RecordBatch.from_pydict({k: v.reshape(-1) if isinstance(v, np.ndarray) else v for k, v in columns.items()})


SCHEMA = "part string, filter_order string, step int, " + ", ".join(
    f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
)


def audit(
    docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, repeats: str | None = "E",
    *, part: str = "source", key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per part, order of the filters and step: what the filter at that step does there.

    kept and removed after and at this step; redundant: failing this filter but removed earlier;
    unique_fails: failing this filter only; good_lost and toxic_lost: removed here and labelled so;
    shapley: what this filter removes, summed over all orders. ``filters`` names one-letter failure
    conditions, ``repeats`` the one for copies (None: without).

    A null text is empty, a null part the empty string, a condition that is null does not fail. A row
    without a key is nobody's copy, makes none of others and has no labels. Repeated rows count each;
    rows that share key and text are not copies of each other. A key with several labels is good if
    one of them says so, and toxic likewise. Other columns are not read; an empty table has no parts.
    """
    ship_package(docs.sparkSession)
    filters = standard_filters(text) if filters is None else filters
    names = [*filters, *([repeats] if repeats else [])]
    if not names or len(names) > MOST_FILTERS or any(len(x) != 1 for x in names) or len(set(names)) != len(names):
        raise ValueError(f"filters need 1 to {MOST_FILTERS} different names of one letter: {names}")
    cells = failure_cells(docs, labels, filters, repeats, part=part, key=key, text=text)
    # at most 2^n cells a part
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *_COUNTS)).alias("cells"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps(names)
        for batch in batches:
            for first in range(0, batch.num_rows, PARTS_AT_ONCE):
                some = batch.slice(first, PARTS_AT_ONCE)
                counted = np.zeros((some.num_rows, 1 << len(names), len(_COUNTS)), np.int64)
                for i, listed in enumerate(some.column("cells").to_pylist()):
                    for cell in listed:
                        counted[i, cell["mask"]] = [cell[c] for c in _COUNTS]
                yield steps.rows(some.column("part").to_pylist(), counted)

    return by_part.mapInArrow(walk, SCHEMA)
