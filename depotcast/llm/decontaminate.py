"""Benchmark decontamination (operator 2): one Aho-Corasick automaton over the test items.

Items and texts are normalised alike: A-Z become lower case, words are the longest runs of
digits, letters and non-ASCII characters. A window is ``window`` consecutive words of an item; an
item of fewer words, but not none, is one window. All windows go into one automaton, which reads
each normalised text once; a match's end is turned into words, and words into places in the
original text.

The items are shipped to the tasks, and their size is checked first. Items beyond ``ITEM_BYTES``
are dealt into parts of about that size; each has an automaton and a pass of its own over the written
texts, one after the other, so the driver and a task never hold more than one part. What the
passes find is united by row. A larger benchmark costs time, not memory.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotcast.llm.caches import held, in_slices
from depotcast.llm.common import fresh, ship_package, stored

#: Consecutive item words that count as a leak.
WINDOW = 10
#: Text of items that are shipped at once and one automaton holds (a single longer item is a part of its own).
ITEM_BYTES = 8 << 20

#: Byte by byte: word bytes stay (A-Z lowered), all others become spaces; lengths stay the same.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


def word_places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word in the original text."""
    inside = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def char_places(text: bytes, places: np.ndarray) -> np.ndarray:
    """Byte places of a UTF-8 text as character places."""
    starts = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    return np.concatenate(([0], np.cumsum(starts)))[places]


class ItemScanner:
    """The automaton of some items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        import ahocorasick

        found: dict[str, tuple[int, set[str]]] = {}
        for item, text in items:
            words = [w.decode() for w in words_of(text)]
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                found.setdefault(f" {' '.join(words[i : i + size])} ", (size, set()))[1].add(item)
        self.automaton = ahocorasick.Automaton()
        for wording, value in found.items():
            self.automaton.add_word(wording, value)
        self.empty = not found
        if found:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges that windows cover, and the items they come from."""
        if self.empty or not words:
            return [], set()
        line = f" {b' '.join(words).decode()} "
        matches = list(self.automaton.iter(line))
        if not matches:
            return [], set()
        ends = np.cumsum(np.fromiter((len(w.decode()) + 1 for w in words), np.int64, len(words)))
        last = np.searchsorted(ends, [at for at, _ in matches]) + 1
        items: set[str] = set()
        ranges: list[tuple[int, int]] = []
        for end, (size, of) in sorted(zip(last.tolist(), (v for _, v in matches), strict=True), key=lambda x: x[0] - x[1][0]):
            items |= of
            ranges.append((end - size, end))
        return merged(ranges), items

    def hits(self, text: bytes | None) -> dict:
        """What ``HITS`` says of one text."""
        words = words_of(text)
        ranges, items = self.scan(words)
        spans = []
        if ranges:
            first, end = word_places(text)
            a = char_places(text, first[[p for p, _ in ranges]]).tolist()
            b = char_places(text, end[[q - 1 for _, q in ranges]]).tolist()
            spans = [{"first_word": p, "end_word": q, "start": s, "end": e} for (p, q), s, e in zip(ranges, a, b, strict=True)]
        return {"n_words": len(words), "n_hit": sum(q - p for p, q in ranges), "items": sorted(items), "spans": spans}


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [T.StructField(n, T.LongType()) for n in ("first_word", "end_word", "start", "end")]
                )
            ),
        ),
    ]
)


def _scanned(docs: DataFrame, text: str, into: str, items: DataFrame, window: int) -> DataFrame:
    """``docs`` with the hits of some items, which are shipped to the tasks as a whole."""
    spark = docs.sparkSession
    listed = [(r.item, bytes(r.text)) for r in items.toLocalIterator()]  # ITEM_BYTES at most, or one item
    shared, name = spark.sparkContext.broadcast(listed), uuid.uuid4().hex
    schema = T.StructType([*docs.schema.fields, T.StructField(into, HITS)])

    def scan(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(HITS)
        # known by a name of this very call: a worker may have served other items before
        scanner = held(("items", name), lambda: ItemScanner(shared.value, window))
        for batch in in_slices(batches, text):
            rows = [scanner.hits(x) for x in batch.column(batch.schema.names.index(text)).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, into])

    return docs.mapInArrow(scan, schema)


def _united(found: DataFrame, key: str, into: str) -> DataFrame:
    """One row per ``key`` with the hits of all passes."""
    lists = found.groupBy(key).agg(
        F.max(f"{into}.n_words").alias("n_words"),
        F.sort_array(F.flatten(F.collect_list(f"{into}.spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{into}.items")))).alias("items"),
    )

    def join(done, span):
        last = F.element_at(done, -1)
        longer = F.struct(
            last["first_word"].alias("first_word"), F.greatest(last["end_word"], span["end_word"]).alias("end_word"),
            last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"),
        )
        adjoins = (F.size(done) > 0) & (span["first_word"] <= F.try_element_at(done, F.lit(-1))["end_word"])
        return F.when(adjoins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(span)))

    # spans are few per text and in order: adjoining ones become one
    empty = F.array().cast(HITS["spans"].dataType)
    merged_spans = lists.withColumn("spans", F.aggregate("spans", empty, join))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end_word"] - x["first_word"])
    return merged_spans.select(key, F.struct("n_words", n_hit.alias("n_hit"), "items", "spans").alias(into))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, item_bytes: int = ITEM_BYTES,
    text: str = "text", item: str = "item_id", item_text: str = "text", into: str = "leaks",
) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, n_hit, items (sorted as text) and the spans hit.

    A span gives its words (from, up to) and the characters of the original text (from, up to);
    adjoining occurrences are one span. Null texts have no words and no hits, null and empty items
    no windows, several items of one id count once, an empty benchmark or table hits nothing. All
    columns and repeated rows of ``docs`` stay; ``into`` must not be one of them.
    """
    if into in docs.columns:
        raise ValueError(f"the documents already have a column {into}")
    ship_package(docs.sparkSession)
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text")).where(
        "item is not null and text is not null"
    )
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    parts = -(-size // item_bytes)
    work = fresh(docs.columns, "leak_work")
    if parts <= 1:
        return _scanned(docs, text, work, items, window).withColumnRenamed(work, into)
    row = fresh([*docs.columns, work], "leak_row")
    kept = stored(docs.withColumn(row, F.monotonically_increasing_id()), "scanned")  # the numbers stay as they are
    dealt = stored(items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts))), "items")
    texts, found = kept.select(row, text), []
    for k in range(parts):
        hits = _scanned(texts, text, work, dealt.where(F.col("part") == k), window).drop(text)
        # the first pass has a row for every text, with its words; the others for those they hit
        found.append(stored(hits if k == 0 else hits.where(F.col(work)["n_hit"] > 0), "hits"))
    united = _united(reduce(DataFrame.unionAll, found), row, work)
    return kept.join(united, row).drop(row).withColumnRenamed(work, into)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of a test item occurs; columns as before."""
    leaks = fresh(docs.columns, "leaks")
    return find_leaks(docs, benchmark, into=leaks, **options).where(F.col(leaks)["n_hit"] == 0).drop(leaks)
