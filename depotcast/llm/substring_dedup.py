"""Substring dedup (operator 7) over a compacted De Bruijn graph.

A window is ``window`` consecutive words of one document: an edge of the De Bruijn graph between
the words before its last and those after its first. A word goes if a window covers it that also
starts in a document with a smaller key.

1. Anchors. The smallest hash of the ``ANCHOR``-word sequences in a window is its anchor; equal
   windows have equal anchors wherever they stand. One row per document and different anchor is
   counted, a fifth of the words or so; only windows whose anchor stands in two documents go on.
2. Compaction. Neighbouring windows with one anchor are a path, at most ``PATH`` edges long. Equal
   paths of all documents become one row with the first document and place it stands in. All places
   of an edge have its anchor, so where an anchor has one path only, the path does not branch and
   stays whole: a passage in a thousand documents is one path there.
3. Edges. Paths of the other anchors, where passages begin or end differently, are taken apart
   into edges, and each edge gets the first document it stands in.
4. Spans. Each document's paths and edges are joined with their sources; what follows each other
   both here and in the source is one span with its source coordinates.
5. Verification. The words of each source span are digested from the source document itself; a
   document's own span must give the same digest, else it stays.

Hashes are 64 bits wide; step 5 keeps a collision from removing anything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotcast.llm.caches import in_slices, release
from depotcast.llm.common import forget, fresh, ship_package, stored

WINDOW = 13
#: Words of an anchor.
ANCHOR = 6
#: Edges of a path at most.
PATH = 8
#: Spans of a source that are asked for together, about.
ASKED = 4096
#: Text bytes hashed at a time.
STEP = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mixed(np.arange(1, 257, dtype=np.uint64))
_BASE, _WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, n - 1).bit_length()
        for k, base in enumerate((_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def word_hashes(text: bytes | None) -> np.ndarray:
    """One 64-bit hash per word, in order; long texts are cut at blanks and done by parts."""
    if not text:
        return np.empty(0, np.uint64)
    if len(text) > STEP:
        parts, at = [], 0
        while at < len(text):
            end = min(len(text), at + STEP)
            while end < len(text) and not _BLANK[text[end]]:
                end += 1
            parts.append(_word_hashes(text[at:end]))
            at = end
        return np.concatenate(parts)
    return _word_hashes(text)


def _word_hashes(text: bytes) -> np.ndarray:
    codes = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[codes], [True])).view(np.int8)))
    first, end = edges[::2], edges[1::2]
    up, down = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTE[codes] * up[: len(codes)], dtype=np.uint64, out=sums[1:])
    return _mixed((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive values."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _WORD_BASE + hashes[k : k + n]
    return _mixed(out)


def window_anchors(hashes: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """Each window's anchor: the smallest hash of the word sequences in it."""
    values = run_hashes(hashes, anchor)
    width = window - anchor + 1
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    done = 1
    while done < width:  # smallest of 1, 2, 4, ... neighbours
        more = min(done, width - done)
        values = np.minimum(values[: len(values) - more], values[more:])
        done += more
    return values[:n]


def _anchor_rows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(key, tid, anchor): one row per document and different anchor."""
    schema = T.StructType([docs.schema["key"], T.StructField("tid", T.LongType()), T.StructField("anchor", T.LongType())])

    def emit(batches):
        release()
        for batch in in_slices(batches, "text"):
            found = [np.unique(window_anchors(word_hashes(x), window, anchor)) for x in batch.column("text").to_pylist()]
            owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
            anchors = np.concatenate(found) if found else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(owner)), batch.column("tid").take(pa.array(owner)), pa.array(anchors.view(np.int64))], names=schema.names)

    return docs.mapInArrow(emit, schema)


def _path_rows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """Paths of the windows whose anchor is among ``anchors`` of the row."""
    key = docs.schema["key"]
    schema = T.StructType(
        [T.StructField("anchor", T.LongType()), T.StructField("path", T.LongType()), T.StructField("key", key.dataType),
         T.StructField("tid", T.LongType()), T.StructField("place", T.LongType()), T.StructField("edges", T.ArrayType(T.LongType(), False))]
    )

    def emit(batches):
        release()
        for batch in in_slices(batches, "text"):
            texts, wanted = batch.column("text").to_pylist(), batch.column("anchors")
            owners, places, sizes, ids, anchors, edges = [], [], [], [], [], []
            for row, text in enumerate(texts):
                hashes = word_hashes(text)
                least = window_anchors(hashes, window, anchor)
                here = np.flatnonzero(np.isin(least, wanted[row].values.to_numpy().view(np.uint64)))
                if not len(here):
                    continue
                anchor_of = least[here]
                starts = np.concatenate(([True], (here[1:] != here[:-1] + 1) | (anchor_of[1:] != anchor_of[:-1])))
                first = np.flatnonzero(starts)
                within = np.arange(len(here)) - np.repeat(first, np.diff(np.append(first, len(here))))
                cut = np.flatnonzero(within % PATH == 0)
                values = run_hashes(hashes, window)[here]
                size = np.diff(np.append(cut, len(here)))
                # a path's hash: of its edges in order, and their number
                position = np.arange(len(here)) - np.repeat(cut, size)
                weight = _mixed(position.astype(np.uint64) + np.uint64(11)) | np.uint64(1)
                path = _mixed(np.add.reduceat(values * weight, cut) + size.astype(np.uint64))
                owners.append(np.full(len(cut), row))
                places.append(here[cut])
                sizes.append(size)
                ids.append(path)
                anchors.append(anchor_of[cut])
                edges.append(values)
            if not owners:
                continue
            owner = pa.array(np.concatenate(owners))
            offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(edges).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).view(np.int64)) for x in (anchors, ids)] + [batch.column("key").take(owner), batch.column("tid").take(owner),
                 pa.array(np.concatenate(places).astype(np.int64)), lists],
                names=[f.name for f in schema],
            )

    return docs.mapInArrow(emit, schema)


def _first_and_last(rows: DataFrame, *keys: str) -> DataFrame:
    """By ``keys``: the smallest document key with a text and place of it, and the largest key.

    Rows without a key count as larger than any. All parts have a fixed width, so that the
    aggregation stays in a hash table; the three minima pick the same row.
    """
    return rows.groupBy(*keys).agg(
        F.min("key").alias("source"), F.min_by("tid", "key").alias("source_tid"), F.min_by("place", "key").alias("source_place"),
        F.max("key").alias("last"), F.max(F.col("key").isNull()).alias("last_without"),
    )


#: Someone after the source has it, and there is a source.
_AGAIN = "source is not null and (last_without or last > source)"


def _source_spans(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(key, tid, spans) of the documents (key, tid, text) with repeated windows; a span has its
    first word, its number of words, and the source's key, tid and first word."""
    anchors = stored(_anchor_rows(docs, window, anchor), "anchors")
    repeated = stored(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeated")
    # the anchors of one text: rows that share a key, or have none, don't meet
    wanted = anchors.join(repeated, "anchor", "left_semi").groupBy("key", "tid").agg(F.collect_set("anchor").alias("anchors"))
    wanted = stored(wanted, "wanted")
    forget(anchors, repeated)
    candidates = docs.join(
        wanted.withColumnsRenamed({"key": "doc", "tid": "of"}), F.col("key").eqNullSafe(F.col("doc")) & F.col("tid").eqNullSafe(F.col("of"))
    ).drop("doc", "of")
    paths = stored(_path_rows(candidates, window, anchor), "paths")
    forget(wanted)

    # equal paths become one; an anchor with one path only does not branch
    different = stored(_first_and_last(paths, "anchor", "path"), "different")
    branching = stored(different.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "branching")
    straight = stored(
        different.where(_AGAIN).join(branching, "anchor", "left_anti").select("anchor", "path", "source", "source_tid", "source_place"), "straight"
    )
    forget(different)
    after = F.col("key").isNull() | (F.col("source") < F.col("key"))
    whole = stored(
        paths.select("anchor", "path", "key", "tid", "place", F.size("edges").alias("edges"))
        .join(straight, ["anchor", "path"]).where(after).drop("anchor", "path"),
        "whole",
    )
    forget(straight)
    # the others are taken apart into edges
    edges = stored(
        paths.join(branching, "anchor", "left_semi").select("key", "tid", "place", F.posexplode("edges").alias("at", "edge"))
        .select("edge", "key", "tid", (F.col("place") + F.col("at")).alias("place")),
        "edges",
    )
    forget(paths, branching)
    sources = stored(
        _first_and_last(edges, "edge").where(_AGAIN).select("edge", "source", "source_tid", "source_place"), "sources"
    )
    single = edges.join(sources, "edge").where(after).drop("edge").withColumn("edges", F.lit(1))
    runs = whole.unionByName(single).groupBy("key", "tid").agg(
        F.collect_set(F.struct("place", "edges", "source", "source_tid", "source_place")).alias("runs")
    )
    spans = stored(_joined_runs(runs, window), "spans")
    forget(whole, edges, sources)
    return spans


def _joined_runs(grouped: DataFrame, window: int) -> DataFrame:
    key = grouped.schema["key"]
    span = T.StructType(
        [T.StructField(n, k) for n, k in (("first", T.LongType()), ("words", T.LongType()), ("source", key.dataType), ("source_tid", T.LongType()), ("source_first", T.LongType()))]
    )
    schema = T.StructType([key, T.StructField("tid", T.LongType()), T.StructField("spans", T.ArrayType(span))])

    def join(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(T.ArrayType(span))
        release()
        for batch in batches:
            out = []
            for runs in batch.column("runs").to_pylist():
                spans: list[list] = []
                for run in sorted(runs, key=lambda r: r["place"]):
                    at, n = run["place"], run["edges"]
                    source = [run["source"], run["source_tid"], run["source_place"]]
                    last = spans[-1] if spans else None
                    if last and at == last[0] + last[1] and source == [*last[2:4], last[4] + last[1]]:
                        last[1] += n
                    else:
                        spans.append([at, n, *source])
                out.append([{"first": a, "words": n + window - 1, "source": k, "source_tid": t, "source_first": p} for a, n, k, t, p in spans])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("tid"), pa.array(out, kind)], names=["key", "tid", "spans"])

    return grouped.mapInArrow(join, schema)


def _digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _source_digests(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, tid, spans) with the digest of each span's words as the source document has them."""
    one = spans.select("key", "tid", F.explode("spans").alias("span"))
    asked = one.select(
        F.col("span.source").alias("key"), F.col("span.source_tid").alias("tid"), F.col("span.source_first").alias("first"), F.col("span.words").alias("words")
    ).distinct()
    # a source that very many documents quote in different cuts is asked in slices, each with its text
    many = asked.groupBy("key", "tid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ASKED)
    slices = F.coalesce(F.ceil(F.col("n") / ASKED), F.lit(1))
    per_source = (
        asked.join(many, ["key", "tid"], "left")
        .groupBy("key", "tid", F.pmod(F.xxhash64("first", "words"), slices).alias("slice"))
        .agg(F.collect_list(F.struct("first", "words")).alias("asked")).drop("slice")
    )
    schema = T.StructType(
        [T.StructField("source", docs.schema["key"].dataType), T.StructField("source_tid", T.LongType()), T.StructField("source_first", T.LongType()),
         T.StructField("words", T.LongType()), T.StructField("digest", T.BinaryType())]
    )

    def answer(batches):
        release()
        for batch in in_slices(batches, "text"):
            keys, tids, texts, asked_of = (batch.column(n) for n in ("key", "tid", "text", "asked"))
            owner, first, count, digest = [], [], [], []
            for row, (text, wanted) in enumerate(zip(texts.to_pylist(), asked_of.to_pylist(), strict=True)):
                words = text.split()
                for x in wanted:
                    owner.append(row)
                    first.append(x["first"])
                    count.append(x["words"])
                    digest.append(_digest(words[x["first"] : x["first"] + x["words"]]))
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [keys.take(at), tids.take(at), pa.array(first, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.binary())], names=schema.names
            )

    # repeated rows of one key and text answer alike
    sources = docs.join(per_source, ["key", "tid"]).mapInArrow(answer, schema)
    answers = stored(sources.groupBy("source", "source_tid", "source_first", "words").agg(F.first("digest").alias("digest")), "digests")
    told = one.select("key", "tid", "span.*").join(answers, ["source", "source_tid", "source_first", "words"])
    out = stored(told.groupBy("key", "tid").agg(F.collect_list(F.struct("first", "words", "digest")).alias("spans")), "spans")
    forget(spans, answers)
    return out


RESULT = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
)


def remove_repeats(
    docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text", into: str = "repeats"
) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, n_removed, and kept, the words that stay, one blank between.

    Words are what stands between ASCII white space. A null text has none. Windows are judged on
    the input. A document without a key has no smaller key than any other: its windows go if they
    stand in a document with a key, and are never a source. Rows of one key do not remove from each
    other. All columns and repeated rows stay; ``into`` must be a new name. ``anchor`` must be less
    than ``window``; it changes the work, not the result.
    """
    if into in docs.columns:
        raise ValueError(f"the documents already have a column {into}")
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("tid"), F.col(text).cast("binary").alias("text"))
    spans = _source_digests(narrow, _source_spans(narrow, window, anchor))
    names = [fresh(docs.columns, n) for n in ("repeat_tid", "repeat_key", "repeat_of", "repeat_spans", "repeat_work")]
    tid, of_key, of_tid, found, work = names
    sides = docs.withColumn(tid, F.xxhash64(text)).join(
        spans.toDF(of_key, of_tid, found), F.col(key).eqNullSafe(F.col(of_key)) & (F.col(tid) == F.col(of_tid)), "left"
    ).select(*docs.columns, found)
    schema = T.StructType([*docs.schema.fields, T.StructField(work, RESULT)])

    def cut(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(RESULT)
        release()
        for batch in in_slices(batches, text):
            rows = []
            texts = batch.column(batch.schema.names.index(text)).cast(pa.binary()).to_pylist()
            for x, spans_of in zip(texts, batch.column(batch.schema.names.index(found)).to_pylist(), strict=True):
                words = x.split() if x else []
                keep = np.ones(len(words), bool)
                for span in spans_of or ():
                    a, b = span["first"], span["first"] + span["words"]
                    if _digest(words[a:b]) == span["digest"]:
                        keep[a:b] = False
                if keep.all():
                    kept = words
                else:
                    kept = [words[i] for i in np.flatnonzero(keep)]
                rows.append({"n_words": len(words), "n_removed": len(words) - len(kept), "kept": b" ".join(kept).decode()})
            others = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != found]
            yield pa.RecordBatch.from_arrays([*others, pa.array(rows, kind)], names=schema.names)

    return sides.mapInArrow(cut, schema).withColumnRenamed(work, into)


def without_repeats(docs: DataFrame, *, text: str = "text", length: str | None = "n_chars", **options) -> DataFrame:
    """Documents with the repeated words gone; columns as before.

    Texts that lose nothing stay as they are; documents that lose all their words go. ``length``
    names a column of character counts, if there is one, which follows the text.
    """
    mark = fresh(docs.columns, "repeats")
    cut = remove_repeats(docs, text=text, into=mark, **options)
    changed = F.col(mark)["n_removed"] > 0
    out = cut.where((F.col(mark)["n_removed"] == 0) | (F.col(mark)["n_removed"] < F.col(mark)["n_words"]))
    columns = []
    for field in docs.schema:
        if field.name == text:
            columns.append(F.when(changed, F.col(mark)["kept"]).otherwise(F.col(text)).alias(text))
        elif field.name == length:
            columns.append(F.when(changed, F.length(F.col(mark)["kept"]).cast(field.dataType)).otherwise(F.col(length)).alias(length))
        else:
            columns.append(F.col(field.name))
    return out.select(*columns)
