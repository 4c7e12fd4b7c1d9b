"""Token ids as flat binary files (operator 1).

A data set is a folder of parts. Part ``N`` holds

* ``part-N.ids``: the ids of its documents one after the other, little-endian unsigned
  integers of 16 bits if the vocabulary allows, else of 32;
* ``part-N.offsets``: one unsigned 64-bit integer per document and a last one, the place of
  its first id within the part;
* ``part-N.keys``: the documents' keys as a Parquet file, in the same order;

and ``manifest.json`` gives the type and each part's first document and first id in the whole
set: prefix sums over the parts' sizes. Parts are in ascending key order, so a reader maps the
files into memory and finds document ``i`` by arithmetic.

Encoding goes through the ``tokenizers`` library. Where a vocabulary's pre-tokens never hold white
space, a text's ids are those of its white-space separated pieces in order, and each distinct piece
is encoded once and kept in a bounded cache. Probes tell whether that holds; with other tokenizers
whole texts are encoded.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotcast.llm.caches import PieceCache, held, in_slices
from depotcast.llm.common import ship_package

#: Bytes of pieces and their ids that a worker keeps, in each of two generations.
CACHE_BYTES = 96 << 20
#: Pieces of text that are looked up together.
GROUP = 200_000
#: Pieces that make a line for the library, and lines of one call.
PIECES_PER_LINE, LINES_PER_CALL = 64, 256
#: A character that stands between the pieces of a line, a token of its own there.
MARK, MARK_BYTE, SEPARATOR = "\x01", b"\x01", b" \x01 "
#: What shows whether a tokenizer treats what stands between blanks one by one: two pieces and a blank.
PROBES = (("a", "b", " "), ("one,", "'two", " "), ("x1", "!", "\n"), ("é", "中文", "\t"), ("it's", "...", "  "), ("-", "-", " "))
#: Documents that one row of the reading side covers.
DOCS_PER_READ = 4096
#: Ids checksummed or handed on at a time.
IDS_PER_STEP = 1 << 20


class PieceEncoder:
    """Ids of whole texts as bytes, by way of their white-space separated pieces."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already fill the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known = PieceCache(CACHE_BYTES)
        self.mark = self._mark_id()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _mark_id(self) -> int | None:
        """The id of ``MARK`` standing alone, if this tokenizer treats pieces one by one; else None."""
        mark = self._ids(MARK)
        alone = len(mark) == 1 and all(
            self._ids(f"{a}{blank}{MARK}{blank}{b}") == [*self._ids(a), *mark, *self._ids(b)] and self._ids(f"{a}{blank}{b}") == self._ids(a) + self._ids(b)
            for a, b, blank in PROBES
        )
        return mark[0] if alone else None

    def _learn(self, pieces: set[bytes]) -> None:
        """Have the ids of all ``pieces`` in the cache.

        Unknown ones are encoded together, many in one line with ``MARK`` between two, which costs the
        library far less than a line each; the places of its id cut the line's ids apart. Pieces that
        hold the mark themselves have a line each.
        """
        unknown = self.known.missing(pieces)
        apart = [x for x in unknown if MARK_BYTE in x]
        together = [x for x in unknown if MARK_BYTE not in x] if apart else unknown
        lines = [together[i : i + PIECES_PER_LINE] for i in range(0, len(together), PIECES_PER_LINE)]
        lines += [[x] for x in apart]
        for at in range(0, len(lines), LINES_PER_CALL):
            some = lines[at : at + LINES_PER_CALL]
            coded = self.tokenizer.encode_batch_fast([SEPARATOR.join(x).decode() for x in some], add_special_tokens=False)
            for line, c in zip(some, coded, strict=True):
                ids = np.array(c.ids, self.dtype)
                if len(line) == 1:
                    self.known.add(line, [ids.tobytes()])
                    continue
                marks = np.flatnonzero(ids == self.mark) * self.dtype.itemsize
                data = ids.tobytes()
                starts = [0, *(marks + self.dtype.itemsize).tolist()]
                self.known.add(line, [data[a:b] for a, b in zip(starts, [*marks.tolist(), len(data)], strict=True)])

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """Per text its ids as bytes; None counts as empty."""
        if self.mark is None:  # this tokenizer joins pieces across blanks: whole texts
            coded = self.tokenizer.encode_batch_fast([(x or b"").decode() for x in texts], add_special_tokens=False)
            yield from (np.array(c.ids, self.dtype).tobytes() for c in coded)
            return
        group: list[list[bytes]] = []
        size = 0
        for text in texts:
            group.append(text.split() if text else [])  # bytes split at ASCII white space only
            size += len(group[-1])
            if size > GROUP:
                yield from self._encode_group(group)
                group, size = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, group: list[list[bytes]]) -> Iterator[bytes]:
        self._learn(set().union(*group))
        ids = self.known.young.__getitem__
        for pieces in group:
            yield b"".join(map(ids, pieces))
        self.known.end_group()


def _encoder(tokenizer_path: str) -> PieceEncoder:
    return held(("pieces", tokenizer_path), lambda: PieceEncoder(tokenizer_path))


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    uri = re.sub(r"^s3[an]://", "s3://", uri)  # the names that Hadoop gives to the same store
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def write_token_files(
    docs: DataFrame, uri: str, tokenizer_path: str, *, end_id: int | None = None, key: str = "doc_id", text: str = "text"
) -> dict:
    """Encode ``docs`` and write them below ``uri`` in ascending key order; returns the manifest.

    Each row is a document; a null text is empty, a null key sorts first, rows of one key are in
    the order of a hash of their text and then the text itself, and repeated rows are all written.
    Other columns are not read. A task writes under a name of its attempt and renames at the end,
    so a repeated task leaves the same files. An empty table gives no parts.
    """
    ship_package(docs.sparkSession)
    key_type = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    # the hash spreads rows that share one key over several parts
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("key", "tie")
    ordered = ordered.sortWithinPartitions("key", "tie", "text")

    def write(batches):
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        fs, folder = _place(uri)
        encoder = _encoder(tokenizer_path)
        end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
        names = {kind: f"{folder}/part-{part:05d}.{kind}" for kind in ("ids", "offsets", "keys")}
        opened, keys, docs_in, ids_in = None, None, 0, 0
        for batch in in_slices(batches, "text"):
            if opened is None:
                fs.create_dir(folder, recursive=True)
                opened = {k: fs.open_output_stream(f"{v}.{attempt}") for k, v in names.items()}
                keys = pq.ParquetWriter(opened["keys"], pa.schema([batch.schema.field("key")]))
                opened["offsets"].write(np.zeros(1, "<u8").tobytes())
            starts = []
            for ids in encoder.encode(batch.column("text").to_pylist()):
                opened["ids"].write(ids + end)
                ids_in += (len(ids) + len(end)) // encoder.dtype.itemsize
                starts.append(ids_in)
            opened["offsets"].write(np.array(starts, "<u8").tobytes())
            keys.write_table(pa.table([batch.column("key")], schema=pa.schema([batch.schema.field("key")])))
            docs_in += batch.num_rows
        if opened is not None:
            keys.close()
            for kind, name in names.items():
                opened[kind].close()
                fs.move(f"{name}.{attempt}", name)
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "docs": [docs_in], "ids": [ids_in], "width": [encoder.dtype.itemsize]}, schema=_COUNTS
            )

    counts = ordered.drop("tie").mapInArrow(write, "part int, docs long, ids long, width int").collect()  # one row per part
    manifest = {"dtype": f"<u{counts[0].width if counts else 2}", "key_type": key_type.json(), "parts": []}
    doc_base = id_base = 0
    for row in sorted(counts):
        manifest["parts"].append({"part": row.part, "docs": row.docs, "ids": row.ids, "doc_base": doc_base, "id_base": id_base})
        doc_base, id_base = doc_base + row.docs, id_base + row.ids
    fs, folder = _place(uri)
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


_COUNTS = pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("width", pa.int32())])


def read_manifest(uri: str) -> dict:
    fs, folder = _place(uri)
    with fs.open_input_stream(f"{folder}/manifest.json") as source:
        return json.loads(source.read())


def _mapped(fs: pafs.FileSystem, name: str, dtype: str, first: int, last: int) -> np.ndarray:
    """Items ``first`` up to ``last`` of a flat file: mapped into memory where the store is a
    mounted one, else read by range."""
    dtype, n = np.dtype(dtype), last - first
    if not n:
        return np.empty(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(name, dtype, "r", first * dtype.itemsize, (n,))
    with fs.open_input_file(name) as source:
        return np.frombuffer(source.read_at(n * dtype.itemsize, first * dtype.itemsize), dtype)


def _keys(fs: pafs.FileSystem, name: str, first: int, last: int) -> pa.Array:
    """Keys ``first`` up to ``last`` of a part, from the row groups that hold them."""
    with fs.open_input_file(name) as source:
        file = pq.ParquetFile(source)
        ends = np.cumsum([file.metadata.row_group(i).num_rows for i in range(file.num_row_groups)])
        a, b = int(np.searchsorted(ends, first, "right")), int(np.searchsorted(ends, last, "left"))
        before = int(ends[a - 1]) if a else 0
        column = file.read_row_groups(list(range(a, b + 1))).column(0)
    return column.slice(first - before, last - first).combine_chunks()


def read_token_files(spark: SparkSession, uri: str, *, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document of the files: key, position, start, n_tokens, ids_crc32, and the ids if wanted.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is over the ids as
    little-endian unsigned 32-bit integers. Work is dealt out in runs of documents, not parts.
    """
    ship_package(spark)
    manifest = read_manifest(uri)
    dtype = manifest["dtype"]
    key_type = T._parse_datatype_json_string(manifest["key_type"])
    fields = [
        T.StructField(key, key_type), T.StructField("position", T.LongType()), T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ] + [T.StructField("ids", T.ArrayType(T.IntegerType() if dtype == "<u2" else T.LongType()))] * with_ids
    schema = T.StructType(fields)

    def read(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        fs, folder = _place(uri)
        for batch in batches:
            for run in batch.to_pylist():
                name, first, last = f"{folder}/part-{run['part']:05d}", run["first"], run["last"]
                offsets = _mapped(fs, f"{name}.offsets", "<u8", first, last + 1).astype(np.int64)
                keys = _keys(fs, f"{name}.keys", first, last)
                ids = _mapped(fs, f"{name}.ids", dtype, int(offsets[0]), int(offsets[-1]))
                cuts = (offsets - offsets[0]).tolist()
                crcs = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    crc = 0
                    for at in range(a, b, IDS_PER_STEP):
                        crc = zlib.crc32(ids[at : min(b, at + IDS_PER_STEP)].astype("<u4").tobytes(), crc)
                    crcs.append(crc)
                columns = [
                    keys, run["doc_base"] + np.arange(first, last), run["id_base"] + offsets[:-1],
                    np.diff(offsets), np.array(crcs, np.int64),
                ]
                if with_ids:
                    columns.append([ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
                arrays = [pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    parts = [(p["part"], p["docs"], p["doc_base"], p["id_base"]) for p in manifest["parts"]]  # a row per part
    listed = spark.createDataFrame(parts, "part int, docs long, doc_base long, id_base long").select(
        "part", "doc_base", "id_base", "docs", F.explode(F.expr(f"sequence(0L, docs - 1, {DOCS_PER_READ}L)")).alias("first")
    )
    runs = listed.withColumn("last", F.least("docs", F.col("first") + DOCS_PER_READ))
    spread = 4 * spark.sparkContext.defaultParallelism
    return runs.repartition(spread).mapInArrow(read, schema)
