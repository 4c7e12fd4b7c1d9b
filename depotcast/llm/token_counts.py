"""Token counts kept up to date by deltas (operator 6).

Totals by source, language and tokenizer version are never recomputed from all documents. A batch
of changes is turned into signed rows: an insert adds a document and its tokens, a delete takes
them away, a revision takes the old count away and adds the new one (a new tokenizer version is a
revision, too). The rows are added up by group and written as one small delta; the totals are the
sum of all committed deltas.

A batch has a name. It is written to a folder of its own, and Spark's marker of a finished write is
its commit; a batch that is there already is not applied again, and one that broke off is written
anew as a whole. ``compact`` folds the deltas committed by then into one, in two steps that can each be
repeated; ``purge`` deletes what is folded. The names of folded batches stay on record, so that
they do not count again.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotcast.llm.caches import held, in_slices
from depotcast.llm.common import ship_package

GROUP = ("source", "lang", "tokenizer")
DELTA = T.StructType(
    [T.StructField(n, T.StringType()) for n in GROUP] + [T.StructField(n, T.LongType()) for n in ("n_docs", "n_tokens")]
)
#: How the names of compacted deltas begin.
FOLD = "compact-"
#: Texts counted by one call of a library.
PER_CALL = 256


def _counter(kind: str, path: str, pattern: str | None):
    """A function from texts to their numbers of tokens."""
    if kind == "ranks":
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(x)) for x in texts]
    if kind == "words":
        return lambda texts: [len(x.encode().split()) for x in texts]
    if kind == "pattern":
        import regex

        found = regex.compile(pattern)
        return lambda texts: [sum(1 for _ in found.finditer(x)) for x in texts]
    raise ValueError(f"unknown kind of tokenizer: {kind}")


def count_tokens(docs: DataFrame, tokenizers: dict[str, tuple[str, str | None, str | None]], *, source: str = "source", lang: str = "lang", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per document and tokenizer version: source, lang, tokenizer, n_tokens, and the columns ``keep``.

    ``tokenizers`` gives, by version, the kind (``ranks``: byte-level BPE; ``words``: runs of
    non-blanks; ``pattern``: matches of one), the file and the pattern. A null text has no tokens; null sources and languages are
    groups of their own. Other columns are not read.
    """
    taken = {*GROUP, "n_tokens"} & {c.lower() for c in keep}
    if taken:
        raise ValueError(f"columns to keep are named like the result's own: {sorted(taken)}")
    ship_package(docs.sparkSession)
    kept = [F.col(c) for c in keep]
    rows = docs.select(*kept, F.col(source).cast("string").alias("_source"), F.col(lang).cast("string").alias("_lang"), F.col(text).cast("string").alias("_text"))
    fields = [*docs.select(*kept).schema.fields] if keep else []
    schema = T.StructType([*fields, T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])

    def count(batches):
        counters = held(
            ("counters", str(tokenizers)), lambda: {version: _counter(*how) for version, how in tokenizers.items()}
        )
        for batch in in_slices(batches, "_text"):
            texts = [x or "" for x in batch.column(len(fields) + 2).to_pylist()]
            for version, counter in counters.items():
                counts = []
                for at in range(0, len(texts), PER_CALL):
                    counts += counter(texts[at : at + PER_CALL])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(fields) + 2], pa.array([version] * len(texts), pa.string()), pa.array(counts, pa.int64())], names=schema.names
                )

    return rows.mapInArrow(count, schema)


def inserts(counted: DataFrame) -> DataFrame:
    return counted.select(*GROUP, F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").cast("long").alias("n_tokens"))


def deletes(counted: DataFrame) -> DataFrame:
    return counted.select(*GROUP, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).cast("long").alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old counts away, new ones in; groups may differ (another source, language or tokenizer version)."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Additive totals in a folder of the shared store."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), place

    def _committed(self, path: str) -> bool:
        fs, place = self._fs(f"{path}/_SUCCESS")
        return fs.exists(place)

    def batches(self) -> list[str]:
        """Names of the committed batches that are not yet part of a compacted one, and of those that are compacted."""
        fs, place = self._fs(self.folder)
        if not fs.exists(place):
            return []
        names = sorted(x.getPath().getName() for x in fs.listStatus(place))
        return [n for n in names if not n.startswith("_") and self._committed(f"{self.folder}/{n}")]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply signed ``changes`` (of ``inserts``, ``deletes``, ``revisions``) once; False if ``batch`` is there already.

        Nothing is computed for a batch that is there. An empty batch is committed, too.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", batch) or batch.startswith(FOLD):
            raise ValueError(f"a batch name is made of letters, digits, points and dashes, and does not begin with {FOLD}")
        path = f"{self.folder}/{batch}"
        if self._committed(path) or self._folded([batch]):
            return False
        sums = changes.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.where("n_docs <> 0 or n_tokens <> 0").select(*[F.col(f.name).cast(f.dataType) for f in DELTA]).write.mode("overwrite").parquet(path)
        return True

    def _lists(self) -> list[str]:
        """Folders with the names that each committed compacted delta holds."""
        return [f"{self.folder}/_list-{n}" for n in self.batches() if n.startswith(FOLD)]

    def _folded(self, names: Sequence[str]) -> set[str]:
        """Which of some batches a compacted delta holds. Their records are searched by Spark: they
        keep a name of every batch there ever was."""
        lists = self._lists()
        if not lists or not names:
            return set()
        return {r.value for r in self.spark.read.text(lists).where(F.col("value").isin(*names)).distinct().collect()}

    def _current(self) -> list[str]:
        present = self.batches()
        folded = self._folded(present)
        return [n for n in present if n not in folded]

    def _sums(self, names: Sequence[str]) -> DataFrame:
        deltas = self.spark.read.schema(DELTA).parquet(*[f"{self.folder}/{n}" for n in names]) if names else self.spark.createDataFrame([], DELTA)
        sums = deltas.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """Totals by source, lang and tokenizer; groups whose documents are all gone are left out."""
        return self._sums(self._current())

    def compact(self, name: str) -> None:
        """Fold the deltas committed by now into one; readers see the old ones until it is committed.

        What is folded is listed once: a batch that is committed meanwhile stays beside the new delta.
        """
        batch = f"{FOLD}{name}"
        if self._committed(f"{self.folder}/{batch}") or self._folded([batch]):
            return
        current = self._current()
        earlier = self._lists()
        # the list first: it counts only once the delta of its name is committed
        names = self.spark.createDataFrame([(n,) for n in current], "value string")
        if earlier:
            names = names.unionAll(self.spark.read.text(earlier)).distinct()
        names.write.mode("overwrite").text(f"{self.folder}/_list-{batch}")
        self._sums(current).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{batch}")

    def purge(self) -> list[str]:
        """Delete the deltas that a committed compacted one holds, once no reader needs them; their names stay on record."""
        gone = sorted(self._folded(self.batches()))
        for name in gone:
            fs, place = self._fs(f"{self.folder}/{name}")
            fs.delete(place, True)
            if name.startswith(FOLD):  # its record is part of the later one's
                fs, place = self._fs(f"{self.folder}/_list-{name}")
                fs.delete(place, True)
        return gone
