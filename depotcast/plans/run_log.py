"""Commit log of a run: what is finished, and for which inputs and parameters.

Every stage has a folder below the run's output and, once its result is whole, a marker beside
it. The marker holds a fingerprint of the stage's parameters, of the listings of the input files it
reads and of the fingerprints of the stages before it. A stage whose marker has the wanted
fingerprint is read back; any other is made again. So a second run does nothing, a run that was killed
goes on where it stopped, and a changed parameter or input redoes its stage and what follows from it.

A stage is redone in this order: the marker goes, the folder is written over, the new marker is
renamed into place. Whatever happens in between, no marker stands beside a half-written result. One
run at a time may write to an output folder.

A ``shared`` log keeps results that are named by what they are made of (a model of certain rows, a
copy of certain files). Several applications may make the same one at a time: each writes to a
folder of its own, and the last marker counts.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, fields, is_dataclass
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from depotcast.sources import storage

#: Raise it when stages come to compute something else from the same inputs and parameters.
LOGIC = 1
_MARKERS = "_committed"


def _plain(value: Any) -> Any:
    if is_dataclass(value):
        return _plain(asdict(value))
    if isinstance(value, Mapping):
        return sorted(([str(k), _plain(v)] for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return [_plain(x) for x in value]
    if isinstance(value, date):
        return value.isoformat()
    return value


def digest(*values: Any) -> str:
    """A hash of parameters: dataclasses, mappings (in any order), sequences, dates and plain values."""
    return hashlib.sha256(json.dumps([LOGIC, *map(_plain, values)], ensure_ascii=False).encode()).hexdigest()


@dataclass(frozen=True)
class Commit:
    """What a marker says."""

    stage: str
    fingerprint: str
    parameters: str
    inputs: dict[str, str]
    needs: dict[str, str]
    path: str
    schema: str | None = None


class RunLog:
    """The stages finished below ``root``; ``done`` and ``skipped`` name this run's."""

    def __init__(self, spark: SparkSession, root: str, shared: bool = False):
        self.spark, self.root, self.shared = spark, root.rstrip("/"), shared
        self.done: list[str] = []
        self.skipped: list[str] = []
        self._now: dict[str, str] = {}

    def folder(self, commit: Commit) -> str:
        """Where a finished stage's result is."""
        return f"{self.root}/{commit.path}"

    def _marker(self, stage: str) -> str:
        return f"{self.root}/{_MARKERS}/{stage}.json"

    def committed(self, stage: str) -> Commit | None:
        """The marker of a stage, if its result is whole. A marker of another version says nothing."""
        path = self._marker(stage)
        if not storage.exists(self.spark, path):
            return None
        said = json.loads(storage.read_text(self.spark, path))
        return Commit(**said) if set(said) == {f.name for f in fields(Commit)} else None

    def stages(self) -> list[str]:
        """All finished stages, of this and of earlier runs."""
        found = storage.names_in(self.spark, f"{self.root}/{_MARKERS}")
        return [n.removesuffix(".json") for n in found if n.endswith(".json")]

    def artifact(
        self, stage: str, write: Callable[[str], str | None], parameters: Any = None,
        inputs: Mapping[str, str] | None = None, needs: Iterable[str] = (),
    ) -> Commit:
        """Have ``write`` fill the stage's folder unless that is done; it may return a schema to keep.

        ``inputs`` has the listings of the inputs by name, ``needs`` the stages whose results are read.
        """
        said, inputs = digest(parameters), dict(inputs or {})
        before = {n: self._now[n] for n in needs}
        fingerprint = digest(stage, said, inputs, before)
        self._now[stage] = fingerprint
        known = self.committed(stage)
        if known is not None and known.fingerprint == fingerprint:
            self.skipped.append(stage)
            return known
        path = f"{stage}/{uuid.uuid4().hex}" if self.shared else stage
        if not self.shared:
            storage.delete(self.spark, self._marker(stage))
        commit = Commit(stage, fingerprint, said, inputs, before, path, write(f"{self.root}/{path}"))
        storage.write_text(self.spark, self._marker(stage), json.dumps(asdict(commit), indent=1, ensure_ascii=False))
        self.done.append(stage)
        return commit

    def table(
        self, stage: str, build: Callable[[], DataFrame], parameters: Any = None,
        inputs: Mapping[str, str] | None = None, needs: Iterable[str] = (),
        publish: Callable[[DataFrame], None] | None = None, partition_by: tuple[str, ...] = (),
    ) -> DataFrame:
        """The written table of a stage. ``build`` is called, and ``publish`` with the written
        table, only if the stage has to be made."""

        def write(path: str) -> str:
            df = build()
            df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
            if publish is not None:
                publish(self._read(path, df.schema))
            return df.schema.json()

        commit = self.artifact(stage, write, parameters, inputs, needs)
        return self._read(self.folder(commit), T.StructType.fromJson(json.loads(commit.schema)))

    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)
