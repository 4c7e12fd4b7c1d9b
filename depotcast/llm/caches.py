"""What a Python worker keeps between batches and tasks, bounded in bytes."""

from __future__ import annotations

from collections.abc import Callable, Collection, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc

#: What an entry of a dictionary takes besides the contents of its key and value.
ENTRY_BYTES = 200
#: Text that is taken from a batch at a time.
SLICE_BYTES = 4 << 20

_HELD: list = [None, None]


def release() -> None:
    """Give back what this worker keeps, as operators do that keep nothing themselves."""
    _HELD[:] = [None, None]
    pa.default_memory_pool().release_unused()


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """The one object that this worker keeps from task to task.

    Workers outlive tasks and serve one operator after another. Whoever asks with another key
    gets an object of its own, and what was kept before goes first: two operators never have their
    tables and caches in one worker at the same time.
    """
    if _HELD[0] != key:
        release()
        _HELD[1] = make()
        _HELD[0] = key
    return _HELD[1]


class PieceCache:
    """Values by piece of text, in two generations of at most about ``most_bytes`` each.

    ``young`` holds all pieces of the group in hand. When it is full after a group it becomes the old
    generation; a piece that is wanted again comes back from there, others are forgotten with it.
    """

    def __init__(self, most_bytes: int):
        self.most_bytes, self.young, self.old, self.bytes = most_bytes, {}, {}, 0

    def missing(self, pieces: set) -> list:
        """The pieces that have no value yet; after that those that have one are in ``young``."""
        new = pieces.difference(self.young)
        again = new & self.old.keys()  # by the pieces, not by all of the old generation
        if again:
            self.add(again, list(map(self.old.__getitem__, again)))
        return list(new.difference(again))

    def add(self, pieces: Collection, values: Collection) -> None:
        self.young.update(zip(pieces, values, strict=True))
        self.bytes += sum(map(len, pieces)) + sum(map(len, values)) + ENTRY_BYTES * len(values)

    def end_group(self) -> None:
        if self.bytes > self.most_bytes:
            self.old, self.young, self.bytes = self.young, {}, 0


def in_slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in runs of at most about ``most_bytes`` of one text or binary column.

    A single longer value is a run of its own.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(column))), 0).to_pylist()
        first = held_bytes = 0
        for i, size in enumerate(sizes):
            if held_bytes and held_bytes + size > most_bytes:
                yield batch.slice(first, i - first)
                first, held_bytes = i, 0
            held_bytes += size
        if first < len(sizes):
            yield batch.slice(first)
