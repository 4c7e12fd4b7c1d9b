"""Byte-level BPE encoding and decoding over a rank table (operator 3).

A pre-token is a linked list of tokens. Every neighbouring pair that has a rank waits in a bucket
of that rank, which holds the left token's list positions; a bitmap in two levels marks the ranks
that have waiting pairs, so find-first-set gives the next rank. A position whose pair has changed
since it was put in is stale and skipped. Each merge costs a constant number of steps, so a
pre-token of a million characters takes time in proportion to its length.

Lookups of pairs go by token ids: the table holds, for each token, every split of its bytes into two
tokens, which is what a lookup of the joined bytes would find.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotcast.llm.caches import PieceCache, held, in_slices
from depotcast.llm.common import fresh, ship_package

#: Bytes of pieces of text, and of pre-tokens, with their ids that a worker keeps, in each of two generations.
PIECES_KEPT, TOKENS_KEPT = 48 << 20, 64 << 20
#: Pieces whose distinct pre-tokens are merged together.
GROUP = 200_000
#: The one pattern under which a blank between non-blanks always begins a pre-token. Fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: In the list of tokens: the place between two pre-tokens, and one that its left neighbour has taken in.
BARRIER, MERGED = -1, -2
BLANKS_TOGETHER = regex.compile(r"^ | $| \s|\s ")
SINGLE_BLANK = regex.compile(r"(?<=\S)(?= \S)")
#: How ids are written.
ID, PACK = np.dtype("<u4"), struct.Struct("<I").pack
#: Bits of a word in the bitmap, and their logarithm.
FAN, SHIFT = 256, 8


def cut(text: str) -> list[str]:
    """Pieces that hold whole pre-tokens of the pattern ``WORDS``.

    A single blank between two non-blanks always begins a pre-token, so the text is cut before
    it. Where blanks stand together the neighbours stay in one piece.
    """
    first, *rest = text.split(" ")
    if not rest:
        return [text]
    if not BLANKS_TOGETHER.search(text):
        return [first, *map(" ".__add__, rest)]
    return [x for x in SINGLE_BLANK.split(text) if x]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes and its rank on each line."""
    with open(path, "rb") as lines:
        table = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in table}


class Decoder:
    """Bytes of ids of one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {i: b for b, i in ranks.items()}
        whole = len(self.bytes_of) == max(self.bytes_of, default=-1) + 1  # a token for every id up to the last
        self.table = pa.array(map(self.bytes_of.__getitem__, range(len(self.bytes_of))), pa.large_binary()) if whole else None

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes of little-endian 32-bit ids; None has none."""
        if not ids:
            return b""
        numbers = np.frombuffer(ids, ID)
        if self.table is None:
            return b"".join(map(self.bytes_of.__getitem__, numbers.tolist()))
        if numbers.max() >= len(self.table):
            raise KeyError(int(numbers.max()))
        _, _, data = self.table.take(pa.array(numbers)).buffers()  # the tokens one after the other
        return data.to_pybytes()


class ByteBPE:
    """Encoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.low = [0] * (max(ranks.values()) // FAN + 1)  # all zero between two calls
        self.pairs: dict[int, int] = {}
        for whole, rank in ranks.items():
            for cut in range(1, len(whole)):
                a, b = ranks.get(whole[:cut]), ranks.get(whole[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self.words = pattern == WORDS  # else pre-tokens are taken from whole texts
        self.pieces, self.tokens = PieceCache(PIECES_KEPT), PieceCache(TOKENS_KEPT)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        return cls(read_ranks(path), pattern)

    def merge(self, tokens: list[bytes]) -> list[list[int]]:
        """Ids of each of some pre-tokens.

        They lie in one list with a barrier between two, and one queue serves them all: pre-tokens
        do not touch each other, so only the order within each matters. ``due[i]`` is the rank of
        the pair that position i now begins; ``buckets`` has the waiting positions by rank; bit r of
        word ``low[r // FAN]`` is set while rank r has any, and bit w of ``top`` while word w has.
        """
        look, low, top = self.pairs.get, self.low, 0
        ids = [BARRIER]
        for token in tokens:
            ids += map(self.byte_ids.__getitem__, token)
            ids.append(BARRIER)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        due = [look(a << 32 | b) if a >= 0 else None for a, b in zip(ids, ids[1:])]
        due.append(None)
        buckets: dict[int, list[int]] = {}
        for i, rank in enumerate(due):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    low[rank >> SHIFT] |= 1 << (rank & FAN - 1)
                    top |= 1 << (rank >> SHIFT)
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = (word << SHIFT) + (bits & -bits).bit_length() - 1
            low[word] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
            waiting = sorted(buckets.pop(rank))
            for at, i in enumerate(waiting):
                if due[i] != rank:
                    continue  # stale: the pair has changed since
                j = after[i]
                k, h = after[j], before[i]
                after[i], before[k] = k, i
                ids[i], ids[j], due[j] = rank, MERGED, None
                lower = False
                new = due[i] = look(rank << 32 | ids[k]) if ids[k] >= 0 else None
                if new is not None:
                    lower = new < rank
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        buckets[new] = [i]
                        low[new >> SHIFT] |= 1 << (new & FAN - 1)
                        top |= 1 << (new >> SHIFT)
                new = due[h] = look(ids[h] << 32 | rank) if ids[h] >= 0 else None
                if new is not None:
                    lower = lower or new < rank
                    if new in buckets:
                        buckets[new].append(h)
                    else:
                        buckets[new] = [h]
                        low[new >> SHIFT] |= 1 << (new & FAN - 1)
                        top |= 1 << (new >> SHIFT)
                if lower and at + 1 < len(waiting):  # a smaller rank has come up: it goes first
                    buckets[rank] = waiting[at + 1 :]
                    low[word] |= 1 << (rank & FAN - 1)
                    top |= 1 << word
                    break
        out, start = [], 1
        for token in tokens:
            end = start + len(token)
            out.append([x for x in ids[start:end] if x >= 0])
            start = end + 1
        return out

    def _pre_tokens(self, piece: str) -> list[str]:
        if piece[0] == " " and piece[1:].isalpha():  # one pre-token, no need to run the pattern
            return [piece]
        if piece[0] == " " and piece[1:-1].isalpha() and piece[-1] in ",.;:!?":
            return [piece[:-1], piece[-1]]
        return self.pattern.findall(piece)

    def _learn_tokens(self, tokens: set[str]) -> None:
        """Have the ids of all pre-tokens in their cache; those that are not known are merged together."""
        unknown = self.tokens.missing(tokens)
        coded = [token.encode() for token in unknown]
        whole = [self.ranks.get(x) for x in coded]
        merged = iter(self.merge([x for x, rank in zip(coded, whole, strict=True) if rank is None]))
        self.tokens.add(unknown, [PACK(rank) if rank is not None else struct.pack(f"<{len(ids := next(merged))}I", *ids) for rank in whole])

    def _learn(self, pieces: set[str]) -> None:
        """Have the ids of all pieces in their cache."""
        unknown = self.pieces.missing(pieces)
        parts = [self._pre_tokens(piece) for piece in unknown]
        self._learn_tokens(set().union(*parts))
        ids = self.tokens.young.__getitem__
        self.pieces.add(unknown, [ids(x[0]) if len(x) == 1 else b"".join(map(ids, x)) for x in parts])
        self.tokens.end_group()

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text, little-endian, 32 bits each; None has none."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            pieces = (cut(text) if self.words else self.pattern.findall(text)) if text else []
            group.append(pieces)
            size += len(pieces) + len(text or "") // 16
            if size > GROUP:
                yield from self._encode_group(group)
                group, size = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, group: list[list[str]]) -> Iterator[bytes]:
        learn, cache = (self._learn, self.pieces) if self.words else (self._learn_tokens, self.tokens)
        learn(set().union(*group))
        ids = cache.young.__getitem__
        for pieces in group:
            yield b"".join(map(ids, pieces))
        cache.end_group()


@dataclass(frozen=True)
class Coder:
    """What one worker needs to encode texts, and to decode the ids again if that is wanted."""

    encoder: ByteBPE
    decoder: Decoder

    @classmethod
    def from_file(cls, path: str, pattern: str) -> Coder:
        ranks = read_ranks(path)
        return cls(ByteBPE(ranks, pattern), Decoder(ranks))


def encode_table(
    docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", into: str = "token_ids", decoded: str | None = None
) -> DataFrame:
    """``docs`` with ``into``: the ids of each whole text as little-endian 32-bit integers.

    With ``decoded``, a column of that name follows with the bytes that these ids decode to. A null
    text has no ids. All columns and repeated rows stay; ``into`` and ``decoded`` must be new names.
    The rank file is read by each worker from ``ranks_path``, which every machine must have.
    """
    wanted = [into, *([decoded] if decoded else [])]
    for name in wanted:
        if name in docs.columns:
            raise ValueError(f"the documents already have a column {name}")
    ship_package(docs.sparkSession)
    work = [fresh(docs.columns, f"work_{i}") for i in range(len(wanted))]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(w, T.BinaryType()) for w in work]])

    def encode(batches):
        coder = held(("byte_bpe", ranks_path, pattern), lambda: Coder.from_file(ranks_path, pattern))
        for batch in in_slices(batches, text):
            ids = list(coder.encoder.encode(batch.column(batch.schema.names.index(text)).to_pylist()))
            columns = [pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(map(coder.decoder.decode, ids), pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *work])

    return docs.mapInArrow(encode, schema).withColumnsRenamed(dict(zip(work, wanted, strict=True)))


def decode_table(coded: DataFrame, ranks_path: str, *, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """``coded`` with ``into``: the bytes of the ids in column ``ids`` (null: none)."""
    if into in coded.columns:
        raise ValueError(f"the rows already have a column {into}")
    ship_package(coded.sparkSession)
    work = fresh(coded.columns, "decoded_work")
    schema = T.StructType([*coded.schema.fields, T.StructField(work, T.BinaryType())])

    def decode(batches):
        decoder = held(("byte_bpe decoder", ranks_path), lambda: Decoder(read_ranks(ranks_path)))
        for batch in in_slices(batches, ids):
            texts = [decoder.decode(x) for x in batch.column(batch.schema.names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, work])

    return coded.mapInArrow(decode, schema).withColumnRenamed(work, into)


def digests(coded: DataFrame, *, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Number of ids and the digests of ids and decoded bytes."""
    return coded.select(
        "*",
        (F.length(ids) / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col(ids), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )
