"""Centroid clustering of integer vectors (operator 13) by progressive Walsh-Hadamard search.

The transform of a vector of 64 integers is 64 integers, and squared distances between transforms
are 64 times those between vectors, exactly. Vectors are transformed once, centroids every round. For
every vector the differences of the coarsest coefficients are added up for all centroids; the
best of them so far is finished, which bounds the distance; then finer coefficients follow, and a
centroid whose sum already exceeds the bound goes. Those left have all 64 coefficients added up, so
the nearest one and its distance are exact, ties included.

Each round is one pass over the written transforms; a task hands on one sum per centroid. Sums
are of transforms, too: the transform is linear and its own inverse up to the factor 64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotcast.llm.common import ship_package, stored

#: Components of a vector.
WIDTH = 64
#: A component becomes floor(SCALE * x).
SCALE = 256
#: Largest absolute component for which 64 times a squared distance surely fits 63 bits.
LARGEST = 1 << 24
#: Coefficients added up between two eliminations, coarse to fine.
BLOCKS = (0, 8, 16, 32, 64)
#: Vectors searched at a time.
ROWS_AT_ONCE = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of every row, in natural order; works on integers exactly."""
    out = np.array(x, np.int64)
    half = 1
    while half < out.shape[1]:
        pairs = out.reshape(len(out), -1, 2, half)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(out.shape)
        half *= 2
    return out


def _by_sequency() -> np.ndarray:
    """Rows of the transform by their number of sign changes: coarse to fine."""
    changes = (np.diff(hadamard(np.eye(WIDTH, dtype=np.int64)), axis=1) != 0).sum(axis=1)
    return np.argsort(changes, kind="stable")


ORDER = _by_sequency()


def coefficients(vectors: np.ndarray) -> np.ndarray:
    """The transform of every vector, coarse to fine."""
    return hadamard(vectors)[:, ORDER]


def components(coded: np.ndarray) -> np.ndarray:
    """The vectors (or sums of vectors) that have these coefficients."""
    natural = np.empty_like(coded)
    natural[:, ORDER] = coded
    return hadamard(natural) // WIDTH  # exact: the sum is a multiple


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of every vector, the smallest of equals, and the squared
    distance; both are given by their coefficients."""
    n = len(vectors)
    first = BLOCKS[1]
    coarse = np.empty((n, len(centroids)), np.int64)
    for c, centre in enumerate(centroids):
        difference = vectors[:, :first] - centre[:first]
        coarse[:, c] = np.einsum("ij,ij->i", difference, difference)
    likely = centroids[coarse.argmin(axis=1)] - vectors
    bound = np.einsum("ij,ij->i", likely, likely)
    rows, at = np.nonzero(coarse <= bound[:, None])
    sums = coarse[rows, at]
    for low, high in zip(BLOCKS[1:], BLOCKS[2:], strict=False):
        difference = vectors[rows, low:high] - centroids[at, low:high]
        sums = sums + np.einsum("ij,ij->i", difference, difference)
        left = sums <= bound[rows]  # only strictly worse ones go
        rows, at, sums = rows[left], at[left], sums[left]
    starts = np.flatnonzero(np.diff(rows, prepend=-1))  # rows ascend, and centroids within a row
    best = np.minimum.reduceat(sums, starts)
    lowest = np.flatnonzero(sums == np.repeat(best, np.diff(np.append(starts, len(rows)))))
    chosen = at[lowest[np.searchsorted(rows[lowest], np.arange(n))]]
    return chosen, best // WIDTH


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def transformed(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, coefficients) of the vectors that have 64 components, none null or not finite."""
    ship_package(vectors.sparkSession)
    values = F.col(vector).cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col(key).alias("key"), values.alias("x")).where((F.size("x") == WIDTH) & finite)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = np.floor(SCALE * _matrix(batch.column("x")))
            if np.abs(whole).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST / SCALE:g} either way: distances would not fit 64 bits")
            coded = coefficients(whole.astype(np.int64))
            listed = pa.ListArray.from_arrays(np.arange(0, coded.size + 1, WIDTH, np.int32), coded.reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column("key"), listed], names=["key", "y"])

    kind = vectors.schema[key].dataType.simpleString()
    return kept.mapInArrow(code, f"key {kind}, y array<bigint>")


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for first in range(0, batch.num_rows, ROWS_AT_ONCE):
        some = batch.slice(first, ROWS_AT_ONCE)
        y = _matrix(some.column("y"))
        yield some, y, *nearest(y, centroids)


def _next(coded: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: componentwise floor(sum / count); empty ones stay."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, y, chosen, _ in _assigned(batch, centroids):
                order = np.argsort(chosen, kind="stable")
                used, starts = np.unique(chosen[order], return_index=True)
                sums[used] += np.add.reduceat(y[order], starts, axis=0)
                counts += np.bincount(chosen, minlength=len(counts))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(used, pa.int32()), "n": counts[used], "y": pa.array(sums[used].tolist(), pa.list_(pa.int64()))})

    parts = coded.mapInArrow(add, "cluster int, n long, y array<bigint>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("y")[i]).alias(f"y{i}") for i in range(WIDTH)])
    moved = components(centroids)
    for row in totals.collect():  # one row per centroid
        total = components(np.array([[row[f"y{i}"] for i in range(WIDTH)]], np.int64))[0]
        moved[row.cluster] = total // row.n  # numpy floors
    return coefficients(moved)


def cluster(
    vectors: DataFrame, *, clusters: int = 40, rounds: int = 5, seed: int = 2, key: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of every kept vector, and the final centroids as rows of integers.

    Vectors are kept that have 64 components, none null or not finite; x becomes floor(256 * x). The
    centroids start as the kept vectors with the smallest SHA-256 of ``<seed>:<key>``, in that order;
    rows that share a key are ordered by their vectors, rows without a key start none. Fewer kept
    rows make fewer centroids; without any there is no result. Then ``rounds`` times every vector
    goes to the nearest centroid, the smaller number of equals, and each centroid to the floor of its
    vectors' mean; at last vectors are assigned once more. Repeated rows count each; other columns
    are not read. Components beyond 65536 either way fail with a message: their squared distances
    would not fit the result's 64 bits.
    """
    ship_package(vectors.sparkSession)
    coded = stored(transformed(vectors, key=key, vector=vector), "coefficients")
    kind = vectors.schema[key].dataType.simpleString()
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")).cast("binary"), 256)
    drawn = coded.select(mark.alias("mark"), "y").where("mark is not null").orderBy("mark", "y").limit(clusters).collect()
    centroids = np.array([r.y for r in drawn], np.int64).reshape(-1, WIDTH)
    if not len(centroids):
        return coded.limit(0).select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = _next(coded, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, _, chosen, distance in _assigned(batch, centroids):
                yield pa.RecordBatch.from_arrays([some.column("key"), pa.array(chosen, pa.int32()), pa.array(distance)], names=["key", "cluster", "distance"])

    found = coded.mapInArrow(assign, f"key {kind}, cluster int, distance long")
    return found.withColumnRenamed("key", key), components(centroids)


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned``, written once, with the sums of distances by cluster and over all, and each
    centroid's digest. One row per centroid is broadcast."""
    spark = assigned.sparkSession
    assigned = stored(assigned, "assigned")
    digests = spark.createDataFrame(
        [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())],
        "cluster int, centroid_sha256 string",
    )
    sums = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    inertia = sums.agg(F.sum("cluster_inertia")).scalar()
    per_cluster = sums.withColumn("inertia", inertia).join(F.broadcast(digests), "cluster")
    return assigned.join(F.broadcast(per_cluster), "cluster")
