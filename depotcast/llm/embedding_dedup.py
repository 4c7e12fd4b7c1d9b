"""Embedding near-duplicates (operator 8) by collision counting on one-dimensional projections.

Every vector is projected on many random lines, and on each it collides with those in a window of
fixed width around its own value. Close vectors collide on most lines, others on few: pairs that
reach a count are verified by cosine in double precision. A line's values are not sorted in one
place: they are cut into slots of a window's width, and a join of each slot with itself and the next
one, then the exact width, gives the very collisions that a sorted line would.

* A line's window would hold a share of all vectors, so each line is cut by a few random
  hyperplanes first: vectors collide on it only if they are on the same side of all of them. The
  number of hyperplanes follows the number of vectors of a label, so that a window's content, and
  with it the work per vector, does not grow with the table.
* ``plan`` finds, from the binomial distribution of the collisions of a pair just at the threshold,
  how many lines and which count reach the wanted recall.
* Copies are one vector with a weight. Very tight groups would still give all their pairs. Vectors
  around the same leader, within a quarter of the threshold angle, are one ball: all its members are
  links of each other, and whole balls are compared. Only where the angle of two leaders leaves it
  open are the members compared one by one. Leaders are drawn at random in cells of random
  hyperplanes, and what joined no ball is dealt into other cells with other leaders, some times over:
  a group that fills a cell is soon led by one of its own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotcast.llm.caches import release
from depotcast.llm.common import forget, ship_package, stored
from depotcast.llm.components import connected_components

THRESHOLD = 0.98
RECALL = 0.99999
#: Width of a window on either side, as a share of the largest distance of a wanted pair.
WIDTH = 1.2
#: Vectors that share the hyperplanes' sides, on average.
SIDE_SHARE = 16
#: Hyperplanes that vectors around one leader share, and how often leaders are drawn. They bear on the work, not on the result.
LEADER_BITS, LEADER_ROUNDS = 12, 4
SEED = 20
#: Rounding that double precision can leave in an angle.
ANGLE_SLACK = 1e-7


@dataclass(frozen=True)
class Plan:
    lines: int
    bits: int
    width: float
    count: int


def _tail(n: int, p: float, least: int) -> float:
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(least, n + 1))


def plan(vectors: int, angle: float, recall: float = RECALL) -> Plan:
    """Lines, hyperplanes, window and count for pairs up to ``angle`` among ``vectors`` of one label.

    On one line such a pair is on the same sides with (1 - angle / pi) ** bits, and its values differ
    normally with the distance as deviation.
    """
    bits = max(0, math.ceil(math.log2(max(1, vectors / SIDE_SHARE))))
    distance = 2 * math.sin(angle / 2)
    near = (1 - angle / math.pi) ** bits * math.erf(WIDTH / math.sqrt(2))
    lines = 8
    while True:
        count = max((c for c in range(2, lines) if _tail(lines, near, c) >= recall), default=0)
        if count >= 3:
            return Plan(lines, bits, WIDTH * distance, count)
        lines += 8


def _unit(batch, name: str):
    """(rows that count, their unit vectors) of a column of arrays, by length of vector."""
    kept: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for i, x in enumerate(batch.column(name)):
        values = x.values
        if values is None or not len(values) or values.null_count:
            continue
        v = values.to_numpy(zero_copy_only=False).astype(np.float64)
        if not np.isfinite(v).all() or not v.any():
            continue
        v = v / np.abs(v).max()
        v = v / np.linalg.norm(v)
        rows, vectors = kept.setdefault(len(v), ([], []))
        rows.append(i)
        vectors.append(v)
    return [(rows, np.array(vectors)) for rows, vectors in kept.values()]


def _signatures(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    weights = np.int64(1) << np.arange(planes.shape[1], dtype=np.int64)
    return ((unit @ planes) > 0) @ weights


def _lines_of(dims: int, plan_: Plan, line: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dims, line])
    return rng.standard_normal(dims), rng.standard_normal((dims, plan_.bits))


VECTOR = T.ArrayType(T.DoubleType(), False)


def _prepared(rows: DataFrame) -> DataFrame:
    """(id, label, dims, unit vector, signatures for the leaders of each round) of the vectors that can link."""
    schema = T.StructType(
        [T.StructField("id", rows.schema["id"].dataType), T.StructField("label", rows.schema["label"].dataType), T.StructField("dims", T.IntegerType()),
         T.StructField("unit", VECTOR), T.StructField("sides", T.ArrayType(T.LongType(), False))]
    )

    def lists(rows: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))

    def prepare(batches):
        release()
        for batch in batches:
            for places, unit in _unit(batch, "vector"):
                dims = unit.shape[1]
                sides = [_signatures(unit, np.random.default_rng([SEED, dims, k]).standard_normal((dims, LEADER_BITS))) for k in range(LEADER_ROUNDS)]
                at = pa.array(places)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(at), batch.column("label").take(at), pa.array(np.full(len(unit), dims, np.int32)), lists(unit),
                     lists(np.stack(sides, axis=1))],
                    names=schema.names,
                )

    return rows.where("label is not null and vector is not null").mapInArrow(prepare, schema)


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _angle(a, b):
    # by the chord, which is exact for small angles where the cosine is not
    chord = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return 2 * F.asin(F.least(F.lit(1.0), chord / 2))


def _collisions(balls: DataFrame, plan_: Plan) -> DataFrame:
    """Pairs (a, b) of balls that collide on at least ``plan_.count`` lines."""
    schema = T.StructType(
        [balls.schema["ball"], balls.schema["label"], T.StructField("line", T.IntegerType()), T.StructField("side", T.LongType()), T.StructField("value", T.DoubleType())]
    )

    def project(batches):
        release()
        for batch in batches:
            ids, labels = batch.column("ball"), batch.column("label")
            for places, unit in _unit(batch, "unit"):
                at = pa.array(places)
                for line in range(plan_.lines):
                    direction, planes = _lines_of(unit.shape[1], plan_, line)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(at), labels.take(at), pa.array(np.full(len(unit), line, np.int32)), pa.array(_signatures(unit, planes)), pa.array(unit @ direction)],
                        names=schema.names,
                    )

    slot = lambda value: F.floor(F.col(value) / plan_.width)
    values = balls.select("ball", "label", "unit").mapInArrow(project, schema).withColumn("slot", slot("value"))
    place = F.xxhash64("label", "line", "side", "slot").alias("place")
    # a window of either width reaches into the next slot: the lower one asks
    ask = values.withColumn("slot", F.explode(F.array("slot", F.col("slot") + 1))).select(place, F.col("ball").alias("a"), F.col("value").alias("at"))
    hit = ask.join(values.select(place, F.col("ball").alias("b"), "value"), "place").where(
        (F.abs(F.col("at") - F.col("value")) <= plan_.width) & ((slot("at") < slot("value")) | (slot("at") == slot("value")) & (F.col("a") < F.col("b")))
        & (F.col("a") != F.col("b"))
    )
    pairs = hit.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))
    return pairs.where(F.col("n") >= plan_.count).select("a", "b")


def _in_balls(vectors: DataFrame, near: float) -> DataFrame:
    """(id, label, unit, size, off, ball) of the weighted vectors: their ball's leader and the angle to it.

    Each round draws a leader in every cell, by a hash of its id; who is within ``near`` joins its ball.
    Leaders and members are done, the others go on to the next round and other cells. Those left at
    the end are balls of their own.
    """
    done, pool, written = [], vectors, []
    for k in range(LEADER_ROUNDS):
        cell = ["label", "dims", "side"]
        here = pool.withColumn("side", F.col("sides")[k])
        leaders = here.groupBy(*cell).agg(F.min_by(F.struct("id", "unit"), F.xxhash64("id", F.lit(k))).alias("leader"))
        placed = stored(
            here.join(leaders, cell).withColumn("off", F.when(F.col("id") == F.col("leader.id"), 0.0).otherwise(_angle(F.col("unit"), F.col("leader.unit"))))
            .select(*pool.columns, "off", F.col("leader.id").alias("ball")),
            "placed",
        )
        written.append(placed)
        joins = F.col("off") <= near
        done.append(placed.where(joins).drop("sides", "dims"))
        pool = placed.where(~joins).drop("off", "ball")
    rest = pool.drop("sides", "dims").withColumns({"off": F.lit(0.0), "ball": F.col("id")})
    members = stored(reduce(DataFrame.unionByName, [*done, rest]), "members")
    forget(*written)
    return members


def near_duplicates(
    vectors: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, key: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """One row per vector: key, n_links (other vectors linked directly), component_id, kept.

    Vectors link when their labels are equal and not null, they have the same number of components
    and their cosine is at least ``threshold``. Vectors that are null, empty or zero or hold null or
    non-finite components link with nothing, and so are components of their own (``kept`` true).
    Keys are expected to be unique; rows that repeat a key in all three columns are one vector, and
    rows that share a key only share its largest number of links and its smallest component. An empty table gives no rows.
    """
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast(T.ArrayType(T.DoubleType())).alias("vector"))
    angle = math.acos(threshold)
    every = stored(_prepared(rows.where("id is not null").distinct()), "vectors")
    # copies are one vector, by the smallest id among them
    same = ["label", "dims", "unit"]
    distinct = stored(
        every.groupBy(*same).agg(F.min("id").alias("id"), F.first("sides").alias("sides"), F.count(F.lit(1)).alias("size")), "distinct"
    )
    members = _in_balls(distinct, angle / 4)
    sizes = members.groupBy("ball").agg(F.sum("size").alias("size"), F.max("off").alias("radius"))
    balls = stored(members.where("id = ball").select("ball", "label", "unit").join(sizes, "ball"), "balls")
    largest = balls.groupBy("label").count().agg(F.max("count").alias("n")).first().n or 0
    candidates = stored(_collisions(balls, plan(largest, 1.5 * angle, recall)), "candidates")

    one = lambda x: balls.select(F.col("ball").alias(x), F.struct("label", "unit", "size", "radius").alias(f"of_{x}"))
    compared = stored(
        candidates.join(one("a"), "a").join(one("b"), "b").where("of_a.label = of_b.label").select(
            "a", "b", F.col("of_a.size").alias("size_a"), F.col("of_b.size").alias("size_b"),
            _angle(F.col("of_a.unit"), F.col("of_b.unit")).alias("apart"), (F.col("of_a.radius") + F.col("of_b.radius")).alias("reach"),
        ).where(F.col("apart") - F.col("reach") <= angle + ANGLE_SLACK),
        "compared",
    )
    sure = (F.col("reach") > 0) & (F.col("apart") + F.col("reach") <= angle - ANGLE_SLACK)
    whole = compared.where(sure)
    each = lambda ball, name: members.select(F.col("ball").alias(ball), F.col("id").alias(name), F.col("unit").alias(f"unit_{name}"), F.col("size").alias(f"size_{name}"))
    verified = stored(
        compared.where(~sure).select("a", "b").join(each("a", "x"), "a").join(each("b", "y"), "b")
        .where(_dot(F.col("unit_x"), F.col("unit_y")) >= threshold).select("x", "y", "size_x", "size_y"),
        "verified",
    )
    per_ball = (
        whole.select(F.col("a").alias("ball"), F.col("size_b").alias("n")).union(whole.select("b", "size_a")).groupBy("ball").agg(F.sum("n").alias("others"))
    )
    per_vector = (
        verified.select(F.col("x").alias("id"), F.col("size_y").alias("n")).union(verified.select("y", "size_x")).groupBy("id").agg(F.sum("n").alias("own"))
    )
    links = whole.select("a", "b").union(verified.select("x", "y")).union(members.where("id <> ball").select("id", "ball"))
    groups = stored(connected_components(links.toDF("a", "b"), "a", "b"), "groups")
    of_ball = stored(balls.select("ball", "size").join(per_ball, "ball", "left"), "counts")
    of_class = stored(
        members.select("id", "ball").join(of_ball, "ball").join(per_vector, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left").select(
            F.col("id").alias("class"), (F.col("size") - 1 + F.coalesce("others", F.lit(0)) + F.coalesce("own", F.lit(0))).cast("long").alias("n_links"),
            F.coalesce("component", "id").alias("component"),
        ),
        "classes",
    )
    names = every.join(distinct.select(*same, F.col("id").alias("class")), same).select("id", "class")
    result = stored(names.join(of_class, "class").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component").alias("component")), "result")
    forget(every, distinct, members, balls, candidates, compared, verified, groups, of_ball, of_class)
    return vectors.select(F.col(key).alias("id")).join(result, "id", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"),
    )
