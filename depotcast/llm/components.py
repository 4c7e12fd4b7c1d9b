"""Connected components of a table of links, by alternating large and small stars.

Each round hangs neighbours under the smallest node they are known to reach; rounds are written
to the shared folder, which cuts the lineage and lets a lost executor cost a re-read only. A node
with very many links shrinks before the shuffle (``min`` is pre-aggregated), and the joins that
read its links are between plain written tables, so adaptive execution can split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotcast.llm.common import forget, stored


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _state(links: DataFrame):
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.hash("a", "b").cast("long")).alias("s")).first()
    return row.n, row.x, row.s


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of a link; the component is its smallest node.

    Links may repeat, run both ways or join a node to itself; null ends are ignored. Nodes may be
    of any type with an order.
    """
    current = stored(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(),
        "links",
    )
    first, later = current, []
    alone = current.where("a = b").select(F.col("a").alias("node")).distinct()
    current = current.where("a < b")
    before = _state(current)
    while before[0]:
        # large star: neighbours above u go under the smallest of u's surroundings
        around = _both_ways(current)
        smallest = stored(around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "stars")
        large = stored(
            around.where("v > u").join(smallest, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "links"
        )
        # small star: u and its neighbours below go under the smallest of them
        lowest = stored(large.groupBy("b").agg(F.min("a").alias("m")), "stars")
        small = large.join(lowest, "b").select(
            F.explode(
                F.array(
                    F.struct(F.col("m").alias("a"), F.col("b").alias("b")),
                    F.struct(F.col("m").alias("a"), F.col("a").alias("b")),
                )
            ).alias("link")
        )
        current = stored(small.select("link.*").where("a < b").distinct(), "links")
        forget(smallest, large, lowest, *later)
        later = [current]
        after = _state(current)
        if after == before:
            break
        before = after
    # a star forest: every node but the smallest has one link
    found = stored(
        current.select(F.col("b").alias("node"), F.col("a").alias("component"))
        .union(current.select("a", "a").distinct())
        .union(alone.select("node", F.col("node")))
        .groupBy("node").agg(F.min("component").alias("component")),
        "components",
    )
    forget(first, *later)
    return found
