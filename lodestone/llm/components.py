"""Connected components of an edge table by Spark joins.

Large-star and small-star steps alternate until nothing changes: each needs one
shuffle, and the number of rounds grows with the logarithm of the longest path.
Every round is written to the shared folder; nothing but a count and a checksum
comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, keyed_join


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())


#: So many edges are no burden for one task, even if all have one node.
PLAIN_ROWS = 1_000_000


def _with_least(pairs: DataFrame, rows: int) -> DataFrame:
    """Adds the least ``v`` of each ``u``.  Sums up before the shuffle; where there are
    many edges, a node with very many of them is no single task's (``keyed_join``)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return (pairs.join(least, "u") if rows <= PLAIN_ROWS else keyed_join(pairs, least, ["u"], "n", rows)).drop("n")


def _with_each(edges: DataFrame, first: tuple, second: tuple) -> DataFrame:
    """Two edges of each row of ``edges``.  A union would hold the plan of ``edges``
    twice, and the driver plans and describes it anew after every stage."""
    edge = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    return edges.select(F.inline(F.array(edge(*first), edge(*second))))


def connected_components(edges: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """node, component (its smallest node), for every node that has an edge.
    ``edges``: u and v, integers; loops and repeated or reversed rows don't matter."""
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, k = work.table(now, f"{name}0"), 0
    state = _state(now)
    while state[0]:
        # large star: neighbours above a node link to the least of its neighbours and itself
        both = _with_each(now, ("u", "v"), ("v", "u"))
        large = _with_least(both, 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # small star: neighbours below a node, and itself, link to the least of them
        low = _with_least(large, state[0])
        small = _with_each(low, ("v", "m"), ("u", "m")).where("u <> v").distinct()
        k += 1
        after = work.table(small, f"{name}{k}")
        work.drop(f"{name}{k - 1}")
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
