"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import staged


def _tidy(edges: DataFrame) -> DataFrame:
    """Each link once, its larger end first; loops go."""
    return (
        edges.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _tidy(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _tidy(moved.unionByName(least.select("a", F.col("m").alias("b"))))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)`` for every node with a link.

    The component is the smallest node reachable. Edges, nodes and labels stay in
    Spark; the driver sees one count and one checksum a round. Rounds grow with
    the logarithm of the longest chain. Hot nodes are combined before the shuffle
    (``min``) and joined back by joins that adaptive execution can split. Null ends
    are dropped; no edges give no rows.
    """
    now = staged(_tidy(edges.select("a", "b").where("a is not null and b is not null")), "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        now = staged(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
