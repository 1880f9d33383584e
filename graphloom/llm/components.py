"""Connected components over edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import staged


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: neighbours hang on to the smallest node that a node sees.

    Large star moves the larger neighbours of each node, small star the
    smaller ones.  The minimum has a partial aggregate, and the join is a plain
    equi-join, which adaptive execution splits on a hot node.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.filter("b < a")
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = near.filter("b > a") if large else near
    out = moved.join(least, "a").select(F.col("b").alias("x"), F.col("m"))
    if not large:
        out = out.union(least.select(F.col("a").alias("x"), "m"))
    return out.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of edges(a, b) that isn't its own root; the root is the smallest reachable node.

    Self loops and repeated edges are allowed; no edges give no rows.  The
    number of rounds grows with the logarithm of the longest chain.  Only two
    numbers a round come to the driver.
    """
    now = staged(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    seen = _state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        now = staged(_star(_star(now, True), False), "edges")
        then, seen = seen, _state(now)
        if then == seen:
            break
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
