"""Connected components of links by alternating stars, without gathering any group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import released, written

#: Rounds after which the links must be stars; the number needed grows with the logarithm of a component's size.
ROUNDS = 60


def _large(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``node, root`` for the nodes of ``links`` (a, b): the root is the least node of the component.

    Loops and repeated links are allowed; links with a null end are left out; no links give no rows.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    seen = _print(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        after = written(_small(_large(edges)), "links")
        now = _print(after)
        released(edges.sparkSession, edges)
        edges = after
        if now == seen:
            break
        seen = now
    else:
        raise ValueError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
