"""Connected components as joins: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.frames import store

ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def _edges(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def partly_connected(links: DataFrame) -> DataFrame:
    """(a, b): every node of ``links`` with a node it is connected to, the smallest one after one round.

    Nodes of one ``b`` are connected; connected nodes may still have different ones. The rows connect
    just what ``links`` connect, and there are at most as many as nodes and links left between stars.
    """
    round_ = _small_star(_large_star(_edges(links)).distinct()).distinct()
    return store(round_.select(F.col("u").alias("a"), F.col("v").alias("b")), "stars")


def connected(links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, part) for every node of links (a, b); ``part`` is the smallest node reached.

    Every round is written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    edges, state = _edges(links), None
    for _ in range(rounds):
        edges = store(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        now = _summary(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("part")).unionByName(
        roots.select("node", F.col("node").alias("part"))
    )
