"""Connected components of an edge table, without collecting edges or nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a long, b long) edges -> (node long, root long); root is the smallest
    node reachable. Nodes without an edge don't appear.

    Alternates the two star operations of Kiveris et al. (2014): every node's
    larger neighbours, then its smaller ones, are linked to its least neighbour.
    The number of rounds grows with the logarithm of a component's size; each
    round is kept in the shared folder, so lineage stays short and no executor's
    loss costs more than the round it hits.
    """
    edges = keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    for _ in range(most_rounds):
        before = _signature(edges)
        edges = keep(_small_star(_large_star(edges)), "edges")
        if _signature(edges) == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # (a, m) is one row a node, so a hub's many rows may be split by AQE.
    return (
        both.join(least, "a").where("b > a")
        .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    linked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]
