"""Connected components of an edge list by alternating large-star and small-star steps, each on DataFrames.

An edge (a, b) always has a > b. No step makes more than one edge per old edge and endpoint, so the list never grows;
the number of rounds is about the logarithm of the longest path. Each step is written to the shared folder: its plan
reads nothing but the step before, so what the driver plans and keeps for a step is small and the same in every round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofset.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the least of itself and its neighbours. Repeated edges may come out."""
    least = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))  # only smaller neighbours can be less than itself
    return edges.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the least node of its component), for every node of an edge (a, b)."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(edges)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        edges = written(_small_star(written(_large_star(edges), "edges")), "edges")
        if (now := _mark(edges)) == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
