"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge; edges: u, v (long).

    Each round links every node's larger neighbours to its least neighbour,
    then the smaller ones. Minima are combined before the shuffle and the
    edges of a hub are joined, not gathered, so a hub needs no single task.
    Rounds end when the edges no longer change; they are written to the shared
    folder. Null ends and loops are ignored; an empty input gives no rows.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialise(e, "components")
    state = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").select(F.col("v").alias("a"), F.least("m", "u").alias("b"), "u").filter("a > u and a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
        # Every edge points from the larger end to the smaller one here.
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e = materialise(small.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now["n"], now["h"]) == state:
            break
        state = (now["n"], now["h"])
    else:
        raise RuntimeError(f"edges still change after {most_rounds} rounds")
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
