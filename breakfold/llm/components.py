"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, with_least


def _stars(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with each u's least neighbour or itself as m; the pairs of a star's centre are dealt over many tasks."""
    return with_least(pairs, "u", "v", "m").withColumn("m", F.least("u", "m"))


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, component) of every id that has an edge (a, b) with another; component is the least id reachable.

    Large stars link every larger neighbour to the least one, small stars every smaller one;
    edges stay at most as many as they were, and rounds grow with the logarithm of a component's size.
    Each round is checkpointed.  Self loops and null ends are no edges.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, as the small stars read it twice.
        large = cut(_stars(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _stars(large)
        e = cut(small.select("u", "m").unionByName(small.select(F.col("v").alias("u"), "m")).where("u <> m").select("u", F.col("m").alias("v")).distinct())
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.expr("cast(xxhash64(u, v) as decimal(38,0))"))).first())
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = now
    raise RuntimeError("components did not settle")
