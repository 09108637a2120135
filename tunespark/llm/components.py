"""Connected components of an edge table, as rounds of joins and aggregations on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunespark.llm.common import discard, join_sized, materialize

MOST_ROUNDS = 60
#: Edge tables counted at no more rows than this (a few MB) are handled without shuffles, in one partition.
FEW_EDGES = 200_000


def _meet(edges: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """edges with the least neighbour of u; the edges of a hub are spread, as its row is broadcast."""
    return edges.join(least, "u") if few else join_sized(edges, least, "u")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("size")).select("u", F.least("u", "low").alias("low"), "size")
    return _meet(both.where("v > u"), least, few).select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("size"))
    linked = _meet(down, least, few).select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
    return linked.union(least.select("u", F.col("low").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) links -> (u, component): for each node that has a link, the smallest node it reaches.

    Alternates large-star and small-star steps until the edges no longer change; each round is a written table.
    Self-links, repeated links and null ends are ignored; an empty edge table gives an empty result.
    """
    edges = materialize(edges.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")).where("u <> v").distinct(), "links")
    few = edges.count() <= FEW_EDGES
    seen = None
    for _ in range(MOST_ROUNDS):
        edges = edges.coalesce(1) if few else edges
        before = edges
        large = _large_star(edges, few)
        large = large if few else materialize(large, "large")
        edges = materialize(_small_star(large, few), "stars")
        discard(*([before] if few else [before, large]))
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return edges.select("u", F.col("v").alias("component")).union(edges.select(F.col("v").alias("u"), F.col("v").alias("component"))).distinct()
