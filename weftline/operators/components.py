"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import measured, materialise


def _sum() -> dict:
    """What tells two sets of links apart: their number and the sum of their hashes."""
    return {"n": F.count(F.lit(1)), "digest": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}


def connected_components(edges: DataFrame, u: str = "src", v: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node reachable.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest node near it. Neighbourhoods
    are never collected: a round is a partial aggregate and a join that AQE can split, so a hub with very many edges
    does no harm. Rounds grow with the logarithm of the number of nodes; lineage is cut by a table after each, and the
    table's checksum, taken while it is written, tells when nothing changes any more.

    Self loops give a component of their own; nulls are dropped; the order of u and v doesn't matter."""
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    start = materialise(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")  # edges are made once
    star, seen = start.where("u <> v"), None
    for _ in range(max_rounds):
        both = star.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # now u > v in every row: the small step; links that occur twice go at its end
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        star, now = measured(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star", **_sum())
        if now == seen or not now["n"]:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = star.groupBy("u").agg(F.min("v").alias("m"))
    nodes = start.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return nodes.join(found, nodes["node"] == found["u"], "left").select("node", F.coalesce("m", "node").alias("component"))
