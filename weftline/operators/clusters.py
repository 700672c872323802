"""Clusters of linked records: membership, quality, validation, repair, and collective resolution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import round_half_up
from ..scratch import materialise
from .components import connected_components
from .edges import active
from .ranking import global_rank


def cluster(edges: DataFrame, src: str = "src", dst: str = "dst", min_size: int = 2) -> DataFrame:
    """(cluster_id, member_key) of the components of edges that aren't suppressed; cluster_id is the smallest member."""
    e = active(edges) if "suppressed" in edges.columns else edges
    found = connected_components(e, src, dst).select(F.col("component").alias("cluster_id"), F.col("node").alias("member_key"))
    if min_size <= 1:
        return found
    big = found.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size).select("cluster_id")
    return found.join(big, "cluster_id", "left_semi")


def wide(members: DataFrame) -> DataFrame:
    """(cluster_id, size, members): for export; an array holds one cluster."""
    return members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"), F.array_sort(F.collect_list("member_key")).alias("members"))


def numbered(members: DataFrame) -> DataFrame:
    """members with the position of each cluster in the order of its id, as cluster_000000."""
    ids = global_rank(members.select("cluster_id").distinct(), ["cluster_id"], "n")
    return members.join(ids.select("cluster_id", F.concat(F.lit("cluster_"), F.lpad((F.col("n") - 1).cast("string"), 6, "0")).alias("name")), "cluster_id")


def cluster_of(members: DataFrame, key: str) -> DataFrame:
    own = members.where(F.col("member_key") == key).select("cluster_id")
    return members.join(F.broadcast(own.limit(1)), "cluster_id", "left_semi")


def inner_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster_id, a, b, similarity): edges within clusters, one a pair, the highest similarity."""
    pair = active(edges) if "suppressed" in edges.columns else edges
    pair = pair.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("similarity").alias("similarity"))
    left = members.select("cluster_id", F.col("member_key").alias("a"))
    right = members.select(F.col("cluster_id").alias("c2"), F.col("member_key").alias("b"))
    return pair.join(left, "a").join(right, "b").where("cluster_id = c2").select("cluster_id", "a", "b", "similarity")


def quality(members: DataFrame, edges: DataFrame) -> DataFrame:
    """size, edge_count, average, min and max similarity, density and quality_score = min(1, .4 density + .6 average) by cluster."""
    size = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    inner = inner_edges(members, edges).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("edge_count"), F.avg("similarity").alias("average"), F.min("similarity").alias("lowest"), F.max("similarity").alias("highest"))
    n = F.col("size") * (F.col("size") - 1) / 2
    density = round_half_up(F.when(n > 0, F.coalesce("edge_count", F.lit(0)) / n).otherwise(0.0))
    average = round_half_up(F.coalesce("average", F.lit(0.0)))
    return size.join(inner, "cluster_id", "left").select(
        "cluster_id", "size", F.coalesce("edge_count", F.lit(0)).alias("edge_count"), average.alias("average_similarity"), round_half_up(F.coalesce("lowest", F.lit(0.0))).alias("min_similarity"),
        round_half_up(F.coalesce("highest", F.lit(0.0))).alias("max_similarity"), density.alias("density"), round_half_up(F.least(F.lit(1.0), density * 0.4 + average * 0.6)).alias("quality_score"),
    )


def coherence(members: DataFrame, edges: DataFrame, low: float = 0.5) -> DataFrame:
    """quality with low_coherence (mean under low) and possible_bridge (weakest under half the mean, not complete)."""
    q = quality(members, edges)
    return q.withColumn("low_coherence", F.col("average_similarity") < low).withColumn("possible_bridge", (F.col("min_similarity") < F.col("average_similarity") * 0.5) & (F.col("density") < 1))


def stats(members: DataFrame) -> DataFrame:
    """One row: clusters, members, average and largest size, and clusters by size."""
    size = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    n = lambda c: F.count(F.when(c, 1))
    return size.agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"), round_half_up(F.coalesce(F.avg("n"), F.lit(0.0))).alias("average_size"), F.max("n").alias("max_size"), n(F.col("n") == 2).alias("size_2"), n(F.col("n") == 3).alias("size_3"), n(F.col("n").between(4, 10)).alias("size_4_10"), n(F.col("n").between(11, 50)).alias("size_11_50"), n(F.col("n") > 50).alias("size_over_50"))


def validate(members: DataFrame, edges: DataFrame, min_size: int = 2, max_size: int = 100) -> DataFrame:
    """(problem, n): members of several clusters, sizes out of bounds, and edges whose ends aren't in one cluster."""
    size = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    many = members.groupBy("member_key").agg(F.count_distinct("cluster_id").alias("n")).where("n > 1")
    at = members.select("member_key", "cluster_id")
    ends = edges.where("src <> dst").join(at.select(F.col("member_key").alias("src"), F.col("cluster_id").alias("c1")), "src", "left").join(at.select(F.col("member_key").alias("dst"), F.col("cluster_id").alias("c2")), "dst", "left")
    count = lambda df, name: df.agg(F.lit(name).alias("problem"), F.count(F.lit(1)).alias("n"))
    return count(many, "overlap").union(count(size.where(F.col("n") < min_size), "too_small")).union(count(size.where(F.col("n") > max_size), "too_large")).union(count(ends.where(~F.col("c1").eqNullSafe(F.col("c2"))), "split_edge"))


def recluster(members: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """members after the clusters that hold a seed (key) have been made anew from the active edges among their members and the seeds."""
    touched = members.join(seeds.select(F.col("key").alias("member_key")), "member_key", "left_semi").select("cluster_id").distinct()
    inside = members.join(touched, "cluster_id", "left_semi").select("member_key").union(seeds.select("key")).distinct()
    e = active(edges)
    own = e.join(inside.select(F.col("member_key").alias("src")), "src", "left_semi").select("src", "dst").union(e.join(inside.select(F.col("member_key").alias("dst")), "dst", "left_semi").select("src", "dst")).distinct()
    # a new edge can reach a cluster that no seed is in: it is made anew too
    reached = members.join(own.select(F.explode(F.array("src", "dst")).alias("member_key")).distinct(), "member_key", "left_semi").select("cluster_id").distinct().union(touched).distinct()
    all_inside = members.join(reached, "cluster_id", "left_semi").select("member_key").union(inside).distinct()
    region = e.join(all_inside.select(F.col("member_key").alias("src")), "src", "left_semi").join(all_inside.select(F.col("member_key").alias("dst")), "dst", "left_semi")
    return members.join(reached, "cluster_id", "left_anti").unionByName(cluster(region))


def bridges(size: int, pairs: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """Of a connected graph: (smaller, larger) ends of each bridge -> nodes and edges on one side of it. One depth-first search:
    an edge is a bridge if nothing below it reaches above it."""
    near: list[list[int]] = [[] for _ in range(size)]
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    order, low, nodes, ends, found = [-1] * size, [0] * size, [1] * size, [len(x) for x in near], {}
    order[0], count, stack = 0, 1, [(0, -1, iter(near[0]))]
    while stack:
        at, above, rest = stack[-1]
        for x in rest:
            if order[x] < 0:
                order[x] = low[x] = count
                count += 1
                stack.append((x, at, iter(near[x])))
                break
            if x != above:
                low[at] = min(low[at], order[x])
        else:
            stack.pop()
            if above >= 0:
                low[above] = min(low[above], low[at])
                nodes[above] += nodes[at]
                ends[above] += ends[at]
                if low[at] > order[above]:
                    found[min(at, above), max(at, above)] = nodes[at], (ends[at] - 1) // 2
    return found if count == size else {}


def repair(members: DataFrame, edges: DataFrame, low: float = 0.5, most_edges: int = 1_000_000) -> DataFrame:
    """(cluster_id, src, dst, similarity, action) for clusters that are incoherent or hang on a bridge. The weakest unconfirmed edge under
    ``low`` whose loss leaves exactly two parts, both denser than the whole, is to be removed; else the cluster is queued.
    A test holds one cluster's edges, and its time grows with their number; clusters of more than ``most_edges`` are queued
    without a test."""
    suspects = coherence(members, edges).where("low_coherence or possible_bridge").select("cluster_id", "size", "density", "edge_count")
    flagged = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max(F.coalesce("confirmed", F.lit(False))).alias("confirmed"))
    rows = inner_edges(members, edges).join(flagged, ["a", "b"]).join(suspects, "cluster_id")

    def test(pdf):
        import pandas as pd

        size, density = int(pdf["size"].iloc[0]), float(pdf["density"].iloc[0])
        at = {x: n for n, x in enumerate(sorted({*pdf["a"], *pdf["b"]}))}
        one, two = pdf["a"].map(at), pdf["b"].map(at)
        cut = bridges(size, list(zip(one, two, strict=True))) if len(at) == size else {}
        dense = lambda nodes, n: n / (nodes * (nodes - 1) / 2) if nodes > 1 else 1.0
        weak = pdf[(~pdf["confirmed"]) & (pdf["similarity"] < low)].sort_values(["similarity", "a", "b"])
        for a, b, s in zip(weak["a"], weak["b"], weak["similarity"], strict=True):
            nodes, n = cut.get((min(at[a], at[b]), max(at[a], at[b])), (0, 0))
            if nodes and min(dense(nodes, n), dense(size - nodes, len(pdf) - 1 - n)) > density:
                return pd.DataFrame({"cluster_id": pdf["cluster_id"].iloc[:1], "src": [a], "dst": [b], "similarity": [s], "action": ["remove_edge"]})
        return pd.DataFrame({"cluster_id": pdf["cluster_id"].iloc[:1], "src": [None], "dst": [None], "similarity": [None], "action": ["queue"]})

    schema = f"cluster_id {members.schema['cluster_id'].dataType.simpleString()}, src string, dst string, similarity double, action string"
    queued = suspects.where(F.col("edge_count") > most_edges).select("cluster_id", F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit("queue"))
    return rows.where(F.col("edge_count") <= most_edges).groupBy("cluster_id").applyInPandas(test, schema).union(queued)


def collective(pairs: DataFrame, neighbours: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame], threshold: float, max_rounds: int = 5) -> tuple[DataFrame, str, int]:
    """Rescoring with merged neighbourhoods: after each round the members of a cluster share the neighbours of all. Stops when a
    clustering repeats. score(pairs, neighbours) gives (doc1_key, doc2_key, score). Returns members, how it ended, and rounds."""
    seen, merged = [], neighbours
    for n in range(1, max_rounds + 1):
        matches = score(pairs, merged).where(F.col("score") >= threshold)
        members = materialise(cluster(matches.select(F.col("doc1_key").alias("src"), F.col("doc2_key").alias("dst"))), "round")
        mark = tuple(members.agg(F.count(F.lit(1)), F.sum(F.xxhash64("cluster_id", "member_key").cast("decimal(38,0)"))).first())
        if mark in seen:
            return members, "converged" if mark == seen[-1] else "oscillated", n
        seen.append(mark)
        of = members.select(F.col("member_key").alias("key"), "cluster_id")
        pooled = neighbours.join(of, "key").select("cluster_id", "neighbour").distinct().join(of, "cluster_id").select("key", "neighbour")
        merged = neighbours.union(pooled).distinct()
    return members, "max_rounds", max_rounds
