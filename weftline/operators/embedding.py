"""Node embeddings from random walks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from .blocking import block_vector
from .factor import randomised_svd
from .ranking import global_rank
from .scoring import neighbours


def random_walks(edges: DataFrame, src: str = "src", dst: str = "dst", walks: int = 10, length: int = 10, seed: int = 42) -> DataFrame:
    """(walk, step, node): uniform walks from every node, the same at each call. A step is a join with the numbered neighbours."""
    near = neighbours(edges, src, dst)
    ranked = materialise(near.select("key", "neighbour", (F.row_number().over(Window.partitionBy("key").orderBy("neighbour")) - 1).alias("n"), F.count(F.lit(1)).over(Window.partitionBy("key")).alias("degree")), "neighbours")
    degree = ranked.select("key", "degree").distinct()
    at = degree.select(F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("w"), F.col("key").alias("node"), "degree").select(F.concat_ws("#", "node", F.col("w").cast("string")).alias("walk"), "node", "degree")
    found = at.select("walk", F.lit(0).alias("step"), "node")
    for step in range(1, length):
        pick = at.select("walk", F.col("node").alias("key"), F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "walk"), F.col("degree")).cast("int").alias("n"))
        at = pick.join(ranked.select("key", "n", F.col("neighbour").alias("node")), ["key", "n"]).select("walk", "node")
        at = at.join(degree.withColumnRenamed("key", "node"), "node")
        found = found.union(at.select("walk", F.lit(step), "node"))
    return found


def cooccurrence(walks: DataFrame, window: int = 5) -> DataFrame:
    """(a, b, n): how often b follows or precedes a within the window."""
    w = Window.partitionBy("walk").orderBy("step")
    near = F.array(*[F.lead("node", d).over(w) for d in range(1, window + 1)])
    pair = walks.select("node", near.alias("near")).select(F.col("node").alias("a"), F.explode("near").alias("b")).where("b is not null and a <> b")
    return pair.union(pair.select("b", "a")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def node2vec(edges: DataFrame, src: str = "src", dst: str = "dst", dim: int = 16, most_nodes: int = 2_000_000, **walk) -> DataFrame:
    """(key, embedding): singular vectors of the positive pointwise mutual information of nodes that meet in walks, scaled by the
    roots of their values and normalised. The matrix stays sparse and distributed; the driver holds some dim + 10 numbers a
    node, so graphs of more than ``most_nodes`` nodes are refused."""
    counts = materialise(cooccurrence(random_walks(edges, src, dst, **walk)), "cooccurrence")
    mass = materialise(counts.groupBy("a").agg(F.sum("n").alias("mass")), "mass")
    n = mass.count()
    if n > most_nodes:
        raise ValueError(f"{n} nodes; at most {most_nodes}")
    names = materialise(global_rank(mass, ["a"], "at").withColumn("at", (F.col("at") - 1).cast("int")), "names")
    total = mass.agg(F.sum("mass")).first()[0] or 0
    one = names.select("a", F.col("at").alias("row"), F.col("mass").alias("m1"))
    two = names.select(F.col("a").alias("b"), "at", F.col("mass").alias("m2"))
    pmi = counts.join(one, "a").join(two, "b").select("row", "at", F.log(F.col("n") * F.lit(float(total)) / F.col("m1") / F.col("m2")).alias("value")).where("value > 0")
    rows = materialise(pmi.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("x")).select(F.col("x.at").alias("at"), F.col("x.value").alias("value")), "pmi")
    v, s = randomised_svd(rows, max(1, n), min(dim, max(1, n)), power=4)
    v = v * np.sqrt(s)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    placed = edges.sparkSession.createDataFrame(pd.DataFrame({"at": np.arange(n, dtype=np.int32), "embedding": [x.tolist() for x in v[:n]]}), "at int, embedding array<double>")
    return names.join(placed, "at").select(F.col("a").alias("key"), "embedding")


def block_graph_embedding(edges: DataFrame, threshold: float = 0.7, limit: int = 20, **options) -> DataFrame:
    """Pairs of nodes with close embeddings."""
    return block_vector(node2vec(edges, **options), "key", "embedding", threshold, limit)
