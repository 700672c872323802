"""An inverted-file index of vectors: lists around centroids, of which a search reads the nearest few."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise


@dataclass
class VectorIndex:
    """rows: (key, vector, list, part), every vector of the table; a long list has several parts. centroids: (lists, dimension), of
    length one. parts: of each list. reach: the largest angle between a list's centroid and a vector of it."""

    rows: DataFrame
    centroids: np.ndarray
    parts: np.ndarray
    reach: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _centroids(x: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means; a list that runs empty starts again at the vector that is worst off."""
    x = _unit(x)
    at = x[np.random.default_rng(seed).choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        near = x @ at.T
        own = near.argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(near.max(axis=1))[: len(empty)]]
        new = _unit(sums)
        if np.allclose(new, at):
            break
        at = new
    return at


def _lists_of(column: str, centroids, n: int):
    """The n nearest lists of each vector, nearest first."""

    @F.pandas_udf("array<int>")
    def nearest(s: pd.Series) -> pd.Series:
        x = _unit(np.stack([np.asarray(v, np.float64) for v in s])) if len(s) else np.zeros((0, 1))
        return pd.Series(list(np.argsort(-(x @ centroids.value.T), axis=1, kind="stable")[:, :n].astype(np.int32)) if len(s) else [])

    return nearest(F.col(column))


def _nearest_list(column: str, centroids):
    """The nearest list of each vector, and the angle to its centroid."""

    @F.pandas_udf("list int, angle double")
    def nearest(s: pd.Series) -> pd.DataFrame:
        x = _unit(np.stack([np.asarray(v, np.float64) for v in s])) if len(s) else np.zeros((0, centroids.value.shape[1]))
        near = x @ centroids.value.T
        return pd.DataFrame({"list": near.argmax(axis=1).astype(np.int32), "angle": np.arccos(np.clip(near.max(axis=1, initial=-1.0), -1, 1))})

    return nearest(F.col(column))


def _lists_within(column: str, least: str, centroids, reach: np.ndarray, probed: int):
    """The lists of each vector, without the nearest ones, that may hold one of at least that similarity (null: any)."""

    @F.pandas_udf("array<int>")
    def within(s: pd.Series, t: pd.Series) -> pd.Series:
        if not len(s):
            return pd.Series([])
        near = _unit(np.stack([np.asarray(v, np.float64) for v in s])) @ centroids.value.T
        most = np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - reach))
        order = np.argsort(-near, axis=1, kind="stable")[:, probed:].astype(np.int32)
        return pd.Series([o[m[o] >= x - 1e-6] for o, m, x in zip(order, most, t.fillna(-2.0), strict=True)])

    return within(F.col(column), F.col(least))


#: Vectors of a list that one task meets at a time.
PART = 4000


def build_index(df: DataFrame, key: str, vector: str, dim: int, lists: int | None = None, rounds: int = 25, sample: int = 100_000, most_lists: int = 4096, seed: int = 42) -> VectorIndex:
    """Centroids are fitted on a bounded sample, ``sample`` vectors by a digest of the key; every vector of dimension dim is put into
    the list of its nearest one. By default there are as many lists as the root of the number of vectors, most_lists at most."""
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) == dim)).select(F.col(key).cast("string").alias("key"), F.col(vector).alias("vector"))
    n = rows.count()
    if not n:
        raise ValueError("no vectors")
    lists = min(n, lists or max(1, min(most_lists, math.isqrt(n))))
    share = min(1.0, 1.2 * sample / n)
    some = rows.where(F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(F.md5("key")).limit(sample)
    drawn = np.stack([np.asarray(r["vector"], np.float64) for r in some.select("vector").toLocalIterator()])
    centroids = _centroids(drawn, min(lists, len(drawn)), rounds, seed)
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    placed = rows.withColumn("_at", _nearest_list("vector", shared)).select("key", "vector", "_at.list", "_at.angle")
    placed = materialise(placed, "index")
    parts, reach = np.ones(len(centroids), np.int64), np.zeros(len(centroids))
    for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("angle")).collect():
        parts[r["list"]], reach[r["list"]] = -(-r["n"] // PART), r["angle"]
    many = F.array(*[F.lit(int(p)) for p in parts])
    return VectorIndex(placed.select("key", "vector", "list", F.pmod(F.xxhash64("key"), F.element_at(many, F.col("list") + 1)).cast("int").alias("part")), centroids, parts, reach)


def _best(limit: int, threshold: float):
    """For groups of queries and vectors that meet: each query's best, after a product of matrices by sums that are the same for
    equal vectors, so that copies tie."""

    def meet(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(rows):
            y, names = np.stack([np.asarray(v, np.float64) for v in rows["vector"]]), rows["key"].to_numpy()
            long = np.sqrt((y * y).sum(axis=1))
            unit = y / np.maximum(long, 1e-300)[:, None]
            for name, q in zip(asked["query"], asked["q"], strict=True):
                x = np.asarray(q, np.float64)
                own = np.sqrt((x * x).sum())
                near = unit @ (x / max(own, 1e-300))
                others = np.flatnonzero((names != name) & (near >= threshold - 1e-9))
                if len(others) > limit:
                    others = others[near[others] >= np.partition(near[others], -limit)[-limit] - 1e-9]
                size = own * long[others]
                exact = np.where(size > 0, (y[others] * x).sum(axis=1) / np.where(size > 0, size, 1.0), 0.0)
                order = np.lexsort((names[others].astype(str), -exact))[:limit]
                out += [(name, names[others[o]], exact[o]) for o in order if exact[o] >= threshold]
        return pd.DataFrame(out, columns=["query", "key", "similarity"])

    return meet


def nearest(index: VectorIndex, queries: DataFrame, key: str, vector: str, limit: int = 20, threshold: float = -1.0, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query, key, similarity, rank): each query's nearest other records among the lists that it probes, 64 at most by default. With
    as many probes as lists the search is exact. ``exact``: lists that aren't probed are searched too, unless their centroid's angle,
    less the list's reach, shows that none of it can be among the best."""
    probes = min(len(index.centroids), probes or 64)
    shared = queries.sparkSession.sparkContext.broadcast(index.centroids)
    parts = F.array(*[F.lit(int(p)) for p in index.parts])
    columns, best = "query string, key string, similarity double", _best(limit, threshold)

    def meet(some: DataFrame) -> DataFrame:
        some = some.withColumn("part", F.explode(F.sequence(F.lit(0), F.element_at(parts, F.col("list") + 1) - 1)))
        return some.groupBy("list", "part").cogroup(index.rows.groupBy("list", "part")).applyInPandas(best, columns)

    asked = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("query"), F.col(vector).alias("q"))
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    asked = asked.dropDuplicates(["query"])
    met = meet(asked.withColumn("list", F.explode(_lists_of("q", shared, probes))))
    if exact and probes < len(index.centroids):
        met = materialise(met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit), "met")
        least = met.where(F.col("rank") == limit).select("query", F.col("similarity").alias("least"))
        rest = _lists_within("q", "least", shared, index.reach, probes)
        met = met.drop("rank").union(meet(asked.join(least, "query", "left").withColumn("list", F.explode(rest)).drop("least")))
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
