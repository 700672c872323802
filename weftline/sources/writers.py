"""Sinks: clusters, canonical graph files, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clusters import wide


def export_clusters(members: DataFrame, path: str) -> None:
    """JSON and CSV of clusters, largest first, and a summary."""
    w = wide(members).orderBy(F.desc("size"), "cluster_id")
    w.write.mode("overwrite").json(f"{path}/json")
    w.withColumn("members", F.array_join("members", ";")).write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    w.agg(F.count(F.lit(1)).alias("clusters"), F.sum("size").alias("members"), F.max("size").alias("largest")).write.mode("overwrite").json(f"{path}/summary")


def write_table(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def write_lines(df: DataFrame, path: str, tsv: bool = False) -> None:
    """Nodes or edges as JSON lines or tab-separated text."""
    if tsv:
        df.select(*[F.col(c).cast("string") for c in df.columns]).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").json(path)


def write_report(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(f"{path}/json")
    metrics.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def write_bulk(df: DataFrame, path: str, kind: str, key: str | None = None, ends: tuple[str, str] | None = None) -> None:
    """Vertices (with _key) or edges (with _from and _to) as CSV files with headers, as many as there are partitions: what bulk
    loaders read side by side."""
    if kind not in ("vertices", "edges"):
        raise ValueError(f"kind {kind!r}; known: vertices, edges")
    named = {"_key": key} if kind == "vertices" else dict(zip(("_from", "_to"), ends, strict=True))
    head = [F.col(c).cast("string").alias(n) for n, c in named.items()]
    df.select(*head, *[F.col(c) for c in df.columns if c not in named.values()]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def bulk_import(existing: DataFrame, new: DataFrame, key: str = "_key", on_duplicate: str = "error") -> DataFrame:
    """existing with the rows of new. on_duplicate says what becomes of a key that is there: ignore keeps the old row, replace
    takes the new one, update takes its values that aren't null, error raises. Of new rows with the same key one counts."""
    new = new.dropDuplicates([key])
    if on_duplicate == "error":
        if not new.join(existing.select(key), key, "left_semi").isEmpty():
            raise ValueError("a key is there already")
        return existing.unionByName(new)
    if on_duplicate == "ignore":
        return existing.unionByName(new.join(existing.select(key), key, "left_anti").select(existing.columns))
    if on_duplicate == "replace":
        return existing.join(new.select(key), key, "left_anti").select(existing.columns).unionByName(new)
    if on_duplicate != "update":
        raise ValueError(f"on_duplicate {on_duplicate!r}; known: error, ignore, replace, update")
    a, b = existing.alias("a"), new.alias("b")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in existing.columns])
