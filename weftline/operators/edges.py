"""Similarity edges as tables: deterministic keys, idempotent inserts, patches and clean-up.

Parquet has no in-place change, so each operator returns the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import edge_key, round_half_up


def make_edges(scored: DataFrame, method: str, collection: str | None = None, bidirectional: bool = False, ts: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(edge_key, src, dst, similarity, method, suppressed, confirmed, ts, keep...) of scored pairs, one row a key."""
    name = lambda c: F.concat(F.lit(f"{collection}/"), F.col(c)) if collection else F.col(c)
    made = scored.select(name("doc1_key").alias("src"), name("doc2_key").alias("dst"), round_half_up("score").alias("similarity"), *keep)
    if bidirectional:
        made = made.union(made.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "similarity", *keep))
    best = Window.partitionBy("edge_key").orderBy(F.desc("similarity"), "src")
    made = made.withColumn("edge_key", edge_key("src", "dst") if not bidirectional else F.md5(F.concat("src", F.lit("->"), "dst")))
    made = made.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    return made.select("edge_key", "src", "dst", "similarity", F.lit(method).alias("method"), F.lit(False).alias("suppressed"), F.lit(False).alias("confirmed"), (ts if ts is not None else F.lit(None).cast("timestamp")).alias("ts"), *keep)


def insert_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Adds the edges whose key isn't there yet."""
    return existing.unionByName(new.join(existing.select("edge_key"), "edge_key", "left_anti").select(existing.columns))


def upsert_edges(existing: DataFrame, new: DataFrame, patch: tuple[str, ...] = ()) -> DataFrame:
    """Inserts new keys; on known ones replaces the columns of patch, or nothing."""
    a, b = existing.alias("a"), new.alias("b")
    known = F.col("a.edge_key").isNotNull()
    cols = [F.when(known, F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in patch else F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in existing.columns]
    return a.join(b, F.col("a.edge_key") == F.col("b.edge_key"), "full_outer").select(*cols)


def clear_edges(edges: DataFrame, method: str | None = None, older_than=None, column: str = "ts") -> DataFrame:
    """What stays when edges of a method, or older than a time, or both, are deleted."""
    gone = F.lit(True)
    if method is not None:
        gone = gone & F.col("method").eqNullSafe(F.lit(method))
    if older_than is not None:
        gone = gone & F.coalesce(F.col(column) < F.lit(older_than), F.lit(False))
    return edges.where(~gone)


def clear_inferred(edges: DataFrame, older_than=None) -> DataFrame:
    gone = F.coalesce("inferred", F.lit(False))
    if older_than is not None:
        gone = gone & F.coalesce(F.col("ts") < F.lit(older_than), F.lit(False))
    return edges.where(~gone)


def keep_last(df: DataFrame, n: int, column: str = "ts") -> DataFrame:
    """Rows not older than the n-th newest distinct time; the few times are ranked, not the rows."""
    cut = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(F.desc(column)).limit(n).agg(F.min(column)).first()[0]
    return df if cut is None else df.where(F.col(column) >= F.lit(cut))


def defects(edges: DataFrame, threshold: float, value: str = "similarity") -> DataFrame:
    """Counts of edges without a value, under the threshold, and from a record to itself."""
    n = lambda c: F.count(F.when(c, 1))
    return edges.agg(F.count(F.lit(1)).alias("total"), n(F.col(value).isNull()).alias("missing"), n(F.col(value) < threshold).alias("below"), n(F.col("src") == F.col("dst")).alias("self_loops"))


def apply_verdicts(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """verdicts (src, dst, decision: match or no_match, decided): the newest of a pair confirms or suppresses its edge; a match without
    an edge makes one with similarity 1."""
    w = Window.partitionBy("edge_key").orderBy(F.desc("decided"), "decision")
    last = verdicts.withColumn("edge_key", edge_key("src", "dst")).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    new = last.where("decision in ('match', 'no_match')").select(
        "edge_key", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.lit(1.0).alias("similarity"), F.lit("verdict").alias("method"),
        (F.col("decision") == "no_match").alias("suppressed"), (F.col("decision") == "match").alias("confirmed"), F.lit(None).cast("timestamp").alias("ts"),
    )
    return upsert_edges(edges.select("edge_key", "src", "dst", "similarity", "method", "suppressed", "confirmed", "ts"), new, ("suppressed", "confirmed"))


def active(edges: DataFrame) -> DataFrame:
    return edges.where(~F.coalesce("suppressed", F.lit(False)))


def sweep_relationships(relations: DataFrame, mapping: DataFrame, src: str = "src", dst: str = "dst", kind: str = "type") -> DataFrame:
    """Relations re-pointed through mapping (member, golden) and merged: (src, dst, type, n, sources). Loops that arise go."""
    one = mapping.select(F.col("member").alias("_m1"), F.col("golden").alias("_g1"))
    two = mapping.select(F.col("member").alias("_m2"), F.col("golden").alias("_g2"))
    moved = relations.join(one, relations[src] == one["_m1"], "left").join(two, relations[dst] == two["_m2"], "left")
    moved = moved.select(F.coalesce("_g1", relations[src]).alias("src"), F.coalesce("_g2", relations[dst]).alias("dst"), relations[kind].alias("type"), F.concat_ws("->", relations[src], relations[dst]).alias("source"))
    return moved.where("src <> dst").groupBy("src", "dst", "type").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("source")).alias("sources"))


def missing_targets(mapping: DataFrame, golden: DataFrame, key: str = "golden_key") -> DataFrame:
    return mapping.join(golden.select(F.col(key).alias("golden")), "golden", "left_anti")


def mapping_cycles(mapping: DataFrame, depth: int = 16) -> DataFrame:
    """Members that reach themselves by following the mapping up to ``depth`` steps."""
    step = mapping.select(F.col("member").alias("m"), F.col("golden").alias("g")).where("m <> g")
    at, found = step.select(F.col("m").alias("start"), F.col("g").alias("at")), None
    for _ in range(depth):
        here = at.where("start = at").select("start")
        found = here if found is None else found.union(here)
        at = at.where("start <> at").join(step, at["at"] == step["m"]).select("start", F.col("g").alias("at"))
    return found.distinct().select(F.col("start").alias("member"))
