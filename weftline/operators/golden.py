"""Golden records: survivorship by field, provenance, overrides, staleness; canonical signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import signature


def _long(records: DataFrame, members: DataFrame, key: str, fields: list[str], recency: str | None, source: str | None) -> DataFrame:
    """(cluster_id, member_key, field, value, recency, source): one row a member and non-blank field."""
    r = records.select(F.col(key).cast("string").alias("member_key"), (F.col(recency).cast("string") if recency else F.lit(None).cast("string")).alias("recency"), (F.col(source).cast("string") if source else F.lit(None).cast("string")).alias("source"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("fv"))
    return members.join(r, "member_key").select("cluster_id", "member_key", "fv.field", "fv.value", "recency", "source").where(F.trim("value") != "")


def survivors(records: DataFrame, members: DataFrame, key: str, fields: dict[str, str], recency: str | None = None, source: str | None = None, priority: list[str] | None = None) -> DataFrame:
    """(cluster_id, field, value, chosen_from, distinct_values, sources) of the value that survives. fields: name -> strategy.

    voting: the commonest value, then the longest, then of the smallest member. most_complete: the longest. most_recent: of the
    greatest recency, as a string. source_priority: of the first source of the list. The last two fall back to voting.
    Votes are counts per (cluster, field, value), so a cluster's rows are never gathered."""
    long = _long(records, members, key, list(fields), recency, source)
    votes = long.groupBy("cluster_id", "field", "value").agg(F.count(F.lit(1)).alias("votes"), F.min("member_key").alias("first"), F.max("recency").alias("recency"), F.min(_rank(F.col("source"), priority)).alias("rank"), F.collect_set("source").alias("sources"))
    how = F.element_at(F.create_map(*[F.lit(x) for kv in fields.items() for x in kv]), F.col("field"))
    size = F.length("value")
    w = Window.partitionBy("cluster_id", "field").orderBy(
        F.when(how == "most_recent", F.col("recency")).desc_nulls_last(),
        F.when(how == "source_priority", F.col("rank")).asc_nulls_last(),
        F.when(how == "most_complete", size).desc_nulls_last(),
        F.desc("votes"),
        size.desc(),
        F.col("first"),
        F.col("value"),
    )
    all_ = Window.partitionBy("cluster_id", "field")
    best = votes.withColumn("_r", F.row_number().over(w)).withColumn("distinct_values", F.count(F.lit(1)).over(all_)).where("_r = 1")
    return best.select("cluster_id", "field", "value", F.col("first").alias("chosen_from"), "distinct_values", F.array_sort("sources").alias("sources"))


def _rank(source: Column, priority: list[str] | None) -> Column:
    at = F.lit(None).cast("int")
    for n, s in reversed(list(enumerate(priority or []))):
        at = F.when(source == s, n).otherwise(at)
    return at


def consolidate(chosen: DataFrame, members: DataFrame, fields: list[str]) -> DataFrame:
    """(golden_key, cluster_id, cluster_size, fields, field_provenance): one row a cluster. golden_key: md5 of its sorted members."""
    size = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"), F.md5(F.array_join(F.array_sort(F.collect_list("member_key")), "|")).alias("golden_key"))
    values = chosen.groupBy("cluster_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields], F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct("chosen_from", "distinct_values", "sources"))))).alias("field_provenance"))
    return size.join(values, "cluster_id", "left").select("golden_key", "cluster_id", "cluster_size", *fields, "field_provenance")


def override(golden: DataFrame, overrides: DataFrame, fields: list[str]) -> DataFrame:
    """golden with the values of overrides (golden_key, field, value) in place of its own."""
    o = overrides.groupBy("golden_key").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_{f}") for f in fields])
    return golden.join(o, "golden_key", "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in golden.columns])


def resolved_edges(golden: DataFrame, members: DataFrame) -> DataFrame:
    return members.join(golden.select("cluster_id", "golden_key"), "cluster_id").select(F.col("member_key").alias("src"), F.col("golden_key").alias("dst"), F.lit("resolvedTo").alias("type"))


def upsert(existing: DataFrame, new: DataFrame, key: str = "golden_key") -> DataFrame:
    """new rows in place of old ones of the same key."""
    return existing.join(new.select(key), key, "left_anti").select(existing.columns).unionByName(new.select(existing.columns))


def stale(golden: DataFrame, members: DataFrame) -> DataFrame:
    """Goldens whose members aren't a cluster any more."""
    now = members.groupBy("cluster_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list("member_key")), "|")).alias("golden_key"))
    return golden.join(now, "golden_key", "left_anti")


def merge(records: DataFrame, members: DataFrame, key: str, fields: list[str], strategy: str = "most_complete", recency: str | None = None) -> DataFrame:
    """One record a cluster: the fields of the most complete, newest or first member, blanks filled from the next in that order."""
    blank = lambda f: F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == ""
    filled = sum((F.when(blank(f), 0).otherwise(1) for f in fields), F.lit(0))
    first = {"most_complete": filled.desc(), "newest": F.col(recency or key).desc_nulls_last(), "first": F.lit(0).asc()}[strategy]
    rows = members.join(records.withColumn("member_key", F.col(key).cast("string")), "member_key")
    w = Window.partitionBy("cluster_id").orderBy(first, "member_key")
    ranked = rows.withColumn("_r", F.row_number().over(w))
    best = [F.min_by(F.when(~blank(f), F.col(f).cast("string")), F.when(~blank(f), F.col("_r"))).alias(f) for f in fields]
    return ranked.groupBy("cluster_id").agg(F.min_by("member_key", "_r").alias("base_key"), F.count(F.lit(1)).alias("merged"), *best)


def completeness(fields: list[str]) -> Column:
    """Share of fields that aren't blank."""
    return sum((F.when(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "", 1.0).otherwise(0.0) for f in fields), F.lit(0.0)) / len(fields)


def canonical_nodes(records: DataFrame, parts: list[Column], source: str | None = None, hub_marker: Column | None = None, hub_degree: int = 50, variants: Column | None = None, top: int = 20, shard: Column | None = None) -> DataFrame:
    """(signature, records, sources, is_hub, variants): records by the hash of their normalised parts. A hub is marked, or has that
    many sources. variants: the commonest spellings, ``top`` at most."""
    sig = signature(*parts)
    sig = F.concat_ws(":", shard, sig) if shard is not None else sig
    rows = records.select(sig.alias("signature"), (F.col(source).cast("string") if source else F.lit(None).cast("string")).alias("source"), (F.coalesce(hub_marker, F.lit(False)) if hub_marker is not None else F.lit(False)).alias("hub"), (variants if variants is not None else F.lit(None)).cast("string").alias("variant"))
    nodes = rows.groupBy("signature").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("source").alias("sources"), F.max("hub").alias("hub"))
    nodes = nodes.select("signature", "records", "sources", (F.col("hub") | (F.col("sources") >= hub_degree)).alias("is_hub"))
    counted = rows.where(F.col("variant").isNotNull()).groupBy("signature", "variant").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("signature").orderBy(F.desc("n"), "variant")
    best = counted.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).groupBy("signature").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "variant"))), lambda x: x["variant"]).alias("variants"))
    return nodes.join(best, "signature", "left")
