"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets come from weights, with a ceiling of ``cap`` times a source's size and the excess reshared (in closed form, by
sorting the ratios at which sources meet their ceilings). Equal-token blocks are then apportioned twice by highest
quotients: to sources by target, and within a source to its shards by size, so that every (source, shard) cell has an
integer quota. In a cell the documents stand in seeded order, ``cap`` epochs of them in a ring; the cell takes its quota
of blocks from a seeded block on. Cells grow as the square root of the number of documents, in number and in size, so
neither a hot source nor the table of cells lands in one task.

Null texts have size 0 and nothing is taken of them; null sources are one source, the last. Texts of any length are counted
whole; one that is longer than a cell's quota is taken in part. Equal quotients go to the party that comes first. Repeated
rows are documents of their own, and ids may be null or repeat. An empty table gives an empty result. Extra columns come
along in ``row`` under any name. Sources stand for corpora: their table goes through one task, and so does that of a
source's cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from .common import WORD, narrow, table


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(parties: DataFrame, by: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """parties with ``quota``: within each group of ``by``, its seats go to the highest quotients votes / (2 k + 1), ties by key.

    A party's quota is within n / 2 times its share, and 1, of its share of the seats. So only quotients that near are
    made and ranked: about 5 rows a party, however many seats there are."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    share = F.coalesce(F.try_divide(F.col(votes).cast("double"), F.sum(votes).over(group)), F.lit(0.0))
    slack = F.ceil(share * F.count(F.lit(1)).over(group) / 2) + 2
    near = parties.withColumn("_base", F.floor(share * F.col(seats) + 0.5)).withColumn("_slack", slack)
    near = near.withColumn("_sure", F.greatest(F.lit(0), F.col("_base") - F.col("_slack"))).withColumn("_open", F.col(seats) - F.sum("_sure").over(group))
    tried = near.withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_base") + F.col("_slack"))))
    rank = F.row_number().over(group.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), F.col(key), F.col("_k")))
    won = tried.withColumn("_won", ((rank <= F.col("_open")) & (F.col(votes) > 0)).cast("long"))
    return won.groupBy(*by, *[c for c in parties.columns if c not in by]).agg((F.first("_sure") + F.sum("_won")).alias("quota"))


def targets(sources: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sources (source, source_size), one row each, with ``target``. Weights repeat over the sources by code point, null last."""
    every = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("_w", weight).withColumn("_ceiling", F.col("source_size") * F.lit(float(cap)))
    rising = every.orderBy(F.col("_ceiling") / F.col("_w"), F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("_ceiling").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    s = s.withColumn("_at", F.row_number().over(rising)).withColumn("_level", level)
    free = F.min(F.when(F.col("_ceiling") > F.col("_level") * F.col("_w"), F.struct("_at", "_level"))).over(every)
    s = s.withColumn("_free", free)
    capped = F.col("_free").isNull() | (F.col("_at") < F.col("_free._at"))
    return s.withColumn("target", F.when(capped, F.col("_ceiling")).otherwise(F.col("_free._level") * F.col("_w"))).drop("_w", "_ceiling", "_at", "_level", "_free")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", keep: bool = False, block: int = 16, seed: int = 17, share: float = 1.5, cap: int = 2, weights: tuple[float, ...] = (3.0, 1.0, 2.0)) -> DataFrame:
    """key, size, source_size, target, taken of each row of docs; with keep, also the row itself as a struct, ``row``.

    block: words a block. taken is at most cap * size. Without keep, only ids, sources and sizes are shuffled."""
    rows = docs.select(
        F.col(key).alias("_key"),
        F.col(source).alias("_source"),
        F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source))).alias("_cell"),
        words(F.col(text)).alias("_size"),
        F.xxhash64(F.lit(seed), F.col(key).cast("string"), *([] if keep else [F.length(text)])).alias("_order"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if keep else []),
    )
    if not keep:
        rows = materialise(rows, "sizes")
    shards = max(1, math.ceil(math.sqrt(rows.count() if not keep else docs.count()) / 2))
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), F.lit(shards)).cast("int"))
    cells = materialise(rows.groupBy("_cell", "_shard").agg(F.first("_source").alias("source"), F.sum("_size").alias("cell_size")), "cells")
    sources = targets(cells.groupBy("_cell").agg(F.first("source").alias("source"), F.sum("cell_size").alias("source_size")), weights, share, cap)
    sources = sources.withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long"))
    sources = sainte_lague(sources, [], "_cell", "target", "_seats").select("_cell", "source_size", "target", F.col("quota").alias("_blocks"))
    quotas = sainte_lague(cells.drop("source").join(sources, "_cell"), ["_cell"], "_shard", "cell_size", "_blocks")

    order = Window.partitionBy("_cell", "_shard").orderBy("_order", "_key", "_size")
    placed = rows.withColumn("_at", F.sum("_size").over(order) - F.col("_size")).join(quotas, ["_cell", "_shard"])
    ring = F.col("cell_size") * cap
    length = F.least(F.col("quota") * block, ring)
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "_cell", "_shard"), F.greatest(F.lit(1), F.ceil(ring / block))) * block

    def overlap(epoch: int, shift: int) -> Column:
        x = F.col("_at") + F.col("cell_size") * epoch
        low = F.col("_start") - F.col("_ring") * shift
        return F.greatest(F.lit(0), F.least(x + F.col("_size"), low + F.col("_length")) - F.greatest(x, low))

    taken = sum((overlap(e, w) for e in range(cap) for w in (0, 1)), F.lit(0))
    placed = placed.withColumns({"_ring": ring, "_length": length, "_start": start})
    return placed.select(F.col("_key").alias(key), *(["row"] if keep else []), F.col("_size").alias("size"), "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(narrow(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))
