"""Precision gates over scored pairs, multi-stage matching, and the review loop."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .blocking import unresolved
from .edges import make_edges
from .scoring import best_and_margin


def token_jaccard(a: Column | str, b: Column | str) -> Column:
    x, y = tokens(a), tokens(b)
    n = F.size(F.array_union(x, y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(0.0)


def gate(scored: DataFrame, checks: dict[str, Column], enforce: bool = True) -> DataFrame:
    """scored with ``failed``: the names of the checks that don't hold (null counts as failed). With enforce, only those that pass all."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]), lambda x: x.isNotNull())
    out = scored.withColumn("failed", failed)
    return out.where(F.size("failed") == 0) if enforce else out


def margin_gate(scored: DataFrame, least: float, enforce: bool = True) -> DataFrame:
    return gate(best_and_margin(scored), {"margin": F.col("margin") >= least}, enforce)


def overlap_gate(a: Column | str, b: Column | str, score: Column | str = "score", bypass: float = 0.95) -> Column:
    """A shared token, or a score high enough to do without."""
    return F.arrays_overlap(tokens(a), tokens(b)) | ((F.col(score) if isinstance(score, str) else score) >= bypass)


def affinity_gate(a: Column | str, target_type: Column, allowed: dict[str, list[str]]) -> Column:
    """The target's type is allowed by some token of a; passes if no token has a rule."""
    t = tokens(a, ())
    has = reduce(lambda x, y: x | y, [F.array_contains(t, k) for k in allowed], F.lit(False))
    fits = reduce(lambda x, y: x | y, [F.array_contains(t, k) & target_type.isin(*v) for k, v in allowed.items()], F.lit(False))
    return ~has | fits


def multi_stage(docs: DataFrame, key: str, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Edges of stages in turn; each stage (name, records -> scored pairs) sees the records that no earlier edge touches."""
    edges = None
    for name, stage in stages:
        left = docs if edges is None else unresolved(docs, key, edges)
        found = make_edges(stage(left), name)
        edges = found if edges is None else edges.unionByName(found)
    return edges


def verdict_override(score: Column, decision: Column, confidence: Column, low: float = 0.55, high: float = 0.8) -> Column:
    """A verifier's match lifts a score over the band, its no_match presses one under it; else the score stays."""
    return F.when((decision == "match") & (score < high), high + (1 - high) * confidence).when((decision == "no_match") & (score >= low), low * (1 - confidence)).otherwise(score)


def verify_band(scored: DataFrame, verify: Callable[[DataFrame], DataFrame], low: float = 0.55, high: float = 0.8, budget: int | None = None) -> DataFrame:
    """Scores after verify(pairs in [low, high)) -> (doc1_key, doc2_key, decision, confidence); with a budget, those nearest the middle."""
    band = scored.where((F.col("score") >= low) & (F.col("score") < high))
    if budget is not None:
        band = band.orderBy(F.abs(F.col("score") - (low + high) / 2), "doc1_key", "doc2_key").limit(budget)
    got = scored.join(verify(band), ["doc1_key", "doc2_key"], "left")
    return got.withColumn("score", verdict_override(F.col("score"), F.col("decision"), F.col("confidence"), low, high))


def feedback_stats(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg_score"), F.avg("confidence").alias("avg_confidence"))


def query_verdicts(verdicts: DataFrame, decision: str | None = None, order: str = "score", descending: bool = True, offset: int = 0, limit: int = 50, tie: str = "id") -> DataFrame:
    """A page of verdicts with the total number that fit."""
    found = verdicts if decision is None else verdicts.where(F.col("decision") == decision)
    total = found.count()
    return found.orderBy(F.col(order).desc() if descending else F.col(order).asc(), tie).offset(offset).limit(limit).withColumn("total", F.lit(total))


def pending_review(scored: DataFrame, verdicts: DataFrame, low: float = 0.55, high: float = 0.8) -> DataFrame:
    """Pairs of the band that have no verdict."""
    return scored.where((F.col("score") >= low) & (F.col("score") < high)).join(verdicts.select("doc1_key", "doc2_key"), ["doc1_key", "doc2_key"], "left_anti")


def threshold_from_feedback(verdicts: DataFrame, isotonic: bool = False) -> float | None:
    """A score over which verdicts tend to be matches: where isotonic regression passes one half, or the middle between the lower
    quarter of matches and the upper quarter of others."""
    rows = verdicts.where("decision in ('match', 'no_match')").select(F.col("score").cast("double").alias("score"), (F.col("decision") == "match").cast("double").alias("label"))
    if isotonic:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import IsotonicRegression

        data = VectorAssembler(inputCols=["score"], outputCol="features").transform(rows)
        model = IsotonicRegression(featuresCol="features", labelCol="label").fit(data)
        for at, p in zip(model.boundaries.toArray(), model.predictions.toArray(), strict=True):
            if p >= 0.5:
                return float(at)
        return None
    a, b = rows.agg(F.percentile(F.when(F.col("label") == 1, F.col("score")), F.lit(0.25)), F.percentile(F.when(F.col("label") == 0, F.col("score")), F.lit(0.75))).first()
    return None if a is None or b is None else (a + b) / 2


def record_audit(log: DataFrame, entries: DataFrame) -> DataFrame:
    return log.unionByName(entries, allowMissingColumns=True)


def history(log: DataFrame, subject: str) -> DataFrame:
    return log.where(F.col("subject") == subject).orderBy("at", "action")


def incremental_scores(records: DataFrame, base: DataFrame, key: str, fields: list[str], candidates: DataFrame, threshold: float = 0.75, top: int = 10) -> DataFrame:
    """(new_key, base_key, score, rank): mean over fields of 1 for equal values, else Jaro-Winkler; fields empty on both sides don't count."""
    from ..functions.similarity import jaro_winkler

    v = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    a = records.select(F.col(key).cast("string").alias("new_key"), *[v(f).alias(f"a_{f}") for f in fields])
    b = base.select(F.col(key).cast("string").alias("base_key"), *[v(f).alias(f"b_{f}") for f in fields])
    met = candidates.join(a, "new_key").join(b, "base_key")
    seen = [(F.col(f"a_{f}") != "") | (F.col(f"b_{f}") != "") for f in fields]
    each = [F.when(F.col(f"a_{f}") == F.col(f"b_{f}"), 1.0).otherwise(jaro_winkler(f"a_{f}", f"b_{f}")) for f in fields]
    n = sum((s.cast("int") for s in seen), F.lit(0))
    total = sum((F.when(s, e).otherwise(0.0) for s, e in zip(seen, each, strict=True)), F.lit(0.0))
    scored = met.select("new_key", "base_key", F.when(n > 0, total / n).otherwise(0.0).alias("score")).where(F.col("score") >= threshold)
    w = Window.partitionBy("new_key").orderBy(F.desc("score"), "base_key")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def parse_verdict(raw: Column | str) -> Column:
    """struct<decision, confidence, reasoning> of a verifier's answer: a JSON object, alone or in a Markdown fence. Null where there is
    none, or none with a decision."""
    text = F.col(raw) if isinstance(raw, str) else raw
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.trim(F.when(text.rlike(r"(?s)```.*?```"), fenced).otherwise(text), F.lit(" \n\r\t"))
    whole = F.when(F.try_parse_json(body).isNotNull() & body.startswith("{"), body)  # from_json would take the start of a broken object
    found = F.from_json(whole, "decision string, confidence double, reasoning string")
    return F.when(found["decision"].isNotNull(), found)
