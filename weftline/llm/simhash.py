"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit set where over half of its shingles' hashes have it set. Fingerprints are compared once
each, not once a document. Bit i gets a random vector of r + 1 bits; table t of 2^(r+1) - 1 keeps the bits whose vector
has an odd product with t. For any r differing bits some t is orthogonal to all their vectors and so leaves all of them
out: every pair within the radius r collides in some table, and no link is lost.

In a bucket, no pairs are enumerated: a search from one fingerprint over those not yet reached links each to one that
reached it, so a bucket of g fingerprints emits under g links and keeps its components whole. A bucket of many
fingerprints never reaches a task as one group: its rows get the keys of all tables over the bits that its own table left
out, which by the same argument loses no pair in it, and so on. Three tables leave some 8 of the 64 bits open, so groups
are bounded then whatever the corpus.

Null and empty texts, and those of white space, have fingerprint zero and are linked like any other; texts of any length
are read whole. A null doc_id takes part in links; a component's id is its smallest doc_id that isn't null. Repeated rows
keep a row each. An empty table gives an empty one. Extra columns aren't read, so their names don't matter. However many
documents share a fingerprint, it is searched once; the join that hands labels back has one row a fingerprint on one
side, so that its hot keys can be split.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..scratch import materialise
from .common import give_back, narrow, small_batches, table

BITS = 64


def fingerprints(texts: list[bytes], shingle: int = 3, seed: int = 42, chunk: int = 1 << 16) -> np.ndarray:
    """uint64 fingerprint of each text. chunk bounds the shingles whose bits are expanded at once."""
    digest, out = xxhash.xxh64_intdigest, np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    owner: list[tuple[int, int]] = []  # text, shingles of it that stand in hashes
    totals: dict[int, list] = {}

    def flush() -> None:
        if not owner:
            return
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.cumsum([0] + [n for _, n in owner[:-1]])
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        for (i, n), row in zip(owner, sums, strict=True):
            if i in totals:
                totals[i][0] += n
                totals[i][1] += row
            else:
                totals[i] = [n, row.copy()]
        last = owner[-1][0]
        for i in [i for i in totals if i != last]:
            close(i)
        hashes.clear()
        owner.clear()

    def close(i: int) -> None:
        n, row = totals.pop(i)
        out[i] = np.packbits(2 * row > n, bitorder="little").view(np.uint64)[0]

    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        joined, size = b" ".join(words), min(shingle, len(words))
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        first, last = [0, *(ends[: len(words) - size] + 1).tolist()], ends[size - 1 :].tolist()
        for lo in range(0, len(first), chunk):
            part = [digest(joined[a:b], seed) for a, b in zip(first[lo : lo + chunk], last[lo : lo + chunk], strict=True)]
            hashes += part
            owner.append((i, len(part)))
            if len(hashes) >= chunk:
                flush()
    flush()
    for i in list(totals):
        close(i)
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3, seed: int = 42, to: str = "fp") -> DataFrame:
    """docs with a long column: the fingerprint's 64 bits as a signed number."""

    @F.pandas_udf("long")
    def fp(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(fingerprints([(x or "").encode() for x in s], shingle, seed).view(np.int64))
        give_back()

    return small_batches(docs).withColumn(to, fp(F.col(text)))


def covering_masks(radius: int, seed: int = 7) -> np.ndarray:
    """uint64 masks of the 2^(radius+1) - 1 tables."""
    vectors = np.random.default_rng(seed).integers(0, 1 << (radius + 1), BITS)
    odd = np.array([[bin(int(v) & t).count("1") % 2 == 1 for v in vectors] for t in range(1, 1 << (radius + 1))])
    return np.packbits(odd, axis=1, bitorder="little").view(np.uint64).ravel()


def _reach(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that join all components of fps: a search over what isn't reached yet."""
    rest = np.arange(1, len(fps))
    todo = [0]
    while len(rest):
        at = todo.pop() if todo else None
        if at is None:
            at, rest = rest[0], rest[1:]
            if not len(rest):
                return
        near = np.bitwise_count(fps[rest] ^ fps[at]) <= radius
        if near.any():
            hit = rest[near]
            rest = rest[~near]
            todo += hit.tolist()
            yield from ((int(at), int(h)) for h in hit)


def links(prints: DataFrame, radius: int = 3, seed: int = 7, large: int = 4096, levels: int = 4) -> DataFrame:
    """(u, v) links between the distinct longs of prints.fp: enough that components under "radius or fewer differing
    bits" come out whole. Not every close pair is listed, as its two ends are linked anyway."""
    masks = F.array(*[F.lit(int(m)) for m in covering_masks(radius, seed).view(np.int64)])

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(pdf["fp"].to_numpy()).view(np.uint64)
        found = np.array([(fps[a], fps[b]) for a, b in _reach(fps, radius)], np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"u": found[:, 0], "v": found[:, 1]})

    open_, groups = prints.select("fp", F.lit(0).cast("long").alias("group"), F.lit(0).cast("long").alias("used")), []
    for level in range(levels):  # used: the bits that a group's members agree in by its tables
        keyed = open_.select("fp", "group", "used", F.posexplode(masks).alias("t", "mask")).withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not("used")))
        keyed = keyed.select("fp", F.xxhash64("group", "t", F.col("fp").bitwiseAND(F.col("mask"))).alias("group"), F.col("used").bitwiseOR(F.col("mask")).alias("used"))
        size = keyed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # most buckets hold one
        shared = materialise(keyed.join(size, "group"), "buckets")
        last = level == levels - 1
        groups.append(shared if last else shared.where(F.col("n") <= large))
        open_ = shared.where(F.col("n") > large)
        if last or open_.isEmpty():
            break
    members = reduce(DataFrame.union, [g.select("group", "fp") for g in groups])
    return members.groupBy("group").applyInPandas(bucket, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp, label, component): label is the same throughout a group, component its smallest key. Only ids and fingerprints
    are shuffled."""
    prints = materialise(with_fingerprint(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", shingle, seed).select("key", "fp"), "prints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    nodes = connected_components(links(distinct.select("fp"), radius), "u", "v")
    labelled = distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    labelled = materialise(labelled, "labels")
    named = labelled.join(labelled.groupBy("label").agg(F.min("least").alias("component")), "label").select("fp", "label", "component")
    return prints.join(named, "fp").select(F.col("key").alias(key), "fp", "label", "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(narrow(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
