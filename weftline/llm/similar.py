"""Near-duplicates by exact similarity of shingle sets: candidates by SimHash and MinHash, confirmed by the sets themselves.

SimHash groups come from ``simhash``: fingerprints within 3 bits, by covering tables. Pairs at 0.8 may differ in more bits than
tables can cover, so MinHash completes the candidates. A group of either is one more bucket.

Two texts are linked when the Jaccard similarity of their sets of 5-word shingles is 0.8 or more. A text gets BANDS keys of
ROWS minima each; a pair at similarity s shares none with probability (1 - s^4)^32, under 5e-8 at 0.8 and less above. Texts
with equal sets are one from the start. Buckets with the same members count once, so a pair is compared about once and
not once a key. In a bucket no pairs are listed: a search from one set over those not yet reached links each to one that
reached it, by comparing whole sets.

Words and shingles are 64-bit hashes, and so are sets' ids. Texts of fewer than five words are one shingle. Null and empty
texts, and those of white space, have the empty set and are linked to each other only. A null doc_id takes part in
links; a component's id is its smallest doc_id that isn't null. Repeated rows keep a row each. Texts of any length are read
whole. An empty table gives an empty one. Extra columns aren't read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..scratch import materialise
from . import simhash
from .common import give_back, small_batches

BANDS, ROWS = 32, 4
BANDS_AT_ONCE = 8  # bounds the rows of one aggregate of keys, and with them an executor's heap
CACHED_WORDS = 1 << 17
#: Ids up to this number (of 8 bytes) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(11)
_PLACE = _rng.integers(0, 1 << 63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = _rng.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.integers(0, 1 << 63, BANDS * ROWS).astype(np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes, words: dict, shingle: int = 5) -> np.ndarray:
    """Sorted distinct uint64 hashes of the text's shingles."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h, size = np.fromiter(map(words.__getitem__, w), np.uint64, len(w)), min(shingle, len(w))
    total = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        total += h[k : len(w) - size + 1 + k] * _PLACE[k]
    return np.unique(_mixed(total))


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes(), len(hashes))


def band_keys(hashes: np.ndarray, chunk: int = 1 << 12) -> np.ndarray:
    """uint64 key of each band of minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), chunk):
        least = np.minimum(least, ((hashes[None, lo : lo + chunk] ^ _FLIP[:, None]) * _FACTOR[:, None]).min(axis=1))
    rows = least.reshape(BANDS, ROWS) * _PLACE[None, :ROWS]
    return _mixed(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _PLACE[ROWS])


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def with_id(docs: DataFrame, text: str = "text", shingle: int = 5, keys: bool = False, sets: bool = False, prints: bool = False, to: str = "s") -> DataFrame:
    """docs with a struct: the id of the text's shingle set; on request the keys of its bands, the set as bytes, or the text's
    SimHash fingerprint. All come from one pass: a second Python function in a task is a second Python worker, which stays."""
    kind = "id long" + (", keys array<long>" if keys else "") + (", hashes binary" if sets else "") + (", print long" if prints else "")

    @F.pandas_udf(kind)
    def sketch(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for s in parts:
            out: dict[str, list] = {"id": []} | ({"keys": []} if keys else {}) | ({"hashes": []} if sets else {})
            texts = [(x or "").encode() for x in s]
            for x in texts:
                found = shingle_set(x, words, shingle)
                out["id"].append(set_id(found))
                if keys:
                    out["keys"].append(_signed(band_keys(found)))
                if sets:
                    out["hashes"].append(found.tobytes())
            if prints:
                out["print"] = _signed(simhash.fingerprints(texts))
            yield pd.DataFrame(out | {"id": _signed(np.array(out["id"], np.uint64))})
        give_back()

    return small_batches(docs).withColumn(to, sketch(F.col(text)))


def reach(sets: list[np.ndarray], least: float = 0.8) -> Iterator[tuple[int, int]]:
    """Links (places in sets) that join all components under Jaccard similarity of least or more."""
    sizes = np.array([len(x) for x in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    edges = np.concatenate([[0], np.cumsum(sizes)])
    rest, flat, starts, todo = np.arange(1, len(sets)), codes[edges[1] :], edges[1:-1] - edges[1], [0]
    mark = np.zeros(codes.max(initial=-1) + 1, bool)
    while len(rest):
        if todo:
            at, seed = todo.pop(), False
        else:
            at, seed = int(rest[0]), True
        own = codes[edges[at] : edges[at + 1]]
        mark[own] = True
        running = np.concatenate([[0], np.cumsum(mark[flat])])
        shared = running[starts + sizes[rest]] - running[starts]
        mark[own] = False
        near = shared >= least * (sizes[rest] + sizes[at] - shared) - 1e-9
        if seed:
            near[0] = True  # itself: it is reached now
        if near.any():
            yield from ((at, int(h)) for h in rest[near] if h != at)
            todo += [int(h) for h in rest[near] if h != at]
            stay = ~near
            flat = flat[np.repeat(stay, sizes[rest])]
            rest = rest[stay]
            starts = np.concatenate([[0], np.cumsum(sizes[rest])])[:-1]


def links(members: DataFrame, least: float = 0.8) -> DataFrame:
    """(u, v) links between ids of members (key, id, hashes), a row for each id in a bucket."""

    def bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy()
        found = np.array(list(reach([np.frombuffer(x, np.uint64) for x in pdf["hashes"]], least)), np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": ids[found[:, 0]], "v": ids[found[:, 1]]})

    return members.groupBy("key").applyInPandas(bucket, "u long, v long").distinct()


def simhash_groups(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(key, id) of prints (id, print): ids whose fingerprints are linked, directly or by others, within the radius; a key a group."""
    linked = connected_components(simhash.links(prints.select(F.col("print").alias("fp")).distinct(), radius), "u", "v")
    labelled = prints.join(linked, prints["print"] == linked["node"], "left").select("id", F.xxhash64(F.lit("simhash"), F.coalesce("component", "print")).alias("key"))
    size = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return labelled.join(size, "key").select("key", "id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, shingle: int = 5) -> DataFrame:
    """(key, fp, label, component): fp is the id of the row's shingle set, label the same throughout a group, component its
    smallest key. Ids, fingerprints and band keys are shuffled, and the sets of texts that share a bucket with another."""
    texts = docs.select(F.col(key).alias("name"), F.col(text).alias("text"))
    prints = materialise(with_id(texts, "text", shingle, keys=True, prints=True).select("name", "s.id", "s.keys", "s.print"), "prints")
    distinct = materialise(prints.groupBy("id").agg(F.min("name").alias("least"), F.first("keys").alias("keys"), F.min("print").alias("print")), "distinct")
    keyed = [materialise(simhash_groups(distinct.select("id", "print")), "grouped")]
    for band in range(1, BANDS + 1, BANDS_AT_ONCE):
        some = distinct.select("id", F.explode(F.slice("keys", band, BANDS_AT_ONCE)).alias("key"))
        size = some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")  # most buckets hold one
        keyed.append(materialise(some.join(size, "key").select("key", "id"), "keyed"))
    shared = reduce(DataFrame.union, keyed)
    digests = [F.bit_xor(F.xxhash64(F.lit(salt), "id")).alias(f"x{salt}") for salt in (1, 2)]
    once = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *digests).groupBy("n", "x1", "x2").agg(F.min("key").alias("key")).select("key")
    members = materialise(shared.join(once, "key"), "members")
    names = materialise(members.select("id").distinct().join(distinct.select("id", "least"), "id").select("least").distinct(), "names")
    some = texts.join(F.broadcast(names) if names.count() <= BROADCAST_IDS else names, texts["name"].eqNullSafe(names["least"]), "left_semi")
    sets = with_id(some, "text", shingle, sets=True).select("s.id", "s.hashes").dropDuplicates(["id"])
    nodes = connected_components(links(members.join(sets, "id"), least), "u", "v")
    labelled = distinct.join(nodes, distinct["id"] == nodes["node"], "left").select("id", "least", F.coalesce("component", "id").alias("label"))
    labelled = materialise(labelled, "labels")
    named = labelled.join(labelled.groupBy("label").agg(F.min("least").alias("component")), "label").select("id", "label", "component")
    return prints.join(named, "id").select(F.col("name").alias(key), F.col("id").alias("fp"), "label", "component")
