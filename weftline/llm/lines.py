"""Line deduplication with two Bloom filters.

Every task enters the keys of its documents' long lines, once a document, into a filter of keys seen once; a key that is
already there enters a second filter of keys seen twice. Filters merge bit by bit: seen twice is twice in either, or once
in both. Merging may add suspects but never loses a repeat. Lines whose key passes the second filter are suspects; their
keys alone are shuffled, in full, for an exact count of documents and the choice of the one that keeps its lines.

The second filter is what is broadcast: at most ``max_bits``. A corpus that needs more is gone through in passes, each for
the keys of one part of the hash's range, with a filter of its own; so filters never fill up, and no key is left out.

Null and empty texts are one empty line. Very long texts and lines are handled like any other; keys and lines aren't cut.
Documents with equal doc_id count once, and keep or drop together; rows without a doc_id count as one document that
never keeps. Repeated lines within a document stay or go together. Ids may be of any type that has an order, and stay in
Arrow arrays of that type. An empty table gives an empty one. Extra columns aren't read, so their names don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialise
from .common import give_back, narrow, small_batches, table

BLANK = b" \t\n\x0b\x0c\r"
SLICE = 1 << 16  # bytes of a filter that are merged at once


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # bytes.lower changes A-Z only


def long_key(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _places(h: np.ndarray, bits: int, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        step = (h * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        return ((h[:, None] + np.arange(k, dtype=np.uint64) * step[:, None]) >> np.uint64(16)) & np.uint64(bits - 1)


def _has(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool).all(axis=1)


def _put(words: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64).ravel(), (np.uint64(1) << (at & np.uint64(63))).ravel())


def _long_keys(text: str | None, least: int) -> list[bytes]:
    """The distinct keys of a text's lines that are long enough."""
    return [x for x in {line_key(x) for x in text.encode().split(b"\n")} if long_key(x, least)] if text else []


def _hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))


def seen_twice(docs: DataFrame, text: str, least: int, bits: int, k: int, turn: int = 0, passes: int = 1) -> np.ndarray:
    """The words of the second filter over all of docs.text, for the keys whose turn it is."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 64, np.uint64), np.zeros(bits // 64, np.uint64)
        for b in batches:
            h = _hashes([x for t in b["text"] for x in _long_keys(t.as_py(), least)])
            h, n = np.unique(h[h % np.uint64(passes) == turn], return_counts=True)
            at = _places(h, bits, k)
            _put(twice, at[(n > 1) | _has(once, at)])
            _put(once, at)
        step = SLICE // 8
        for i in range(0, bits // 64, step):
            x, y = once[i : i + step], twice[i : i + step]
            if x.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([i // step], pa.int32()), "once": [zlib.compress(x.tobytes(), 1)], "twice": [zlib.compress(y.tobytes(), 1)]})
        give_back()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once = twice = np.uint64(0)
        for a, b in zip(pdf["once"], pdf["twice"], strict=True):
            a, b = np.frombuffer(zlib.decompress(a), np.uint64), np.frombuffer(zlib.decompress(b), np.uint64)
            once, twice = once | a, twice | b | (once & a)
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})

    schema = "slice int, once binary, twice binary"
    filled = docs.select(F.col(text).alias("text")).mapInArrow(fill, schema)
    salted = filled.withColumn("salt", (F.rand(1) * 32).cast("int"))  # merge in two steps, so that no group grows with the tasks
    first = salted.groupBy("slice", "salt").applyInPandas(lambda pdf: merge(pdf.drop(columns="salt")), schema)
    out = np.zeros(bits // 64, np.uint64)
    for r in first.groupBy("slice").applyInPandas(merge, schema).select("slice", "twice").toLocalIterator():
        part = np.frombuffer(zlib.decompress(r["twice"]), np.uint64)
        out[r["slice"] * (SLICE // 8) :][: len(part)] = part
    return out


def _with_suspects(rows: DataFrame, twice: np.ndarray, least: int, bits: int, k: int, turn: int, passes: int) -> DataFrame:
    """rows (key, text, suspects) with the keys of this turn that pass the filter added to suspects."""
    shared = rows.sparkSession.sparkContext.broadcast(twice)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 512) for b in batches for i in range(0, len(b), 512)):  # few keys and copies of texts at once
            keys, owner = [], []
            for i, t in enumerate(b["text"]):
                own = _long_keys(t.as_py(), least)
                keys += own
                owner += [i] * len(own)
            h = _hashes(keys)
            hit = np.flatnonzero((h % np.uint64(passes) == turn) & _has(shared.value, _places(h, bits, k))) if keys else ()
            suspects = [x.as_py() or [] for x in b["suspects"]]
            for j in hit:
                suspects[owner[j]].append(keys[j].decode())
            yield pa.RecordBatch.from_arrays([b["key"], b["text"], pa.array(suspects, pa.list_(pa.string()))], ["key", "text", "suspects"])
        give_back()

    return rows.mapInArrow(mark, f"key {rows.schema['key'].dataType.simpleString()}, text string, suspects array<string>")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 40, documents: int = 5, k: int = 4, max_bits: int = 1 << 30, bits_per_document: int = 256) -> DataFrame:
    """key, kept (the text that stays), n_lines, n_dropped for each row of docs.

    A line whose key has at least ``least`` code points and stands in at least ``documents`` documents stays only in the
    largest key that holds it. bits_per_document sizes the filters; beyond max_bits there are more passes."""
    rows = small_batches(docs).select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    wanted = rows.count() * bits_per_document
    passes = max(1, -(-wanted // max_bits))
    bits = 1 << max(6, min(max_bits.bit_length() - 1, max(20, (wanted // passes).bit_length())))
    marked = rows.withColumn("suspects", F.array().cast("array<string>"))
    for turn in range(passes):
        marked = materialise(_with_suspects(marked, seen_twice(rows, "text", least, bits, k, turn, passes), least, bits, k, turn, passes), "marked")
    marked = marked.withColumn("n_lines", F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + F.lit(1).cast("long"))
    held = marked.select("key", F.explode("suspects").alias("line")).distinct()
    repeated = held.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("keeper")).where(F.col("n") >= documents)
    drops = held.join(repeated, "line").where(~F.col("key").eqNullSafe(F.col("keeper"))).groupBy("key").agg(F.collect_list("line").alias("drop"))
    suspect = marked.where(F.size("suspects") > 0).select("key", "text", "n_lines")
    joined = suspect.join(drops.withColumnRenamed("key", "k"), suspect["key"].eqNullSafe(F.col("k")), "left").select("key", "text", "n_lines", "drop")

    @F.pandas_udf("struct<kept:string,n:long>")
    def without(texts: pd.Series, drop: pd.Series) -> pd.DataFrame:
        out = []
        for t, d in zip(texts, drop, strict=True):
            lines = t.split("\n") if d is not None else []
            gone = set(d) if d is not None else ()
            keep = [x for x in lines if line_key(x.encode()).decode() not in gone]
            out.append(("\n".join(keep), len(lines) - len(keep)) if d is not None else (t, 0))
        return pd.DataFrame(out, columns=["kept", "n"])

    changed = joined.select("key", "n_lines", without("text", "drop").alias("r")).select("key", F.col("r.kept").alias("kept"), "n_lines", F.col("r.n").alias("n_dropped"))
    same = marked.where(F.size("suspects") == 0).select("key", F.col("text").alias("kept"), "n_lines", F.lit(0).cast("long").alias("n_dropped"))
    return same.union(changed).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = deduplicate(narrow(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, i, line,
    translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
r AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT l.*, r.keeper IS NOT NULL AND r.keeper <> l.doc_id AS gone FROM l LEFT JOIN r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
