"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of at most ``PASSAGE`` words. Passages are TF-IDF vectors over the benchmark's
vocabulary, with document frequencies counted over the whole corpus. A distributed randomised SVD of the passages gives
the latent space; every window of every document is folded into it. Windows whose cosine with a passage reaches ``near``
are candidates; a window's norm counts as once to CLIP times the passage's, so that neither a window with one shared word is
near, nor a short passage lost among the other words of its window.
Candidates are then checked on words: the longest common subsequence with the passage, inside a stretch of one and a half
times its length, must cover ``sure`` of the passage, or ``likely`` of it with the answer: the words that the item's
answer names, or else the passage's rarest.

Documents are never shuffled. A benchmark of many words is indexed in blocks of passages of about ``most_terms`` words; the
driver holds one block at a time, and tasks get as many blocks at once as fit ``most_bytes``: beyond that, the corpus is
gone through again, with what was found so far beside it. An item whose passages fall in several blocks is reported once,
with its best passage.

Null and empty texts leak nothing; items without words find nothing; equal items are each reported. Texts of any length are
searched whole, window by window. Every row of the corpus is judged by itself, so repeated rows agree; null ids don't
matter. Of passages of an item that match alike, the first found counts. An empty corpus gives an empty table, an empty
benchmark no leaks. Extra columns stay; one called like the result is replaced.
"""

from __future__ import annotations

import itertools
import math
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.factor import randomised_svd
from ..scratch import materialise
from .common import give_back, narrow, small_batches, table

PASSAGE, BLOCK, SPAN = 48, 16, 4  # words of a passage at most; of a block; blocks of a window: it holds a passage whole
CLIP = 1.5
_PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return (text or "").lower().encode().translate(_PLAIN).split()


def passages(text: str | None) -> list[list[bytes]]:
    """Equal cuts of at most PASSAGE words."""
    w = words(text)
    n = -(-len(w) // PASSAGE)
    return [w[i * len(w) // n : (i + 1) * len(w) // n] for i in range(n)]


def longest_common(pattern: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence. pattern: id -> bits of its places. One step per word, on whole integers."""
    v = full = (1 << size) - 1
    for t in text:
        u = v & pattern.get(t, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


@dataclass
class Index:
    """One block of items. vocabulary: word -> term. terms: (terms, k) latent rows, IDF within. items: item of each passage.
    latent: (passages, k). coded: terms of each passage. answers: of each passage, terms that must show in a paraphrase."""

    vocabulary: dict[bytes, int]
    terms: np.ndarray
    items: list
    latent: np.ndarray
    coded: list[list[int]]
    answers: list[set[int]]

    @property
    def size(self) -> int:
        """Bytes that it takes, about."""
        return self.terms.nbytes + self.latent.nbytes + 128 * len(self.vocabulary) + 40 * sum(map(len, self.coded))

    def code(self, texts: list[str | None]) -> list[np.ndarray]:
        get = self.vocabulary.get
        return [np.fromiter(map(get, w, itertools.repeat(-1)), np.int32, len(w)) for w in map(words, texts)]

    def windows(self, coded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Latent vectors of all windows of SPAN blocks, one from each block on; the document and the first block of each."""
        blocks = [max(1, -(-len(c) // BLOCK)) for c in coded]
        first = np.cumsum([0, *blocks])
        ids = np.concatenate(coded) if coded else np.zeros(0, np.int32)
        place = np.concatenate([np.arange(len(c)) // BLOCK + f for c, f in zip(coded, first[:-1], strict=True)]) if coded else ids
        known = ids >= 0
        ids, place = ids[known], place[known]
        sums = np.zeros((int(first[-1]) + 1, self.terms.shape[1]), np.float32)
        step = 1 << 11  # so many rows of terms stay in the processor's cache
        rows = np.empty((step, self.terms.shape[1]), np.float32)
        for lo in range(0, len(ids), step):
            p = place[lo : lo + step]
            starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            got = np.take(self.terms, ids[lo : lo + step], axis=0, out=rows[: len(p)], mode="clip")
            sums[p[starts]] += np.add.reduceat(got, starts, axis=0)  # a block is in one chunk once
        doc = np.repeat(np.arange(len(coded)), blocks)
        block = np.arange(first[-1]) - first[doc]
        left = np.array(blocks)[doc] - block if len(doc) else block  # blocks from here to the document's end
        window = sums[:-1].copy()
        for more in range(1, SPAN):
            follows = np.flatnonzero(left > more)
            window[follows] += sums[follows + more]
        use = (left >= SPAN) | (block == 0)  # what is cut short by the end stands in a window before, if there is one
        return window[use], doc[use], block[use]

    def search(self, texts: list[str | None], near: float, likely: float, sure: float) -> list[list[dict]]:
        coded = self.code(texts)
        out: list[dict] = [{} for _ in texts]
        latent, doc, block = self.windows(coded)
        norm = np.linalg.norm(self.latent, axis=1)
        step = max(16, (1 << 22) // len(self.items))  # windows times passages at once
        for lo in range(0, len(latent), step):
            w = latent[lo : lo + step]
            cos = w @ self.latent.T / np.maximum(norm * np.clip(np.linalg.norm(w, axis=1)[:, None], norm, CLIP * norm), 1e-12)
            for i, j in zip(*np.nonzero(cos >= near), strict=True):
                d, at = int(doc[lo + i]), int(block[lo + i]) * BLOCK
                best = out[d].get(self.items[j])
                if best is None or best["similarity"] < 1:
                    share = self.verify(coded[d][max(0, at - BLOCK) : at + (SPAN + 1) * BLOCK].tolist(), int(j), likely, sure)
                    if share and (best is None or share > best["similarity"]):
                        out[d][self.items[j]] = {"item": self.items[j], "similarity": share, "cosine": float(min(1.0, cos[i, j]))}
        return [sorted(x.values(), key=lambda r: r["item"]) for x in out]

    def verify(self, near: list[int], j: int, likely: float, sure: float) -> float:
        """The share of passage j that near has in order, if that is enough; else 0."""
        passage = self.coded[j]
        n, places = len(passage), {}
        for i, t in enumerate(passage):
            places[t] = places.get(t, 0) | 1 << i
        if longest_common(places, n, near) < likely * n:
            return 0.0
        span, best = n + n // 2, 0.0
        for lo in range(0, max(1, len(near) - span + max(1, n // 8)), max(1, n // 8)):
            part = near[lo : lo + span]
            share = longest_common(places, n, part) / n
            if share >= sure or share >= likely and len(self.answers[j] & set(part)) * 3 >= 2 * len(self.answers[j]):
                best = max(best, share)
        return best


#: Words whose frequencies tasks and driver hold in a dictionary, and words that a task counts before it passes counts on.
WORDS_HELD, WORDS_COUNTED = 1 << 19, 1 << 18


def document_frequencies(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(word, n): in how many of all documents each word of wanted.word stands, from one pass; the empty word has the number
    of documents. Where the words wanted are few, tasks count only those; else all, which are met by a join."""
    few = wanted.count() <= WORDS_HELD
    shared = docs.sparkSession.sparkContext.broadcast({r["word"]: i for i, r in enumerate(wanted.toLocalIterator())} if few else None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(len(known or ()) + 1, np.int64)
        counted: dict[bytes, int] = {}
        rows = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(counted), pa.binary()), "n": pa.array(list(counted.values()), pa.int64())})

        for b in batches:
            rows += len(b)
            for t in b["text"]:
                w = words(t.as_py())
                if known is not None:
                    total[np.unique(np.fromiter(map(known.get, w, itertools.repeat(-1)), np.int32, len(w)))] += 1
                    continue
                for x in set(w):
                    counted[x] = counted.get(x, 0) + 1
                if len(counted) > WORDS_COUNTED:
                    yield out()
                    counted.clear()
        if known is not None:  # the last place has the words that aren't wanted
            counted |= {x: int(total[i]) for x, i in known.items() if total[i]}
        counted[b""] = rows
        yield out()

    found = small_batches(docs).select(F.col(text).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found if few else found.join(wanted.union(docs.sparkSession.createDataFrame(pa.table({"word": pa.array([b""], pa.binary())}))), "word", "left_semi")


def build(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", answer: str | None = None, k: int = 192, most_terms: int = 1 << 16) -> Iterator[Index]:
    """Indexes of blocks of passages, made as they are asked for. answer: a column of benchmark with the item's answer, if it has
    one."""
    own = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("answer"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"word": pa.array(list({w for t in b["text"] for w in words(t.as_py())}), pa.binary())})

    wanted = materialise(own.select("text").mapInArrow(split, "word binary").distinct(), "wanted")
    frequency = materialise(document_frequencies(docs, text, wanted), "frequency")
    few = frequency.count() <= WORDS_HELD + 1
    held = {r["word"]: r["n"] for r in frequency.toLocalIterator()} if few else {}
    n = sum(r["n"] for r in frequency.where("word = X''").collect())

    def index(vocabulary: dict, rows: list) -> Index:
        known = held
        if not few:
            here = docs.sparkSession.createDataFrame(pa.table({"word": pa.array(list(vocabulary), pa.binary())}))
            known = {r["word"]: r["n"] for r in frequency.join(here, "word").collect()}
        return _index(docs.sparkSession, vocabulary, rows, np.array([known.get(w, 0) for w in vocabulary]), n, k)

    vocabulary, rows = {}, []
    for r in own.orderBy("item", "text").toLocalIterator():
        for p in passages(r["text"]):
            if len(vocabulary) > most_terms:
                yield index(vocabulary, rows)
                vocabulary, rows = {}, []
            rows.append((r["item"], [vocabulary.setdefault(w, len(vocabulary)) for w in p], words(r["answer"])))
    if rows:
        yield index(vocabulary, rows)


def _index(spark: SparkSession, vocabulary: dict, rows: list, df: np.ndarray, n: int, k: int) -> Index:
    idf = np.log((n + 1) / (df + 1)) + 0.05
    sparse = []
    for _, terms, _ in rows:
        at, tf = np.unique(terms, return_counts=True)
        sparse.append((at.tolist(), (tf * idf[at]).tolist()))
    # from Arrow: rows of Python objects would start a second set of Python workers, with another environment, in each executor
    given = pa.table({"at": pa.array([a for a, _ in sparse], pa.list_(pa.int32())), "value": pa.array([v for _, v in sparse], pa.list_(pa.float64()))})
    matrix = spark.createDataFrame(given, "at array<int>, value array<double>").repartition(max(1, min(64, len(sparse) // 256)))
    vectors, _ = randomised_svd(matrix, len(vocabulary), min(k, len(rows)))
    latent = np.array([np.asarray(v) @ vectors[a] for a, v in sparse])
    answers = []
    for _, terms, said in rows:
        named = {vocabulary[w] for w in said if w in vocabulary}
        rare = sorted(set(terms), key=lambda t: (-idf[t], t))[: max(3, math.ceil(len(terms) / 8))]
        answers.append(named or set(rare))
    return Index(vocabulary, (vectors * idf[:, None]).astype(np.float32), [r[0] for r in rows], latent.astype(np.float32), [r[1] for r in rows], answers)


def _best(*found: list[dict]) -> list[dict]:
    """Each item once, as it is most similar."""
    best: dict = {}
    for x in itertools.chain(*found):
        if x["item"] not in best or x["similarity"] > best[x["item"]]["similarity"]:
            best[x["item"]] = x
    return sorted(best.values(), key=lambda x: x["item"])


def _search(docs: DataFrame, indexes: list[Index], item_type: str, text: str, near: float, likely: float, sure: float, to: str, more: bool) -> DataFrame:
    """docs with the leaks that indexes find; with more, beside those in the column already."""
    shared = docs.sparkSession.sparkContext.broadcast(indexes)

    @F.pandas_udf(f"array<struct<item:{item_type},similarity:double,cosine:double>>")
    def leaks(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for s, before in parts:
            out, batch, size = [], [], 0
            for t in [*s, None]:
                batch.append(t)
                size += len(t or "")
                if size > 1 << 19 or len(out) + len(batch) > len(s):
                    found = [x.search(batch, near, likely, sure) for x in shared.value]
                    out += [_best(*each) for each in zip(*found, strict=True)]
                    batch, size = [], 0
            yield pd.Series([_best(b, x) for b, x in zip(before, out, strict=False)] if more else out[: len(s)])
        give_back()

    return small_batches(docs).withColumn(to, leaks(F.col(text), F.col(to) if more else F.lit(0)))


def with_leaks(docs: DataFrame, indexes: Iterable[Index], item_type: str = "bigint", text: str = "text", near: float = 0.45, likely: float = 0.6, sure: float = 0.8, to: str = "leaks", most_bytes: int = 256 << 20) -> DataFrame:
    """docs with array<struct<item, similarity, cosine>>: the benchmark items that a document holds, each once."""
    settings = item_type, text, near, likely, sure, to
    some, size, more = [], 0, False
    for index in indexes:
        if some and size + index.size > most_bytes:
            docs, more, some, size = materialise(_search(docs, some, *settings, more), "leaks"), True, [], 0
        some.append(index)
        size += index.size
    if not some:
        return docs.withColumn(to, F.array().cast(f"array<struct<item:{item_type},similarity:double,cosine:double>>"))
    return _search(docs, some, *settings, more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = narrow(table(spark, sf_dir, "documents"), "doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = with_leaks(docs, build(docs, benchmark)).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", F.col("leak.item").alias("item_id"), F.col("leak.similarity").alias("similarity"), F.col("leak.cosine").alias("cosine"))
