"""Language ID by interpolated Kneser-Ney character language models.

Texts are lower-cased and every run of characters that aren't letters becomes one space. A language's model of order n
interpolates discounted counts of n-grams with continuation counts of shorter ones. All languages share one set of
sorted 64-bit hash arrays, one per order, with a row of probabilities and back-off weights per language; a look-up is a
binary search. A text goes to the language with the lowest cross-entropy per character.

Rejection is calibrated on documents that were not counted: a text is rejected if its cross-entropy exceeds its
language's mean by more than ``slack`` nats and a multiple of the deviation that a text of its length shows.

Null texts and texts without letters are ``und`` with score 0, and rejected; marks alone are no letters. Ties go to the
first language by name. Texts of any length are scored whole, each row by itself, so repeated rows agree. Counts come from
a bounded sample of labelled rows: ``per_language`` documents of each language, chosen by hash. Without any such row, as
in an empty table, all texts are ``und``. Extra columns aren't read; a column called like the result is replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, narrow, small_batches, table

ORDER = 4
_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)), bool, 0x110000)
        _letters[0xD800:0xE000] = False
    return _letters


def _clean(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, cleaned and with ORDER - 1 spaces before each; the index of the text of each."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter = _letter_table()[points]
    points = np.where(letter, points, 32).astype(np.uint64)
    first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
    before = np.r_[False, letter[:-1]] if len(owner) else first
    keep = letter | (before & ~first)  # one space after a word
    return points[keep], owner[keep]


def _grams(points: np.ndarray, owner: np.ndarray, n: int = ORDER) -> np.ndarray:
    """The packed n-gram that ends at each point; spaces stand before a text's start. 16 bits a character."""
    p, out = points & np.uint64(0xFFFF), np.zeros(len(points), np.uint64)
    for back in range(n - 1, -1, -1):
        shifted = np.full(len(p), 32, np.uint64)
        if back:
            same = owner[back:] == owner[:-back]
            shifted[back:] = np.where(same, p[:-back], np.uint64(32))
        else:
            shifted = p
        out = (out << np.uint64(16)) | shifted
    return out


def _hash(packed: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (packed ^ np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


@dataclass
class Model:
    """hashes[n-1]: sorted; probability[n-1], backoff[n-1]: (n-grams, languages), of the discounted n-gram and of the
    context's left-over weight. floor: probability of any character without counts. mean, deviation: by language, per character."""

    languages: list[str]
    hashes: list[np.ndarray]
    probability: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None

    def log_probability(self, packed: np.ndarray) -> np.ndarray:
        """(n-grams, languages): log P(last character | those before)."""
        p = np.broadcast_to(self.floor, (len(packed), len(self.languages))).astype(np.float64)
        for n in range(1, ORDER + 1):
            own = packed & np.uint64((1 << (16 * n)) - 1) if n < 4 else packed
            context = own >> np.uint64(16)
            seen, at = _find(self.contexts[n - 1], _hash(context, n))
            p = np.where(seen[:, None], self.backoff[n - 1][at], 1.0) * p
            seen, at = _find(self.hashes[n - 1], _hash(own, n))
            p = p + np.where(seen[:, None], self.probability[n - 1][at], 0.0)
        return np.log(p)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters scored, and cross-entropy by language, of each text."""
        points, owner = _clean(texts)
        n = np.bincount(owner, minlength=len(texts))
        total = np.zeros((len(texts), len(self.languages)))
        if len(points):
            codes, distinct = pd.factorize(_grams(points, owner))
            logs = self.log_probability(distinct).astype(np.float32)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            for j in range(len(self.languages)):
                total[owner[starts], j] = np.add.reduceat(logs[:, j][codes].astype(np.float64), starts)
        return n, -total / np.maximum(n, 1)[:, None]

    def predict(self, texts: list[str], slack: float = 1.2, spread: float = 6.0) -> pd.DataFrame:
        """lang, score (the posterior at a temperature that grows with the root of the length), accepted."""
        if not self.languages:
            return pd.DataFrame({"lang": ["und"] * len(texts), "score": 0.0, "accepted": False})
        n, h = self.entropies(texts)
        n[[not any(map(str.isalpha, t)) for t in texts]] = 0
        best = h.argmin(axis=1)
        z = np.exp(-(h - h.min(axis=1, keepdims=True)) * np.sqrt(np.maximum(n, 1))[:, None])
        over = h[np.arange(len(h)), best] - self.mean[best]
        fine = (n > 0) & (over <= slack + spread * self.deviation[best] / np.sqrt(np.maximum(n, 1)))
        lang = np.array([*self.languages], object)[best]
        lang[n == 0] = "und"
        return pd.DataFrame({"lang": lang, "score": np.where(n > 0, 1 / z.sum(axis=1), 0.0), "accepted": fine})


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return sorted_[at] == wanted, at


def fit(counts: pd.DataFrame, discount: float = 0.75) -> Model:
    """counts: (lang, gram: packed as a signed long, n) of order ORDER. Lower orders follow from it: their counts are numbers of
    distinct characters before them."""
    languages = sorted(counts["lang"].unique())
    model = Model(languages, [], [], [], [], np.zeros(len(languages)))
    by_order: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in languages:
        own = counts[counts["lang"] == lang]
        grams, n = own["gram"].to_numpy().view(np.uint64), own["n"].to_numpy().astype(float)
        orders = [(grams, n)]
        for k in range(ORDER - 1, 0, -1):
            shorter, n = np.unique(orders[0][0] & np.uint64((1 << (16 * k)) - 1), return_counts=True)
            orders.insert(0, (shorter, n.astype(float)))
        by_order.append(orders)
    letters = np.unique(np.concatenate([o[0][0] for o in by_order])) if by_order else ()
    model.floor = np.full(len(languages), 1 / (len(letters) + 1))  # order 0: all known characters and one more alike
    for k in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([o[k - 1][0] for o in by_order])) if by_order else np.zeros(0, np.uint64)
        contexts = np.unique(keys >> np.uint64(16))
        p, back = np.zeros((len(keys), len(languages))), np.ones((len(contexts), len(languages)))
        for j, orders in enumerate(by_order):
            grams, n = orders[k - 1]
            at = np.searchsorted(contexts, grams >> np.uint64(16))
            total = np.bincount(at, n, len(contexts))
            kinds = np.bincount(at, minlength=len(contexts))
            p[np.searchsorted(keys, grams), j] = np.maximum(n - discount, 0) / total[at]
            back[:, j] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        for what, (h, rows) in (("own", (_hash(keys, k), p)), ("context", (_hash(contexts, k), back))):
            order = np.argsort(h)
            (model.hashes if what == "own" else model.contexts).append(h[order])
            (model.probability if what == "own" else model.backoff).append(rows[order])
    return model


def held_out(key: Column) -> Column:
    """Documents that nothing is learned from, by the checksum of their id."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 400, calibration: int = 150, most_languages: int = 500) -> Model:
    """A model of the labelled rows of docs that aren't held out. per_language bounds the documents counted of each language,
    calibration those that set its rejection limits. A column of more than most_languages values holds no languages, and is
    refused."""
    d = small_batches(docs).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("key")))
    d = d.withColumn("h", F.xxhash64(F.col("key").cast("string"), F.lit("language")))
    wanted = per_language + calibration
    sizes = d.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"column {lang!r} has more than {most_languages} values")
    # a hash below this share of the range: about twice the documents wanted, before the exact choice
    near = F.lit(False)
    for r in sizes:
        near = near | ((F.col("lang") == r["lang"]) & (F.col("h") / 2.0**64 + 0.5 <= 2 * wanted / r["count"]))
    ranked = d.where(near).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "key")))
    counted = F.lit(0)
    for r in sizes:  # a language of few documents keeps a quarter of them for calibration
        counted = F.when(F.col("lang") == r["lang"], min(per_language, -(-3 * r["count"] // 4))).otherwise(counted)
    chosen = ranked.where(F.col("rank") <= wanted).select("lang", "text", (F.col("rank") > counted).alias("later"))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, own in p.groupby("lang"):
                gram, n = np.unique(_grams(*_clean(own["text"].tolist())), return_counts=True)
                yield pd.DataFrame({"lang": name, "gram": gram.view(np.int64), "n": n})

    # few languages mean few groups: deal the sample out before counting
    dealt = chosen.repartition(16)
    counts = dealt.where(~F.col("later")).mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model = fit(counts.toPandas().sort_values(["lang", "gram"], ignore_index=True))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def calibrate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for p in parts:
            n, h = m.entropies(p["text"].tolist())
            own = h[np.arange(len(p)), [m.languages.index(x) for x in p["lang"]]]
            yield pd.DataFrame({"lang": p["lang"], "n": n, "h": own})[n > 0]

    limits = dealt.where("later").mapInPandas(calibrate, "lang string, n long, h double").groupBy("lang").agg((F.sum(F.col("n") * F.col("h")) / F.sum("n")).alias("mean"), F.collect_list(F.struct("n", "h")).alias("all")).collect()
    model.mean, model.deviation = np.full(len(model.languages), 3.0), np.ones(len(model.languages))  # of a language with one document
    for r in limits:
        j = model.languages.index(r["lang"])
        model.mean[j] = r["mean"]
        model.deviation[j] = max(0.5, np.sqrt(np.mean([x["n"] * (x["h"] - r["mean"]) ** 2 for x in r["all"]])))
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", to: str = "language") -> DataFrame:
    """docs with struct<lang, score, accepted>."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,score:double,accepted:boolean>")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            done, texts, size = [], [], 0
            for t in [x or "" for x in s]:  # some half a million characters at once
                texts.append(t)
                size += len(t)
                if size > 1 << 19:
                    done.append(shared.value.predict(texts))
                    texts, size = [], 0
            yield pd.concat([*done, *([shared.value.predict(texts)] if texts or not done else [])], ignore_index=True)
        give_back()

    return small_batches(docs).withColumn(to, predict(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = narrow(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.accepted").alias("accepted"))
