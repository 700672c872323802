"""Blocking: candidate pairs (doc1_key < doc2_key, once each) from records that share something.

A block's size is counted first and blocks outside the size band are left out before any pair is made, so pairs grow with
the number of records times the cap. Null keys form a block like any value, unless a filter takes them out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.expressions import canonical_pair, round_half_up
from ..scratch import materialise
from .predicates import apply_filters, computed, predicate
from .ranking import global_rank
from .search import bm25_top


def _sized(made: DataFrame, by: list[str], **measures: Column) -> DataFrame:
    """made with what is measured of each block."""
    size = made.groupBy(*by).agg(*[c.alias(n) for n, c in measures.items()]).withColumnsRenamed({c: f"_size_{c}" for c in by})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_size_{c}")) for c in by])
    return made.join(size, same).drop(*[f"_size_{c}" for c in by])


def _split(made: DataFrame, by: list[str], max_size: int) -> DataFrame:
    """made (with a number, _split) with ``band``: blocks over max_size are cut into bands of equal width of that number, as many
    as give bands of half that size on average; other blocks, and rows without the number, are in band 0."""
    at = F.col("_split")
    cut = _sized(made, by, _n=F.count(F.lit(1)), _low=F.min(at), _high=F.max(at))
    bands = F.ceil(F.col("_n") * 2 / F.lit(max_size))
    band = F.least(bands - 1, F.floor((at - F.col("_low")) / (F.col("_high") - F.col("_low")) * bands))
    wide = (F.col("_n") > max_size) & (F.col("_high") > F.col("_low")) & at.isNotNull()
    return cut.withColumn("band", F.when(wide, band).otherwise(F.lit(0)).cast("long")).drop("_n", "_low", "_high", "_split")


def _members(df: DataFrame, key: str | None, by: dict[str, str | Column], filters: dict | None, exclude: dict[str, list] | None, max_size: int | None, split: str | Column | None) -> tuple[DataFrame, list[str]]:
    """Rows (key, block keys) before sizes are looked at, and the names of all block keys."""
    made = apply_filters(df, filters).select(*([F.col(key).cast("string").alias("_key")] if key else []), *[computed(c).alias(n) for n, c in by.items()], *([computed(split).cast("double").alias("_split")] if split is not None else []))
    made = made.where("_key <> ''") if key else made
    for name, values in (exclude or {}).items():
        made = made.where(predicate(name, {"not_in": values}))
    made = made.distinct() if key else made
    if split is None or max_size is None:
        return made.drop("_split"), [*by]
    return _split(made, [*by], max_size), [*by, "band"]


def blocks(df: DataFrame, key: str, by: dict[str, str | Column], filters: dict | None = None, exclude: dict[str, list] | None = None, min_size: int = 2, max_size: int | None = 100, split: str | Column | None = None) -> DataFrame:
    """(key, block keys, block_size) of the records whose block's size is in the band.

    A block over max_size is left out, and ``skipped_blocks`` names it. With ``split``, a number of the record, it is cut into
    bands of like numbers first (a further block key, ``band``), so that a cap that suits small tables doesn't empty large ones."""
    made, names = _members(df, key, by, filters, exclude, max_size, split)
    sized = _sized(made, names, block_size=F.count(F.lit(1))).where(F.col("block_size") >= min_size)
    return sized if max_size is None else sized.where(F.col("block_size") <= max_size)


def skipped_blocks(df: DataFrame, by: dict[str, str | Column], max_size: int, top: int | None = None, filters: dict | None = None, split: str | Column | None = None) -> DataFrame:
    """The blocks that a cap leaves out, largest first."""
    made, names = _members(df, None, by, filters, None, max_size, split)
    size = made.groupBy(*names).agg(F.count(F.lit(1)).alias("block_size"))
    size = size.where(F.col("block_size") > max_size).orderBy(F.desc("block_size"), *names)
    return size.limit(top) if top else size


def block_pairs(members: DataFrame, by: list[str], method: str) -> DataFrame:
    """All pairs within blocks."""
    a, b = members.alias("a"), members.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by])
    keys = F.create_map(*[x for c in by for x in (F.lit(c), F.col(f"a.{c}").cast("string"))])
    found = a.join(b, same & (F.col("a._key") < F.col("b._key")))
    return found.select(F.col("a._key").alias("doc1_key"), F.col("b._key").alias("doc2_key"), F.lit(method).alias("method"), F.col("a.block_size").alias("block_size"), keys.alias("blocking_keys"))


def block_collect(df: DataFrame, key: str, by: dict[str, str | Column], method: str = "collect_blocking", **band) -> DataFrame:
    """Pairs of records with equal composite keys. band: the settings of ``blocks``."""
    found = blocks(df, key, by, **band)
    return block_pairs(found, [c for c in found.columns if c not in ("_key", "block_size")], method)


def block_scored(df: DataFrame, key: str, by: list[str], fields: list[str], scores: dict[str, Column], spread: int = 256) -> DataFrame:
    """(doc1_key, doc2_key, scores) of all pairs in blocks of equal values, none of them null, without a cap. scores read a.<field> and
    b.<field>. A block's records with equal fields are a class: scores are taken once for each two classes, in both orders, and
    pairs come from the classes' sorted keys in the same task. Only records are shuffled, never pairs."""
    made = df.select(F.col(key).cast("string").alias("_key"), *[F.col(c).alias(f"_by{n}") for n, c in enumerate(by)], *fields)
    names = [f"_by{n}" for n in range(len(by))]
    made = made.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in ("_key", *names)]))
    classes = made.groupBy(*names, *fields).agg(F.array_sort(F.collect_list("_key")).alias("_keys"))
    classes = classes.select(*names, F.struct(*fields).alias("_d"), "_keys").repartition(spread, *names)
    a, b = (classes.select(*names, F.col("_d").alias(x), F.col("_keys").alias(f"_{x}")) for x in "ab")
    met = a.join(b.hint("shuffle_hash"), names).select("_a", "_b", *[c.alias(n) for n, c in scores.items()])
    met = met.where(F.col("_a")[0] < F.element_at("_b", -1))
    one = met.select(F.explode("_a").alias("doc1_key"), "_b", *scores)
    return one.select("doc1_key", F.explode("_b").alias("doc2_key"), *scores).where("doc1_key < doc2_key")


def block_exact(df: DataFrame, key: str, field: str, drop: tuple[str, ...] = ("", "0")) -> DataFrame:
    return block_collect(df, key, {field: field}, "exact", filters={field: {"not_null": True, "not_in": list(drop)}}, max_size=None)


def name_key(c: str | Column, letters: int = 3) -> Column:
    """First letters and half the length."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.upper(F.substring(c, 1, letters)), F.lit("_"), F.floor(F.length(c) / 2).cast("string"))


def block_ngram(df: DataFrame, key: str, field: str, max_size: int | None = 100) -> DataFrame:
    return block_collect(df, key, {"ngram": name_key(field)}, "ngram", filters={field: {"not_null": True, "min_length": 1}}, max_size=max_size)


def block_phonetic(df: DataFrame, key: str, field: str | Column, code=F.soundex, max_size: int | None = 100) -> DataFrame:
    c = F.col(field) if isinstance(field, str) else field
    return block_collect(df.where(c.isNotNull()), key, {"phonetic": code(c)}, "phonetic", max_size=max_size)


def block_sorted_neighborhood(df: DataFrame, key: str, order: Column, window: int = 3, partition: Column | None = None) -> DataFrame:
    """Records within ``window`` ranks of each other in sort order. With a partition, order and ranks are within it; without,
    a global rank is made from sorted ranges, so that no task sees all records."""
    rows = df.select(F.col(key).cast("string").alias("_key"), F.coalesce(order.cast("string"), F.lit("")).alias("_o"), (partition if partition is not None else F.lit(0)).alias("_p"))
    if partition is None:
        ranked = global_rank(rows, ["_o", "_key"], "_rank")
    else:
        ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_p").orderBy("_o", "_key")))
    ranked = ranked.select("_key", "_p", "_rank")
    later = ranked.select(F.col("_key").alias("k2"), F.col("_p").alias("p2"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(window)), lambda d: F.col("_rank") - d)).alias("r"), F.col("_rank").alias("r2"))
    met = ranked.join(later, (ranked["_rank"] == later["r"]) & ranked["_p"].eqNullSafe(later["p2"]))
    one, two = canonical_pair("_key", "k2")
    return met.select(one.alias("doc1_key"), two.alias("doc2_key"), F.lit("sorted_neighborhood").alias("method"), (F.col("r2") - F.col("_rank")).cast("int").alias("distance")).where("doc1_key <> doc2_key")


def block_geographic(df: DataFrame, key: str, kind: str, state: str | None = None, city: str | None = None, zip_code: str | None = None, zip_ranges: list[tuple[str, str]] | None = None, min_size: int = 2, max_size: int | None = 1000) -> DataFrame:
    """kind: state, city, city_state, zip_prefix (first three digits), or zip_range: equal codes of records whose code's prefix lies in
    one of the ranges."""
    code = F.col(zip_code).cast("string") if zip_code else None
    by = {"state": {"state": state}, "city": {"city": city}, "city_state": {"city": city, "state": state}, "zip_prefix": {"zip_prefix": zip_code}, "zip_range": {"zip": zip_code}}[kind]
    by = {n: F.substring(code, 1, 3) if n == "zip_prefix" else F.col(c).cast("string") for n, c in by.items()}
    if kind == "zip_range":
        df = df.where(reduce(lambda a, b: a | b, [(F.substring(code, 1, len(low)) >= low) & (F.substring(code, 1, len(high)) <= high) for low, high in zip_ranges or []], F.lit(False)))
    keyed = df.select(F.col(key), *[c.alias(n) for n, c in by.items()]).where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() & (F.col(n) != "") for n in by]))
    return block_collect(keyed, key, {n: n for n in by}, f"geographic_{kind}", min_size=min_size, max_size=max_size)


def block_graph(edges: DataFrame, src: str = "src", dst: str = "dst", direction: str = "any", min_size: int = 2, max_size: int | None = 100) -> DataFrame:
    """Records that share a neighbour. outbound: sources of the same target; inbound: targets of the same source; any: both.
    Parallel edges count once."""
    one, other = edges.select(F.col(src).alias("e"), F.col(dst).alias("node")), edges.select(F.col(dst).alias("e"), F.col(src).alias("node"))
    ends = {"outbound": one, "inbound": other, "any": one.union(other)}[direction]
    return block_collect(ends, "e", {"shared_node": "node"}, "graph_traversal", min_size=min_size, max_size=max_size)


def _words(df: DataFrame, key: str, text: str | Column, same: str | None) -> DataFrame:
    """(doc, same, w): w the lower-case runs of ASCII letters and digits in order; same is never null."""
    c = F.col(text) if isinstance(text, str) else text
    group = F.coalesce(F.concat(F.lit("="), F.col(same).cast("string")), F.lit("")) if same else F.lit("")
    return df.select(F.col(key).cast("string").alias("doc"), group.alias("same"), F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))


def postings(df: DataFrame, key: str, text: str | Column, same: str | None = None) -> DataFrame:
    """(doc, same, token, tf, doc_len) of ``_words``."""
    words = _words(df, key, text, same)
    return words.select("doc", "same", F.size("w").alias("doc_len"), F.explode("w").alias("token")).groupBy("doc", "same", "token", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def bm25_frequencies(documents: DataFrame) -> tuple[int, float, DataFrame]:
    """Of postings: how many documents, their mean length, and (token, df)."""
    n, avg_len = documents.select("doc", "doc_len").distinct().agg(F.count(F.lit(1)), F.avg("doc_len")).first()
    return n, avg_len, documents.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def bm25_scores(queries: DataFrame, documents: DataFrame, k1: float = 1.2, b: float = 0.75, over: float = 0.0, weights: tuple[int, float, DataFrame] | None = None) -> DataFrame:
    """(d1, d2, bm25) of postings of queries against postings of documents of the same group; each query token counts once. Of scores
    over ``over`` all are listed, and others may be left out. weights: frequencies of a larger collection than documents.

    Postings meet by token, and very common tokens would bring nearly all documents together. So a query's tokens are taken from
    the least weight up, by the most that a token adds to any document, as long as these sum up to half of ``over`` at most.
    The tokens beyond are met first; only pairs that the others can still lift over ``over`` are met by them too."""
    n, avg_len, df = weights or bm25_frequencies(documents)
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.lit(avg_len)))
    weighted = documents.join(df, "token").select("token", "same", F.col("doc").alias("d2"), (idf * tf).alias("w"))
    asked = queries.select(F.col("doc").alias("d1"), "same", "token")
    if over <= 0:
        return asked.join(weighted, ["token", "same"]).where("d1 <> d2").groupBy("d1", "d2").agg(F.sum("w").alias("bm25"))
    weighted = materialise(weighted, "weights")
    most = weighted.groupBy("token").agg(F.max("w").alias("most"))
    rising = Window.partitionBy("d1").orderBy("most", "token").rowsBetween(Window.unboundedPreceding, 0)
    asked = materialise(asked.join(most, "token").withColumn("sum", F.sum("most").over(rising)), "asked")
    few = F.col("sum") <= over / 2
    common = asked.where(few).groupBy("d1").agg(F.max("sum").alias("left"))
    met = asked.where(~few).select("d1", "same", "token").join(weighted, ["token", "same"]).where("d1 <> d2").groupBy("d1", "d2").agg(F.sum("w").alias("first"))
    met = materialise(met.join(common, "d1", "left").where(F.col("first") + F.coalesce("left", F.lit(0.0)) > over - 1e-9).select("d1", "d2", "first"), "met")
    rest = met.select("d1", "d2").join(asked.where(few).select("d1", "token"), "d1").join(weighted.drop("same"), ["token", "d2"]).groupBy("d1", "d2").agg(F.sum("w").alias("rest"))
    scored = met.join(rest, ["d1", "d2"], "left").select("d1", "d2", (F.col("first") + F.coalesce("rest", F.lit(0.0))).alias("bm25"))
    return scored.where(F.col("bm25") > over)


def top_k(scored: DataFrame, by: str, score: str, k: int, tie: str) -> DataFrame:
    """Each group's k best rows."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def block_bm25(df: DataFrame, key: str, text: str | Column, threshold: float = 2.0, limit: int = 20, same: str | None = None) -> DataFrame:
    """Directed top-k: for each record the others, of equal ``same`` if named, that its tokens rank highest; (d1, d2, bm25, rank). Both directions may occur;
    ``orchestrate`` makes pairs of them."""
    found = bm25_top(_words(df, key, text, same), threshold, limit)
    return top_k(found, "d1", "bm25", limit, "d2")


def block_hybrid(df: DataFrame, key: str, text: str, bm25_threshold: float = 2.0, levenshtein_threshold: float = 0.5, bm25_weight: float = 0.2, limit: int = 20) -> DataFrame:
    """BM25 candidates rescored with Levenshtein similarity: bm25 * w + lev * (1 - w), both thresholds, top k; d1 < d2."""
    post = postings(df, key, text)
    own = df.select(F.col(key).cast("string").alias("k"), F.upper(F.trim(F.coalesce(F.col(text), F.lit("")))).alias("t"))
    found = bm25_scores(post, post, over=bm25_threshold).withColumn("bm25", round_half_up("bm25", 6)).where((F.col("bm25") > bm25_threshold) & (F.col("d1") < F.col("d2")))
    found = found.join(own.select(F.col("k").alias("d1"), F.col("t").alias("t1")), "d1").join(own.select(F.col("k").alias("d2"), F.col("t").alias("t2")), "d2")
    found = found.withColumn("lev", S.levenshtein("t1", "t2", 0.0)).where(F.col("lev") >= levenshtein_threshold)
    return top_k(found.withColumn("combined", F.col("bm25") * bm25_weight + F.col("lev") * (1 - bm25_weight)), "d1", "combined", limit, "d2").drop("t1", "t2")


def _signs(df: DataFrame, vector: str, key: str, tables: int, bits: int, seed: int, dim: int) -> DataFrame:
    """(_key, v, table, bucket): v normalised; one bucket per hash table from the signs of random projections."""
    planes = np.random.RandomState(seed).randn(tables * bits, dim)

    @F.pandas_udf("array<long>")
    def codes(s):
        import pandas as pd

        x = np.stack([np.asarray(v, np.float64) for v in s])
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        on = (x @ planes.T >= 0).reshape(len(x), tables, bits)
        return pd.Series(list((on * (1 << np.arange(bits))).sum(axis=2)))

    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) == dim)).select(F.col(key).cast("string").alias("_key"), F.col(vector).alias("v"))
    return rows.select("_key", "v", F.posexplode(codes("v")).alias("table", "bucket"))


def block_lsh(df: DataFrame, key: str, vector: str, dim: int, tables: int = 10, bits: int = 8, seed: int = 42, same: str | None = None, threshold: float | None = None) -> DataFrame:
    """Pairs that share a bucket of random hyperplane signs in some table; the first such table is kept. With a threshold, only
    pairs of at least that cosine similarity, which is added. Buckets grow with the records over 2^bits: more records want more
    bits, and more tables then."""
    coded = _signs(df, vector, key, tables, bits, seed, dim).drop("v")
    if same:
        coded = coded.join(df.select(F.col(key).cast("string").alias("_key"), F.col(same).alias("same")), "_key")
    else:
        coded = coded.withColumn("same", F.lit(0))
    a, b = coded.alias("a"), coded.alias("b")
    met = a.join(b, (F.col("a.table") == F.col("b.table")) & (F.col("a.bucket") == F.col("b.bucket")) & F.col("a.same").eqNullSafe(F.col("b.same")) & (F.col("a._key") < F.col("b._key")))
    found = met.groupBy(F.col("a._key").alias("doc1_key"), F.col("b._key").alias("doc2_key")).agg(F.min("a.table").alias("table"))
    if threshold is None:
        return found
    own = df.select(F.col(key).cast("string").alias("k"), F.col(vector).alias("v"))
    found = found.join(own.select(F.col("k").alias("doc1_key"), F.col("v").alias("v1")), "doc1_key").join(own.select(F.col("k").alias("doc2_key"), F.col("v").alias("v2")), "doc2_key")
    return found.withColumn("similarity", S.cosine("v1", "v2")).where(F.col("similarity") >= threshold).drop("v1", "v2")


def cosine_pairs(df: DataFrame, key: str, vector: str, same: str, block: int = 1000) -> DataFrame:
    """(a, b, cosine), a < b: the cosine of all pairs of equal ``same``, which isn't null, as products of matrices of some ``block``
    vectors a side; 0 where a vector has no length, null where there is none."""
    most = df.where(F.col(same).isNotNull()).groupBy(same).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    n = -(-most // block)
    rows = df.where(F.col(same).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"), F.col(same).alias("s"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("b"))
    cells = F.expr(f"transform(sequence(0, {n - 1}), x -> struct(least(b, x) as i, greatest(b, x) as j))")
    dealt = rows.select("k", "v", "s", "b", F.explode(cells).alias("g")).select("k", "v", "s", "b", "g.i", "g.j")
    kind = df.schema[key].dataType.simpleString()

    def meet(t):
        import pyarrow as pa
        import pyarrow.compute  # noqa: F401

        keys, at = t["k"].combine_chunks(), t["b"].to_numpy()
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        order = np.argsort(keys.to_numpy(zero_copy_only=False), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        vectors = t["v"].combine_chunks()
        known = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
        flat = vectors.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = np.full((len(at), len(flat) // max(1, len(known))), np.nan)
        x[known] = flat.reshape(len(known), -1)
        size = np.sqrt((x * x).sum(axis=1))
        x = x / np.where(size == 0, 1.0, size)[:, None]
        one, two = np.flatnonzero(at == i), np.flatnonzero(at == j)
        p, q = (z.ravel() for z in np.meshgrid(one, two, indexing="ij"))
        cosine = (x[one] @ x[two].T).ravel()
        first = rank[p] < rank[q]
        if i == j:
            p, q, cosine = p[first], q[first], cosine[first]
        else:
            p, q = np.where(first, p, q), np.where(first, q, p)
        a, b = keys.take(pa.array(p)), keys.take(pa.array(q))
        found = pa.table({"a": a, "b": b, "cosine": pa.array(cosine, mask=np.isnan(cosine))})
        return found.filter(pa.compute.not_equal(a, b))

    return dealt.groupBy("s", "i", "j").applyInArrow(meet, f"a {kind}, b {kind}, cosine double")


def block_vector(df: DataFrame, key: str, vector: str, threshold: float = 0.7, limit: int | None = 20, same: str | None = None, block: int = 2000) -> DataFrame:
    """Pairs with cosine similarity at or over the threshold, exactly: normalised vectors meet block by block, as matrix products
    of some ``block`` vectors a side. With ``limit``, each record keeps its best. (doc1_key, doc2_key, similarity). The work grows
    with the square of the vectors; ``nearest`` looks them up in an index instead."""
    blocks_ = max(1, -(-df.where(F.col(vector).isNotNull()).count() // block))
    unit = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(vector).cast("array<double>").alias("v"), (F.col(same).cast("string") if same else F.lit("")).alias("s"))
    part = unit.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks_)).cast("int"))
    # record block i meets blocks i..n: each pair of blocks is one group
    left = part.select("k", "v", "s", F.explode(F.expr(f"transform(sequence(0, {blocks_ - 1}), x -> struct(least(b, x) as i, greatest(b, x) as j))")).alias("g"), "b").select("k", "v", "s", "b", "g.i", "g.j")

    def meet(pdf):
        import pandas as pd

        x = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, 1))
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        a, b = np.flatnonzero(pdf["b"].to_numpy() == i), np.flatnonzero(pdf["b"].to_numpy() == j)
        k, s = pdf["k"].to_numpy(), pdf["s"].to_numpy()
        out = []
        for lo in range(0, len(a), 1024):
            sim = x[a[lo : lo + 1024]] @ x[b].T
            p, q = np.nonzero(sim >= threshold)
            one, two = a[lo + p], b[q]
            fine = (k[one] < k[two]) if i == j else np.ones(len(p), bool)
            fine &= s[one] == s[two]
            out.append(pd.DataFrame({"x": k[one[fine]], "y": k[two[fine]], "similarity": sim[p[fine], q[fine]]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"x": np.zeros(0, object), "y": np.zeros(0, object), "similarity": np.zeros(0)})

    one, two = canonical_pair("x", "y")
    found = left.groupBy("i", "j").applyInPandas(meet, "x string, y string, similarity double").select(one.alias("doc1_key"), two.alias("doc2_key"), "similarity")
    if limit is None:
        return found
    both = found.select(F.col("doc1_key").alias("d1"), F.col("doc2_key").alias("d2"), "similarity").union(found.select("doc2_key", "doc1_key", "similarity"))
    one, two = canonical_pair("d1", "d2")
    return top_k(both, "d1", "similarity", limit, "d2").select(one.alias("doc1_key"), two.alias("doc2_key"), "similarity").distinct()


def ann_query(df: DataFrame, key: str, vector: str, query: list[float], threshold: float = 0.7, limit: int = 20, filters: dict | None = None, exclude: str | None = None) -> DataFrame:
    """The records nearest to one vector, filtered before the cut."""
    rows = apply_filters(df.where(F.col(vector).isNotNull()), filters)
    q = F.array(*[F.lit(float(x)) for x in query])
    found = rows.select(F.col(key).cast("string").alias("key"), S.cosine(vector, q).alias("similarity")).where(F.col("similarity") >= threshold)
    found = found if exclude is None else found.where(F.col("key") != exclude)
    return found.orderBy(F.desc("similarity"), "key").limit(limit)


def embeddings_coverage(df: DataFrame, vector: str) -> DataFrame:
    has = F.col(vector).isNotNull() & (F.size(vector) > 0)
    n = F.count(F.lit(1))
    return df.agg(n.alias("total"), F.count(F.when(has, 1)).alias("with_vector"), (n - F.count(F.when(has, 1))).alias("without_vector"), F.max(F.when(has, F.size(vector))).cast("long").alias("dimension"))


def block_address(df: DataFrame, key: str, street: str | Column, city: str | Column, state: str | Column, postal: str | Column, max_size: int | None = 100, case_fix: bool = True) -> DataFrame:
    """Pairs with equal street, city, state and five-digit code. case_fix=False strips lower-case letters before upper-casing, as
    some older keys do."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    strip = lambda x: F.regexp_replace(x, r"[^A-Z0-9\s]", "")
    s = strip(F.upper(c(street))) if case_fix else F.upper(strip(c(street)))
    part = lambda x: F.upper(F.trim(c(x)))
    by = {"address": F.concat_ws("|", F.trim(F.regexp_replace(s, r"\s+", " ")), part(city), part(state), F.substring(c(postal), 1, 5))}
    return block_collect(df, key, by, "address", max_size=max_size)


def prefix_candidates(records: DataFrame, base: DataFrame, key: str, fields: list[str], n: int = 3) -> DataFrame:
    """(new_key, base_key): base records that share a lower-case prefix in some field; one equi-join a field. A record without any
    value has no candidates: it could not score over 0 with any."""
    prefix = lambda c: F.lower(F.substring(F.col(c).cast("string"), 1, n))
    found = []
    for f in fields:
        a = records.select(F.col(key).cast("string").alias("new_key"), prefix(f).alias("p")).where("p <> ''")
        found.append(a.join(base.select(F.col(key).cast("string").alias("base_key"), prefix(f).alias("p")), "p").select("new_key", "base_key"))
    return reduce(lambda a, b: a.union(b), found).where("new_key <> base_key").distinct()


def orchestrate(candidates: dict[str, DataFrame], mode: str = "union") -> DataFrame:
    """Canonical pairs of several strategies, with the names of those that found them; union or intersection."""
    one, two = canonical_pair("doc1_key", "doc2_key")
    tagged = [df.select(one.alias("doc1_key"), two.alias("doc2_key"), F.lit(name).alias("s")) for name, df in candidates.items()]
    pairs = reduce(lambda a, b: a.union(b), tagged).where("doc1_key <> doc2_key and doc1_key <> ''")
    merged = pairs.groupBy("doc1_key", "doc2_key").agg(F.array_sort(F.collect_set("s")).alias("sources"))
    if mode == "intersection":
        return merged.where(F.size("sources") == len(candidates))
    if mode != "union":
        raise ValueError(f"merge mode {mode!r}; known: union, intersection")
    return merged


def unresolved(df: DataFrame, key: str, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Records at no edge's end."""
    ends = edges.select(F.explode(F.array(src, dst)).alias("_end")).distinct()
    return df.join(ends, df[key].cast("string") == ends["_end"], "left_anti")


def block_stats(pairs: DataFrame, score: str | None = None) -> DataFrame:
    more = [F.avg(score).alias("avg_score"), F.max(score).alias("max_score")] if score else []
    return pairs.agg(F.count(F.lit(1)).alias("total_pairs"), *more)
