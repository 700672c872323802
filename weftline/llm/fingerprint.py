"""Document fingerprints: a canonical exact digest.

Canonical text: Unicode normal form KC, full case folding, runs of white space as one space, none at the ends. Its
digest is two 64-bit xxHash values under different seeds. Texts are grouped by digest; inside a digest that several
share, canonical texts are compared byte by byte (as the least and the greatest of the group), and a digest that
different texts share is told apart by a suffix. So fingerprints are equal exactly where canonical texts are: those of
documents, and, in ``compare_in_order``, those of documents and of their edits alike.

Likeness of two fingerprints is 1 where they are equal, else 0. Null texts are empty, and so equal to empty ones; texts of
any length are read whole. Documents with equal ids are ordered by digest, then by their place in the table; null ids come
last; repeated rows keep a row each. An empty table gives an empty one. Extra columns of any name stay in ``fingerprint``
(one called like the result is replaced) and aren't read by ``compare_in_order``.

Everything is DataFrame expressions; the Unicode work is done by the ICU library that Spark ships, through Spark SQL's
``reflect``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from .common import narrow, table

#: Tables of ids or digests (of about 40 bytes a row) are broadcast up to so many rows, and else joined by a shuffle.
BROADCAST_ROWS = 200_000


def canonical(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    icu = lambda cls, name, c: F.reflect(F.lit(cls), F.lit(name), c, F.lit(True))
    composed = icu("com.ibm.icu.text.Normalizer", "compose", icu("com.ibm.icu.lang.UCharacter", "foldCase", icu("com.ibm.icu.text.Normalizer", "compose", t)))
    plain = t.rlike(r"\A[\x00-\x7F]*\z")  # ASCII is in normal form
    return F.trim(F.regexp_replace(F.when(plain, F.lower(t)).otherwise(composed), r"[\s\x{85}\p{Z}]+", " "))


def wide_hash(c: Column) -> Column:
    """128 bits as 32 hex digits. Each argument of xxhash64 seeds the next: the salt stands first, so that the second half hashes
    the text anew instead of following from the first."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(c)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("wide"), c)), 16, "0")))


def _few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows. It should be a written table."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shared_digests(digests: DataFrame) -> DataFrame:
    """The digests that occur more than once."""
    return _few(materialise(digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "shared"))


def differing(texts: DataFrame) -> DataFrame:
    """The digests of texts (digest, canon) that different canonical texts have; none as a rule. Each task passes on two texts
    of a digest at most."""
    spread = texts.groupBy("digest").agg(F.min("canon").alias("a"), F.max("canon").alias("b"))
    return materialise(spread.where("a <> b").select("digest"), "differing")


def _apart(canon: Column) -> Column:
    """What is added to a digest that different texts share."""
    return F.concat(F.lit("-"), F.sha2(canon, 256))


def fingerprint(docs: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """docs with a string column: equal exactly where canonical texts are equal."""
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c != to]
    made = materialise(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), wide_hash(canonical(docs[text])).alias("digest")), "digests")
    canon = canonical(F.col(f"row.`{text}`"))
    odd = differing(made.join(shared_digests(made.select("digest")), "digest").select("digest", canon.alias("canon")))
    if odd.isEmpty():
        return made.select(*kept, F.col("digest").alias(to))
    marked = made.join(odd.withColumn("odd", F.lit(True)), "digest", "left")
    return marked.select(*kept, F.when(F.col("odd"), F.concat("digest", _apart(canon))).otherwise(F.col("digest")).alias(to))


def _bucket(bounds: list, kind: str, o: Column) -> Column:
    """How many of bounds (ascending) are not above o: a binary search in a constant array."""
    n = len(bounds)
    array = F.from_json(F.lit(json.dumps(bounds, default=str)), f"array<struct<named:boolean,key:{kind},digest:string>>")
    steps = [F.lit(1 << i) for i in range(n.bit_length() - 1, -1, -1)] or [F.lit(1)]
    at = F.aggregate(F.array(*steps), F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) <= o, at + step).otherwise(at))
    return at if n else F.lit(0)


def with_next(base: DataFrame, kind: str, per_bucket: int = 64, most_buckets: int = 8192) -> DataFrame:
    """base (uid, key, digest, text) with next_uid, next_digest, next_text of the document that comes after in descending order
    of keys; the last has the first's.

    Documents are dealt into sorted ranges by (key, digest), whose bounds come from a sample of about eight rows a range,
    chosen by hash. Each range is sorted alone; the first document of each is put once more at the end of the range before.
    So texts are shuffled once, and no task sees the whole order, whatever the keys."""
    n = base.count()
    buckets = min(most_buckets, n // per_bucket)
    o = F.struct(F.col("key").isNotNull().alias("named"), F.col("key").alias("key"), F.col("digest").alias("digest"))
    some = base.where(F.pmod(F.xxhash64("uid"), F.lit(1 << 20)) < int(min(1.0, 8 * buckets / max(1, n)) * (1 << 20)))
    drawn = [{"named": r["named"], "key": r["key"], "digest": r["digest"]} for r in some.select(o.alias("o")).orderBy("o").select("o.*").collect()] if buckets > 1 else []
    bounds = [drawn[len(drawn) * i // buckets] for i in range(1, buckets)] if drawn else []
    placed = base.withColumn("bucket", _bucket(bounds, kind, o))
    # one row a range: which document comes first in it, and which range gets that document at its end
    tops = placed.groupBy("bucket").agg(F.max(F.struct(F.col("key").isNotNull().alias("named"), "key", "digest", "uid"))["uid"].alias("top"))
    every = Window.partitionBy(F.lit(0))
    goals = materialise(tops.select("top", F.coalesce(F.lead("bucket").over(every.orderBy("bucket")), F.min("bucket").over(every)).alias("to")), "goals")
    edge = base.join(F.broadcast(goals), base["uid"] == goals["top"]).select("uid", "key", "digest", "text", F.col("to").alias("bucket"), F.lit(1).alias("edge"))
    rows = placed.select("uid", "key", "digest", "text", "bucket", F.lit(0).alias("edge")).union(edge)
    w = Window.partitionBy("bucket").orderBy("edge", F.col("key").desc_nulls_last(), F.desc("digest"), F.desc("uid"))
    return rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("uid", "digest", "text")}).where("edge = 0").drop("edge", "bucket")


def edit(text: Column, other: Column) -> Column:
    """The last half of text's code points, rounded down, replaced by the first as many (or all) of other."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def compare_in_order(docs: DataFrame, key: str = "doc_id", text: str = "text", per_bucket: int = 64) -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document.

    Texts are written once, with the digest of each, and shuffled once to meet the next; what follows reads digests only,
    but for the texts whose digest another text or edit has too."""
    kind = docs.schema[key].dataType.simpleString()
    plain = docs.select(docs[key].alias("key"), F.coalesce(docs[text], F.lit("")).alias("text"))
    base = materialise(plain.select("key", "text", wide_hash(canonical(F.col("text"))).alias("digest"), F.monotonically_increasing_id().alias("uid")), "digests")
    edited = with_next(base, kind, per_bucket).withColumn("edited", edit(F.col("text"), F.col("next_text")))
    marked = materialise(edited.select("uid", "key", "digest", "next_uid", "next_digest", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), wide_hash(canonical(F.col("edited"))).alias("edited_digest")), "marked")

    def texts(own: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(uid, digest, canon) of the documents and of the edits with the given digests."""
        originals = base.join(own, "digest").select("uid", "digest", canonical(F.col("text")).alias("canon"))
        pairs = _few(materialise(marked.join(edits.withColumnRenamed("digest", "edited_digest"), "edited_digest").select("uid", "next_uid", F.col("edited_digest").alias("digest")), "pairs"))
        first = base.select("uid", "text").join(pairs, "uid")
        other = base.select(F.col("uid").alias("next_uid"), F.col("text").alias("next_text")).join(pairs.select("next_uid").distinct(), "next_uid")
        return originals, first.join(other, "next_uid").select("uid", "digest", canonical(edit(F.col("text"), F.col("next_text"))).alias("canon"))

    shared = shared_digests(marked.select("digest").union(marked.select("edited_digest")))
    originals, edits = texts(shared, shared)
    odd = differing(originals.union(edits).select("digest", "canon"))
    named = marked.select("*", *[F.col(c).alias(f"{c}_fp") for c in ("digest", "edited_digest", "next_digest")])
    if not odd.isEmpty():
        originals, edits = (x.select("uid", F.concat("digest", _apart(F.col("canon"))).alias("fp")) for x in texts(odd, odd))
        for c, at, found in (("digest", "uid", originals), ("edited_digest", "uid", edits), ("next_digest", "next_uid", originals)):
            named = named.join(found.withColumnsRenamed({"uid": at}), at, "left").withColumn(f"{c}_fp", F.coalesce("fp", f"{c}_fp")).drop("fp")
    like = lambda a, b: F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)
    return named.select(
        F.col("key").alias(key),
        "n_chars",
        "edited_sha256",
        F.col("digest_fp").alias("fingerprint"),
        F.col("edited_digest_fp").alias("edited_fingerprint"),
        like("digest_fp", "edited_digest_fp").alias("near_edited"),
        like("digest_fp", "next_digest_fp").alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_in_order(narrow(table(spark, sf_dir, "documents"), "doc_id", "text"))
