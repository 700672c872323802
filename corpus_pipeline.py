"""The corpus pipeline: language ID, near-duplicate removal, decontamination, source mixing and token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

In every stage null and empty texts, texts of any length, null or repeated ids, repeated rows and extra columns are handled
as its operator's module states; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import decontaminate, language, mixing, similar, tokens
from weftline.scratch import leaving, materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go: without letters, or in no language that was learned."""
    found = language.identify(docs, language.train(docs), to="_language")
    return found.where("_language.accepted").select(docs.columns)


#: Ids up to this number (of 8 bytes) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts stays: one with the smallest doc_id. SimHash groups are searched for texts with a 5-word
    shingle similarity of 0.8 or more; such texts that are further apart than its radius are found by MinHash."""
    found = materialise(similar.near_duplicates(docs), "near")
    if found.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        gone = materialise(found.where("doc_id <> component").select("doc_id"), "gone")
        return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(docs.columns)
    # ids that repeat or are null don't tell rows apart: go by shingle set as well
    best = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp")).alias("b")).select(F.col("b.doc_id").alias("_id"), F.col("b.fp").alias("_best"))
    marked = similar.with_id(docs, to="_s").withColumn("_fp", F.col("_s.id"))
    kept = marked.join(best, marked["doc_id"].eqNullSafe(best["_id"]) & (marked["_fp"] == best["_best"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_fp"]).select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    indexes = decontaminate.build(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.with_leaks(docs, indexes, to="_leaks").where(F.size("_leaks") == 0).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, in whole copies: not at all, once or twice.

    Where the mix takes part of a copy, parts add up along the source's cut documents, longest first, and a copy is taken
    when the sum passes the next half. The sum is never off by more than half a copy, so a source's copies are within half
    of its longest cut document of the words that the mix takes. A cell cuts at most two documents, so a source has few."""
    mixed = materialise(mixing.mix(docs, keep=True).withColumns({"_whole": F.expr("coalesce(taken div nullif(size, 0), 0)"), "_part": F.expr("coalesce(taken % nullif(size, 0), 0)")}), "mixed")
    whole, cut = mixed.where("_part = 0"), mixed.where("_part > 0")
    unit = 1 << 30  # parts as integers: sums don't depend on the order of additions
    along = Window.partitionBy("row.source").orderBy(F.col("size").desc(), F.xxhash64("row.doc_id", "row.text"), "taken")
    sums = along.rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumn("_share", F.expr(f"_part * {unit}L div size")).withColumn("_sum", F.sum("_share").over(sums))
    passed = lambda c: F.floor((c + unit // 2) / unit)
    cut = cut.withColumn("_whole", F.col("_whole") + passed(F.col("_sum")) - passed(F.col("_sum") - F.col("_share")))
    every = whole.select("row", "_whole").union(cut.select("row", "_whole"))
    return every.select("row", F.explode(F.array_repeat(F.lit(1), F.col("_whole").cast("int")))).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix in checksummed blocks, and each document's place in them."""
    tokenizer = tokens.default_tokenizer()
    return tokens.read(tokens.write(docs, tokenizer), tokenizer).withColumnRenamed("key", "doc_id")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Models, hashes and tokenizers are beyond SQL; the tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with leaving(1):  # what a stage has written on its way goes when its result is there
            docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
