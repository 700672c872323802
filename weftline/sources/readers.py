"""Readers that give records with a string _key, and truth tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluation import parse_boolean, truth_pairs


def collection(spark: SparkSession, path: str, key: str | None = None, columns: list[str] | None = None, form: str = "parquet") -> DataFrame:
    """A table by path; with key, also as string _key. Only the columns named are read."""
    df = spark.read.format(form).load(path)
    df = df.withColumn("_key", F.col(key).cast("string")) if key else df
    return df.select(*(["_key"] if key else []), *columns) if columns else df


def json_records(spark: SparkSession, path: str, wrappers: tuple[str, ...] = ("customers", "data", "records")) -> DataFrame:
    """Records of a JSON file: a list, an object with a list under one of the wrappers, or a single object."""
    df = spark.read.option("multiLine", True).json(path)
    for w in wrappers:
        if w in df.columns and df.schema[w].dataType.typeName() == "array":
            return df.select(F.explode(w).alias("r")).select("r.*")
    return df


def delimited(spark: SparkSession, path: str, sep: str = "\t", header: list[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """Text columns of a delimited file; malformed rows are dropped. header: names, if the file has none."""
    reader = spark.read.option("sep", sep).option("encoding", encoding).option("mode", "DROPMALFORMED").option("multiLine", False)
    if header:
        return reader.schema(", ".join(f"`{h}` string" for h in header)).csv(path)
    return reader.option("header", True).csv(path)


def from_pandas(spark: SparkSession, pdf) -> DataFrame:
    return spark.createDataFrame(pdf)


def truth(df: DataFrame) -> DataFrame:
    """True pairs of a table with _from and _to, id_a and id_b, or record_a_id, record_b_id and is_match."""
    for a, b in (("_from", "_to"), ("id_a", "id_b"), ("record_a_id", "record_b_id")):
        if a in df.columns and b in df.columns:
            rows = df.where(parse_boolean(F.col("is_match"))) if "is_match" in df.columns else df
            return truth_pairs(rows, a, b)
    raise ValueError(f"no pair of id columns among {df.columns}")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Truth from JSON (a list, or under pairs) or CSV."""
    df = json_records(spark, path, ("pairs",)) if path.rstrip("/").endswith(".json") else spark.read.option("header", True).csv(path)
    return truth(df)


def linkage_table(df: DataFrame, source: str, key: str, title: str, body: list[str]) -> DataFrame:
    """df with _key (source_key), source_id, _source, title, body and text: the columns of a record-linkage benchmark."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    made = {"_key": F.concat(F.lit(f"{source}_"), F.col(key).cast("string")), "source_id": F.col(key).cast("string"), "_source": F.lit(source), "title": F.trim(blank(title)), "body": F.trim(F.concat_ws(" ", *[blank(c) for c in body]))}
    return df.withColumns(made).withColumn("text", F.trim(F.concat_ws(" ", "title", "body")))


def lookup(df: DataFrame, keys: DataFrame, columns: list[str], key: str = "_key") -> DataFrame:
    """The records with the given keys, with the named columns only."""
    return df.select(key, *columns).join(keys.select(key).distinct(), key, "left_semi")


def pending(df: DataFrame, done: DataFrame, key: str = "_key") -> DataFrame:
    """Records that the log of processed keys doesn't have."""
    return df.join(done.select(key), key, "left_anti")


def sample(df: DataFrame, n: int, key: str, seed: int | None = None) -> DataFrame:
    """n records: the first by key, or by a seeded digest of it."""
    return df.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string"))) if seed is not None else F.col(key), key).limit(n)


def tables(spark: SparkSession) -> list[tuple[str, int]]:
    """Names and counts of the catalogue's tables."""
    return [(t.name, spark.table(t.name).count()) for t in spark.catalog.listTables()]
