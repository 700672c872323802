"""Tables of the driver and expressions that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn("key", F.col("c_custkey").cast("string"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("key", F.col("p_partkey").cast("string"))


def r(x: str, n: int = 4) -> str:
    """The SQL of round_half_up."""
    return f"floor(({x})::DOUBLE * {10**n}.0 + 0.5) / {10**n}.0"


#: Candidate pairs of customers by nation and segment, scored: the flagship's first half, as SQL. Blocks over 200 are cut into
#: bands of like balances.
SCORED = f"""
measured AS (SELECT *, count(*) OVER w AS n0, min(c_acctbal) OVER w AS low, max(c_acctbal) OVER w AS high FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_mktsegment)),
banded AS (
  SELECT *, CASE WHEN n0 > 200 AND high > low AND c_acctbal IS NOT NULL
    THEN least(ceil(n0 * 2 / 200) - 1, floor((c_acctbal - low) / (high - low) * ceil(n0 * 2 / 200))) ELSE 0 END AS band FROM measured),
sized AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, band) AS n FROM banded),
pairs AS (
  SELECT CAST(a.c_custkey AS VARCHAR) AS k1, CAST(b.c_custkey AS VARCHAR) AS k2, a.c_name AS n1, b.c_name AS n2, a.c_acctbal AS b1, b.c_acctbal AS b2
  FROM sized a JOIN sized b
    ON a.c_nationkey IS NOT DISTINCT FROM b.c_nationkey AND a.c_mktsegment IS NOT DISTINCT FROM b.c_mktsegment AND a.band = b.band
    AND CAST(a.c_custkey AS VARCHAR) < CAST(b.c_custkey AS VARCHAR)
  WHERE a.n BETWEEN 2 AND 200 AND b.n BETWEEN 2 AND 200),
scored AS (
  SELECT k1 AS doc1_key, k2 AS doc2_key,
    {r("0.7 * (1.0 - levenshtein(upper(n1), upper(n2))::DOUBLE / greatest(length(n1), length(n2))) + 0.3 * (1.0 - least(1.0, abs(b1 - b2) / 11000.0))")} AS score
  FROM pairs)
"""
#: Its matches as edges, and their components by the smallest label reached.
COMPONENTS = """
e AS (SELECT doc1_key AS src, doc2_key AS dst, score AS similarity FROM scored WHERE score >= 0.9),
both_ways AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
members AS (SELECT min(other) AS cluster_id, node AS member_key FROM reach GROUP BY node)
"""


#: How customers are blocked.
BLOCKS = {"by": {"nation": "c_nationkey", "segment": "c_mktsegment"}, "max_size": 200, "split": "c_acctbal"}


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.blocking import block_collect

    return block_collect(customers(spark, sf_dir), "key", **BLOCKS)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc1_key, doc2_key, score): name by Levenshtein, balance by closeness."""
    from ..functions.expressions import round_half_up
    from ..functions.similarity import levenshtein
    from ..operators.scoring import with_documents

    met = with_documents(candidates(spark, sf_dir).select("doc1_key", "doc2_key"), customers(spark, sf_dir), "key", ["c_name", "c_acctbal"])
    name = levenshtein(F.upper("a.c_name"), F.upper("b.c_name"))
    close = 1.0 - F.least(F.lit(1.0), F.abs(F.col("a.c_acctbal") - F.col("b.c_acctbal")) / 11000.0)
    return met.select("doc1_key", "doc2_key", round_half_up(name * 0.7 + close * 0.3).alias("score"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.edges import make_edges
    from ..scratch import materialise

    return materialise(make_edges(scored(spark, sf_dir).where("score >= 0.9"), "weighted"), "edges")  # several queries read it twice


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.clusters import cluster

    return cluster(edges(spark, sf_dir))
