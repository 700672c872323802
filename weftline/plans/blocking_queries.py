"""Filters, projections and blocking over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.expressions import round_half_up, within_days, within_km
from ..operators import blocking as B
from ..operators.predicates import apply_filters, computed, predicate
from ..sources import readers as R
from . import sql as Q
from .common import customers, parts, r, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def pairs_sql(table_: str, key: str, by: dict[str, str], method: str, low: int = 2, high: int | None = 100, where: str = "TRUE") -> str:
    """Pairs within blocks, as SQL."""
    cols = ", ".join(f"{e} AS {n}" for n, e in by.items())
    same = " AND ".join(f"a.{n} IS NOT DISTINCT FROM b.{n}" for n in by)
    band = f"n >= {low}" + (f" AND n <= {high}" if high else "")
    return f"""
WITH d AS (SELECT DISTINCT CAST({key} AS VARCHAR) AS k, {cols} FROM {table_} WHERE {where}),
s AS (SELECT *, count(*) OVER (PARTITION BY {", ".join(by)}) AS n FROM d),
m AS (SELECT * FROM s WHERE {band})
SELECT a.k AS doc1_key, b.k AS doc2_key, '{method}' AS method, a.n AS block_size FROM m a JOIN m b ON {same} AND a.k < b.k"""


def slim(df):
    return df.select("doc1_key", "doc2_key", "method", "block_size")


@query("scan_collection", "SELECT CAST(c_custkey AS VARCHAR) AS _key, c_name, c_nationkey FROM customer")
def _(spark, d):
    return R.collection(spark, f"{d}/customer.parquet", "c_custkey", ["c_name", "c_nationkey"])


@query("scan_limit", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10")
def _(spark, d):
    return R.sample(table(spark, d, "customer"), 10, "c_custkey").select("c_custkey", "c_name")


@query("random_sample", "SELECT c_custkey, c_name FROM customer ORDER BY md5('42' || c_custkey), c_custkey LIMIT 100")
def _(spark, d):
    return R.sample(table(spark, d, "customer"), 100, "c_custkey", seed=42).select("c_custkey", "c_name")


@query("key_lookup_batch", "SELECT CAST(c_custkey AS VARCHAR) AS _key, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def _(spark, d):
    keys = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").cast("string").alias("_key"))
    return R.lookup(customers(spark, d).withColumn("_key", F.col("key")), keys, ["c_name"])


@query("pending_scan", "SELECT CAST(c_custkey AS VARCHAR) AS _key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("_key")).distinct()
    return R.pending(customers(spark, d).select(F.col("key").alias("_key")), done)


@query("truth_source", "SELECT DISTINCT least(CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS doc1_key, greatest(CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS doc2_key FROM lineitem WHERE l_partkey <> l_suppkey")
def _(spark, d):
    return R.truth(table(spark, d, "lineitem").select(F.col("l_partkey").alias("id_a"), F.col("l_suppkey").alias("id_b")))


@query("filter_suite", """
SELECT c_custkey FROM customer WHERE c_mktsegment IS NOT NULL AND c_mktsegment IS DISTINCT FROM 'BUILDING' AND length(c_name) >= 5 AND length(c_name) <= 40
  AND contains(c_name, 'Customer') AND regexp_matches(c_name, '[0-9]*[13579]$') AND c_nationkey IN (1, 2, 3, 5, 8, 13)""")  # fmt: skip
def _(spark, d):
    rules = {"c_mktsegment": {"not_null": True, "not_equal": "BUILDING"}, "c_name": {"min_length": 5, "max_length": 40, "contains": "Customer", "regex": "[0-9]*[13579]$"}, "c_nationkey": {"in": [1, 2, 3, 5, 8, 13]}}
    return apply_filters(table(spark, d, "customer"), rules).select("c_custkey")


@query("filter_null_safe", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS status FROM orders WHERE (CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END) IS DISTINCT FROM 'O'")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"))
    return o.where(predicate("status", {"not_equal": "O"}))


@query("projection_metadata", "SELECT CAST(c_custkey AS VARCHAR) AS key, md5(upper(trim(c_name))) AS name_hash, left(c_name, 5) AS prefix FROM customer")
def _(spark, d):
    return customers(spark, d).select("key", F.md5(F.upper(F.trim("c_name"))).alias("name_hash"), computed("left(c_name, 5)").alias("prefix"))


@query("geo_filter", f"""
WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_custkey % 180) - 90.0 END AS lat, (c_custkey % 360) - 180.0 AS lon, (c_nationkey * 3) % 90 AS lat2, c_nationkey * 5.0 AS lon2 FROM customer),
h AS (SELECT *, 2 * 6371.0 * asin(sqrt(pow(sin((radians(lat2) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon) / 2), 2))) AS km FROM p)
SELECT c_custkey FROM h WHERE coalesce(km <= 5000.0, TRUE)""")  # fmt: skip
def _(spark, d):
    p = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") % 180) - 90.0).alias("lat"), ((F.col("c_custkey") % 360) - 180.0).alias("lon"), ((F.col("c_nationkey") * 3) % 90).alias("lat2"), (F.col("c_nationkey") * 5.0).alias("lon2"))
    return p.where(within_km("lat", "lon", "lat2", "lon2", 5000.0)).select("c_custkey")


@query("temporal_filter", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) <= 30")
def _(spark, d):
    met = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.where(within_days(F.to_date("o_orderdate").cast("string"), F.to_date("l_shipdate").cast("string"), 30)).select("l_orderkey", "l_linenumber")


@query("type_compatibility", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE (c_mktsegment = 'BUILDING' AND o_orderpriority LIKE '1%') OR (c_mktsegment = 'MACHINERY' AND o_orderpriority LIKE '2%') OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def _(spark, d):
    from ..operators.linkage import type_compatible

    met = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).withColumn("source_type", F.col("c_mktsegment")).withColumn("target_type", F.substring("o_orderpriority", 1, 1))
    return type_compatible(met, [("BUILDING", "1"), ("MACHINERY", "2")]).select("c_custkey", "o_orderkey")


@query("block_collect", pairs_sql("customer", "c_custkey", {"x": "c_nationkey", "y": "c_mktsegment"}, "collect_blocking", high=200))
def _(spark, d):
    return slim(B.block_collect(customers(spark, d), "key", {"nation": "c_nationkey", "segment": "c_mktsegment"}, max_size=200))


@query("block_collect_capped", pairs_sql("part", "p_partkey", {"x": "p_brand", "y": "p_size"}, "collect_blocking", high=3))
def _(spark, d):
    return slim(B.block_collect(parts(spark, d), "key", {"brand": "p_brand", "size": "p_size"}, max_size=3))


@query("block_shard_parallel", pairs_sql("part", "p_partkey", {"s": "p_partkey % 4", "x": "p_brand", "y": "p_size"}, "shard_local", high=None))
def _(spark, d):
    return slim(B.block_collect(parts(spark, d), "key", {"shard": F.col("p_partkey") % 4, "brand": "p_brand", "size": "p_size"}, "shard_local", max_size=None))


@query("block_null_keys", pairs_sql("orders", "o_orderkey", {"x": "nullif(o_orderstatus, 'O')", "y": "o_orderdate::DATE"}, "collect_blocking", high=6))
def _(spark, d):
    o = table(spark, d, "orders")
    return slim(B.block_collect(o, "o_orderkey", {"status": F.nullif(F.col("o_orderstatus"), F.lit("O")), "day": F.to_date("o_orderdate")}, max_size=6))


@query("block_exclude_values", pairs_sql("part", "p_partkey", {"x": "p_brand", "y": "p_size"}, "collect_blocking", where="p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#21')"))
def _(spark, d):
    return slim(B.block_collect(parts(spark, d), "key", {"brand": "p_brand", "size": "p_size"}, exclude={"brand": ["Brand#11", "Brand#12", "Brand#21"]}))


@query("computed_field_block", pairs_sql("customer", "c_custkey", {"x": "c_nationkey", "y": "floor(c_acctbal / 1000)"}, "collect_blocking"))
def _(spark, d):
    return slim(B.block_collect(customers(spark, d), "key", {"nation": "c_nationkey", "band": "floor(c_acctbal / 1000)"}))


@query("skipped_block_report", "SELECT p_name AS name, count(*) AS block_size FROM part GROUP BY p_name HAVING count(*) > 20 ORDER BY block_size DESC, name LIMIT 5")
def _(spark, d):
    return B.skipped_blocks(parts(spark, d), {"name": "p_name"}, 20, 5)


SPLIT = """
WITH m AS (SELECT CAST(p_partkey AS VARCHAR) AS k, p_brand AS x, p_retailprice AS v, count(*) OVER w AS n0, min(p_retailprice) OVER w AS low, max(p_retailprice) OVER w AS high FROM part WINDOW w AS (PARTITION BY p_brand)),
b AS (SELECT *, CASE WHEN n0 > 6 AND high > low AND v IS NOT NULL THEN least(ceil(n0 * 2 / 6) - 1, floor((v - low) / (high - low) * ceil(n0 * 2 / 6))) ELSE 0 END::BIGINT AS band FROM m),
s AS (SELECT *, count(*) OVER (PARTITION BY x, band) AS n FROM b)"""


@query("block_split", SPLIT + " SELECT a.k AS doc1_key, b.k AS doc2_key, 'collect_blocking' AS method, a.n AS block_size FROM s a JOIN s b ON a.x = b.x AND a.band = b.band AND a.k < b.k WHERE a.n BETWEEN 2 AND 6")
def _(spark, d):
    return slim(B.block_collect(parts(spark, d), "key", {"brand": "p_brand"}, max_size=6, split="p_retailprice"))


@query("skipped_split_blocks", SPLIT + " SELECT x AS brand, band, count(*) AS block_size FROM s WHERE n > 6 GROUP BY 1, 2 ORDER BY block_size DESC, brand, band")
def _(spark, d):
    return B.skipped_blocks(parts(spark, d), {"brand": "p_brand"}, 6, split="p_retailprice")


@query("block_exact", pairs_sql("supplier", "s_suppkey", {"x": "s_nationkey"}, "exact", high=None, where="s_nationkey IS NOT NULL AND s_nationkey <> 0"))
def _(spark, d):
    s = table(spark, d, "supplier").withColumn("nation", F.col("s_nationkey").cast("string"))
    return slim(B.block_exact(s, "s_suppkey", "nation"))


@query("block_ngram", pairs_sql("part", "p_partkey", {"x": "upper(left(p_name || ' ' || p_type, 3)) || '_' || (length(p_name || ' ' || p_type) // 2)", "y": "p_brand"}, "collect_blocking"))
def _(spark, d):
    name = F.concat_ws(" ", "p_name", "p_type")
    return slim(B.block_collect(parts(spark, d), "key", {"ngram": B.name_key(name), "brand": "p_brand"}))


@query("bulk_generate_all", f"""
WITH one AS ({pairs_sql("part", "p_partkey", {"x": "p_name", "y": "p_size"}, "exact", high=None)}),
two AS ({pairs_sql("part", "p_partkey", {"x": "upper(left(p_name, 3)) || '_' || (length(p_name) // 2)", "y": "p_brand", "z": "p_size"}, "ngram", high=None)})
SELECT doc1_key, doc2_key, list_sort(list(DISTINCT m)) AS sources FROM (SELECT doc1_key, doc2_key, 'exact' AS m FROM one UNION ALL SELECT doc1_key, doc2_key, 'ngram' FROM two) GROUP BY ALL""")  # fmt: skip
def _(spark, d):
    p = parts(spark, d)
    one = B.block_collect(p, "key", {"name": "p_name", "size": "p_size"}, "exact", max_size=None)
    two = B.block_collect(p, "key", {"ngram": B.name_key("p_name"), "brand": "p_brand", "size": "p_size"}, "ngram", max_size=None)
    return B.orchestrate({"exact": one, "ngram": two})


@query("orchestrate_intersection", f"""
WITH one AS ({pairs_sql("part", "p_partkey", {"x": "p_brand", "y": "p_size"}, "a")}), two AS ({pairs_sql("part", "p_partkey", {"x": "p_type", "y": "p_size"}, "b")})
SELECT doc1_key, doc2_key, ['brand', 'type'] AS sources FROM one SEMI JOIN two USING (doc1_key, doc2_key)""")  # fmt: skip
def _(spark, d):
    p = parts(spark, d)
    return B.orchestrate({"brand": B.block_collect(p, "key", {"brand": "p_brand", "size": "p_size"}), "type": B.block_collect(p, "key", {"type": "p_type", "size": "p_size"})}, "intersection")


@query("block_phonetic", pairs_sql("part", "p_partkey", {"x": Q.soundex("split_part(p_type, ' ', 1)"), "y": "p_brand", "z": "p_size"}, "phonetic"))
def _(spark, d):
    word = F.split_part(F.col("p_type"), F.lit(" "), F.lit(1))
    return slim(B.block_collect(parts(spark, d), "key", {"sound": F.soundex(word), "brand": "p_brand", "size": "p_size"}, "phonetic"))


@query("soundex_simple", f"SELECT CAST(p_partkey AS VARCHAR) AS key, {Q.soundex_simple('p_name')} AS code, {Q.soundex('p_name')} AS standard FROM part")
def _(spark, d):
    return parts(spark, d).select("key", X.soundex_simple("p_name").alias("code"), F.soundex("p_name").alias("standard"))


@query("block_sorted_neighborhood", """
WITH k AS (SELECT CAST(p_partkey AS VARCHAR) AS k, row_number() OVER (ORDER BY p_name || '|' || p_brand, CAST(p_partkey AS VARCHAR)) AS n FROM part)
SELECT least(a.k, b.k) AS doc1_key, greatest(a.k, b.k) AS doc2_key, 'sorted_neighborhood' AS method, CAST(b.n - a.n AS INTEGER) AS distance FROM k a JOIN k b ON b.n - a.n BETWEEN 1 AND 3""")  # fmt: skip
def _(spark, d):
    return B.block_sorted_neighborhood(parts(spark, d), "key", F.concat_ws("|", "p_name", "p_brand"), 3)


NATION = "supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _places(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("zip", F.lpad((F.col("s_suppkey") * 7919 % 2500).cast("string"), 5, "0"))


for _kind, _by in (("state", {"x": "r_name"}), ("city", {"x": "n_name"}), ("city_state", {"x": "n_name", "y": "r_name"}), ("zip_prefix", {"x": "left(lpad(CAST(s_suppkey * 7919 % 2500 AS VARCHAR), 5, '0'), 3)"})):
    query(f"block_geo_{_kind}", pairs_sql(NATION, "s_suppkey", _by, f"geographic_{_kind}", high=1000))(lambda spark, d, kind=_kind: slim(B.block_geographic(_places(spark, d), "s_suppkey", kind, "r_name", "n_name", "zip")))


ZIP = "lpad(CAST(s_suppkey % 40 * 25 AS VARCHAR), 5, '0')"


@query("block_geo_zip_range", pairs_sql(NATION, "s_suppkey", {"x": ZIP}, "geographic_zip_range", high=1000, where=f"left({ZIP}, 4) BETWEEN '0010' AND '0019' OR left({ZIP}, 4) BETWEEN '0050' AND '0089'"))
def _(spark, d):
    p = _places(spark, d).withColumn("zip", F.lpad((F.col("s_suppkey") % 40 * 25).cast("string"), 5, "0"))
    return slim(B.block_geographic(p, "s_suppkey", "zip_range", zip_code="zip", zip_ranges=[("0010", "0019"), ("0050", "0089")]))


@query("block_graph_traversal", pairs_sql("(SELECT DISTINCT l_suppkey AS e, l_orderkey AS node FROM lineitem)", "e", {"x": "node"}, "graph_traversal"))
def _(spark, d):
    return slim(B.block_graph(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey", "outbound"))


@query("block_address", pairs_sql(f"(SELECT *, lpad(CAST(s_suppkey % 7 AS VARCHAR), 5, '0') AS zip FROM {NATION})", "s_suppkey", {"x": "concat_ws('|', 'MAIN ST ' || s_nationkey, upper(n_name), upper(r_name), zip)"}, "address"))
def _(spark, d):
    p = _places(spark, d).withColumn("street", F.concat(F.lit("Main St. "), F.col("s_nationkey").cast("string"))).withColumn("zip", F.lpad((F.col("s_suppkey") % 7).cast("string"), 5, "0"))
    return slim(B.block_address(p, "s_suppkey", "street", "n_name", "r_name", "zip"))


def bm25_sql(rows: str, key: str, least: float, same: str = "''") -> str:
    """(d1, d2, bm25) over ``least``, of all records against all of the same group."""
    return f"""
WITH t AS (SELECT CAST({key} AS VARCHAR) AS doc, {same} AS same, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM {rows}),
p AS (SELECT doc, same, token, doc_len, count(*) AS tf FROM (SELECT doc, same, len(w) AS doc_len, unnest(w) AS token FROM t) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(doc_len) AS avg_len FROM (SELECT DISTINCT doc, doc_len FROM p)),
df AS (SELECT token, count(*) AS df FROM p GROUP BY token),
s AS (SELECT a.doc AS d1, b.doc AS d2, {r('sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (b.tf * 2.2 / (b.tf + 1.2 * (0.25 + 0.75 * b.doc_len / avg_len))))', 6)} AS bm25
  FROM p a JOIN p b ON a.token = b.token AND a.same IS NOT DISTINCT FROM b.same JOIN df ON df.token = a.token, st WHERE a.doc <> b.doc GROUP BY 1, 2 HAVING bm25 > {least})"""


@query("block_bm25", bm25_sql("documents", "doc_id", 300.0, "source") + ", k AS (SELECT *, row_number() OVER (PARTITION BY d1 ORDER BY bm25 DESC, d2) AS rank FROM s) SELECT d1, d2, bm25, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 20")
def _(spark, d):
    return B.block_bm25(table(spark, d, "documents"), "doc_id", "text", 300.0, 20, "source")


# the levenshtein of SQL engines may count bytes: other letters are left out on both sides
PLAIN = "regexp_replace(text, '[^ -~]', '', 'g')"


@query("block_hybrid", bm25_sql(f"(SELECT item_id, {PLAIN} AS text FROM benchmark)", "item_id", 2.0) + f""", x AS (SELECT CAST(item_id AS VARCHAR) AS k, upper(trim({PLAIN})) AS t FROM benchmark),
l AS (SELECT d1, d2, bm25, 1.0 - levenshtein(a.t, b.t)::DOUBLE / greatest(length(a.t), length(b.t)) AS lev FROM s JOIN x a ON d1 = a.k JOIN x b ON d2 = b.k WHERE d1 < d2)
SELECT d1, d2, {r('bm25 * 0.2 + lev * 0.8', 6)} AS combined FROM (SELECT *, row_number() OVER (PARTITION BY d1 ORDER BY bm25 * 0.2 + lev * 0.8 DESC, d2) AS n FROM l WHERE lev >= 0.2) WHERE n <= 20""")  # fmt: skip
def _(spark, d):
    b = table(spark, d, "benchmark").withColumn("text", F.regexp_replace("text", "[^ -~]", ""))
    return B.block_hybrid(b, "item_id", "text", levenshtein_threshold=0.2).select("d1", "d2", round_half_up("combined", 6).alias("combined"))


COS = "SELECT least(CAST(a.vec_id AS VARCHAR), CAST(b.vec_id AS VARCHAR)) AS doc1_key, greatest(CAST(a.vec_id AS VARCHAR), CAST(b.vec_id AS VARCHAR)) AS doc2_key, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"


@query("block_vector", f"WITH c AS ({COS}) SELECT doc1_key, doc2_key, {r('s')} AS similarity FROM c WHERE s >= 0.35")
def _(spark, d):
    return B.block_vector(table(spark, d, "embeddings"), "vec_id", "embedding", 0.35, None).withColumn("similarity", round_half_up("similarity"))


@query("block_vector_same_label", f"WITH c AS ({COS} AND a.label = b.label) SELECT doc1_key, doc2_key, {r('s')} AS similarity FROM c WHERE s >= 0.3")
def _(spark, d):
    return B.block_vector(table(spark, d, "embeddings"), "vec_id", "embedding", 0.3, None, "label").withColumn("similarity", round_half_up("similarity"))


def _lsh_sql(dim: int = 64, tables: int = 10, bits: int = 8, seed: int = 42) -> str:
    """The same planes, written out."""
    import numpy as np

    planes = np.random.RandomState(seed).randn(tables * bits, dim)
    rows = ", ".join(f"({i}, [{', '.join(map(repr, p.tolist()))}])" for i, p in enumerate(planes))
    return f"""
WITH planes(i, p) AS (VALUES {rows}),
coded AS (SELECT CAST(vec_id AS VARCHAR) AS k, i // {bits} AS t, sum(CASE WHEN list_inner_product(embedding::DOUBLE[], p) >= 0 THEN 1 << (i % {bits}) ELSE 0 END) AS bucket FROM embeddings, planes GROUP BY ALL)
SELECT a.k AS doc1_key, b.k AS doc2_key, CAST(min(a.t) AS INTEGER) AS "table" FROM coded a JOIN coded b USING (t, bucket) WHERE a.k < b.k GROUP BY 1, 2"""


@query("block_lsh", _lsh_sql())
def _(spark, d):
    return B.block_lsh(table(spark, d, "embeddings"), "vec_id", "embedding", 64)


@query("ann_query", f"WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), c AS (SELECT CAST(vec_id AS VARCHAR) AS key, {r('list_cosine_similarity(embedding::DOUBLE[], v)')} AS similarity FROM embeddings, q WHERE vec_id <> 0) SELECT * FROM c WHERE similarity >= 0.1 ORDER BY similarity DESC, key LIMIT 20")
def _(spark, d):
    e = table(spark, d, "embeddings")
    v = e.where("vec_id = 0").first()["embedding"]
    return B.ann_query(e, "vec_id", "embedding", v, 0.0, 1 << 30, exclude="0").withColumn("similarity", round_half_up("similarity")).where("similarity >= 0.1").orderBy(F.desc("similarity"), "key").limit(20)


@query("embeddings_coverage", "SELECT count(*) AS total, count(embedding) AS with_vector, count(*) - count(embedding) AS without_vector, CAST(max(len(embedding)) AS BIGINT) AS dimension FROM embeddings")
def _(spark, d):
    return B.embeddings_coverage(table(spark, d, "embeddings"), "embedding")


@query("incremental_prefix_block", """
WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, lower(left(n_name, 3)) AS p FROM supplier JOIN nation ON s_nationkey = n_nationkey), c AS (SELECT 'n' || n_nationkey AS k, lower(left(n_name, 3)) AS p FROM nation)
SELECT DISTINCT s.k AS new_key, c.k AS base_key FROM s JOIN c USING (p)""")  # fmt: skip
def _(spark, d):
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("k"), "n_name")
    return B.prefix_candidates(s, n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("k"), "n_name"), "k", ["n_name"])


@query("unresolved_filter", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, d):
    e = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"))
    return B.unresolved(table(spark, d, "customer"), "c_custkey", e).select("c_custkey")
