"""Sources, sinks, single predicates, text functions, joins and set operations over the driver tables, one query each."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.expressions import round_half_up
from ..operators import blocking as B
from ..operators import clusters as C
from ..operators import edges as E
from ..operators import gates as G
from ..operators import golden as O
from ..operators import learning as L
from ..operators import scoring as P
from ..operators.predicates import predicate
from ..scratch import shared_folder
from ..sources import readers as R
from ..sources import writers as W
from . import sql as Q
from .blocking_queries import pairs_sql
from .common import COMPONENTS, SCORED, candidates, customers, edges, members, parts, r, scored, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/weftline-{name}-{uuid.uuid4().hex}"


# --- sources ---


@query("json_file_source", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def _(spark, d):
    path = folder(spark, "json")
    wrapped = table(spark, d, "nation").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("customers"))  # 25 rows
    wrapped.coalesce(1).write.json(path)
    return R.json_records(spark, path).select("n_nationkey", "n_name")


@query("csv_source", "SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name FROM supplier")
def _(spark, d):
    path = folder(spark, "tsv")
    table(spark, d, "supplier").select("s_suppkey", "s_name").write.option("sep", "\t").csv(path)
    return R.delimited(spark, path, "\t", ["key", "name"])


@query("pandas_source", "SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    return R.from_pandas(spark, table(spark, d, "region").toPandas())  # five rows


@query("benchmark_loader", "SELECT 'a_' || p_partkey AS _key, p_name AS title, p_brand || ' ' || p_type AS body, p_name || ' ' || p_brand || ' ' || p_type AS text FROM part")
def _(spark, d):
    path = folder(spark, "linkage")
    table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type").write.option("header", True).csv(path)
    return R.linkage_table(R.delimited(spark, path, ","), "a", "p_partkey", "p_name", ["p_brand", "p_type"]).select("_key", "title", "body", "text")


@query("ground_truth_source", "SELECT DISTINCT least(CAST(l_partkey AS VARCHAR), CAST(l_orderkey AS VARCHAR)) AS doc1_key, greatest(CAST(l_partkey AS VARCHAR), CAST(l_orderkey AS VARCHAR)) AS doc2_key FROM lineitem WHERE l_linenumber = 1 AND l_partkey <> l_orderkey")
def _(spark, d):
    path = folder(spark, "truth")
    t = table(spark, d, "lineitem").select(F.col("l_partkey").alias("record_a_id"), F.col("l_orderkey").alias("record_b_id"), F.when(F.col("l_linenumber") == 1, "Yes").otherwise("no").alias("is_match"))
    t.write.option("header", True).csv(path)
    return R.ground_truth(spark, path)


@query("key_lookup_point", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def _(spark, d):
    return table(spark, d, "customer").where("c_custkey = 42").select("c_custkey", "c_name")


@query("collection_stats", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def _(spark, d):
    n = lambda t: table(spark, d, t).agg(F.lit(t).alias("name"), F.count(F.lit(1)).alias("n"))
    return n("customer").union(n("orders"))


# --- sinks ---


@query("insert_edges_detailed", f"WITH {SCORED} SELECT doc1_key AS src, doc2_key AS dst, score AS similarity, floor(score * 10) AS band FROM scored WHERE score >= 0.9")
def _(spark, d):
    return E.make_edges(scored(spark, d).where("score >= 0.9").withColumn("band", F.floor(F.col("score") * 10).cast("double")), "detailed", keep=("band",)).select("src", "dst", "similarity", "band")


@query("insert_edges_bidirectional", f"WITH {SCORED} SELECT doc1_key AS src, doc2_key AS dst FROM scored WHERE score >= 0.9 UNION ALL SELECT doc2_key, doc1_key FROM scored WHERE score >= 0.9")
def _(spark, d):
    return E.make_edges(scored(spark, d).where("score >= 0.9"), "both", bidirectional=True).select("src", "dst")


@query("clear_inferred_edges", "SELECT o_orderkey FROM orders WHERE NOT (coalesce(o_orderstatus = 'P', FALSE) AND o_orderdate < TIMESTAMP '1996-01-01')")
def _(spark, d):
    import datetime

    e = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "P").alias("inferred"), F.col("o_orderdate").alias("ts"))
    return E.clear_inferred(e, datetime.datetime(1996, 1, 1)).select("o_orderkey")


@query("cluster_store", f"WITH RECURSIVE {SCORED}, {COMPONENTS} SELECT cluster_id, count(*) AS size FROM members GROUP BY 1")
def _(spark, d):
    path = folder(spark, "clusters")
    W.write_table(C.wide(members(spark, d)), path)
    return spark.read.parquet(path).select("cluster_id", "size")


@query("golden_upsert", "SELECT c_custkey AS golden_key, CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS v FROM customer")
def _(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("golden_key"), F.col("c_mktsegment").alias("v"))
    return O.upsert(old, old.where("golden_key % 3 = 0").withColumn("v", F.concat(F.upper("v"), F.lit("!"))))


@query("resolved_edges", f"WITH RECURSIVE {SCORED}, {COMPONENTS} SELECT member_key AS src, md5(string_agg(member_key, '|' ORDER BY member_key) OVER (PARTITION BY cluster_id ORDER BY member_key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS dst, 'resolvedTo' AS type FROM members")
def _(spark, d):
    m = members(spark, d)
    return O.resolved_edges(O.consolidate(O.survivors(customers(spark, d), m, "key", {"c_mktsegment": "voting"}), m, ["c_mktsegment"]), m)


@query("canonical_nodes_sink", "SELECT left(sha256(upper(p_brand)), 16) AS signature, count(*) AS records FROM part GROUP BY p_brand")
def _(spark, d):
    path = folder(spark, "nodes")
    W.write_lines(O.canonical_nodes(table(spark, d, "part"), [X.normalise("p_brand")]).select("signature", "records"), path)
    return spark.read.schema("signature string, records long").json(path)


@query("canonical_edges_sink", "SELECT left(sha256(upper(p_brand)), 16) AS src, left(sha256(upper(p_type)), 16) AS dst, count(*) AS n FROM part GROUP BY p_brand, p_type")
def _(spark, d):
    from ..functions.expressions import signature

    path = folder(spark, "edges")
    e = table(spark, d, "part").groupBy(signature(X.normalise("p_brand")).alias("src"), signature(X.normalise("p_type")).alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    W.write_lines(e, path, tsv=True)
    return spark.read.option("sep", "\t").option("header", True).schema("src string, dst string, n long").csv(path)


# --- predicates, one each ---

CASES = {
    "filter_not_null": ("o_orderstatus", {"not_null": True}, "o_orderstatus IS NOT NULL"),
    "filter_not_equal": ("o_orderstatus", {"not_equal": ["F", "P"]}, "o_orderstatus IS DISTINCT FROM 'F' AND o_orderstatus IS DISTINCT FROM 'P'"),
    "filter_equals": ("o_orderstatus", {"equals": "O"}, "o_orderstatus = 'O'"),
    "filter_min_length": ("o_orderpriority", {"min_length": 7}, "length(o_orderpriority) >= 7"),
    "filter_max_length": ("o_orderpriority", {"max_length": 7}, "length(o_orderpriority) <= 7"),
    "filter_contains": ("o_orderpriority", {"contains": "HIGH"}, "contains(o_orderpriority, 'HIGH')"),
    "filter_regex": ("o_orderpriority", {"regex": "^[12]"}, "regexp_matches(o_orderpriority, '^[12]')"),
    "filter_in": ("o_orderstatus", {"in": ["F", "O"]}, "o_orderstatus IN ('F', 'O')"),
}
for _name, (_field, _rules, _sql) in CASES.items():
    query(_name, f"SELECT o_orderkey FROM orders WHERE {_sql}")(lambda spark, d, f=_field, rules=_rules: table(spark, d, "orders").where(predicate(f, rules)).select("o_orderkey"))


@query("edge_defect_filter", f"WITH {SCORED} SELECT count(*) AS total, 0::BIGINT AS missing, count(*) FILTER (score < 0.75) AS below, 0::BIGINT AS self_loops FROM scored")
def _(spark, d):
    return E.defects(scored(spark, d).select(F.col("doc1_key").alias("src"), F.col("doc2_key").alias("dst"), F.col("score").alias("similarity")), 0.75)


# --- blocking ---


@query("block_stats", f"WITH {SCORED} SELECT count(*) AS total_pairs, {r('avg(score) + 1e-9', 6)} AS avg_score, max(score) AS max_score FROM scored")
def _(spark, d):
    return B.block_stats(scored(spark, d), "score").withColumn("avg_score", round_half_up(F.col("avg_score") + 1e-9, 6))


@query("block_ngram_name", pairs_sql("nation JOIN supplier ON s_nationkey = n_nationkey", "s_suppkey", {"x": "upper(left(n_name, 3)) || '_' || (length(n_name) // 2)"}, "ngram", high=None))
def _(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return B.block_ngram(s, "s_suppkey", "n_name", None).select("doc1_key", "doc2_key", "method", "block_size")


@query("block_phonetic_name", pairs_sql("nation JOIN supplier ON s_nationkey = n_nationkey", "s_suppkey", {"x": Q.soundex("n_name")}, "phonetic", high=None))
def _(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return B.block_phonetic(s, "s_suppkey", "n_name", max_size=None).select("doc1_key", "doc2_key", "method", "block_size")


@query("single_record_sorted_neighborhood", "WITH k AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, s_nationkey AS p, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name, CAST(s_suppkey AS VARCHAR)) AS n FROM supplier) SELECT least(a.k, b.k) AS doc1_key, greatest(a.k, b.k) AS doc2_key, CAST(b.n - a.n AS INTEGER) AS distance FROM k a JOIN k b ON a.p = b.p AND b.n - a.n BETWEEN 1 AND 2")
def _(spark, d):
    return B.block_sorted_neighborhood(table(spark, d, "supplier"), "s_suppkey", F.col("s_name"), 2, F.col("s_nationkey")).select("doc1_key", "doc2_key", "distance")


@query("orchestrate_from_config", pairs_sql("part", "p_partkey", {"x": "p_brand", "y": "p_size"}, "x", high=50).replace(", 'x' AS method, a.n AS block_size", ""))
def _(spark, d):
    from .pipeline import STRATEGIES

    return STRATEGIES["exact"](parts(spark, d), "key", {"fields": ["p_brand", "p_size"], "max_block_size": 50}).select("doc1_key", "doc2_key")


@query("bulk_streaming", pairs_sql("part", "p_partkey", {"x": "p_brand", "y": "p_size"}, "x", high=None).replace(", 'x' AS method, a.n AS block_size", ""))
def _(spark, d):
    path = folder(spark, "pairs")
    W.write_table(B.block_collect(parts(spark, d), "key", {"b": "p_brand", "s": "p_size"}, "bulk", max_size=None), path, ["method"])
    return spark.read.parquet(path).select("doc1_key", "doc2_key")


# --- joins and set operations ---


@query("join_theta", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
def _(spark, d):
    a, b = table(spark, d, "supplier").alias("a"), table(spark, d, "supplier").alias("b")
    return a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_acctbal") < F.col("b.s_acctbal"))).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"))


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def _(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderpriority like '1%'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("best_match", f"WITH {SCORED} SELECT doc1_key, doc2_key, score FROM (SELECT *, row_number() OVER (PARTITION BY doc1_key ORDER BY score DESC, doc2_key) AS n FROM scored) WHERE n = 1")
def _(spark, d):
    return B.top_k(scored(spark, d), "doc1_key", "score", 1, "doc2_key").drop("rank")


@query("dedupe_max", f"WITH {SCORED} SELECT doc1_key, doc2_key, max(score) AS score FROM scored GROUP BY ALL")
def _(spark, d):
    s = scored(spark, d)
    both = s.union(s.select(F.col("doc2_key").alias("doc1_key"), F.col("doc1_key").alias("doc2_key"), (F.col("score") - 0.1).alias("score")))
    return both.groupBy(F.least("doc1_key", "doc2_key").alias("doc1_key"), F.greatest("doc1_key", "doc2_key").alias("doc2_key")).agg(F.max("score").alias("score"))


@query("set_except", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS k FROM orders EXCEPT SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey < 5")
def _(spark, d):
    old = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("k")).distinct()
    return old.join(customers(spark, d).where("c_nationkey < 5").select(F.col("key").alias("k")), "k", "left_anti")


@query("union_distinct_vertices", f"WITH {SCORED} SELECT doc1_key AS k FROM scored WHERE score >= 0.9 UNION SELECT doc2_key FROM scored WHERE score >= 0.9")
def _(spark, d):
    return edges(spark, d).select(F.explode(F.array("src", "dst")).alias("k")).distinct()


@query("dedup_pairs", f"WITH {SCORED} SELECT DISTINCT doc1_key, doc2_key FROM scored")
def _(spark, d):
    c = candidates(spark, d)
    return B.orchestrate({"a": c, "b": c.select(F.col("doc2_key").alias("doc1_key"), F.col("doc1_key").alias("doc2_key"))}).select("doc1_key", "doc2_key")


# --- text functions ---


@query("remove_punctuation", "SELECT page_id, regexp_replace(url, '[[:punct:]]', '', 'g') AS bare, regexp_replace(url, '[^A-Za-z0-9]', '', 'g') AS alnum FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", X.remove_punctuation("url").alias("bare"), X.alphanumeric_only("url").alias("alnum"))


@query("state_code", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'NY' WHEN 1 THEN 'TX' ELSE replace(upper(n_name), '_', '') END AS code FROM nation")
def _(spark, d):
    n = F.col("n_nationkey") % 3
    return table(spark, d, "nation").select("n_nationkey", X.state_code(F.when(n == 0, " new  york.").when(n == 1, "Texas").otherwise(F.col("n_name"))).alias("code"))


@query("street_suffix", "SELECT s_suppkey, s_suppkey || ' MAIN ' || CASE s_suppkey % 3 WHEN 0 THEN 'STREET' WHEN 1 THEN 'AVENUE' ELSE 'ROAD' END AS street, upper(s_name) || ' INC' AS company FROM supplier")
def _(spark, d):
    k = F.col("s_suppkey")
    street = F.concat_ws(" ", k.cast("string"), F.lit("Main"), F.when(k % 3 == 0, "St.").when(k % 3 == 1, "ave").otherwise("Rd"))
    return table(spark, d, "supplier").select("s_suppkey", X.street_suffix(street).alias("street"), X.company_suffix(F.concat_ws(" ", "s_name", F.lit("Incorporated"))).alias("company"))


@query("token_normaliser", "SELECT s_suppkey, s_suppkey || ' MAIN STREET' AS line FROM supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", X.expand_tokens(F.concat(F.col("s_suppkey").cast("string"), F.lit(" Main St., Apt. 7 B"))).alias("line"))


@query("missing_sentinels", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END AS v FROM orders")
def _(spark, d):
    k = F.col("o_orderkey") % 4
    return table(spark, d, "orders").select("o_orderkey", X.missing_sentinels(F.when(k == 0, " Unknown ").otherwise(F.col("o_orderstatus"))).alias("v"))


@query("validate_fields", "SELECT c_custkey, c_custkey % 2 = 0 AS email, c_custkey % 3 = 0 AS phone, c_custkey % 5 = 0 AS zip FROM customer")
def _(spark, d):
    k = F.col("c_custkey")
    c = k.cast("string")
    return table(spark, d, "customer").select("c_custkey", X.valid_email(F.concat(F.lit("c"), c, F.when(k % 2 == 0, "@example.com").otherwise("@example"))).alias("email"), X.valid_phone(F.when(k % 3 == 0, "(555) 123-4567").otherwise("123")).alias("phone"), X.valid_zip(F.when(k % 5 == 0, "12345-6789").otherwise("1234")).alias("zip"))


@query("normalize_field_value", "SELECT c_custkey, lower('C' || c_custkey || '@Example.COM') AS email, '555' || c_custkey AS phone FROM customer")
def _(spark, d):
    c = F.col("c_custkey").cast("string")
    return table(spark, d, "customer").select("c_custkey", X.field_value("email", F.concat(F.lit(" C"), c, F.lit("@Example.COM "))).alias("email"), X.field_value("phone", F.concat(F.lit("(555) "), c)).alias("phone"))


@query("extract_field_features", "SELECT c_custkey, ['c' || c_custkey || '@x.org', 'x.org'] AS features FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.field_features("email", F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit("@X.org"))).alias("features"))


@query("alias_expansion", "SELECT p_partkey, a AS alias FROM (SELECT p_partkey, unnest([p_name] || CASE WHEN starts_with(p_name, 'small') THEN ['little'] WHEN starts_with(p_name, 'large') THEN ['big', 'great'] ELSE [] END) AS a FROM part)")
def _(spark, d):
    from ..operators.linkage import expand_acronyms

    known = spark.createDataFrame([("small", "little"), ("large", "big"), ("large", "great")], "acronym string, expansion string")
    return expand_acronyms(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", known).select("p_partkey", F.explode("expanded").alias("alias"))


# --- scoring ---


@query("explain_match", f"WITH {SCORED} SELECT doc1_key, doc2_key, CASE WHEN score >= 0.9 THEN 'strong' WHEN score >= 0.75 THEN 'likely' WHEN score >= 0.55 THEN 'possible' ELSE 'unlikely' END AS reading FROM scored")
def _(spark, d):
    return scored(spark, d).select("doc1_key", "doc2_key", P.interpretation(F.col("score")).alias("reading"))


@query("gamma_build", f"WITH {SCORED} SELECT doc1_key, doc2_key, CAST(score >= 0.85 AS INTEGER) AS g, CASE WHEN score >= 0.9 THEN 0 WHEN score >= 0.8 THEN 1 ELSE 2 END AS level FROM scored")
def _(spark, d):
    return scored(spark, d).select("doc1_key", "doc2_key", L.gamma(F.col("score")).alias("g"), L.gamma_level(F.col("score"), [0.9, 0.8]).alias("level"))


@query("comparison_bands", f"WITH {SCORED}, {Q.HISTOGRAM}, {Q.BANDS} SELECT {r('band', 6)} AS band FROM bands")
def _(spark, d):
    return spark.createDataFrame([(b,) for b in L.comparison_bands(*L.score_bins(scored(spark, d)))], "band double").select(round_half_up("band", 6).alias("band"))


@query("threshold_auto", f"WITH {SCORED}, {Q.HISTOGRAM} SELECT {r('CASE WHEN depth >= 0.15 THEN cut ELSE 0.8 END', 6)} AS threshold, {r('depth', 6)} AS depth, depth >= 0.15 AS accepted FROM depth")
def _(spark, d):
    found = spark.createDataFrame([L.auto_threshold(scored(spark, d))], "threshold double, depth double, accepted boolean")
    return found.withColumns({c: round_half_up(c, 6) for c in ("threshold", "depth")})


# --- review ---


@query("verdict_merge", f"WITH RECURSIVE {SCORED}, {COMPONENTS}, k AS (SELECT DISTINCT cluster_id FROM members ORDER BY 1 LIMIT 2) SELECT CASE WHEN cluster_id IN (SELECT cluster_id FROM k) THEN (SELECT min(cluster_id) FROM k) ELSE cluster_id END AS cluster_id, member_key FROM members")
def _(spark, d):
    e = edges(spark, d)
    one, two = [x["cluster_id"] for x in C.cluster(e).select("cluster_id").distinct().orderBy("cluster_id").limit(2).collect()]
    return C.cluster(E.apply_verdicts(e, spark.createDataFrame([(one, two, "match", 1)], "src string, dst string, decision string, decided int")))


@query("verdict_remove", f"WITH {SCORED} SELECT doc1_key AS src, doc2_key AS dst FROM scored WHERE score >= 0.9 AND doc1_key <> (SELECT min(doc1_key) FROM scored WHERE score >= 0.9)")
def _(spark, d):
    e = edges(spark, d)
    first = e.agg(F.min("src")).first()[0]
    gone = e.where(F.col("src") == first).select("src", "dst", F.lit("no_match").alias("decision"), F.lit(1).alias("decided"))
    return E.active(E.apply_verdicts(e, gone)).select("src", "dst")


@query("feedback_store", "SELECT doc_id, quality FROM labels WHERE toxic = 0")
def _(spark, d):
    lab = table(spark, d, "labels")
    log = lab.where("toxic = 0 and quality = 1").select("doc_id", "quality")
    return G.record_audit(log, lab.where("toxic = 0 and quality = 0").select("doc_id", "quality"))


@query("curation_audit", "SELECT CAST(o_orderkey AS VARCHAR) AS action, o_orderdate AS at FROM orders WHERE o_custkey = 7 ORDER BY 2, 1")
def _(spark, d):
    log = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("subject"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").cast("string").alias("action"))
    return G.history(log, "7").select("action", "at")


@query("clean_results", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def _(spark, d):
    import datetime

    return E.clear_edges(table(spark, d, "orders").withColumn("ts", F.col("o_orderdate")), older_than=datetime.datetime(1996, 1, 1)).select("o_orderkey")


@query("quality_drift", f"WITH p AS (SELECT a.label AS label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT label, count(*) AS n, {r('1 - avg(s)', 4)} AS drift FROM p GROUP BY 1")
def _(spark, d):
    from ..functions.similarity import cosine

    a, b = table(spark, d, "embeddings").alias("a"), table(spark, d, "embeddings").alias("b")
    s = a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.label").alias("label"), cosine("a.embedding", "b.embedding").alias("s"))
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), round_half_up(1 - F.avg("s")).alias("drift"))
