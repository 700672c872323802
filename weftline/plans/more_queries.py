"""Whole runs, advice, graph embeddings and single-record look-ups over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import round_half_up
from ..operators import advisor as A
from ..operators import clusters as C
from ..operators import embedding as N
from ..operators import learning as L
from ..operators import lookups as K
from . import pipeline as R
from . import sql as Q
from .common import COMPONENTS, SCORED, customers, edges, parts, r, table
from .matching_queries import BRAND_PAIRS, LEV, QUALITY

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


RUN = {"key": "key", "blocking": {"strategy": "exact", "fields": ["p_brand", "p_size"], "max_block_size": 50}, "fields": {"p_name": {"weight": 0.7, "algorithm": "levenshtein"}, "p_type": {"weight": 0.3, "algorithm": "exact"}}, "threshold": 0.6, "golden": {"p_type": "voting"}}
RUN_SQL = f"""
p AS (SELECT *, CAST(p_partkey AS VARCHAR) AS key, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part),
scored AS (SELECT a.key AS doc1_key, b.key AS doc2_key, {r("0.7 * (1.0 - levenshtein(upper(a.p_name), upper(b.p_name))::DOUBLE / greatest(length(a.p_name), length(b.p_name))) + 0.3 * CAST(a.p_type = b.p_type AS INTEGER)")} AS score FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.key < b.key WHERE a.n BETWEEN 2 AND 50),
{COMPONENTS.replace("score >= 0.9", "score >= 0.6")}"""


@query("pipeline_run_members", f"WITH RECURSIVE {RUN_SQL} SELECT cluster_id, member_key FROM members")
def _(spark, d):
    return R.run(parts(spark, d), R.Config(**RUN))["members"]


def _rounded(c):
    """To six places; NaN stays, as in SQL."""
    return F.when(F.isnan(c), F.lit(float("nan"))).otherwise(round_half_up(c, 6))


@query("pipeline_run_stats", f"WITH RECURSIVE {RUN_SQL} SELECT (SELECT count(*) FROM part) AS records, (SELECT count(*) FROM scored) AS pairs, (SELECT count(*) FROM e) AS edges, count(*) AS clustered, count(DISTINCT cluster_id) AS clusters, {r('(SELECT count(*) FROM e) / (SELECT count(*) FROM scored)', 6)} AS match_rate, {r('(count(*) - count(DISTINCT cluster_id)) * 100 / (SELECT count(*) FROM part)', 6)} AS reduction FROM members")
def _(spark, d):
    df = parts(spark, d)
    got = R.run_stats(df, R.run(df, R.Config(**RUN)))
    return got.withColumns({"records": F.col("records").cast("long"), "pairs": F.col("pairs").cast("long"), "edges": F.col("edges").cast("long"), "match_rate": _rounded("match_rate"), "reduction": _rounded("reduction")})


@query("pipeline_run_golden", f"WITH RECURSIVE {RUN_SQL}, v AS (SELECT cluster_id, p_type AS v, count(*) AS n, min(member_key) AS f FROM members JOIN p ON member_key = key GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, length(v) DESC, f, v) AS k FROM v) SELECT cluster_id, v AS p_type FROM b WHERE k = 1")
def _(spark, d):
    return R.run(parts(spark, d), R.Config(**RUN))["golden"].select("cluster_id", "p_type")


@query("address_pipeline", """
WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, concat_ws('|', 'DOCK ' || (s_suppkey % 4), upper(n_name)) AS a FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT min(k) OVER (PARTITION BY a) AS cluster_id, k AS member_key FROM s WHERE a IN (SELECT a FROM s GROUP BY a HAVING count(*) BETWEEN 2 AND 100)""")  # fmt: skip
def _(spark, d):
    from ..operators.blocking import block_address
    from ..operators.edges import make_edges

    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.withColumn("street", F.concat(F.lit("Dock "), (F.col("s_suppkey") % 4).cast("string")))
    pairs = block_address(s, "s_suppkey", "street", "n_name", F.lit(""), F.lit(""))
    return C.cluster(make_edges(pairs.withColumn("score", F.lit(1.0)), "address"))


@query("cluster_legacy", f"WITH RECURSIVE {SCORED}, {COMPONENTS}, {QUALITY} SELECT cluster_id, {r('least(1.0, least(1.0, size / 10.0) * 0.3 + (CASE WHEN density >= 0.3 THEN density ELSE density * 0.5 END) * 0.4 + average_similarity * 0.3)')} AS legacy_score FROM q")
def _(spark, d):
    e = edges(spark, d)
    return K.legacy_quality(C.quality(C.cluster(e), e)).select("cluster_id", round_half_up("legacy_score").alias("legacy_score"))


@query("agg_confidence_buckets", f"WITH {SCORED} SELECT floor(score * 20 + 1e-7) / 20 AS bucket, count(*) AS n FROM scored WHERE score >= 0.9 GROUP BY 1")
def _(spark, d):
    return K.confidence_buckets(edges(spark, d))


@query("agg_value_counts", "SELECT c_mktsegment AS value, count(*) AS count FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def _(spark, d):
    return L.term_frequencies(table(spark, d, "customer"), ["c_mktsegment"]).select("value", "count")


@query("golden_legacy", f"WITH RECURSIVE {SCORED}, {COMPONENTS} SELECT member_key, {r('0.5 + 0.5 * ((CASE WHEN c_name <> chr(32) THEN 1 ELSE 0 END) + (CASE WHEN c_mktsegment IS NOT NULL THEN 1 ELSE 0 END)) / 2.0')} AS quality FROM members JOIN customer ON member_key = CAST(c_custkey AS VARCHAR)")
def _(spark, d):
    from .common import members

    c = customers(spark, d).select(F.col("key").alias("member_key"), K.record_quality(["c_name", "c_mktsegment"]).alias("quality"))
    return members(spark, d).join(c, "member_key").select("member_key", round_half_up("quality").alias("quality"))


@query("golden_overrides", f"WITH RECURSIVE {SCORED}, {COMPONENTS} SELECT cluster_id, CASE WHEN count(*) > 2 THEN 'REVIEWED' ELSE any_value(s) END AS c_mktsegment FROM (SELECT cluster_id, first_value(c_mktsegment) OVER (PARTITION BY cluster_id ORDER BY c DESC, length(c_mktsegment) DESC, f, c_mktsegment) AS s FROM (SELECT cluster_id, c_mktsegment, count(*) OVER (PARTITION BY cluster_id, c_mktsegment) AS c, min(member_key) OVER (PARTITION BY cluster_id, c_mktsegment) AS f FROM members JOIN customer ON member_key = CAST(c_custkey AS VARCHAR))) GROUP BY cluster_id")
def _(spark, d):
    from ..operators import golden as O
    from .common import members

    m = members(spark, d)
    g = O.consolidate(O.survivors(customers(spark, d), m, "key", {"c_mktsegment": "voting"}), m, ["c_mktsegment"])
    reviewed = g.where("cluster_size > 2").select("golden_key", F.lit("c_mktsegment").alias("field"), F.lit("REVIEWED").alias("value"))
    return O.override(g, reviewed, ["c_mktsegment"]).select("cluster_id", "c_mktsegment")


@query("model_latest", "SELECT o_custkey AS name, max(o_orderkey) AS version FROM orders GROUP BY 1")
def _(spark, d):
    return L.latest_model(table(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("version")))


@query("single_record_exact", "SELECT DISTINCT 's' || s_suppkey AS new_key, 'c' || c_custkey AS base_key, 'exact' AS method FROM supplier JOIN customer ON s_suppkey % 500 = c_custkey % 500 OR (s_nationkey = c_nationkey AND left(c_mktsegment, 1) = chr(65 + CAST(s_suppkey % 8 AS INTEGER)))")
def _(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("k"), F.lit(None).cast("string").alias("email"), F.concat(F.lit("1"), (F.col("s_suppkey") % 500).cast("string")).alias("phone"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("last"), F.chr(65 + F.col("s_suppkey") % 8).alias("first"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("k"), F.lit(None).cast("string").alias("email"), F.concat(F.lit("1"), (F.col("c_custkey") % 500).cast("string")).alias("phone"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("last"), F.col("c_mktsegment").alias("first"))
    return K.lookup_exact(s, c, "k", "email", "phone", "last", "first")


@query("single_record_ngram", "SELECT DISTINCT 'p' || a.p_partkey AS new_key, 'b' || b.n AS base_key, 'ngram' AS method FROM part a JOIN (SELECT DISTINCT p_brand AS n, p_name AS x FROM part) b ON upper(left(a.p_name, 3)) = upper(left(b.x, 3))")
def _(spark, d):
    p = table(spark, d, "part")
    new = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("k"), F.col("p_name").alias("x"))
    base = p.select(F.concat(F.lit("b"), "p_brand").alias("k"), F.col("p_name").alias("x")).distinct()
    return K.lookup_ngram(new, base, "k", ["x"])


@query("single_record_phonetic", f"SELECT DISTINCT 'n' || a.n_nationkey AS new_key, 'bn' || b.n_nationkey AS base_key, 'phonetic' AS method FROM nation a JOIN nation b ON {Q.soundex('a.n_name')} = {Q.soundex('b.n_name')}")
def _(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("k"), "n_name")
    return K.lookup_phonetic(n, n.withColumn("k", F.concat(F.lit("b"), "k")), "k", "n_name")


@query("node2vec")
def _(spark, d):
    e = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"))
    return N.node2vec(e)


@query("block_graph_embedding")
def _(spark, d):
    e = table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"))
    return N.block_graph_embedding(e)


LEVELS = f"WITH {BRAND_PAIRS} SELECT " + ", ".join(f"CASE WHEN {s} >= 0.9 THEN 0 WHEN {s} >= 0.5 THEN 1 ELSE 2 END AS {c}" for c, s in (("a", LEV.format("x", "y")), ("b", LEV.format("tx", "ty")))) + ", count(*) AS n FROM bp GROUP BY ALL"


@query("em_categorical", f"WITH RECURSIVE {Q.em_categorical(LEVELS, {'a': 3, 'b': 3})} " + " UNION ALL ".join(f"SELECT '{name}' AS field, {i} AS level, {r(f'm{f}_{i}', 6)} AS m, {r(f'u{f}_{i}', 6)} AS u, {r('p', 6)} AS prior FROM last" for f, name in enumerate(("name", "type")) for i in range(3)))
def _(spark, d):
    import numpy as np

    from ..functions.similarity import levenshtein
    from .matching_queries import _brand_pairs

    g = L.patterns(_brand_pairs(spark, d).select(L.gamma_level(levenshtein("x", "y"), [0.9, 0.5]).alias("a"), L.gamma_level(levenshtein("tx", "ty"), [0.9, 0.5]).alias("b")), ["a", "b"]).collect()
    m, u, prior = L.em_categorical(np.array([[x["a"], x["b"]] for x in g], float).reshape(-1, 2), [3, 3], np.array([x["n"] for x in g]))
    found = spark.createDataFrame([(f, i, float(m[k][i]), float(u[k][i]), float(prior)) for k, f in enumerate(("name", "type")) for i in range(3)], "field string, level int, m double, u double, prior double")
    return found.withColumns({c: round_half_up(c, 6) for c in ("m", "u", "prior")})


@query("advisor_blocking_candidates", f"""
WITH s AS (SELECT 'p_brand' AS fields, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'p_size', count(*) FROM part GROUP BY p_size UNION ALL SELECT 'p_brand + p_size', count(*) FROM part GROUP BY p_brand, p_size)
SELECT fields, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS pairs, max(n) AS largest FROM s GROUP BY 1""")  # fmt: skip
def _(spark, d):
    return A.blocking_candidates(table(spark, d, "part"), ["p_brand", "p_size"]).select("fields", "pairs", "largest")


@query("emit_similarity_config", f"""
WITH t AS ({" UNION ALL ".join(f"SELECT '{c}' AS field, {Q.field_type(c, 'customer')} AS type" for c in ('c_name', 'c_mktsegment', 'c_acctbal'))}),
k AS (SELECT t.*, w, algorithm FROM t JOIN (VALUES {", ".join(f"('{n}', {x.weight}, '{x.algorithm}')" for n, x in A.TYPE_DEFAULTS.items())}) v(type, w, algorithm) USING (type) WHERE type <> 'free_text')
SELECT field, type, round(w / sum(w) OVER (), 4)::DOUBLE AS weight, algorithm FROM k""")
def _(spark, d):
    got = A.similarity_config(A.field_types(table(spark, d, "customer"), ["c_name", "c_mktsegment", "c_acctbal"]))
    return spark.createDataFrame([(x["field"], x["type"], x["weight"], x["algorithm"]) for x in got], "field string, type string, weight double, algorithm string")


@query("export_clusters", f"WITH RECURSIVE {SCORED}, {COMPONENTS} SELECT cluster_id, count(*) AS size, string_agg(member_key, ';' ORDER BY member_key) AS members FROM members GROUP BY 1")
def _(spark, d):
    import uuid

    from ..scratch import shared_folder
    from ..sources.writers import export_clusters
    from .common import members

    path = f"{shared_folder(spark)}/weftline-export-{uuid.uuid4().hex}"
    export_clusters(members(spark, d), path)
    return spark.read.option("header", True).schema("cluster_id string, size long, members string").csv(f"{path}/csv")


@query("incremental_commit", f"WITH RECURSIVE {SCORED}, {COMPONENTS} SELECT cluster_id, member_key FROM members")
def _(spark, d):
    """Customers of one segment in five come later; clusters made step by step equal those made at once."""
    from ..operators.edges import make_edges
    from ..scratch import materialise
    from ..streaming.incremental import commit_batch
    from .common import scored

    late = customers(spark, d).where("c_custkey % 5 = 0").select("key")
    good = materialise(scored(spark, d).where("score >= 0.9"), "matches")
    of_late = good.join(late.select(F.col("key").alias("doc1_key")), "doc1_key", "left_semi").select(F.col("doc1_key").alias("new_key"), F.col("doc2_key").alias("base_key"), "score")
    of_late = of_late.union(good.join(late.select(F.col("key").alias("doc2_key")), "doc2_key", "left_semi").select("doc2_key", "doc1_key", "score")).dropDuplicates(["new_key", "base_key"])
    early = good.join(of_late.select(F.least("new_key", "base_key").alias("doc1_key"), F.greatest("new_key", "base_key").alias("doc2_key")), ["doc1_key", "doc2_key"], "left_anti")
    first = materialise(make_edges(early, "weighted"), "edges")
    return commit_batch(of_late, first, materialise(C.cluster(first), "members"))[1]


@query("incremental_resolve", """
WITH s AS (SELECT 's' || s_suppkey AS k, lower(trim(n_name)) AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0), b AS (SELECT 'n' || n_nationkey AS k, lower(trim(n_name)) AS x FROM nation),
m AS (SELECT s.k AS new_key, b.k AS base_key, row_number() OVER (PARTITION BY s.k ORDER BY b.k) AS n FROM s JOIN b ON left(s.x, 3) = left(b.x, 3) WHERE s.x = b.x)
SELECT base_key AS cluster_id, new_key AS member_key FROM m WHERE n <= 25 UNION SELECT base_key, base_key FROM m WHERE n <= 25""")  # fmt: skip
def _(spark, d):
    from ..operators.edges import make_edges
    from ..streaming.incremental import resolve_and_commit

    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("k"), "n_name")
    s = table(spark, d, "supplier").where("s_suppkey % 2 = 0").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("k"), "n_name")
    nothing = make_edges(spark.createDataFrame([], "doc1_key string, doc2_key string, score double"), "none")
    return resolve_and_commit(s, n, nothing, spark.createDataFrame([], "cluster_id string, member_key string"), "k", ["n_name"], 1.0)["members"]


@query("verdict_parse", """
WITH v AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{"decision": "match", "confidence": 0.' || quality || '}' WHEN 1 THEN 'Sure:' || chr(10) || '```json' || chr(10) || '{"decision": "no_match", "confidence": 0.5, "reasoning": "q' || quality || '"}' || chr(10) || '```'
  WHEN 2 THEN '```{"decision": "match"}``` and more' WHEN 3 THEN '{"decision": "match"' ELSE '{"verdict": "match"}' END AS raw FROM labels),
b AS (SELECT doc_id, trim(CASE WHEN contains(raw, '```') THEN regexp_extract(raw, '(?s)```(?:json)?\\s*(.*?)```', 1) ELSE raw END, chr(10) || ' ') AS body FROM v),
j AS (SELECT doc_id, CASE WHEN json_valid(body) THEN body END AS body FROM b)
SELECT doc_id, body ->> '$.decision' AS decision, CASE WHEN body ->> '$.decision' IS NOT NULL THEN CAST(body ->> '$.confidence' AS DOUBLE) END AS confidence, CASE WHEN body ->> '$.decision' IS NOT NULL THEN body ->> '$.reasoning' END AS reasoning FROM j""")  # fmt: skip
def _(spark, d):
    from ..operators.gates import parse_verdict

    q, k = F.col("quality").cast("string"), F.col("doc_id") % 5
    raw = (
        F.when(k == 0, F.concat(F.lit('{"decision": "match", "confidence": 0.'), q, F.lit("}"))).when(k == 1, F.concat(F.lit('Sure:\n```json\n{"decision": "no_match", "confidence": 0.5, "reasoning": "q'), q, F.lit('"}\n```')))
        .when(k == 2, '```{"decision": "match"}``` and more').when(k == 3, '{"decision": "match"').otherwise('{"verdict": "match"}')
    )
    return table(spark, d, "labels").select("doc_id", parse_verdict(raw).alias("v")).select("doc_id", "v.decision", "v.confidence", "v.reasoning")


@query("validate_identifiers", """
WITH n AS (SELECT p_partkey, unnest([p_name, replace(p_name, ' ', '_'), p_brand, 'p.' || replace(p_name, ' ', '.'), '_' || p_size, p_size || 'x', '']) AS name FROM part)
SELECT p_partkey, name, regexp_full_match(name, '[a-zA-Z][a-zA-Z0-9_]*') AND length(name) <= 256 AS collection, regexp_full_match(name, '[a-zA-Z_][a-zA-Z0-9_]*(\\.[a-zA-Z_][a-zA-Z0-9_]*)*') AS field, regexp_full_match(name, '[a-zA-Z_][a-zA-Z0-9_]*') AS plain FROM n""")
def _(spark, d):
    from ..functions import text as X

    c, size = F.col("p_name"), F.col("p_size").cast("string")
    names = F.array(c, F.replace(c, F.lit(" "), F.lit("_")), F.col("p_brand"), F.concat(F.lit("p."), F.replace(c, F.lit(" "), F.lit("."))), F.concat(F.lit("_"), size), F.concat(size, F.lit("x")), F.lit(""))
    n = table(spark, d, "part").select("p_partkey", F.explode(names).alias("name"))
    return n.select("p_partkey", "name", X.valid_collection("name").alias("collection"), X.valid_field("name").alias("field"), X.valid_field("name", nested=False).alias("plain"))


@query("bulk_import", "SELECT CAST(p_partkey AS VARCHAR) AS _key, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def _(spark, d):
    import uuid

    from ..scratch import shared_folder
    from ..sources import writers as W

    path = f"{shared_folder(spark)}/weftline-bulk-{uuid.uuid4().hex}"
    p = table(spark, d, "part")
    W.write_bulk(p.where("p_partkey % 3 = 0").select("p_partkey", F.upper("p_name").alias("name")), path, "vertices", key="p_partkey")
    there = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("_key"), F.col("p_name").alias("name"))
    return W.bulk_import(there, spark.read.option("header", True).option("escape", '"').schema("_key string, name string").csv(path), on_duplicate="replace")


@query("bulk_import_edges", "SELECT 's/' || l_suppkey AS _from, 'p/' || l_partkey AS _to, count(*) AS n FROM lineitem GROUP BY ALL")
def _(spark, d):
    import uuid

    from ..scratch import shared_folder
    from ..sources import writers as W

    path = f"{shared_folder(spark)}/weftline-bulk-{uuid.uuid4().hex}"
    e = table(spark, d, "lineitem").groupBy(F.concat(F.lit("s/"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("p/"), F.col("l_partkey").cast("string")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    W.write_bulk(e, path, "edges", ends=("a", "b"))
    return spark.read.option("header", True).option("escape", '"').schema("_from string, _to string, n long").csv(path)


@query("ann_index", f"""
WITH s AS (SELECT CAST(a.vec_id AS VARCHAR) AS query, CAST(b.vec_id AS VARCHAR) AS key, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query, key, {r('s + 1')} AS similarity, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, key) AS n FROM s) WHERE n <= 10""")
def _(spark, d):
    """Every vector is indexed; queries are those with an id divisible by 50. Lists that could hold a nearer vector than those
    probed are searched too."""
    from ..operators.nearest import build_index, nearest

    e = table(spark, d, "embeddings")
    found = nearest(build_index(e, "vec_id", "embedding", 64), e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10, exact=True)
    return found.select("query", "key", round_half_up(F.col("similarity") + 1).alias("similarity"), "rank")


@query("advisor_variants", f"""
WITH s AS (SELECT 'brand' AS variant, 150 AS most, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'size', 60, count(*) FROM part GROUP BY p_size UNION ALL SELECT 'both', 150, count(*) FROM part GROUP BY p_brand, p_size),
a AS (SELECT count(*)::DOUBLE AS rows FROM part),
v AS (SELECT variant, coalesce(sum(n * (n - 1) // 2) FILTER (n BETWEEN 2 AND most), 0)::BIGINT AS pairs, max(n) AS largest, coalesce(sum(n) FILTER (n BETWEEN 2 AND most), 0) AS met, coalesce(sum(n) FILTER (n > most), 0) AS skipped FROM s GROUP BY 1),
f AS (SELECT variant, pairs, largest, 0.6 * (met / rows) + 0.15 * (1 - pairs / (rows * (rows - 1) / 2)) + 0.1 * (1 - largest / rows) + 0.15 * (1 - skipped / rows) AS fit FROM v, a)
SELECT variant, pairs, largest, {r('fit', 6)} AS fit, CAST(row_number() OVER (ORDER BY fit DESC, variant) AS INTEGER) AS rank FROM f""")
def _(spark, d):
    got = A.compare_variants(table(spark, d, "part"), "p_partkey", {"brand": (["p_brand"], 150), "size": (["p_size"], 60), "both": (["p_brand", "p_size"], 150)}, "recall_first")
    return got.select("variant", "pairs", "largest", round_half_up("fit", 6).alias("fit"), "rank")


@query("pipeline_stages", f"WITH RECURSIVE {RUN_SQL} SELECT 'scored' AS stage, count(*) AS rows FROM scored UNION ALL SELECT 'pairs', count(*) FROM scored UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'members', count(*) FROM members UNION ALL SELECT 'quality', count(DISTINCT cluster_id) FROM members UNION ALL SELECT 'golden', count(DISTINCT cluster_id) FROM members")
def _(spark, d):
    out = None
    for name, made in R.stages(parts(spark, d), R.Config(**RUN)):
        one = made.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("rows"))
        out = one if out is None else out.union(one)
    return out
