"""Cases of the second review that the driver's small tables don't have."""

import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from tests import oracle
from weftline.plans import catalogue


def agree(spark, folder, name, **tables):
    """The query named gives its SQL's rows over these tables."""
    con = duckdb.connect()
    for t, df in tables.items():
        shutil.rmtree(f"{folder}/{t}.parquet", ignore_errors=True)
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    found = catalogue.QUERIES[name](spark, str(folder))
    rel = con.sql(catalogue.ORACLES[name])
    assert sorted(found.columns) == sorted(rel.columns)
    got, want = oracle.rows(found.columns, found.collect()), oracle.rows(rel.columns, rel.fetchall())
    assert got == want
    return want


def many_parts(spark, n, same=1):
    """n parts in one block, of some names and types."""
    i = F.floor(F.col("id") / same)
    return spark.range(n).select(F.col("id").alias("p_partkey"), F.concat(F.lit("red "), F.array(*map(F.lit, ("bolt", "ring", "nut", "cog")))[(i % 4).cast("int")], F.when(i % 3 == 0, " x").otherwise("")).alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.when(i % 2 == 0, "LARGE").otherwise("SMALL TIN").alias("p_type"), F.lit(7).alias("p_size"), (F.col("id") * 1.5).alias("p_retailprice"))


@pytest.mark.parametrize("n", [40, 60])
def test_run_stats_without_pairs(spark, tmp_path, n):
    """blocks over the cap leave no pairs, and a match rate of none is no number."""
    agree(spark, tmp_path, "pipeline_run_stats", part=many_parts(spark, n))


@pytest.mark.parametrize("name", ["alg_ngram_jaccard", "sim_weighted_skip", "sim_weighted_zero"])
def test_pairs_of_blocks_by_classes(spark, tmp_path, name):
    """copies, missing values, and blocks without a brand, which make no pairs; pairs are never shuffled."""
    part = many_parts(spark, 60, 5).withColumn("p_brand", F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")))
    assert len(agree(spark, tmp_path, name, part=part)) == 45 * 44 // 2
    plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("ShuffledHashJoin")]


def some_vectors(spark, n, dim=8):
    """Vectors of three labels or none, with copies, one without length and one missing."""
    import random

    rng = random.Random(3)
    drawn = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(n)]
    rows = [(i, drawn[i // 2 if i % 7 == 0 else i], i % 3 if i % 11 else None) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def test_index_gives_the_nearest_of_all(spark, tmp_path):
    """more lists than are probed, and copies that tie."""
    import random

    rng = random.Random(4)
    drawn = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(2500)]
    rows = [(i, drawn[i % 2500]) for i in range(5200)]
    agree(spark, tmp_path, "ann_index", embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>"))


def test_cosine_of_all_pairs_by_blocks(spark, tmp_path, monkeypatch):
    """several blocks a label; pairs are made as products of matrices."""
    from weftline.operators import blocking

    e = some_vectors(spark, 300)
    agree(spark, tmp_path, "alg_cosine", embeddings=e)
    want = {(r.a, r.b): r.cosine for r in blocking.cosine_pairs(e, "vec_id", "embedding", "label").collect()}
    got = blocking.cosine_pairs(e, "vec_id", "embedding", "label", 17).collect()
    assert len(got) == len(want) and all(abs(want[r.a, r.b] - r.cosine) < 1e-12 for r in got)
    odd = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, blocking.cosine_pairs(odd, "vec_id", "embedding", "label").collect()), key=str) == [(1, 2, None), (1, 3, 0.0), (2, 3, None)]


def people(spark, n, m):
    s = spark.range(n).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("Supplier#00"), (F.col("id") % 40).cast("string")).alias("s_name"), F.when(F.col("id") % 13 != 0, F.col("id") % 3).cast("int").alias("s_nationkey"), F.when(F.col("id") % 17 != 0, (F.col("id") * 37 % 4000) + 0.25 * (F.col("id") % 4)).cast("double").alias("s_acctbal"))
    c = spark.range(m).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Customer#00"), (F.col("id") % 70).cast("string")).alias("c_name"), F.when(F.col("id") % 11 != 0, F.col("id") % 2).cast("int").alias("c_nationkey"), F.when(F.col("id") % 19 != 0, (F.col("id") * 7 % 300) + 0.03 * (F.col("id") % 9) - 1300.0 * (F.col("id") % 2)).cast("double").alias("c_acctbal"), F.lit("X").alias("c_mktsegment"))
    return {"supplier": s, "customer": c}


@pytest.mark.parametrize("name", ["hub_resolve", "xmatch_levenshtein", "xmatch_bm25"])
@pytest.mark.parametrize("m", [3, 600])
def test_best_matches_by_classes(spark, tmp_path, name, m):
    """copies of names and balances, missing balances and nations, and hubs out of reach."""
    found = agree(spark, tmp_path, name, **people(spark, 200, m))
    plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert found and (name != "hub_resolve" or "SortMergeJoin" not in plan.split("FlatMapCoGroups")[1])


def test_near_duplicate_stage_finds_simhash_groups(spark, monkeypatch):
    """SimHash brings texts together by itself, without any MinHash key; the sets decide."""
    import random

    import corpus_pipeline as P
    from weftline.llm import similar

    rng = random.Random(5)
    words = [f"w{rng.randint(0, 9000)}" for _ in range(3000)]
    near, other = [*words[:1500], "other", *words[1501:]], [f"v{rng.randint(0, 9000)}" for _ in range(3000)]
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate((words, near, other))]
    monkeypatch.setattr(similar, "BANDS", 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.drop_near_duplicates(spark, docs, "").select("doc_id").collect()) == [0, 2]


def linked(spark, n, m, k):
    """n suppliers of three nations or none, and lines of suppliers, some of them unknown, with parts; lines repeat and lack ends."""
    i = F.col("id")
    s = spark.range(n).select(i.alias("s_suppkey"), F.when(i % 11 != 0, i % 3).cast("int").alias("s_nationkey"))
    lines = spark.range(m).select(F.when(i % 29 != 0, F.pmod(F.xxhash64("id"), F.lit(n + 3))).alias("l_suppkey"), F.when(i % 13 != 0, F.pmod(F.xxhash64(i, F.lit(1)), F.lit(k))).alias("l_partkey"))
    every = spark.range(n).where("id % 7 <> 3").select(i.alias("l_suppkey"), F.lit(-1).cast("long").alias("l_partkey"))
    return {"supplier": s, "lineitem": lines.union(every)}


def test_shared_neighbours_of_blocks(spark, tmp_path):
    """missing nations and ends, a part of nearly all, suppliers without lines; no join of pairs with neighbourhoods."""
    found = agree(spark, tmp_path, "neighbour_features", **linked(spark, 70, 300, 40))
    assert {r[0] for r in found} == {'True', 'False'}
    plan = catalogue.QUERIES["neighbour_features"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "Join" not in plan.split("FlatMapCoGroups")[0]


@pytest.mark.parametrize(("size", "links"), [(1000, 1 << 21), (7, 1 << 21), (1000, 40)])
def test_shared_neighbours_by_parts_of_blocks(spark, size, links):
    """F2: the parts that a block is dealt into don't show, and pairs are scored as by themselves."""
    from weftline.operators import scoring

    t = linked(spark, 70, 900, 25)
    s = t["supplier"].where("s_nationkey is not null").withColumn("k", F.concat(F.lit("s"), "s_suppkey"))
    lines = t["lineitem"].where("l_partkey is not null").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("neighbour"))
    got = scoring.block_graph_features(s, "s_suppkey", "k", "s_nationkey", lines, size=size, links=links).collect()
    pairs = s.select(F.col("k").alias("doc1_key"), "s_nationkey").join(s.select(F.col("k").alias("doc2_key"), "s_nationkey"), "s_nationkey").where("doc1_key < doc2_key")
    want = scoring.graph_features(pairs, lines.select(F.concat(F.lit("s"), "key").alias("src"), F.concat(F.lit("p"), "neighbour").alias("dst"))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r.shared_neighbours for r in got}) > 2


def test_bm25_best_without_pairs(spark, tmp_path):
    """F8: groups and none, copies that tie, texts that are missing or short; documents that reach the threshold aren't paired in Spark."""
    import random

    rng = random.Random(6)
    texts = [" ".join(f"w{int(rng.random() ** 2 * 6000)}" for _ in range(900 if n == 7 else rng.randint(0, 1400))) for n in range(120)]
    rows = [(i, None if i % 31 == 5 else texts[7 if i % 4 == 0 else i % 120].upper(), None if i % 3 == 0 else f"s{i % 3}") for i in range(260)]
    found = agree(spark, tmp_path, "block_bm25", documents=spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert len(found) > 1000
    plan = catalogue.QUERIES["block_bm25"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize(("postings", "frequent"), [(1 << 22, 0.25), (300, 0.25), (300, 2.0), (1 << 22, 0.0)])
def test_bm25_best_by_parts(spark, monkeypatch, postings, frequent):
    """F8: neither the parts of the index nor what is held as a matrix shows."""
    import random

    from weftline.operators import blocking, search

    monkeypatch.setattr(search, "FREQUENT", frequent)
    monkeypatch.setattr(search, "MANY", 5)
    rng = random.Random(7)
    rows = [(f"d{i}", " ".join(f"w{int(rng.random() ** 3 * 90)}" for _ in range(rng.randint(0, 25))), f"g{i % 5 // 2}") for i in range(130)]
    df = spark.createDataFrame(rows, "k string, t string, g string")
    post = blocking.postings(df, "k", "t", "g")
    for over in (0.0, 6.0):
        every = blocking.bm25_scores(post, post).withColumn("bm25", F.floor(F.col("bm25") * 1e6 + 0.5) / 1e6).where(F.col("bm25") > over)
        want = {(r.d1, r.d2, r.rank): r.bm25 for r in blocking.top_k(every, "d1", "bm25", 4, "d2").collect()}
        best = search.bm25_top(blocking._words(df, "k", "t", "g"), over, 4, postings=postings)
        got = {(r.d1, r.d2, r.rank): r.bm25 for r in blocking.top_k(best, "d1", "bm25", 4, "d2").collect()}
        assert got == pytest.approx(want, abs=1e-5) and len(got) > 200
