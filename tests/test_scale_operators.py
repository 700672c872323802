"""Operators that stand in for all-pairs work, and the steps of incremental runs, against plain loops."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import phonetic as PH
from weftline.functions import text as X
from weftline.operators import advisor as A
from weftline.operators import blocking as B
from weftline.operators import clusters as C
from weftline.operators import edges as E
from weftline.operators import gates as G
from weftline.operators import linkage as K
from weftline.operators import nearest as N
from weftline.plans import common
from weftline.plans import pipeline as R
from weftline.sources import writers as W
from weftline.streaming import incremental as I


def test_blocking_keeps_its_pairs_as_tables_grow(spark):
    """150,000 customers: blocks of 1,200 by nation and segment, which a cap of 200 alone would leave out."""
    n = F.col("id")
    customers = spark.range(150_000).select(
        n.cast("string").alias("key"), (F.pmod(F.xxhash64(n), F.lit(25))).alias("c_nationkey"), F.pmod(F.xxhash64(n, F.lit(1)), F.lit(5)).alias("c_mktsegment"), (F.pmod(F.xxhash64(n, F.lit(2)), F.lit(1_100_000)) / 100 - 1000).alias("c_acctbal")
    )
    found = B.blocks(customers, "key", **common.BLOCKS)
    size = found.agg(F.count(F.lit(1)).alias("n"), F.max("block_size").alias("most"), F.sum(F.col("block_size") - 1).alias("pairs")).first()
    assert size.n == 150_000 and size.most <= 200 and size.pairs / 2 > 5_000_000
    assert B.skipped_blocks(customers, common.BLOCKS["by"], 200, split="c_acctbal").count() == 0
    assert B.blocks(customers, "key", common.BLOCKS["by"], max_size=200).count() == 0


def test_split_blocks_equal_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(str(i), rng.choice("abc"), rng.choice([None, 1.0, rng.random() * 50])) for i in range(200)] + [(f"x{i}", None, 3.0) for i in range(9)]
    got = {(r._1, r._2) for r in B.block_collect(spark.createDataFrame(rows, "k string, g string, v double"), "k", {"g": "g"}, max_size=8, split="v").select(F.col("doc1_key").alias("_1"), F.col("doc2_key").alias("_2")).collect()}
    want, band = set(), {}
    for g in (*"abc", None):
        own = [(k, v) for k, x, v in rows if x == g]
        values = [v for _, v in own if v is not None]
        low, high, n = min(values), max(values), -(-len(own) * 2 // 8)
        for k, v in own:
            at = min(n - 1, int((v - low) / (high - low) * n)) if len(own) > 8 and v is not None and high > low else 0
            band.setdefault((g, at), []).append(k)
    for keys in band.values():
        if 2 <= len(keys) <= 8:
            want |= set(itertools.combinations(sorted(keys), 2))
    assert got == want


def test_bridges_equal_removal(spark):
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(2, 14)
        pairs = {(min(a, b), max(a, b)) for a, b in ((i, rng.randrange(i)) for i in range(1, n))}
        pairs |= {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(0, 5))}
        want = {}
        for cut in pairs:
            side, rest = {cut[0]}, pairs - {cut}
            while more := {x for p in rest for x in p if set(p) & side} - side:
                side |= more
            if cut[1] not in side:
                want[cut] = {(len(side), sum(set(p) <= side for p in rest)), (n - len(side), sum(not set(p) & side for p in rest))}
        got = C.bridges(n, sorted(pairs))
        assert got.keys() == want.keys() and all(got[p] in want[p] for p in got)
    assert C.bridges(4, [(0, 1), (2, 3)]) == {}


def test_crowded_clusters_are_queued(spark):
    e = E.make_edges(spark.createDataFrame([("a", "b", 0.2), ("b", "c", 0.3)], "doc1_key string, doc2_key string, score double"), "m")
    assert [r.action for r in C.repair(C.cluster(e), e, most_edges=1).collect()] == ["queue"]


@pytest.mark.parametrize("block", [7, 2000])
def test_names_meet_their_best_whatever_their_letters(spark, block):
    rng = random.Random(3)
    letters = "abcdeé "
    entities = ["Martha Jones", "Aartha Jonez", "", None, *{"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(40)}]
    mentions = ["Aartha Jonez", "martha  jones", "", *{"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(40)}]
    got = {r.mention: (r.entity, r.score) for r in K.names_to_hub(spark.createDataFrame([(x,) for x in mentions], "mention string"), spark.createDataFrame([(x,) for x in entities], "entity string"), block=block).collect()}
    want = {}
    for m in mentions:
        scored = [(-PH.jaro_winkler(m.lower().strip(" "), e.lower().strip(" ")), e) for e in entities if e]
        best = min(scored)
        if m.strip(" ") and -best[0] >= 0.7:
            want[m] = (best[1], -best[0])
    assert got == want


def test_pruned_bm25_equals_all_pairs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    rows = [(f"d{i}", " ".join(words[int(rng.random() ** 3 * 60)] for _ in range(rng.randint(0, 25)))) for i in range(80)]
    post = B.postings(spark.createDataFrame(rows, "k string, t string"), "k", "t").cache()
    every = {(r.d1, r.d2): r.bm25 for r in B.bm25_scores(post, post).collect()}
    for over in (0.5, 6.0, 20.0):
        got = {(r.d1, r.d2): r.bm25 for r in B.bm25_scores(post, post, over=over).collect()}
        assert got == pytest.approx({k: v for k, v in every.items() if v > over}) and len(got) < len(every)
    grouped = [(k, t, None if n % 3 == 0 else f"g{n % 3}") for n, (k, t) in enumerate(rows)]
    group = {k: g for k, _, g in grouped}
    top = B.block_bm25(spark.createDataFrame(grouped, "k string, t string, g string"), "k", "t", 6.0, 1000, "g").collect()
    assert {(r.d1, r.d2): r.bm25 for r in top} == pytest.approx({(a, b): v for (a, b), v in every.items() if v > 6.0 and group[a] == group[b]}, abs=1e-5)


def test_vector_index_recall_and_exactness(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16))
    x = centres[rng.integers(0, 30, 2000)] + 0.35 * rng.standard_normal((2000, 16))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(5000, None), (5001, [1.0])], "id long, v array<double>")
    index = N.build_index(df, "id", "v", 16)
    assert index.rows.count() == 2000 and len(index.centroids) == 44
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = df.where("id % 50 = 0 and id < 2000")
    near = {i: set(np.argsort(-(unit @ unit[i]), kind="stable")[1:11]) for i in range(0, 2000, 50)}
    hit = lambda probes: sum(int(r.key) in near[int(r.query)] for r in N.nearest(index, asked, "id", "v", 10, probes=probes).collect()) / 400
    assert hit(None) == 1.0 and hit(8) >= 0.9
    with pytest.raises(ValueError):
        N.build_index(df.limit(0), "id", "v", 16)


def test_lsh_rerank(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((20, 8)), 3, axis=0) + 0.01 * rng.standard_normal((60, 8))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, v array<double>")
    got = {(int(r.doc1_key), int(r.doc2_key)) for r in B.block_lsh(df, "id", "v", 8, threshold=0.99).collect()}
    assert {tuple(sorted(p)) for p in got} == {p for p in itertools.combinations(range(60), 2) if p[0] // 3 == p[1] // 3}


def test_commits_by_batches_equal_one_clustering(spark):
    rng = random.Random(7)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(55)})
    rows = [(f"k{a:02}", f"k{b:02}", 0.9) for a, b in pairs]
    make = lambda x: spark.createDataFrame(x, "doc1_key string, doc2_key string, score double")
    edges = E.make_edges(make(rows[:20]), "m").withColumn("suppressed", F.col("src") == rows[0][0])
    members = C.cluster(edges)
    for lo in range(20, 55, 9):
        batch = make(rows[lo - 3 : lo + 9]).select(F.col("doc2_key").alias("new_key"), F.col("doc1_key").alias("base_key"), "score")
        edges, members = I.commit_batch(batch, edges, members)
    assert edges.count() == len(rows) and edges.where("suppressed").count() == sum(a == rows[0][0] for a, *_ in rows[:20])
    assert sorted(map(tuple, members.collect())) == sorted(map(tuple, C.cluster(edges).collect()))


def test_watch_keeps_state_by_batch(spark, tmp_path):
    schema = "k string, name string"
    base = spark.createDataFrame([("b1", "anna smith"), ("b2", "carl jones")], schema)
    E.make_edges(spark.createDataFrame([], "doc1_key string, doc2_key string, score double"), "m").write.parquet(f"{tmp_path}/state/0/edges")
    spark.createDataFrame([], "cluster_id string, member_key string").write.parquet(f"{tmp_path}/state/0/members")
    spark.createDataFrame([("n1", "anna smith"), ("n2", "nobody else")], schema).coalesce(1).write.json(f"{tmp_path}/in")
    told = []
    start = lambda: I.watch(spark.readStream.schema(schema).json(f"{tmp_path}/in"), lambda s: base, "k", ["name"], f"{tmp_path}/state", f"{tmp_path}/check", on_batch=told.append).awaitTermination()
    start()
    spark.createDataFrame([("n3", "carl jones")], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    start()
    assert told == [0, 1]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/state/2/members").collect())) == [("b1", "b1"), ("b1", "n1"), ("b2", "b2"), ("b2", "n3")]
    assert {r.key for r in spark.read.parquet(f"{tmp_path}/state/1/resolved").collect()} == {"n1", "n2"}


def test_verdicts_of_models_are_parsed(spark):
    raw = ['{"decision": "match", "confidence": 0.9, "reasoning": "same"}', 'x ```json\n{"decision": "no_match"}\n``` y ```{"decision": "z"}```', "```\n[1]\n```", "", None, "not json", '{"decision": "match"', '["decision"]', '{"confidence": 1}']
    got = [r.v and (r.v.decision, r.v.confidence, r.v.reasoning) for r in spark.createDataFrame(enumerate(raw), "i int, t string").orderBy("i").select(G.parse_verdict("t").alias("v")).collect()]
    assert got == [("match", 0.9, "same"), ("no_match", None, None), *[None] * 7]


def test_bulk_files_and_duplicates(spark, tmp_path):
    old = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], "_key string, v string, w string")
    new = spark.createDataFrame([("2", 'q "quoted", text', None), ("3", "c", "z")], "k string, v string, w string")
    W.write_bulk(new, f"{tmp_path}/v", "vertices", key="k")
    read = spark.read.option("header", True).option("escape", '"').schema("_key string, v string, w string").csv(f"{tmp_path}/v")
    rows = lambda how: sorted(map(tuple, W.bulk_import(old, read, on_duplicate=how).collect()))
    assert rows("ignore") == [("1", "a", "x"), ("2", "b", "y"), ("3", "c", "z")]
    assert rows("replace") == [("1", "a", "x"), ("2", 'q "quoted", text', None), ("3", "c", "z")]
    assert rows("update") == [("1", "a", "x"), ("2", 'q "quoted", text', "y"), ("3", "c", "z")]
    for how in ("error", "other"):
        with pytest.raises(ValueError):
            rows(how)
    with pytest.raises(ValueError):
        W.write_bulk(new, f"{tmp_path}/w", "others")


def test_identifiers(spark):
    names = [("companies", True, True), ("a_1", True, True), ("1a", False, False), ("_x", False, True), ("a.b", False, True), ("a..b", False, False), ("'; DROP", False, False), ("", False, False), ("a" * 257, False, False), (None, False, False)]
    got = [(r.c, r.f) for r in spark.createDataFrame([(i, n) for i, (n, *_) in enumerate(names)], "i int, n string").orderBy("i").select(X.valid_collection("n").alias("c"), X.valid_field("n").alias("f")).collect()]
    assert got == [(c, f) for _, c, f in names]


def test_exported_configuration_runs_and_reports(spark, tmp_path):
    rows = [(str(i), f"Person {chr(65 + i // 2)} Smith", f"{i // 2:05}-X{i // 2}") for i in range(10)]
    df = spark.createDataFrame(rows, "id string, name string, code string")
    ranked = A.compare_variants(df, "id", {"code": (["code"], 10), "all": (["code", "name"], 10), "none": (["id"], 10)}).orderBy("rank").collect()
    assert [r.pairs for r in ranked] == [5, 5, 0] and ranked[0].recall == 1.0 and ranked[2].recall == 0.0
    path = tmp_path / "c.json"
    path.write_text(A.export_config(df, "id", ["name", "code"], (["code"], 10), threshold=0.9))
    told = []
    out = R.run(df, R.Config.load(str(path)), told.append)
    assert out["members"].count() == 10 and [t["stage"] for t in told] == ["pairs", "scored", "edges", "members", "quality"] and json.loads(path.read_text())["entity_resolution"]["key"] == "id"


def test_node_embeddings_equal_the_dense_factors(spark):
    from weftline.operators import embedding as M

    rng = random.Random(8)
    pairs = {tuple(sorted(rng.sample("abcdefghijkl", 2))) for _ in range(18)}
    df = spark.createDataFrame(sorted(pairs), "src string, dst string")
    got = {r.key: np.array(r.embedding) for r in M.node2vec(df).collect()}
    counts = M.cooccurrence(M.random_walks(df)).collect()
    names = sorted({r.a for r in counts})
    m = np.zeros((len(names), len(names)))
    for r in counts:
        m[names.index(r.a), names.index(r.b)] = r.n
    mass = m.sum(axis=1)
    with np.errstate(divide="ignore"):
        pmi = np.maximum(np.log(m * m.sum() / np.outer(mass, mass)), 0)
    u, s, _ = np.linalg.svd(pmi)
    want = u * np.sqrt(s)
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    x = np.stack([got[k] for k in names])
    assert names == sorted(got) and np.allclose(x @ x.T, want @ want.T, atol=1e-5)
