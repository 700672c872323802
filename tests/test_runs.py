"""Configured runs, advice, walks and ranks."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import advisor as A
from weftline.operators import embedding as N
from weftline.operators.ranking import global_rank
from weftline.plans.pipeline import Config, run, run_stats

ROWS = [("1", "ann lee", "berlin"), ("2", "ann leee", "berlin"), ("3", "bob ray", "berlin"), ("4", "bob ray", "paris"), ("5", None, "paris"), ("6", "zoe", None)]
CONFIG = {"key": "k", "blocking": {"strategy": "exact", "fields": ["city"]}, "fields": {"name": {"weight": 1.0, "algorithm": "levenshtein"}}, "threshold": 0.8, "golden": {"name": "voting"}}


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(ROWS, "k string, name string, city string")


def test_run_from_json_and_yaml(spark, people, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"entity_resolution": CONFIG}))
    (tmp_path / "c.yaml").write_text(json.dumps(CONFIG))  # JSON is YAML
    for name in ("c.json", "c.yaml"):
        out = run(people, Config.load(str(tmp_path / name)))
        assert [(r.cluster_id, r.member_key) for r in out["members"].orderBy("member_key").collect()] == [("1", "1"), ("1", "2")]
        assert [r["name"] for r in out["golden"].collect()] == ["ann leee"]
        s = run_stats(people, out).first()
        assert (s.records, s.pairs, s.edges, s.clustered, s.clusters) == (6, 4, 1, 2, 1)


@pytest.mark.parametrize("change", [{"blocking": {"strategy": "nope"}}, {"fields": {}}, {"threshold": 3}, {"fields": {"name": {"weight": -1}}}])
def test_bad_configurations_are_refused(change):
    with pytest.raises(ValueError):
        Config(**(CONFIG | change)).checked()


def test_every_strategy_runs(spark):
    df = spark.createDataFrame([(str(i), f"word{i % 3} thing{i % 2} x", [float(i % 3 + 1), 1.0], "NY", "c", "12345") for i in range(8)], "k string, name string, v array<double>, st string, ct string, zip string")
    for blocking in (
        {"strategy": "bm25", "search_field": "name", "threshold": 0.1}, {"strategy": "hybrid", "search_field": "name"}, {"strategy": "vector", "vector": "v"}, {"strategy": "lsh", "vector": "v", "dim": 2},
        {"strategy": "geographic", "kind": "zip_prefix", "zip": "zip"}, {"strategy": "sorted", "field": "name"}, {"strategy": "phonetic", "field": "name"},
    ):
        out = run(df, Config("k", blocking, {"name": {"algorithm": "jaro_winkler"}}, 0.99))
        assert out["scored"].where("doc1_key >= doc2_key").count() == 0 and out["members"].count() >= 0


def test_automatic_threshold_runs(people):
    assert run(people, Config(**(CONFIG | {"threshold": "auto"})))["edges"].count() >= 0


def test_ranks_are_global(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("a"), "id")
    got = [(r.rank, r.a, r.id) for r in global_rank(df, ["a", "id"]).orderBy("rank").collect()]
    assert [g[0] for g in got] == list(range(1, 1001)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert global_rank(df.limit(0), ["a", "id"]).count() == 0


def test_walks_follow_edges_and_embeddings_separate(spark):
    ring = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(5) for j in range(i)]
    edges = ring("a") + ring("b") + [("a0", "b0")]
    df = spark.createDataFrame(edges, "src string, dst string")
    walks = {}
    for r in N.random_walks(df, walks=2, length=6).collect():
        walks.setdefault(r.walk, {})[r.step] = r.node
    allowed = {frozenset(e) for e in edges}
    assert len(walks) == 20 and all(frozenset((w[i], w[i + 1])) in allowed for w in walks.values() for i in range(5))
    pairs = {(r.doc1_key, r.doc2_key): r.similarity for r in N.block_graph_embedding(df, threshold=-1.0, limit=None, dim=4).collect()}
    mean = lambda same: [s for (x, y), s in pairs.items() if (x[0] == y[0]) == same]
    assert sum(mean(True)) / len(mean(True)) > sum(mean(False)) / max(1, len(mean(False)))
    with pytest.raises(ValueError):
        N.node2vec(df, most_nodes=3)


def test_advice(spark, people):
    types = {r.field: r.type for r in A.field_types(spark.createDataFrame([("a@b.co", "555-123-4567", "2024-01-02", "12.5", f"AB-{i}", "Ann Lee", "Acme Inc", "12 Main St") for i in range(3)], "e string, p string, d string, n string, i string, w string, o string, s string"), list("epdniwos")).collect()}
    assert types == {"e": "email", "p": "phone", "d": "date", "n": "numeric", "i": "id", "w": "person_name", "o": "org_name", "s": "address"}
    got = {r.fields: (r.pairs, r.largest) for r in A.blocking_candidates(people, ["city", "name"]).collect()}
    assert got["city"] == (4, 3) and got["city + name"] == (0, 1)
    assert A.recommend(A.blocking_candidates(people, ["city", "name"]), 10)["strategy"] == "exact"
    assert A.recommend(A.blocking_candidates(people, ["city"]), 1)["strategy"] == "bm25"
