"""Operators on small fixtures, against values worked out by hand or by a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import phonetic as PH
from weftline.functions import similarity as S
from weftline.functions import text as X
from weftline.operators import blocking as B
from weftline.operators import clusters as C
from weftline.operators import edges as E
from weftline.operators import evaluation as V
from weftline.operators import gates as G
from weftline.operators import golden as O
from weftline.operators import learning as L
from weftline.operators import scoring as P
from weftline.operators.components import connected_components
from weftline.operators.predicates import computed, predicate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def components_by_hand(edges):
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in parent}


@pytest.mark.parametrize("seed,n,m", [(1, 30, 20), (2, 200, 150), (3, 50, 400)])
def test_components_equal_union_find(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    edges += [(i, i + 1) for i in range(1000, 1040)]  # a long path
    edges += [(2000, 2000 + i) for i in range(1, 60)]  # a hub
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == components_by_hand(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0
    assert connected_components(spark.createDataFrame([(None, "a"), ("b", "b")], "src string, dst string")).collect() == [("b", "b")]


def test_predicates_are_null_safe(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("",)], "x string")
    keep = lambda rules: [r["x"] for r in df.where(predicate("x", rules)).collect()]
    assert keep({"not_equal": "a"}) == ["b", None, ""]
    assert keep({"not_in": ["a", ""]}) == ["b", None]
    assert keep({"max_length": 0}) == [None, ""]
    assert keep({"not_null": True, "min_length": 1}) == ["a", "b"]
    assert keep({"equals": "a"}) == ["a"]
    with pytest.raises(ValueError):
        predicate("x", {"nope": 1})


def test_computed_fields_refuse_statements_and_unknown_functions(spark):
    assert one(spark, computed("left('abcdef', 3)")) == "abc"
    for bad in ("reflect('java.lang.System', 'exit')", "x; drop table y", "(select 1)"):
        with pytest.raises(ValueError):
            computed(bad)


def test_blocks_keep_null_keys_and_the_size_band(spark):
    df = spark.createDataFrame([("1", None), ("2", None), ("3", "a"), ("4", "a"), ("5", "a"), ("6", "b"), ("", "a")], "k string, v string")
    got = {(r.doc1_key, r.doc2_key) for r in B.block_collect(df, "k", {"v": "v"}).collect()}
    assert got == {("1", "2"), ("3", "4"), ("3", "5"), ("4", "5")}
    assert {(r.doc1_key, r.doc2_key) for r in B.block_collect(df, "k", {"v": "v"}, max_size=2).collect()} == {("1", "2")}
    assert B.block_collect(df.limit(0), "k", {"v": "v"}).count() == 0


def test_sorted_neighbourhood_equals_sorting(spark):
    rng = random.Random(5)
    rows = [(str(i), "".join(rng.choice("abc") for _ in range(4))) for i in range(80)]
    order = [k for k, v in sorted(rows, key=lambda r: (r[1], r[0]))]
    want = {tuple(sorted((order[i], order[j]))) for i in range(80) for j in range(i + 1, min(80, i + 3))}
    got = {(r.doc1_key, r.doc2_key) for r in B.block_sorted_neighborhood(spark.createDataFrame(rows, "k string, v string"), "k", F.col("v"), 2).collect()}
    assert got == want


def test_vector_blocking_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((70, 8))
    rows = [(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)] + [(99, None, 0)]
    df = spark.createDataFrame(rows, "k int, v array<double>, s int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    want = {tuple(sorted((str(i), str(j)))) for i in range(70) for j in range(i) if sim[i, j] >= 0.5}
    assert {(r.doc1_key, r.doc2_key) for r in B.block_vector(df, "k", "v", 0.5, None).collect()} == want
    same = {p for p in want if int(p[0]) % 2 == int(p[1]) % 2}
    assert {(r.doc1_key, r.doc2_key) for r in B.block_vector(df, "k", "v", 0.5, None, "s").collect()} == same


def test_geography_counts_missing_as_near(spark):
    from weftline.functions.expressions import parse_date, within_km

    assert one(spark, within_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0), 1.0))
    assert not one(spark, within_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), 100.0))
    assert [str(one(spark, parse_date(F.lit(s)))) for s in ("2024-02-03", "2024/02/03", "02/03/2024", "2024", "soon")] == ["2024-02-03"] * 3 + ["2024-01-01", "None"]


@pytest.mark.parametrize("a,b,want", [("MARTHA", "MARHTA", 0.9611), ("DIXON", "DICKSONX", 0.8133), ("", "x", 0.0), ("abc", "abc", 1.0), ("abc", "xyz", 0.0)])
def test_jaro_winkler(a, b, want):
    assert round(PH.jaro_winkler(a, b), 4) == want


def test_phonetic_codes(spark):
    assert PH.metaphone("Thompson") == "TMSN" or PH.metaphone("Thompson").startswith("0M")
    assert PH.metaphone("Knight")[0] == "N"
    assert PH.match_rating_codex("Catherine") == "CTHRN"
    assert PH.nysiis("Knight")[0] == "N"
    assert [one(spark, X.soundex_simple(F.lit(w))) for w in ("Robert", "Pfister", "Tymczak", "", "Lee")] == ["R163", "P123", "T520", "0000", "L000"]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, X.e164(lit("(555) 123-4567"))) == "+15551234567"
    assert one(spark, X.state_code(lit("new york"))) == "NY"
    assert one(spark, X.street_suffix(lit("12 main st."))) == "12 MAIN STREET"
    assert one(spark, X.company_suffix(lit("Acme Incorporated"))) == "ACME INC"
    assert one(spark, X.expand_tokens(lit("12 Main St, Apt 4"))) == "12 MAIN STREET"
    assert one(spark, X.missing_sentinels(lit(" N/A "))) == ""
    assert one(spark, X.acronym(lit("Very Large Scale of it"))) == "VLS"
    assert one(spark, X.field_features("last_name", lit("smith"))) == ["Smith", "Smi", one(spark, X.soundex_simple(lit("Smith")))]
    assert one(spark, X.field_value("address", lit("1 oak ave"))) == "1 Oak Avenue"
    assert one(spark, X.valid_email(lit("a@b.co"))) and not one(spark, X.valid_zip(lit("123")))


def test_similarities(spark):
    lit = F.lit
    assert one(spark, S.levenshtein(lit(""), lit(""))) == 1.0
    assert one(spark, S.jaccard(lit(""), lit(""))) == 1.0
    assert one(spark, S.jaccard(lit("a b c"), lit("b c d"))) == 0.5
    assert one(spark, S.ngram_jaccard(lit("ab"), lit("abc"))) == 0.0
    assert one(spark, S.cosine(F.array(lit(0.0)), F.array(lit(1.0)))) == 0.0
    with pytest.raises(ValueError):
        S.algorithm("nope")


def test_weighted_score_null_modes(spark):
    docs = spark.createDataFrame([("1", "ann", None), ("2", "ann", "x")], "k string, a string, b string")
    pairs = spark.createDataFrame([("1", "2")], "doc1_key string, doc2_key string")
    f = [P.Field("a", 0.5, "exact"), P.Field("b", 0.5, "exact")]
    got = [P.score_pairs(pairs, docs, "k", f, nulls=n).first()["score"] for n in ("skip", "zero")]
    assert got == [1.0, 0.5]


def test_edges_upsert_and_verdicts(spark):
    scored = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.8), ("b", "c", 0.7)], "doc1_key string, doc2_key string, score double")
    e = E.make_edges(scored, "m")
    assert sorted((r.src, r.dst, r.similarity) for r in e.collect()) == [("a", "b", 0.9), ("b", "c", 0.7)]
    assert E.insert_edges(e, e).count() == 2
    verdicts = spark.createDataFrame([("b", "a", "no_match", 2), ("a", "b", "match", 1), ("x", "y", "match", 1)], "src string, dst string, decision string, decided int")
    got = {(r.src, r.dst): (r.suppressed, r.confirmed) for r in E.apply_verdicts(e, verdicts).collect()}
    assert got == {("a", "b"): (True, False), ("b", "c"): (False, False), ("x", "y"): (False, True)}


def test_repair_cuts_a_bridge(spark):
    strong = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f")]
    rows = [(x, y, 0.95) for x, y in strong] + [("c", "d", 0.2)]
    e = E.make_edges(spark.createDataFrame(rows, "doc1_key string, doc2_key string, score double"), "m")
    got = C.repair(C.cluster(e), e).collect()
    assert [(r.src, r.dst, r.action) for r in got] == [("c", "d", "remove_edge")]


def test_collective_resolution_spreads_and_converges(spark):
    pairs = spark.createDataFrame([("A", "B"), ("A", "C"), ("A", "D")], "doc1_key string, doc2_key string")
    near = spark.createDataFrame([("B", "acme"), ("C", "acme"), ("D", "acme")], "key string, neighbour string")

    def score(p, n):
        a, b = n.select(F.col("key").alias("doc1_key"), F.col("neighbour").alias("n1")), n.select(F.col("key").alias("doc2_key"), F.col("neighbour").alias("n2"))
        shared = p.join(a, "doc1_key").join(b, "doc2_key").where("n1 = n2").select("doc1_key", "doc2_key").distinct().withColumn("s", F.lit(1.0))
        attr = F.when((F.col("doc1_key") == "A") & (F.col("doc2_key") == "B"), 0.9).otherwise(0.0)
        return p.join(shared, ["doc1_key", "doc2_key"], "left").select("doc1_key", "doc2_key", F.greatest(attr, F.coalesce("s", F.lit(0.0))).alias("score"))

    members, how, rounds = C.collective(pairs, near, score, 0.8)
    assert {r.member_key for r in members.collect()} == {"A", "B", "C", "D"} and how == "converged" and rounds <= 4


SURVIVORS = [("1", "Bob", "bob@a.com", "2024-01-01", "crm"), ("2", "Robert Smith", "bob@b.com", "2026-03-01", "web_signup"), ("3", "Bob", "bob@c.com", "2025-06-01", "import")]


@pytest.mark.parametrize("strategy,field,want", [("voting", "name", "Bob"), ("most_complete", "name", "Robert Smith"), ("most_recent", "email", "bob@b.com"), ("source_priority", "email", "bob@c.com")])
def test_survivorship(spark, strategy, field, want):
    records = spark.createDataFrame(SURVIVORS, "k string, name string, email string, updated_at string, source string")
    members = spark.createDataFrame([("1", m) for m in "123"], "cluster_id string, member_key string")
    got = O.survivors(records, members, "k", {field: strategy}, "updated_at", "source", ["import", "crm", "web_signup"]).first()
    assert got["value"] == want


def test_em_patterns_equal_rows_and_recover(spark):
    rng = np.random.default_rng(0)
    match = rng.random(6000) < 0.2
    g = np.where(match[:, None], rng.random((6000, 3)) < [0.95, 0.9, 0.8], rng.random((6000, 3)) < [0.1, 0.05, 0.2]).astype(float)
    g[rng.random(g.shape) < 0.05] = np.nan
    rows, counts = np.unique(np.nan_to_num(g, nan=-1), axis=0, return_counts=True)
    rows[rows < 0] = np.nan
    a, b = L.em_binary(g, rounds=300), L.em_binary(rows, counts, rounds=300)
    assert np.allclose(a.m, b.m) and np.allclose(a.u, b.u)
    assert np.allclose(a.m, [0.95, 0.9, 0.8], atol=0.06) and np.allclose(a.u, [0.1, 0.05, 0.2], atol=0.04) and abs(a.prior - 0.2) < 0.05
    flipped = L.em_binary(rows, counts, m0=0.1, u0=0.9, prior0=0.8, rounds=300)
    assert flipped.m.mean() > flipped.u.mean()


def test_otsu_finds_the_valley_and_refuses_flat_scores(spark):
    rng = np.random.default_rng(1)
    two = np.concatenate([rng.normal(0.2, 0.05, 3000), rng.normal(0.8, 0.05, 1000)])
    cut, depth, ok = L.auto_threshold(spark.createDataFrame([(float(v),) for v in two], "score double"))
    assert ok and 0.35 < cut < 0.65 and depth > 0.5
    flat = spark.createDataFrame([(0.5,)] * 50, "score double")
    assert L.auto_threshold(flat, fallback=0.77) == (0.77, 0.0, False)


def test_evaluation(spark):
    scored = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.7), ("a", "c", 0.6), ("c", "d", 0.4)], "doc1_key string, doc2_key string, score double")
    truth = V.truth_pairs(spark.createDataFrame([("b", "a"), ("d", "c"), ("x", "y")], "p string, q string"), "p", "q")
    c = V.confusion(scored, truth, 0.5).first()
    assert (c.tp, c.fp, c.fn) == (1, 1, 2) and round(c.candidate_recall, 4) == 0.6667
    sweep = V.exact_sweep(scored, truth).orderBy("threshold").collect()
    assert [r.tp for r in sweep] == [2, 1, 1] and all(x.recall >= y.recall for x, y in zip(sweep, sweep[1:], strict=False))
    m = lambda rows: spark.createDataFrame(rows, "cluster_id string, member_key string")
    got = V.b_cubed(m([("1", "a"), ("1", "b"), ("2", "c")]), m([("x", "a"), ("y", "b"), ("y", "c")])).first()
    assert round(got.precision, 4) == 0.6667 and round(got.recall, 4) == 0.6667


QUALITY = [
    ("e1a", "Acme Corporation", "12 Main Street", "Springfield", "info@acme.com", "5551234567"), ("e1b", "Acme Corporation", "12 Main St", "Springfield", "info@acme.com", None),
    ("e2a", "Globex International", "400 Oak Avenue", "Shelbyville", "sales@globex.com", "5559876543"), ("e2b", "Globex Internationl", "400 Oak Avenue", "Shelbyville", None, "5559876543"),
    ("e3a", "Initech", "9 Pine Road", "Austin", "hello@initech.com", "5550001111"), ("e4a", "Umbrella Labs", "77 River Drive", "Raccoon City", None, "5552223333"), ("e5a", "Hooli", "1 Silicon Way", "Palo Alto", "x@hooli.com", None),
]


def test_matching_quality_gate(spark):
    docs = spark.createDataFrame(QUALITY, "k string, name string, address string, city string, email string, phone string")
    from weftline.operators.blocking import orchestrate

    every = orchestrate({"a": B.block_collect(docs, "k", {"c": F.lit(1)}, max_size=None)})
    f = [P.Field("name", 0.4, "jaro_winkler"), P.Field("address", 0.25, "jaro_winkler"), P.Field("email", 0.2, "jaro_winkler"), P.Field("phone", 0.1, "jaro_winkler"), P.Field("city", 0.05, "jaro_winkler")]
    scored = P.score_pairs(every, docs, "k", f, 0.8)
    members = C.cluster(E.make_edges(scored, "w"), min_size=1)
    truth = spark.createDataFrame([(r[0][:2], r[0]) for r in QUALITY], "cluster_id string, member_key string")
    assert V.pairwise_closure(members, truth).first().f1 >= 0.8


def test_margin_gate_keeps_only_clear_bests(spark):
    scored = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.85), ("d", "e", 0.7)], "doc1_key string, doc2_key string, score double")
    assert [(r.doc1_key, r.doc2_key) for r in G.margin_gate(scored, 0.1).collect()] == [("d", "e")]
    assert {r.doc2_key: round(r.margin, 2) for r in G.best_and_margin(scored).collect()} == {"b": 0.05, "c": 0.0, "e": 0.7}


def test_isotonic_threshold(spark):
    rows = [(0.1, "no_match"), (0.3, "no_match"), (0.6, "match"), (0.9, "match")]
    df = spark.createDataFrame(rows, "score double, decision string")
    assert G.threshold_from_feedback(df, isotonic=True) in (0.6, 0.3, 0.9)
    assert 0.2 < G.threshold_from_feedback(df) < 0.7


def test_sources_and_stream(spark, tmp_path):
    import json

    from weftline.sources import readers as R
    from weftline.streaming.incremental import resolve_stream

    (tmp_path / "w.json").write_text(json.dumps({"customers": [{"id": 1, "n": "a"}, {"id": 2, "n": "b"}]}))
    (tmp_path / "l.json").write_text(json.dumps([{"record_a_id": "1", "record_b_id": "2", "is_match": "yes"}, {"record_a_id": "1", "record_b_id": "3", "is_match": "0"}]))
    assert R.json_records(spark, str(tmp_path / "w.json")).count() == 2
    assert [tuple(r) for r in R.ground_truth(spark, str(tmp_path / "l.json")).collect()] == [("1", "2")]
    base = spark.createDataFrame([("b1", "martha"), ("b2", "zoe")], "k string, n string")
    spark.createDataFrame([("n1", "marhta"), ("n2", "quentin")], "k string, n string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, n string").parquet(str(tmp_path / "in"))
    q = resolve_stream(stream, lambda s: base, "k", ["n"], str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [(r.new_key, r.base_key) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("n1", "b1")]
