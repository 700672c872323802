"""F1, pipeline: what Python workers of its stages hold beside an executor's heap."""

import tracemalloc

import numpy as np

from weftline.llm import decontaminate, similar, tokens


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sketches_of_near_duplicates_take_one_worker(spark, monkeypatch):
    """Shingle sets, band keys and fingerprints come from one Python function: two in a task were two workers a core."""
    seen, real = {}, similar.materialise
    monkeypatch.setattr(similar, "materialise", lambda df, name="cut": seen.setdefault(name, plan(df)) and real(df, name))
    texts = ["one two three four five six", None, "", "One  two three four five six", "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component for r in similar.near_duplicates(docs).collect()}
    assert found == {0: 0, 1: 1, 2: 1, 3: 0, 4: 4}
    assert seen["prints"].count("ArrowEvalPython") == 1


def test_fingerprints_beside_keys_are_those_of_simhash(spark):
    texts = ["a b c d e", None, "", " \t", "\xc9t\xe9 A b C", "one two", "w " * 3000]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    both = similar.simhash.with_fingerprint(similar.with_id(docs, keys=True, prints=True), to="fp").collect()
    assert len(both) == len(texts)
    assert all(r.s.print == r.fp and len(r.s["keys"]) == similar.BANDS for r in both)


def test_passages_reach_the_factors_without_python_rows(spark, monkeypatch):
    """Rows of Python objects go through Python workers of another environment, a second set in each executor."""
    seen, real = [], decontaminate.randomised_svd
    monkeypatch.setattr(decontaminate, "randomised_svd", lambda rows, *a: seen.append((plan(rows), rows.collect())) or real(rows, *a))
    docs = spark.createDataFrame([(1, "some words that stand here"), (2, "others")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "some words that stand here " * 20), (2, "others do")], "item_id long, text string")
    (index,) = decontaminate.build(docs, benchmark)
    ((found, rows),) = seen
    assert "LocalTableScan" in found and "ExistingRDD" not in found
    assert len(rows) == len(index.items) and all(len(r.at) == len(r.value) for r in rows)


def test_token_workers_give_memory_back_by_chunk(spark, tmp_path, monkeypatch):
    """After the pieces of a chunk and after its blocks, and not at the end of a task alone."""
    said = str(tmp_path / "said")

    def note():
        with open(said, "a") as f:
            f.write("x")

    monkeypatch.setattr(tokens, "give_back", note)
    monkeypatch.setattr(tokens, "CHUNK", 1 << 10)
    docs = spark.createDataFrame([(i, "some words " * 100) for i in range(20)], "doc_id long, text string")
    written = tokens.write(docs, tokens.default_tokenizer(), partitions=1)
    chunks = written.count()
    assert chunks == 20
    with open(said) as f:
        assert len(f.read()) >= 2 * chunks


def test_ids_are_spread_in_little_room():
    """Beside what is returned, as much again, and not the places of a million words' ids in 64 bits three times over."""
    start, at = np.arange(0, 4 * 1000 + 1, 4), np.arange(1 << 20) % 1000
    flat = np.arange(4000, dtype=np.int32)
    tracemalloc.start()
    out, ends = tokens._spread(flat, start, at)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (out.reshape(-1, 4) == flat.reshape(-1, 4)[at]).all() and (ends == np.arange(0, 4 * len(at) + 1, 4)).all()
    assert peak < 2 * (out.nbytes + ends.nbytes)
