"""Exact search of large corpora by cells: equal to comparing everything, with few comparisons."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlake.operators import cells, similarity

SCHEMA = "corpus_id long, vector array<double>, extra string"


def brute(queries: dict, corpus: dict, k: int) -> dict:
    def unit(v):
        n = np.sqrt(np.dot(v, v))
        return np.asarray(v, float) / (n if n > 0 else 1.0)

    ids = sorted(corpus)
    rows = np.stack([unit(corpus[i]) for i in ids])
    out = {}
    for q, v in queries.items():
        sims = np.round(rows @ unit(v), 6)
        order = sorted(range(len(ids)), key=lambda j: (-sims[j], ids[j]))[:k]
        out[q] = [(str(ids[j]), pytest.approx(sims[j], abs=2e-6)) for j in order]
    return out


def found(df) -> dict:
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r[0], r["rank"])):
        out.setdefault(r[0], []).append((r["match_id"], r["similarity"]))
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(similarity, "MAX_CORPUS", 5)
    monkeypatch.setattr(cells, "SHARD_ROWS", 16)
    monkeypatch.setattr(cells, "SLICE_ROWS", 8)


def clustered(n: int, seed: int = 0) -> dict:
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(8, 12))
    return {i: heads[i % 8] + 0.05 * rng.normal(size=12) for i in range(n)}


def test_equal_to_brute_force(spark, small):
    corpus = clustered(400)
    corpus |= {1000 + i: np.ones(12) for i in range(250)}  # one vector held by a third of the rows
    corpus |= {2000: np.zeros(12), 2001: 1e200 * np.ones(12)}
    queries = {i: v for i, v in clustered(60, 1).items()} | {900: np.zeros(12), 901: np.ones(12), 902: -np.ones(12)}
    bad = [(5000, None, "x"), (5001, [1.0] * 11, "x"), (5002, [1.0] * 13, "x"), (5003, [None] + [1.0] * 11, "x"), (5004, [float("nan")] * 12, "x"), (5005, [], "x"), (None, [1.0] * 12, "x")]
    c = spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in corpus.items()] + bad, SCHEMA)
    q = spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in queries.items()] + bad[:6], SCHEMA).withColumnRenamed("corpus_id", "id")
    want = brute(queries, {i: (v if i != 2001 else np.ones(12)) for i, v in corpus.items()}, 5)
    assert found(similarity.top_k(q, "id", c, 5, vector_col="vector")) == want


def test_both_sizes_agree_on_odd_vectors(spark, monkeypatch):
    rows = [(1, [1.0, 0.0], "x"), (2, None, "x"), (3, [1.0], "x"), (4, [0.0, 2.0], "x"), (5, [3.0, 0.0], "x"), (6, [None, 1.0], "x"), (7, [0.0, 0.0], "x")]
    c = spark.createDataFrame(rows, SCHEMA)
    q = c.select(F.col("corpus_id").alias("id"), "vector")
    got = []
    for limit in (4096, 2):
        monkeypatch.setattr(similarity, "MAX_CORPUS", limit)
        got.append(found(similarity.top_k(q, "id", c, 3, vector_col="vector")))
    assert got[0] == got[1]
    assert got[0] == {1: [("1", 1.0), ("5", 1.0), ("4", 0.0)], 4: [("4", 1.0), ("1", 0.0), ("5", 0.0)], 5: [("1", 1.0), ("5", 1.0), ("4", 0.0)], 7: [("1", 0.0), ("4", 0.0), ("5", 0.0)]}


def test_repeated_and_null_queries_keep_their_rows(spark, small):
    corpus = spark.createDataFrame([(i, f"word{i} word{i + 1} common text") for i in range(40)], "corpus_id int, text string")
    queries = spark.createDataFrame([(1, "word3 word4 common text"), (1, "word3 word4 common text"), (2, None), (3, ""), (None, "word7 word8")], "id int, text string")
    rows = similarity.with_matches(queries, "id", "text", corpus, 2, "m").collect()
    assert len(rows) == 5 and all(len(r["m"]) == 2 for r in rows)
    by_text = {r["text"]: [m["match_id"] for m in r["m"]] for r in rows}
    assert by_text["word3 word4 common text"][0] == "3" and by_text["word7 word8"][0] == "7" and by_text[""] == by_text[None] == ["0", "1"]


def test_empty_tables(spark, small):
    c = spark.createDataFrame([(i, [float(i), 1.0], "x") for i in range(30)], SCHEMA)
    none = c.limit(0).withColumnRenamed("corpus_id", "id")
    assert similarity.top_k(none, "id", c, 3, vector_col="vector").count() == 0
    assert similarity.top_k(c.withColumnRenamed("corpus_id", "id"), "id", c.limit(0), 3, vector_col="vector").count() == 0


def test_bounds_leave_out_most_cells(spark, small):
    corpus = spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in clustered(900).items()], SCHEMA)
    units = cells.with_units(corpus, 12)
    index = cells.build(units, units, 5)
    asked = cells.with_units(spark.createDataFrame([(i, [float(x) for x in v], "x") for i, v in clustered(40, 1).items()], SCHEMA), 12)
    asked = asked.select(cells.query_key().alias("query_key"), "vector")
    first = cells.visits(asked, index, 5).count()
    kth = cells.search(asked, index, 5).where("rank = 5").select("query_key", F.col("similarity").alias("kth"))
    assert first + cells.visits(asked.join(kth, "query_key"), index, 5).count() < 0.4 * asked.count() * len(index.bounds.cells)
    # Every bound holds for every vector of its cell.
    held = index.rows.collect()
    probe = np.stack([np.array(r["vector"]) for r in asked.collect()])
    upper = index.bounds.upper(probe)
    place = {c: i for i, c in enumerate(index.bounds.cells.tolist())}
    for r in held:
        assert (probe @ np.array(r["vector"]) <= upper[:, place[r["cell"]]] + 1e-9).all()
