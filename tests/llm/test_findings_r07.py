"""pipeline: disk holds what is still read, not the shuffle files and tables of all steps."""

from __future__ import annotations

import os
import random
import time

from pyspark.sql import functions as F

from wardlake.llm import jaccard_join, tables


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_shuffle_files_go_with_their_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_folder", lambda _, purpose: str(tmp_path / purpose))
    before = shuffle_files(spark)
    rows = tables.kept(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s")).repartition(3, "s"), "sums")
    for _ in range(100):  # they are removed in the background
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before and rows.count() == 100
    assert spark.conf.get(tables.CLEANUP, "false") == "false"
    tables.released(rows)
    assert not (tmp_path / "sums").exists()


def test_near_duplicates_leave_small_tables_only(spark, tmp_path, monkeypatch):
    """Sets, prefixes, counts and cells are gone when the documents that stay are known; the documents are those of all pairs."""
    made = []
    monkeypatch.setattr(tables, "shared_folder", lambda _, purpose: made.append(purpose) or str(tmp_path / f"{purpose}-{len(made)}"))
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    rng = random.Random(5)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(500)], k=40)) for _ in range(30)]
    near = [f"{texts[i % 3]} extra{i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate([*texts, *near, *texts[5:9], None, ""])), "doc_id long, text string")
    rule = jaccard_join.Rule()
    got = sorted(r["doc_id"] for r in jaccard_join.one_of_each(docs, rule).collect())

    def shingles(text):
        w = (text or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(r["text"]) for r in docs.orderBy("doc_id").collect()]
    forest = jaccard_join._Forest()
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                forest.join(a, b)
    assert got == [i for i in range(len(sets)) if forest.root(i) == i]
    left = {d.rsplit("-", 1)[0] for d in os.listdir(tmp_path)}
    assert {"described", "classes", "sizes", "placed", "members", "judged", "decisions"} <= set(made)
    assert left <= {"rows", "names", "stays", "links", "cells", "filled", "edges", "stars"}
