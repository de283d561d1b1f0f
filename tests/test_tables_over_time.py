"""Batches that count once, versions as of an event's time, and a fit per fold."""

from __future__ import annotations

import random
import threading

from pyspark.sql import functions as F

from wardlake.operators import datasets, metrics, model, registry
from wardlake.sources import audit


def some_events(spark, n, first_day=1):
    return spark.range(n).select(
        F.concat(F.lit("i"), F.col("id").cast("string")).alias("interaction_id"), F.lit("input").alias("direction"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3 + first_day - 1).cast("int")).alias("event_date"),
    )


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "audit")
    assert audit.commit(some_events(spark, 10), path, "one")
    assert not audit.commit(some_events(spark, 10), path, "one")
    assert audit.commit(some_events(spark, 5, first_day=20), path, "two")
    assert audit.commit(some_events(spark, 0), path, "nothing")
    some_events(spark, 7).write.partitionBy("event_date").parquet(f"{path}/events/attempt=died")
    assert audit.committed(spark, path).count() == 15
    late = audit.committed(spark, path, since="2024-01-20")
    assert late.count() == 5
    read = late.inputFiles()
    assert read and all("event_date=2024-01-2" in f for f in read)
    assert audit.committed(spark, path, since="2024-01-03").where("event_date < '2024-01-03'").count() == 0


def test_of_two_attempts_one_counts(spark, tmp_path):
    path, added = str(tmp_path / "audit"), []
    both = [threading.Thread(target=lambda: added.append(audit.commit(some_events(spark, 10), path, "one"))) for _ in range(2)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert True in added and audit.committed(spark, path).count() == 10


def test_only_empty_batches(spark, tmp_path):
    path = str(tmp_path / "audit")
    audit.commit(some_events(spark, 0), path, "nothing")
    out = audit.committed(spark, path)
    assert out.count() == 0 and out.columns == ["interaction_id", "direction", "event_date"]


def test_version_of_the_events_own_time(spark):
    rng = random.Random(5)
    keys = ["hot"] * 20 + ["a", "b", None]
    versions = [(rng.choice(keys), rng.choice([None, *range(0, 4000, 7)]), i, i / 10) for i in range(300)]
    events = [(i, rng.choice([*keys, "none"]), rng.choice([None, *range(0, 4000, 5)]), "clash") for i in range(900)]
    v = spark.createDataFrame(versions, "k string, at int, id int, limit double").withColumn("since", F.timestamp_seconds("at")).drop("at")
    e = spark.createDataFrame(events, "id int, k string, at int, limit string").withColumn("t", F.timestamp_seconds("at"))
    got = registry.as_of(e, v, ["k"], "t", "since", "id").collect()
    assert len(got) == len(events)

    def plain(key, at):
        fit = [(s, i) for k, s, i, _ in versions if key is not None and k == key and at is not None and s is not None and s <= at]
        return max(fit)[1] if fit else None

    want = {i: plain(k, at) for i, k, at, _ in events}
    assert {r["id"]: r["known"]["id"] if r["known"] else None for r in got} == want
    assert sum(x is not None for x in want.values()) > 500


def test_each_fold_is_judged_by_a_model_that_has_not_seen_it(spark):
    rows = [(f"s{i}", ("bad awful text " if i % 2 else "kind fine words ") + f"number{i}", i % 2) for i in range(60)]
    samples = spark.createDataFrame(rows, "sample_id string, text string, label int").withColumn("digest", F.md5("text"))
    placed = datasets.folds(samples, 3).select("text", "label", "fold")
    good = model.cross_validate(placed).collect()
    assert sorted(r["fold"] for r in good) == [0, 1, 2] and all(r["f1"] == 1.0 for r in good)
    # Labels by a word of their own are known to a model that saw the row, and to no other.
    rng = random.Random(3)
    noise = spark.createDataFrame([(f"only{i} only{i} only{i}", rng.randrange(2), i % 3) for i in range(90)], "text string, label int, fold int")
    held = model.cross_validate(noise, reg=0.0001)
    assert max(r["accuracy"] for r in held.collect()) < 0.8
    fold = noise.where("fold <> 1").withColumn("weight", F.lit(float(datasets.class_weight(noise.where("fold <> 1")).first()["positive_weight"])))
    fold = fold.withColumn("weight", F.when(F.col("label") == 1, F.col("weight")).otherwise(1.0))
    one = metrics.confusion(model.score(model.pipeline(0.0001).fit(fold), noise.where("fold = 1")), [], "probability_1").first()
    same = held.where("fold = 1").first()
    assert (one["tp"], one["fp"], one["tn"], one["fn"]) == (same["tp"], same["fp"], same["tn"], same["fn"])
