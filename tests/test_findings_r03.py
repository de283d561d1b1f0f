"""Findings of the third round: part files as streams, the SQL's word edges, payloads and windows, work done once."""

from __future__ import annotations

import base64
from datetime import datetime

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wardlake.functions import text, vectors
from wardlake.operators import metrics, pii, routing
from wardlake.plans import dataset_jobs, detector_jobs, streaming_jobs
from wardlake.streaming import windows
from wardlake.streaming.runs import drain_to_table, read_stream


@pytest.mark.parametrize("n_files", [1, 3])
def test_a_folder_of_part_files_is_streamed_whole(spark, tmp_path, n_files):
    spark.range(9).repartition(n_files).write.parquet(f"{tmp_path}/rows.parquet")
    assert drain_to_table(read_stream(spark, str(tmp_path), "rows"), "rows").count() == 9


def test_windows_hold_the_times_that_round_into_them(spark):
    times = [datetime(2024, 1, 1, 5, 59, 59, u) for u in (499_999, 500_000, 900_000)] + [datetime(2024, 1, 1, 6)]
    events = spark.createDataFrame([(i, "block", t) for i, t in enumerate(times)], "interaction_id int, decision_action string, created_at timestamp_ntz")
    rates = windows.windowed_rates(streaming_jobs._rounded(events), f"{streaming_jobs.WIDTH_S} seconds", watermark=False)
    got = {str(r[0]): r[1] for r in rates.select(F.col("window_start").cast("string"), "total_interactions").collect()}
    w = streaming_jobs.WIDTH_S
    want = duckdb.execute(f"SELECT strftime(make_timestamp((epoch(t)::BIGINT // {w}) * {w} * 1000000), '%Y-%m-%d %H:%M:%S'), count(*) FROM (SELECT unnest(?::TIMESTAMP[]) AS t) GROUP BY 1", [times]).fetchall()
    assert got == dict(want) == {"2024-01-01 00:00:00": 1, "2024-01-01 06:00:00": 3}


def test_entities_end_where_the_sql_ends_them(spark):
    value = "\U0001F600 5 im über 189 einstü, x mail a.b@c.deü or 4111 1111 1111 1111 ä123-45-6789"
    df = spark.createDataFrame([(1, value)], "doc_id long, text string")
    cols = ["entity_type", "start", "end", "value"]
    got = sorted(tuple(r) for r in pii.detect(df, "doc_id", ascii_edges=True).select(*cols).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE probed AS SELECT 1::BIGINT AS doc_id, ? AS text", [value])
    want = sorted(con.execute(f'WITH {detector_jobs.entities_cte("probed", "doc_id")} SELECT entity_type, "start", "end", value FROM entities').fetchall())
    assert got == want and ("ADDRESS", "189 einst") in {(t, v) for t, _, _, v in got}
    assert "189 einst" not in {r["value"] for r in pii.detect(df, "doc_id").collect()}


def test_whole_payloads_hold_text_alone(spark):
    partly, fully = (base64.b64encode(b).decode() for b in (b"ab\xff cp \xff rest12", b"hello there cp!"))
    df = spark.createDataFrame([(partly,), (fully,)], "text string")
    decoded = [r["decoded"] for r in text.with_variants(df, whole=True).collect()]
    assert decoded == [[], ["hello there cp!"]]
    assert all("cp" in r["decoded"][0] for r in text.with_variants(df).collect())


def test_dense_blocks_are_bounded_and_equal(monkeypatch):
    one = pa.array([[1, 1, 2], None, [], [5], [383]], pa.list_(pa.int32()))
    two = pa.array([[7], None, [], [], [0]], pa.list_(pa.int32()))
    whole = vectors.dense_batch(one, two)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 2)
    blocks = list(vectors.dense_blocks(one, two))
    assert [len(b) for b in blocks] == [2, 2, 1] and [r for b in blocks for r in b.tolist()] == whole.tolist()
    assert whole[0, 1] == 2 / (4 + 1 + 2.25) ** 0.5 and not whole[1].any()


def test_roc_scores_are_computed_once(spark):
    df = spark.createDataFrame([(0.1, 0), (0.9, 1), (0.9, 0)], "score double, label int")
    out = metrics.roc_auc(df)
    assert "LocalTableScan" not in out._jdf.queryExecution().executedPlan().toString() and out.first()["roc_auc"] == 0.75


def test_equal_requests_are_judged_once(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, t, "user", "hi") for i in range(30) for t in range(2)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    judged = []
    real = dataset_jobs.guard
    monkeypatch.setattr(dataset_jobs, "guard", lambda df, *a: judged.append(df.count()) or real(df, *a))
    rows = dataset_jobs.scenario_regression(spark, str(tmp_path)).collect()
    assert judged == [len(dataset_jobs.SCENARIOS)] and {(r["n"], r["n_as_expected"]) for r in rows} == {(30, 30)}


def test_a_filter_on_the_ranking_stays_above_it(spark):
    df = routing.with_ranking(spark.createDataFrame([("weather in oslo",), (" ",)], "text string"), routing.default_endpoints(spark)).where(F.size("ranking") > 0)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort(") == 1 and df.count() == 1
