"""Continuous guard: requests in, audit events appended, review queue merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.plans.governance import guard
from wardlake.session import shared_folder
from wardlake.sources import audit
from wardlake.streaming.runs import drain_each

QUEUE = "interaction_id string, direction string, use_case string, geography string, risk_tier string, escalation_reason string, payload string, status string, seq long"


def audit_rows(decided: DataFrame) -> DataFrame:
    return decided.select(
        "interaction_id", "session_id", "direction", "use_case", "geography",
        F.to_json(F.struct("checks", F.struct("tier", "confidence").alias("risk"), F.struct("action", "reason").alias("decision"))).alias("envelope"),
        F.col("action").alias("decision_action"), "policy_version", "created_at", F.to_date("created_at").alias("event_date"),
    )


def review_rows(decided: DataFrame) -> DataFrame:
    return decided.where(F.col("action").isin("flag", "escalate")).select(
        "interaction_id", "direction", "use_case", "geography", F.col("tier").alias("risk_tier"), F.col("reason").alias("escalation_reason"),
        F.col("text").alias("payload"), F.lit("pending").alias("status"),
    )


def run(requests: DataFrame, events_path: str, queue_path: str, rules_table: DataFrame | None = None) -> None:
    """Drain a stream of requests (interaction_id, session_id, text, use_case, geography, declared, created_at).

    Each batch is written under its batch number, so a batch that is repeated
    after a failure replaces its own rows and nothing is counted twice.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        # One file is one task: its rows are spread first. Two tables are written from them, so they are judged once and kept.
        spread = batch.repartition(batch.sparkSession.sparkContext.defaultParallelism)
        decided = guard(spread, "interaction_id", rules_table=rules_table).persist()
        try:
            audit_rows(decided).write.mode("overwrite").parquet(f"{events_path}/batch={batch_id}")
            review_rows(decided).withColumn("seq", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{queue_path}/batch={batch_id}")
        finally:
            decided.unpersist()

    drain_each(requests, "guard", step)


def live_queue(spark: SparkSession, queue_path: str) -> DataFrame:
    """One review row per interaction: the newest change."""
    rows = spark.read.schema(QUEUE).parquet(queue_path)
    rest = [c for c in rows.columns if c not in ("interaction_id", "batch")]
    return rows.groupBy("interaction_id").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select("interaction_id", "r.*").drop("seq")


def run_to_tables(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Run into fresh shared folders and return (audit events, live review queue)."""
    spark = requests.sparkSession
    events_path, queue_path = shared_folder(spark, "audit"), shared_folder(spark, "queue")
    run(requests, events_path, queue_path)
    return audit.read(spark, events_path).drop("batch"), live_queue(spark, queue_path)
