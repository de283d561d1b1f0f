"""Requests, envelopes and audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake import fixed

ENVELOPE = (
    "struct<interaction_id:string,created_at:string,use_case:string,geography:string,direction:string,"
    "payload:struct<role:string,content:string>,"
    "checks:array<struct<check_name:string,score:double,verdict:string>>,"
    "risk:struct<tier:string,confidence:double>,model:struct<routed_to:string>>"
)


def _filled(values: Column) -> Column:
    return F.when(F.size(F.coalesce(values, F.array().cast("array<string>"))) > 0, values)


def build(requests: DataFrame) -> DataFrame:
    """Envelope rows from request rows.

    Columns in: request_id, session_id, role, content, use_case, geography,
    header_use_case, header_geography, pii, allowed_pii, model, endpoint_id.
    Headers count only when they name a known value.
    """
    case = F.lower("header_use_case")
    place = F.upper("header_geography")
    empty = F.array().cast("array<string>")
    return requests.select(
        F.col("request_id").alias("interaction_id"),
        "session_id",
        F.when(case.isin(*fixed.USE_CASES), case).otherwise(F.coalesce("use_case", F.lit("customer_support"))).alias("use_case"),
        F.when(place.isin(*fixed.GEOGRAPHIES), place).otherwise(F.coalesce("geography", F.lit("US"))).alias("geography"),
        F.lit("input").alias("direction"),
        F.struct(F.col("role"), F.col("content")).alias("payload"),
        F.coalesce(_filled(F.col("pii")), _filled(F.col("allowed_pii")), empty).alias("pii_declaration"),
        F.coalesce(F.nullif("model", F.lit("")), F.nullif("endpoint_id", F.lit(""))).alias("model_requested"),
    )


def audit_events(decisions: DataFrame) -> DataFrame:
    """Events to append: one per direction, the output one only if the input passed.

    Columns in: interaction_id, session_id, direction, use_case, geography,
    created_at, action, reason, tier, confidence, policy_version.
    """
    blocked_inputs = decisions.where((F.col("direction") == "input") & (F.col("action") == "block")).select("interaction_id")
    inputs = decisions.where(F.col("direction") == "input")
    outputs = decisions.where(F.col("direction") == "output").join(blocked_inputs, "interaction_id", "left_anti")
    events = inputs.unionByName(outputs)
    envelope = F.struct(
        "interaction_id",
        "use_case",
        "geography",
        "direction",
        F.struct("tier").alias("risk"),
        F.struct("action", "reason").alias("decision"),
    )
    return events.select(
        "interaction_id",
        "session_id",
        "direction",
        "use_case",
        "geography",
        F.to_json(envelope).alias("envelope"),
        F.col("action").alias("decision_action"),
        "policy_version",
        "created_at",
        F.to_date("created_at").alias("event_date"),
    )


def flatten(events: DataFrame, envelope: str = "envelope") -> DataFrame:
    """Dashboard rows from stored events: tier low and confidence 0 where absent."""
    df = events.withColumn("_e", F.from_json(envelope, ENVELOPE))
    return df.select(
        "interaction_id",
        F.col("created_at").alias("timestamp"),
        "use_case",
        "geography",
        "direction",
        "decision_action",
        F.coalesce("_e.risk.tier", F.lit("low")).alias("risk_tier"),
        F.coalesce("_e.risk.confidence", F.lit(0.0)).alias("risk_confidence"),
        F.col("_e.model.routed_to").alias("model_used"),
        F.coalesce("_e.payload.content", F.lit("")).alias("content"),
        F.size(F.coalesce("_e.checks", F.array().cast("array<struct<check_name:string,score:double,verdict:string>>"))).cast("long").alias("n_checks"),
    )


def geography_context(df: DataFrame) -> DataFrame:
    """Residency profile and currency of each row's geography."""
    case = F.upper("geography")
    zone = F.when(case == "EU", "European Union").when(case == "IN", "India").otherwise("United States")
    law = F.when(case == "EU", "GDPR").when(case == "IN", "DPDP Act").otherwise("US Federal/State law")
    currency = F.when(case == "EU", "EUR").when(case == "IN", "INR").otherwise("USD")
    return (
        df.withColumn("currency", currency)
        .withColumn("residency", zone)
        .withColumn("prompt_prefix", F.concat(F.lit("Data zone: "), zone, F.lit(". Follow "), law, F.lit(". Amounts in "), currency, F.lit(".")))
    )
