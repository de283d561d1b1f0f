"""The guards end to end: one narrow pass from texts to decisions, for requests, replies and whole interactions.

Normalisation, lexicon, patterns, secrets, personal data, similarity, fusion
and the policy fold all stay in the row. Policies and permissions are small
tables over closed domains and are broadcast. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.functions import rules
from wardlake.functions.rows import settle
from wardlake.functions.text import with_variants
from wardlake.operators import detect, envelopes, fusion, leakage, lexicon, normalize, pii, policy, secrets, similarity

CHECKS = ("prompt_injection", "toxicity", "secrets", "pii")
OUT_CHECKS = ("toxicity", "sensitive_data", "system_prompt_leakage", "pii")


def guard_checks(requests: DataFrame, id_col: str, corpus: DataFrame | None = None) -> DataFrame:
    """Add ``checks`` (four fused checks in guard order) and the permission outcome."""
    df = requests
    if corpus is not None:
        df = similarity.with_matches(df, id_col, "text", corpus, 1, "_near").withColumn("_vec", similarity.max_similarity(F.col("_near"))).drop("_near")
    else:
        df = df.withColumn("_vec", F.lit(0.0))
    df = with_variants(df)
    df = lexicon.with_hits(lexicon.with_scan_text(df)).drop("scan_text")
    df = detect.with_toxicity_context(detect.with_injection_context(df))
    unpacked = F.array_join(normalize.unpacked_strings(F.col("text")), " ")
    df = df.withColumn("_fast", rules.best_score(detect.injection_fast_hits(F.col("text")))).withColumn(
        "_with_code", F.concat_ws(" ", "text", unpacked)
    )
    df = secrets.with_secret_scan(df, "_with_code")
    df = pii.evaluate(pii.with_permissions(pii.with_entities(df), pii.permission_table(df.sparkSession)))
    checks = F.array(
        fusion.injection_in(F.col("_fast"), F.col("injection_score"), F.col("_vec")),
        fusion.toxicity_in(
            lexicon.score(F.col("severe"), F.col("moderate"), F.col("mild")), F.col("context_score"), F.col("context_verdict"), F.col("_vec")
        ),
        fusion.secrets_in(F.col("secret_score"), F.col("_vec")),
        fusion.pii_in(pii.calibrated_score(F.col("blocked_pii"), F.col("warned_pii")), pii.calibrated_verdict(F.col("blocked_pii"), F.col("warned_pii"))),
    )
    return settle(
        df.select(
            *requests.columns, "detected_pii", "blocked_pii", "allowed_pii", "warned_pii", "findings", "pii_blocks", checks.alias("checks")
        )
    )


def guard(requests: DataFrame, id_col: str, corpus: DataFrame | None = None, rules_table: DataFrame | None = None, version: str = "default") -> DataFrame:
    """Decisions for requests (id, text, use_case, geography, declared)."""
    spark = requests.sparkSession
    rules_table = rules_table if rules_table is not None else policy.default_rules(spark)
    df = policy.with_thresholds(guard_checks(requests, id_col, corpus), rules_table, list(CHECKS))
    df = df.withColumn("_d", policy.decide_row(F.col("checks"), F.col("thresholds"), F.col("blocked_pii"), version))
    df = df.select(
        *requests.columns, "checks", "detected_pii", "blocked_pii", F.lit("input").alias("direction"),
        pii.must_block(F.col("findings"), F.lit(False)).alias("finding_blocks"), "_d.*",
    )
    return policy.override(df).drop("finding_blocks")


def egress_checks(replies: DataFrame) -> DataFrame:
    """Add ``checks`` (four checks of the output side in order) to replies (text, use_case, content_type, prompts, declared).

    Tripwires and verbatim prompts settle a reply before the costly leak signals; structured
    content is not scored for toxicity.
    """
    df = with_variants(replies)
    df = lexicon.with_hits(lexicon.with_scan_text(df)).drop("scan_text")
    df = secrets.with_secret_scan(detect.with_toxicity_context(df), "text")
    df = settle(leakage.with_leak_score(df))
    df = pii.evaluate(pii.with_permissions(pii.with_entities(df), pii.permission_table(df.sparkSession)))
    sensitive = fusion.secrets_in(F.col("secret_score"), F.lit(0.0))
    checks = F.array(
        fusion.toxicity_out(lexicon.score(F.col("severe"), F.col("moderate"), F.col("mild")), F.col("context_score"), F.col("context_verdict"), F.col("content_type")),
        F.struct(F.lit("sensitive_data").alias("check_name"), sensitive["score"].alias("score"), sensitive["verdict"].alias("verdict"), sensitive["layer"].alias("layer")),
        F.struct(F.lit("system_prompt_leakage").alias("check_name"), F.col("leak_score").alias("score"), F.col("leak_verdict").alias("verdict"), F.col("leak_layer").alias("layer")),
        fusion.pii_in(pii.calibrated_score(F.col("blocked_pii"), F.col("warned_pii")), pii.calibrated_verdict(F.col("blocked_pii"), F.col("warned_pii"))),
    )
    return settle(df.select(*replies.columns, "blocked_pii", "findings", checks.alias("checks")))


def egress(replies: DataFrame, rules_table: DataFrame | None = None, version: str = "default") -> DataFrame:
    """Decisions for replies; a missing decision of the output side allows."""
    rules_table = rules_table if rules_table is not None else policy.default_rules(replies.sparkSession)
    df = policy.with_thresholds(egress_checks(replies), rules_table, list(OUT_CHECKS))
    df = df.withColumn("_d", policy.decide_row(F.col("checks"), F.col("thresholds"), F.col("blocked_pii"), version))
    df = df.select(*replies.columns, "checks", "blocked_pii", F.lit("output").alias("direction"), pii.must_block(F.col("findings"), F.lit(False)).alias("finding_blocks"), "_d.*")
    return policy.override(df).drop("finding_blocks", "blocked_pii")


DECISION = ("action", "reason", "tier", "confidence", "policy_version")


def interactions(pairs: DataFrame, rules_table: DataFrame | None = None, version: str = "default") -> DataFrame:
    """Both guards over interactions, in one row each: ``input`` and ``output`` decisions, the latter null where the input was blocked.

    Needs interaction_id, session_id, prompt, reply, use_case, geography, declared, content_type, prompts and created_at.
    The reply of a blocked input never reaches the output side: it is null from there on.
    """
    asked = guard(pairs.withColumnRenamed("prompt", "text"), "interaction_id", None, rules_table, version)
    asked = settle(asked.select(*[c for c in pairs.columns if c != "prompt"], F.struct(*DECISION).alias("input")))
    passed = F.col("input.action") != "block"
    replied = egress(asked.withColumn("text", F.when(passed, F.col("reply"))).drop("reply"), rules_table, version)
    keep = [c for c in pairs.columns if c not in ("prompt", "reply", "prompts", "declared")]
    return settle(replied.select(*keep, "input", F.when(passed, F.struct(*DECISION)).alias("output")))


def decisions(judged: DataFrame) -> DataFrame:
    """One row for each decision of the rows of ``interactions``."""
    each = F.explode(F.array_compact(F.array(*[F.when(F.col(d).isNotNull(), F.struct(F.lit(d).alias("direction"), *[F.col(f"{d}.{c}").alias(c) for c in DECISION])) for d in ("input", "output")])))
    keep = [c for c in judged.columns if c not in ("input", "output")]
    return judged.select(*keep, each.alias("_d")).select(*keep, "_d.*")


def outcome(judged: DataFrame) -> DataFrame:
    """The combined decision of each interaction, how many audit events it leaves, and whether a person is to review it.

    All of it follows from the row. A blocked input decides alone.
    """
    both = judged.select("interaction_id", *policy.merged(F.col("input"), F.col("output")), "input", "output")
    stopped = F.col("input.action") == "block"
    alone = {"action": F.lit("block"), "reason": F.col("input.reason"), "tier": F.lit("high"), "confidence": F.col("input.confidence"), "escalated": F.lit(False)}
    both = both.withColumns({c: F.when(stopped, v).otherwise(F.col(c)) for c, v in alone.items()})
    both = both.withColumn("n_events", F.when(F.col("output").isNull(), 1).otherwise(2)).drop("input", "output")
    return both.withColumn("to_review", F.col("escalated") | (F.col("action") == "flag"))
