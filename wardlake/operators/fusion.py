"""Score fusion: one check per guard from lexicon, context, patterns and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.functions import rules

STRUCTURED_TYPES = ("json", "code", "opaque")
HARD_SAFE = ("safe_technical_context", "safe_pop_culture_context", "safe_multilingual_context")
ALL_SAFE = (*HARD_SAFE, "safe_positive_emphasis")


def _layer(vector: Column, context: Column, fast: Column) -> Column:
    return (
        F.when(vector > F.greatest(fast, context), "L3_vector_store")
        .when(context > fast, "L2_contextual_ml")
        .otherwise("L1_lexicon")
    )


def _check(name: str, score: Column, verdict: Column, layer: Column) -> Column:
    return F.struct(
        F.lit(name).alias("check_name"), F.round(score, 4).alias("score"), verdict.alias("verdict"), layer.alias("layer")
    )


def toxicity_in(lexicon: Column, context: Column, context_verdict: Column, vector: Column) -> Column:
    safe = context_verdict.isin(*HARD_SAFE)
    score = F.when(safe, F.greatest(context, vector)).otherwise(F.greatest(lexicon, context, vector))
    layer = F.when(safe, F.lit("L2_contextual_ml")).otherwise(_layer(vector, context, lexicon))
    return _check("toxicity", score, rules.verdict(score, 0.75, 0.40), layer)


def injection_in(
    fast: Column, context: Column, vector: Column, fail: float = 0.70, warn: float = 0.40, vector_floor: float = 0.0
) -> Column:
    counted = F.when(vector >= vector_floor, vector).otherwise(F.lit(0.0))
    score = F.greatest(fast, context, counted)
    return _check("prompt_injection", score, rules.verdict(score, fail, warn), _layer(counted, context, fast))


def secrets_in(rule_score: Column, vector: Column) -> Column:
    score = F.greatest(rule_score, vector)
    layer = F.when(vector > rule_score, "L3_vector_store").otherwise("detect_secrets")
    return _check("secrets", score, rules.verdict(score, 0.70, 0.35), layer)


def pii_in(score: Column, verdict: Column) -> Column:
    return _check("pii", score, verdict, F.lit("pii_service"))


def toxicity_out(lexicon: Column, context: Column, context_verdict: Column, content_type: Column) -> Column:
    structured = content_type.isin(*STRUCTURED_TYPES)
    score = (
        F.when(structured, F.lit(0.0)).when(context_verdict.isin(*ALL_SAFE), F.lit(0.05)).otherwise(F.greatest(lexicon, context))
    )
    verdict = F.when(structured, "not_applicable").otherwise(rules.verdict(score, 0.80))
    layer = F.when(structured, "L0_normalization").when(context > lexicon, "L2_contextual_ml").otherwise("L1_lexicon")
    return _check("toxicity", score, verdict, layer)
