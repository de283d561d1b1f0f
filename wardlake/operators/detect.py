"""Pattern detectors: commands, injection, toxicity context, judge outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.functions import rules, text


def command_hits(source: Column) -> Column:
    return rules.hits(F.lower(source), fixed.COMMAND_RULES)


def injection_fast_hits(source: Column) -> Column:
    return rules.hits(F.lower(source), fixed.INJECTION_FAST_RULES)


def with_injection_context(df: DataFrame, model_score: str | None = None) -> DataFrame:
    """Rules over canonical, leet and decoded forms; needs the variant columns."""
    df = df.withColumn(
        "_forms", F.lower(F.array_join(F.array_distinct(F.concat(F.array("canonical", "leet"), F.col("decoded"))), "\n\u0001\n"))
    )
    df = df.withColumn("injection_hits", rules.hits(F.col("_forms"), fixed.INJECTION_CONTEXT_RULES))
    pattern = rules.best_score(F.col("injection_hits"))
    best = F.greatest(pattern, F.coalesce(F.col(model_score), F.lit(0.0))) if model_score else pattern
    return (
        df.withColumn("injection_score", F.round(best, 4))
        .withColumn(
            "injection_verdict",
            F.when(F.col("injection_score") >= 0.70, "injection_detected")
            .when(F.col("injection_score") >= 0.40, "warn")
            .otherwise("safe"),
        )
        .drop("_forms")
    )


def safe_context(lowered: Column, canonical: Column) -> Column:
    """Name of the first safe context that matches the lower-case text, else null."""
    out = None
    for name, patterns in fixed.SAFE_CONTEXTS.items():
        found = rules.possible(lowered, name) & rules.any_of(lowered, patterns, ignore_case=False)
        if name == "safe_positive_emphasis":
            found = found | (rules.possible(canonical, name) & rules.any_of(canonical, patterns, ignore_case=False))
        out = F.when(found, F.lit(name)) if out is None else out.when(found, F.lit(name))
    return out


# The terms' first letters are looked for before the letters around a term, whose test costs far more.
_TERMS = (
    f"(?=[{''.join(sorted({t[0] for t in fixed.HOSTILE_TERMS}))}])(?<!{text.WORD_CHAR})(?:{'|'.join(fixed.HOSTILE_TERMS)})(?!{text.WORD_CHAR})"
)


def with_toxicity_context(df: DataFrame, source: str = "text", model_score: str | None = None) -> DataFrame:
    """Contextual toxicity: a safe context wins, else the best of model and reframed hostility."""
    df = df.withColumn("_low", F.lower(source))
    df = df.withColumn("safe_label", safe_context(F.col("_low"), F.col("canonical"))).drop("_low")
    hostile = rules.hits_any([F.col("canonical"), F.col("leet")], fixed.HOSTILITY_RULES, ignore_case=False)
    df = df.withColumn("hostile_hits", F.when(F.col("safe_label").isNull(), hostile))
    raw = F.coalesce(rules.best_score(F.col("hostile_hits")), F.lit(0.0))
    if model_score:
        raw = F.greatest(raw, F.coalesce(F.col(model_score), F.lit(0.0)))
    unsafe = F.col("safe_label").isNull()
    return (
        df.withColumn("context_score", F.when(unsafe, F.round(raw, 4)).otherwise(F.lit(0.01)))
        .withColumn(
            "context_verdict",
            F.coalesce(
                F.col("safe_label"),
                F.when(F.col("context_score") >= 0.75, "toxic").when(F.col("context_score") >= 0.40, "warn").otherwise("safe"),
            ),
        )
        .withColumn(
            "context_terms",
            F.when(
                unsafe & rules.contains_any(F.col("canonical"), fixed.HOSTILE_TERMS),
                F.array_sort(F.array_distinct(F.regexp_extract_all("canonical", F.lit(_TERMS), F.lit(0)))),
            )
            .when(unsafe & F.col("canonical").isNull(), F.lit(None))
            .otherwise(F.array().cast("array<string>")),
        )
        .drop("safe_label")
    )


JUDGE_SCHEMA = "struct<groundedness_score:double,coherence_score:double,fabrication_risk:double,reasoning:string>"


def judge_scores(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Risk from a judge's JSON reply; a reply that cannot be read passes with 0."""
    body = F.trim(F.replace(F.replace(F.col(raw), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    parsed = F.from_json(body, JUDGE_SCHEMA, {"mode": "PERMISSIVE"})
    df = df.withColumn("_readable", F.try_parse_json(body).isNotNull()).withColumn("_judge", parsed)
    risk = (
        F.coalesce(F.col("_judge.fabrication_risk"), F.lit(0.0))
        + (1.0 - F.coalesce(F.col("_judge.groundedness_score"), F.lit(1.0)))
    ) / 2.0
    readable = F.coalesce(F.col("_readable"), F.lit(False))
    return (
        df.withColumn("_risk", F.when(readable, risk).otherwise(F.lit(0.0)))
        .withColumn("judge_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_risk"))))
        .withColumn("judge_verdict", F.when(F.col("_risk") > 0.5, "fail").otherwise("pass"))
        .drop("_judge", "_readable", "_risk")
    )
