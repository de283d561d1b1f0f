"""Workflow routing: endpoint index, hybrid ranking, calibration, resolution, registry."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.functions import rules, text, vectors
from wardlake.functions.rows import settle, spread_structs
from wardlake.operators import similarity
from wardlake.session import bounded_rows

DEFAULT_MODEL = "general-small"
MODELS = ("general-small", "general-large")
DIGITS = 6

# Our own endpoint descriptions and sample requests.
ENDPOINTS = (
    ("general_query", "General Query Service",
     "Answers general questions about facts, companies, technology, science, mathematics and programming. Gives short explanations.",
     ("what is quantum computing", "explain recursion with an example", "how many people work in a large company",
      "tell me about machine learning", "write a function that reverses a string", "who was the first person on the moon")),
    ("email_service", "Email Service",
     "Composes, drafts and sends electronic mail messages for a request in plain language. Needs a recipient.",
     ("send an email to someone@example.com saying the meeting moved", "write an email about the deadline",
      "send a mail to the team with the weekly report", "email the customer that the order shipped")),
    ("leave_approval", "Leave Approval Service",
     "Handles employee leave requests, vacation, sick days and time off by fixed rules. Decides from the number of days.",
     ("i need 2 days off next week", "request sick leave for tomorrow", "i want leave from may 2 to may 5",
      "can i take 4 days off for personal work")),
    ("weather_service", "Weather Service",
     "Reports temperature, rain, wind and humidity for a city. Uses live weather observations.",
     ("what is the weather in oslo right now", "will it rain in lima tomorrow", "how hot is it in cairo today",
      "current temperature and humidity in quito")),
)
# Our own words for these endpoints, from the descriptions and samples above.
KEYWORDS = {
    "general_query": ("question", "fact", "company", "science", "mathematics", "programming", "explain", "tell me", "how many", "what is", "who was", "function"),
    "email_service": ("mail", "message", "compose", "draft", "recipient", "send", "write to"),
    "leave_approval": ("leave", "vacation", "sick", "time off", "days off", "day off", "absent"),
    "weather_service": ("weather", "temperature", "rain", "wind", "humidity", "hot", "cold", "city"),
}
INDEX = "endpoint string, kind string, ordinal int, text string"


def default_endpoints(spark: SparkSession) -> DataFrame:
    rows = [
        (i, eid, name, instructions, list(exemplars), list(KEYWORDS[eid]), f"/{eid}/complete", eid, 1.0, True)
        for i, (eid, name, instructions, exemplars) in enumerate(ENDPOINTS)
    ]
    return spark.createDataFrame(
        rows,
        "position int, endpoint string, name string, instructions string, exemplars array<string>, "
        "keywords array<string>, target string, use_case string, weight double, active boolean",
    )


def index_texts(endpoints: DataFrame) -> DataFrame:
    """Texts that stand for each endpoint: its summary line and its sample requests.

    Without samples, up to six sentences of the instructions (over 15
    characters) serve, else the name.
    """
    summary = F.when(F.length("instructions") > 0, F.split_part("instructions", F.lit("."), F.lit(1))).otherwise(F.col("name"))
    cut = F.slice(
        F.filter(F.transform(F.split("instructions", r"\.", -1), text.strip), lambda s: F.length(s) > 15), 1, 6
    )
    samples = F.when(F.size(F.coalesce("exemplars", F.array())) > 0, F.col("exemplars")).when(F.size(cut) > 0, cut).otherwise(
        F.array("name")
    )
    entries = F.concat(
        F.array(F.struct(F.lit("primary").alias("kind"), F.lit(0).alias("ordinal"), F.concat_ws(": ", "name", summary).alias("text"))),
        F.transform(samples, lambda s, i: F.struct(F.lit("exemplar").alias("kind"), (i + 1).alias("ordinal"), s.alias("text"))),
    )
    return spread_structs(endpoints, ["endpoint"], entries)


def index_endpoints(endpoints: DataFrame) -> DataFrame:
    """The index with router vectors (stop words dropped)."""
    return similarity.embed(index_texts(endpoints), stopwords=True)


def _dense_scorer(primary: np.ndarray, exemplars: list[np.ndarray]):
    def scores(queries: np.ndarray) -> np.ndarray:
        columns = []
        for i, samples in enumerate(exemplars):
            first = queries @ primary[i]
            ranked = -np.sort(-(queries @ samples.T), axis=1)[:, :3]
            columns.append(0.30 * first + 0.50 * ranked[:, 0] + 0.20 * ranked.mean(axis=1))
        return np.stack(columns, axis=1)

    @F.arrow_udf("array<double>")
    def score(one: pa.Array, two: pa.Array) -> pa.Array:
        return vectors.joined([vectors.listed(scores(rows)) for rows in vectors.dense_blocks(one, two)], pa.list_(pa.float64()))

    return score


def intents(prompt: Column, lowered: Column) -> dict[str, Column]:
    found = {eid: rules.contains_any(lowered, phrases) for eid, phrases in fixed.INTENT_PHRASES.items()}
    found["email_service"] = found["email_service"] | prompt.rlike("(?U)" + fixed.EMAIL_INTENT_PATTERN)
    return found


def with_ranking(queries: DataFrame, endpoints: DataFrame, prompt: str = "text") -> DataFrame:
    """Add ``ranking``: all endpoints of a non-blank prompt, best first, calibrated.

    The endpoint table is small and its size is checked; ranking is row-local.
    """
    rows = bounded_rows(endpoints.orderBy("position"))
    index = bounded_rows(index_endpoints(endpoints))
    if rows is None or index is None:
        raise ValueError("too many endpoints for row-local ranking")
    primary = np.array([next(r["vector"] for r in index if r["endpoint"] == e["endpoint"] and r["kind"] == "primary") for e in rows])
    samples = [
        np.array([r["vector"] for r in sorted(index, key=lambda r: r["ordinal"]) if r["endpoint"] == e["endpoint"] and r["kind"] == "exemplar"])
        for e in rows
    ]
    table = F.array(
        *[
            F.struct(
                F.lit(e["endpoint"]).alias("endpoint"),
                F.lit(e["name"]).alias("name"),
                F.lit(e["target"]).alias("target"),
                F.lit(e["use_case"]).alias("use_case"),
                F.lit(e["active"]).alias("active"),
                F.array(*[F.lit(k.lower().strip()) for k in e["keywords"] if k.strip()]).cast("array<string>").alias("keywords"),
                F.array(
                    *[F.lit(w) for w in sorted(set(_plain_words(e["instructions"])) - set(fixed.STOPWORDS))]
                ).cast("array<string>").alias("inst_words"),
            )
            for e in rows
        ]
    )
    lowered = F.lower(text.strip(F.coalesce(F.col(prompt), F.lit(""))))
    df = queries.withColumn("_q", lowered)
    df = vectors.with_buckets(df, F.col("_q"), "_b", stopwords=True)
    df = df.withColumn("_dense", _dense_scorer(primary, samples)("_b.one", "_b.two")).withColumn(
        "_words", F.array_distinct(F.filter(text.words(F.col("_q")), lambda w: ~w.isin(*fixed.STOPWORDS)))
    )
    found = intents(F.col(prompt), F.col("_q"))
    flags = F.create_map(*[x for eid, flag in found.items() for x in (F.lit(eid), F.coalesce(flag, F.lit(False)))])
    df = settle(df.withColumn("_intents", flags))
    none = ~F.array_contains(F.map_values("_intents"), True)

    def scored(e: Column, i: Column) -> Column:
        dense = F.element_at("_dense", i + 1)
        matched = F.filter(e["keywords"], lambda k: F.contains(F.col("_q"), k))
        overlap = F.least(F.lit(0.20), F.size(F.array_intersect("_words", e["inst_words"])) * 0.05)
        sparse = F.least(F.lit(0.50), F.size(matched) * 0.15 + overlap)
        boost = (
            F.when(F.coalesce(F.try_element_at(F.col("_intents"), e["endpoint"]), F.lit(False)), 0.45)
            .when((e["endpoint"] == "general_query") & none, 0.35)
            .otherwise(F.lit(0.0))
        )
        raw = dense * 0.55 + sparse * 0.20 + boost * 0.25
        return F.struct(
            F.round(raw, DIGITS).alias("raw"), i.alias("position"), e["endpoint"].alias("endpoint"), e["name"].alias("name"),
            e["target"].alias("target"), e["use_case"].alias("use_case"), e["active"].alias("active"),
            dense.alias("dense"), matched.alias("matched"),
        )

    df = df.withColumn("_raw", F.transform(table, scored)).withColumn(
        "_raw",
        F.array_sort(
            "_raw",
            lambda a, b: F.when(a["raw"] > b["raw"], -1).when(a["raw"] < b["raw"], 1).otherwise(a["position"] - b["position"]),
        ),
    )
    df = settle(df)
    top = F.col("_raw")[0]["raw"]

    def calibrated(e: Column, i: Column) -> Column:
        score = F.when(i == 0, F.least(F.lit(0.98), F.greatest(F.lit(0.88), 0.85 + top * 0.15))).otherwise(
            F.greatest(F.lit(0.12), F.least(F.lit(0.55), 0.70 - (top - e["raw"]) * 1.5))
        )
        return F.struct(
            (i + 1).alias("rank"), e["endpoint"].alias("endpoint"), e["name"].alias("name"), e["target"].alias("target"),
            e["use_case"].alias("use_case"), e["active"].alias("active"), F.round(score, 4).alias("score"),
            e["raw"].alias("raw"), F.round(e["dense"], 4).alias("similarity"),
            F.round(F.greatest(F.lit(0.0), 1.0 - e["dense"]), 4).alias("distance"), e["matched"].alias("matched_keywords"),
        )

    blank = F.col("_q") == ""
    ranked = F.transform("_raw", calibrated)
    # A filter on the ranking must not take all of the above below itself, into one expression.
    return settle(df.withColumn("ranking", F.when(~blank, ranked).otherwise(F.slice(ranked, 1, 0)))).drop(
        "_q", "_b", "_dense", "_words", "_intents", "_raw"
    )


def _plain_words(value: str) -> list[str]:
    import re

    return re.findall(r"\w+", value.lower())


def resolve(df: DataFrame, endpoints: DataFrame, requested: str = "requested") -> DataFrame:
    """Final route of each request from its ``ranking``.

    An explicit known endpoint wins, then an explicit model or URL, then the
    best active candidate, else the default model.
    """
    asked = F.when((F.col(requested) != "auto") & (F.col(requested) != ""), F.col(requested))
    custom = asked.isin(*MODELS) | asked.startswith("http://") | asked.startswith("https://")
    best = F.try_element_at(F.filter("ranking", lambda e: e["active"]), F.lit(1))
    known = endpoints.groupBy(F.col("endpoint").alias("_asked")).agg(F.min_by(F.struct("endpoint", "target"), "target").alias("_explicit"))
    df = df.withColumn("_best", best).withColumn("_asked", asked).join(known, "_asked", "left")
    return (
        df.withColumn(
            "routed_endpoint",
            F.when(F.col("_explicit").isNotNull(), F.col("_explicit.endpoint")).when(custom, "custom").otherwise(F.col("_best.endpoint")),
        )
        .withColumn(
            "routed_to",
            F.when(F.col("_explicit").isNotNull(), F.col("_explicit.target"))
            .when(custom, F.col("_asked"))
            .otherwise(F.coalesce(F.col("_best.target"), F.lit(DEFAULT_MODEL))),
        )
        .withColumn(
            "route_score",
            F.when(F.col("_explicit").isNotNull() | custom, F.lit(1.0)).otherwise(F.coalesce(F.col("_best.score"), F.lit(1.0))),
        )
        .withColumn(
            "route_reason",
            F.when(F.col("_explicit").isNotNull() | custom, "explicit_selection")
            .when(F.col("_best").isNotNull(), "ranked")
            .otherwise("default_fallback"),
        )
        .drop("_best", "_explicit", "_asked")
    )


def registry_state(changes: DataFrame, key: str = "endpoint") -> DataFrame:
    """Live endpoints after a log of upserts and deletes; ``seq`` orders the log."""
    latest = changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in changes.columns if c != key]), "seq").alias("r"))
    return latest.select(key, "r.*").where(F.col("op") != "delete").drop("op")
