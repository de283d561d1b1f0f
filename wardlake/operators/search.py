"""Multi-field token search with graded matches, evaluated row by row in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\s/_\-.:,\[\]\"'()]"


def _escaped(char: str) -> str:
    return re.escape(char)


def subsequence_pattern(token: str) -> str:
    """Pattern whose group 1 runs from the first to the last letter of the token's leftmost in-word subsequence."""
    body = _escaped(token[0])
    for ch in token[1:]:
        body += f"[^{_escaped(ch)}]*{_escaped(ch)}"
    return f"^[^{_escaped(token[0])}]*({body})"


def token_score(token: str, field: str, words: str) -> Column:
    """Score of one token in one lower-case field; ``words`` names the field's parts, in order."""
    size = float(len(token))
    escaped = token.replace("\\", "\\\\").replace("'", "\\'")
    t = f"'{escaped}'"
    starts = f"filter({words}, w -> startswith(w, {t}))"
    acronym = f"array_join(transform({words}, w -> substr(w, 1, 1)), '')"
    edges = SEPARATORS.replace("\\", "\\\\").replace("'", "\\'")
    arms = [
        f"WHEN length({field}) = 0 THEN 0D",
        f"WHEN {field} = {t} THEN 100D",
        f"WHEN startswith({field}, {t}) THEN 90 + {size}D / length({field}) * 10",
        f"WHEN instr({field}, {t}) > 0 THEN CASE WHEN substr({field}, instr({field}, {t}) - 1, 1) RLIKE '{edges}' THEN 80D ELSE 65D END "
        f"+ {size}D / length({field}) * 10",
        f"WHEN size({starts}) > 0 THEN 75 + {size}D / length(try_element_at({starts}, 1)) * 10",
    ]
    if len(token) >= 2:
        arms.append(f"WHEN contains({acronym}, {t}) THEN 70D")
    if len(token) >= 4:
        pattern = subsequence_pattern(token).replace("\\", "\\\\").replace("'", "\\'")
        spans = f"filter(transform({words}, w -> length(regexp_extract(w, '{pattern}', 1))), n -> n > 0 AND n <= {len(token) + 2})"
        arms.append(f"WHEN size({spans}) > 0 THEN greatest(30D, least(80D, 50 + {size}D / try_element_at({spans}, 1) * 20))")
    return F.expr(f"coalesce(CASE {' '.join(arms)} ELSE 0D END, 0D)")


def fuzzy(df: DataFrame, query: str, weights: dict[str, float]) -> DataFrame:
    """Rows in which every query token matches some field, with the summed score."""
    tokens = [t for t in query.lower().split() if t]
    if not tokens:
        return df.withColumn("search_score", F.lit(1.0))
    for name in weights:
        df = df.withColumn(f"_f_{name}", F.lower(F.col(name).cast("string")))
    for name in weights:
        df = df.withColumn(f"_w_{name}", F.filter(F.split(f"_f_{name}", f"{SEPARATORS}+", -1), lambda w: w != ""))
    for i, token in enumerate(tokens):
        best = F.lit(0.0)
        for name, weight in weights.items():
            best = F.greatest(best, token_score(token, f"_f_{name}", f"_w_{name}") * weight)
        df = df.withColumn(f"_t_{i}", best)
    every = F.lit(True)
    total = F.lit(0.0)
    for i in range(len(tokens)):
        every = every & (F.col(f"_t_{i}") > 0)
        total = total + F.col(f"_t_{i}")
    helpers = [f"_f_{n}" for n in weights] + [f"_w_{n}" for n in weights] + [f"_t_{i}" for i in range(len(tokens))]
    return df.where(every).withColumn("search_score", total).drop(*helpers)
