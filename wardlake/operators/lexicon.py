"""Tiered word and phrase scan.

A lexicon is a small table (term, tier). Its size is checked when it is read;
terms then become array literals and the scan stays one narrow projection.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.functions import text
from wardlake.functions.rows import spread
from wardlake.session import bounded_rows

TIERS = ("severe", "moderate", "mild")


def tier_of_extension(term: Column) -> Column:
    stem = F.lit(False)
    for part in fixed.KILL_STEMS:
        stem = stem | term.contains(part)
    return F.when(stem, F.lit("severe")).otherwise(F.lit("moderate"))


def tier_table(spark: SparkSession) -> DataFrame:
    """Base tiers merged with the language extensions: (term, tier), one row per term and tier."""
    base = spark.createDataFrame(
        [(term, tier) for tier, terms in fixed.LEXICON.items() for term in terms], "term string, tier string"
    )
    extra = spark.createDataFrame(
        [(term,) for terms in fixed.LEXICON_EXTENSIONS.values() for term in terms], "term string"
    ).withColumn("tier", tier_of_extension(F.col("term")))
    return base.unionByName(extra).distinct()


def load_tiers(lexicon: DataFrame) -> dict[str, list[str]]:
    """A lexicon table as term lists per tier; refuses a table beyond the size limit."""
    rows = bounded_rows(lexicon.select("term", "tier").distinct())
    if rows is None:
        raise ValueError("lexicon too large for the in-row scan; use scan_by_join")
    return {tier: sorted(r["term"] for r in rows if r["tier"] == tier) for tier in TIERS}


def default_tiers() -> dict[str, list[str]]:
    tiers = {tier: set(terms) for tier, terms in fixed.LEXICON.items()}
    for terms in fixed.LEXICON_EXTENSIONS.values():
        for term in terms:
            tiers["severe" if any(s in term for s in fixed.KILL_STEMS) else "moderate"].add(term)
    return {tier: sorted(terms) for tier, terms in tiers.items()}


def with_scan_text(df: DataFrame, out: str = "scan_text") -> DataFrame:
    """All normalised forms of a text as lines of one string, equal forms once."""
    forms = F.array_distinct(F.concat(F.array("canonical", "leet", "compressed"), F.col("decoded")))
    return df.withColumn(out, F.array_join(forms, "\n"))


def _terms(terms: list[str]) -> Column:
    """Terms as one array; constant folding turns it into a literal."""
    return F.split(F.lit("\n".join(terms)), "\n")


def _phrase_hit(scan: Column, phrase: str) -> Column:
    bounded = rf"(?<!{text.WORD_CHAR})" + re.escape(phrase) + rf"(?!{text.WORD_CHAR})"
    return scan.contains(phrase) & scan.rlike(bounded)


def with_hits(df: DataFrame, scan: str = "scan_text", tiers: Mapping[str, list[str]] | None = None, raw: str | None = None) -> DataFrame:
    """Add the distinct hits of each tier as arrays ``severe``, ``moderate``, ``mild``.

    Normal forms rewrite some punctuation, so terms that hold any are also looked for in the ``raw`` text.
    """
    seen = F.col(scan) if raw is None else F.concat_ws("\n", scan, F.lower(raw))
    tiers = tiers or default_tiers()
    df = df.withColumn("_tokens", F.array_distinct(text.words(F.col(scan))))
    columns = []
    for tier in TIERS:
        # A term that is not one word token (a phrase, or with punctuation inside) is looked for as written.
        single = [t for t in tiers[tier] if re.fullmatch(r"\w+", t)]
        phrases = [t for t in tiers[tier] if not re.fullmatch(r"\w+", t)]
        found = (
            F.array_intersect(F.col("_tokens"), _terms(single))
            if single
            else F.array().cast("array<string>")
        )
        if phrases:
            found = F.concat(
                found, F.array_compact(F.array(*[F.when(_phrase_hit(F.col(scan) if re.fullmatch(r"[\w ]+", p) else seen, p), F.lit(p)) for p in phrases]))
            )
        columns.append(F.array_sort(found).alias(tier))
    return df.select(*[c for c in df.columns if c != "_tokens"], *columns)


def score(severe: Column, moderate: Column, mild: Column) -> Column:
    def step(base: float, cap: float, hits: Column) -> Column:
        return F.least(F.lit(base) + F.lit(0.05) * (F.size(hits) - 1), F.lit(cap))

    return F.round(
        F.when(F.size(severe) > 0, step(0.85, 1.0, severe))
        .when(F.size(moderate) > 0, step(0.75, 0.95, moderate))
        .when(F.size(mild) > 0, step(0.45, 0.65, mild))
        .otherwise(F.lit(0.0)),
        2,
    )


def scan(df: DataFrame, text_col: str = "text", tiers: Mapping[str, list[str]] | None = None, whole: bool = False) -> DataFrame:
    """Add tier hits and ``lexicon_score`` to a table of texts; ``whole`` as in ``text.with_variants``."""
    wide = with_hits(with_scan_text(text.with_variants(df, text_col, whole=whole)), tiers=tiers, raw=text_col)
    return wide.withColumn("lexicon_score", score(F.col("severe"), F.col("moderate"), F.col("mild"))).drop("scan_text")


def _runs_of(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))


def scan_by_join(df: DataFrame, lexicon: DataFrame, id_col: str, text_col: str = "text", max_words: int | None = None) -> DataFrame:
    """The same scan for a lexicon of any size: distinct word runs joined to the term table.

    Returns (id, term, tier). Runs are cut from lines split at anything but a
    single space, so phrases match as written. Runs are as long as the longest phrase of the lexicon. Terms with
    punctuation are few; they are looked for in the row.
    """
    terms = lexicon.select("term", "tier").distinct()
    plain = F.col("term").rlike(rf"^{text.WORD}(?: {text.WORD})*$")
    odd = bounded_rows(terms.where(~plain))
    if odd is None:
        raise ValueError("too many lexicon terms with punctuation")
    if max_words is None:
        max_words = terms.where(plain).agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
    wide = with_scan_text(text.with_variants(df.select(id_col, text_col), text_col))
    pieces = spread(
        wide, [id_col], F.regexp_extract_all("scan_text", F.lit(rf"{text.WORD}(?: {text.WORD})*"), F.lit(0)), "piece"
    ).distinct()
    tokens = pieces.withColumn("w", F.split("piece", " "))
    runs = None
    for n in range(1, max_words + 1):
        grams = spread(tokens.where(F.size("w") >= n), [id_col], _runs_of(n), "term")
        runs = grams if runs is None else runs.unionByName(grams)
    found = runs.distinct().join(terms, "term").select(id_col, "term", "tier")
    if odd:
        seen = F.concat_ws("\n", "scan_text", F.lower(text_col))
        struct = [F.when(_phrase_hit(seen, r["term"]), F.struct(F.lit(r["term"]).alias("term"), F.lit(r["tier"]).alias("tier"))) for r in odd]
        found = found.unionByName(wide.select(id_col, F.inline(F.array_compact(F.array(*struct)))))
    return found


def _labelled(tier: str) -> Column:
    return F.transform(tier, lambda t: F.struct(t.alias("term"), F.lit(tier).alias("tier")))


def scan_table(df: DataFrame, lexicon: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Hits (id, term, tier) of a lexicon table of any size: in the row within the size limit, else by joins."""
    if bounded_rows(lexicon.select("term", "tier").distinct()) is None:
        return scan_by_join(df, lexicon, id_col, text_col)
    wide = with_hits(with_scan_text(text.with_variants(df, text_col)), tiers=load_tiers(lexicon), raw=text_col)
    hits = F.concat(*[_labelled(tier) for tier in TIERS])
    return wide.select(id_col, F.inline(hits))
