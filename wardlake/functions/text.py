"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wardlake import fixed
from wardlake.functions.rows import settle

WORD = r"[\p{L}\p{N}_]+"
WORD_CHAR = r"[\p{L}\p{N}_]"
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"

# Characters that NFKC leaves as they are and that never combine with a
# neighbour. Text made of these alone does not have to visit Python.
NFKC_STABLE = (
    r"\x00-\x7F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131\u0134-\u013E"
    r"\u0141-\u0148\u014A-\u017E\u0391-\u03A1\u03A3-\u03CE\u0400-\u0481\u2013\u2014\u2018-\u201D\u200B-\u200D\uFEFF"
)
# One range and a few single characters: a fast first test for Latin-1 text.
LATIN_UNSTABLE = (
    r"[\u00A0\u00A8\u00AA\u00AF\u00B2\u00B3\u00B4\u00B5\u00B8\u00B9\u00BA\u00BC\u00BD\u00BE\u0100-\x{10FFFF}]"
)


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode NFKC; only rows with a character outside the stable set go to Python."""
    unstable = (
        F.when(F.octet_length(text) == F.length(text), F.lit(False))
        .when(~text.rlike(LATIN_UNSTABLE), F.lit(False))
        .otherwise(text.rlike(f"[^{NFKC_STABLE}]"))
    )
    return F.coalesce(_nfkc(F.when(unstable, text)), text)


def fold_homoglyphs(text: Column) -> Column:
    return F.translate(text, fixed.HOMOGLYPHS_FROM, fixed.HOMOGLYPHS_TO)


def strip_zero_width(text: Column) -> Column:
    return F.translate(text, fixed.ZERO_WIDTH, "")


def fold_marks(text: Column) -> Column:
    """Both in one pass: homoglyphs folded, zero-width characters taken out."""
    return F.translate(text, fixed.HOMOGLYPHS_FROM + fixed.ZERO_WIDTH, fixed.HOMOGLYPHS_TO)


def join_spaced_letters(text: Column) -> Column:
    """``b.a.d`` and ``b a d`` become ``bad``."""
    # The first two tests only settle most places before the word edge, which costs far more, is looked for.
    return F.regexp_replace(text, r"(?U)(?=[\s._\-])(?<![a-zA-Z]{2})(?<=\b[a-zA-Z])[\s._\-]+(?=[a-zA-Z]\b)", "")


def fold_leet(text: Column) -> Column:
    return F.translate(text, fixed.LEET_FROM, fixed.LEET_TO)


def compress_repeats(text: Column) -> Column:
    """Three or more of one character become two."""
    return F.regexp_replace(text, r"(.)\1{2,}", "$1$1")


def clean_text(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", ""), f"{SPACE}+", " "), F.lit(""))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def unquote(text: Column) -> Column:
    """Percent-decoding that leaves ``+`` and stray ``%`` alone."""
    kept = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(kept)


def url_payload(text: Column) -> Column:
    """The percent-decoded text where decoding changes it, else null."""
    decoded = unquote(text)
    return F.when(
        text.rlike("%[0-9A-Fa-f]{2}") & (decoded != text) & (F.length(strip(decoded)) > 3),
        decoded,
    )


def base64_payloads(text: Column, whole: bool = False) -> Column:
    """Readable contents of the base64 tokens (12 characters or more) of a text.

    Bytes that are no text are left out of a payload; with ``whole`` a payload that holds any is left out.
    """
    tokens = F.regexp_extract_all(
        text, F.lit(r"(?=[A-Za-z0-9])(?<![A-Za-z0-9_])(?<![\p{L}\p{N}_])[A-Za-z0-9][A-Za-z0-9+/]{11,}={0,2}(?![\p{L}\p{N}_])"), F.lit(0)
    )
    def fits(t: Column) -> Column:
        even = F.length(t) % 4 == 0
        return even & F.coalesce(F.is_valid_utf8(F.try_to_binary(t, F.lit("base64")).cast("string")), F.lit(False)) if whole else even

    readable = F.transform(
        F.filter(tokens, fits),
        lambda t: strip(
            F.replace(F.make_valid_utf8(F.try_to_binary(t, F.lit("base64")).cast("string")), F.lit("\uFFFD"), F.lit(""))
        ),
    )
    return F.filter(readable, lambda t: t.rlike(r"\p{L}") & (F.length(t) > 2))


def decoded_payloads(text: Column, whole: bool = False) -> Column:
    return F.concat(F.array_compact(F.array(url_payload(text))), base64_payloads(text, whole))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def with_variants(df: DataFrame, text: str = "text", decoded: bool = True, whole: bool = False) -> DataFrame:
    """Add canonical, leet, compressed (all lower case) and decoded forms of a text column.

    ``whole`` decodes only payloads that are text in full, as the checking SQL does; the guard reads the others too.

    Each step is its own projection, so a form that feeds several others is
    computed once and not inlined into each of them.
    """
    source = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("_folded", fold_marks(nfkc(source)))
    out = settle(out.withColumn("_stripped", join_spaced_letters(F.col("_folded"))))
    out = out.withColumn("_leet", fold_leet(F.col("_stripped")))
    out = out.select(
        *df.columns,
        F.lower("_stripped").alias("canonical"),
        F.lower("_leet").alias("leet"),
        F.lower(compress_repeats(F.col("_leet"))).alias("compressed"),
        *([decoded_payloads(source, whole).alias("decoded")] if decoded else []),
    )
    return settle(out)


def sentences(text: Column) -> Column:
    """Sentences of at least three words."""
    parts = F.split(text, rf"(?<=[.!?\n]){SPACE}+", -1)
    kept = F.filter(
        F.transform(parts, strip), lambda s: F.size(F.split(s, f"{SPACE}+", -1)) >= 3
    )
    return kept


def title_case(text: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere."""
    chars = F.split(text, "")
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(chars), F.lit(1))),
            lambda i: F.when(
                (i == 1) | ~F.try_element_at(chars, F.greatest(i - 1, F.lit(1))).rlike(r"\p{L}"),
                F.upper(F.try_element_at(chars, i)),
            ).otherwise(F.lower(F.try_element_at(chars, i))),
        ),
        "",
    )
