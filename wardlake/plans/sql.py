"""Pieces of the checking SQL: literals, text normalisation, hashed vectors."""

from __future__ import annotations

from collections.abc import Iterable

from wardlake import fixed
from wardlake.functions import text


def lit(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(rows: Iterable[tuple], columns: str, name: str = "v") -> str:
    body = ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS {name}({columns}))"


def strings(items: Iterable[str]) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def case(rows: Iterable[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rows) + f" ELSE {otherwise} END"


def match(column: str, pattern: str, ignore_case: bool = True) -> str:
    return f"regexp_matches({column}, {lit(('(?i)' if ignore_case else '') + pattern)})"


SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
WORDS = lit(text.WORD)


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def clean(x: str) -> str:
    return f"coalesce(regexp_replace({strip(x)}, '{SPACE}+', ' ', 'g'), '')"


def folded(x: str) -> str:
    mapped = f"translate({x}, {lit(fixed.HOMOGLYPHS_FROM)}, {lit(fixed.HOMOGLYPHS_TO)})"
    return r"regexp_replace(" + mapped + r", '[\x{200B}-\x{200D}\x{FEFF}\x{AD}]', '', 'g')"


# letters beyond ASCII get word characters around them, so that ASCII \b sees them as letters
_FOREIGN = r"([\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{1FFF}])"


def joined_letters(x: str) -> str:
    guarded = f"regexp_replace({x}, '{_FOREIGN}', '0' || chr(2) || '\\1' || chr(2) || '0', 'g')"
    once = r"'\b([a-zA-Z])[\s._\-]+([a-zA-Z])\b', '\1' || chr(1) || '\2', 'g'"
    marked = f"regexp_replace(regexp_replace({guarded}, {once}), {once})"
    return f"replace(replace(replace({marked}, chr(1), ''), '0' || chr(2), ''), chr(2) || '0', '')"


def leet(x: str) -> str:
    return f"translate({x}, {lit(fixed.LEET_FROM)}, {lit(fixed.LEET_TO)})"


def variants(source: str, id_col: str) -> str:
    """CTEs ending in ``variants(id, text, canonical, leet, compressed, decoded)`` from a source CTE.

    Runs of a character are compressed over the exploded characters of the text.
    """
    return f"""
    v0 AS (SELECT {id_col} AS id, text, {folded('text')} AS f FROM {source}),
    v1 AS (SELECT id, text, {joined_letters('f')} AS stripped FROM v0),
    v2 AS (SELECT id, text, lower(stripped) AS canonical, {leet('stripped')} AS leet0 FROM v1),
    v3 AS (SELECT id, unnest(string_split(leet0, '')) AS c, generate_subscripts(string_split(leet0, ''), 1) AS i FROM v2),
    v4 AS (SELECT id, c, i, lag(c, 1) OVER w AS p1, lag(c, 2) OVER w AS p2 FROM v3 WINDOW w AS (PARTITION BY id ORDER BY i)),
    v5 AS (SELECT id, string_agg(c, '' ORDER BY i) AS s FROM v4
           WHERE c = chr(10) OR p1 IS NULL OR p2 IS NULL OR NOT (c = p1 AND c = p2) GROUP BY id),
    variants AS (SELECT v2.id, v2.text, canonical, lower(leet0) AS leet, coalesce(lower(s), '') AS compressed,
      list_filter([CASE WHEN regexp_matches(v2.text, '%[0-9A-Fa-f]{{2}}') AND url_decode(v2.text) <> v2.text THEN url_decode(v2.text) END]
        || list_transform(list_filter(regexp_extract_all(v2.text, '[A-Za-z0-9+/]{{12,}}={{0,2}}'), lambda t: length(t) % 4 = 0),
             lambda t: TRY(decode(from_base64(t)))), lambda d: d IS NOT NULL) AS decoded
      FROM v2 LEFT JOIN v5 USING (id))"""


def scan_text(source: str = "variants") -> str:
    """CTE ``scan(id, s, toks)``: all forms as lines of one string."""
    return f"""
    scan0 AS (SELECT *, array_to_string([canonical, leet, compressed] || decoded, chr(10)) AS s FROM {source}),
    scan AS (SELECT *, list_distinct(regexp_extract_all(s, {WORDS})) AS toks FROM scan0)"""


def lexicon(tiers: dict[str, list[str]], source: str = "scan") -> str:
    """CTE ``lex`` with severe, moderate, mild lists and lexicon_score."""
    parts = []
    for tier, terms in tiers.items():
        single = [t for t in terms if " " not in t]
        phrases = [t for t in terms if " " in t]
        found = f"list_filter({strings(single)}, lambda t: list_contains(toks, t))"
        if phrases:
            checks = ", ".join(
                f"CASE WHEN regexp_matches(s, {lit('(?:^|[^' + text.WORD_CHAR[1:-1] + '])' + p + '(?:$|[^' + text.WORD_CHAR[1:-1] + '])')}) THEN {lit(p)} END"
                for p in phrases
            )
            found = f"({found} || list_filter([{checks}], lambda t: t IS NOT NULL))"
        parts.append(f"list_sort({found}) AS {tier}")
    return f"""
    lex0 AS (SELECT *, {', '.join(parts)} FROM {source}),
    lex AS (SELECT *, round(CASE WHEN len(severe) > 0 THEN least(0.85 + 0.05 * (len(severe) - 1), 1.0)
       WHEN len(moderate) > 0 THEN least(0.75 + 0.05 * (len(moderate) - 1), 0.95)
       WHEN len(mild) > 0 THEN least(0.45 + 0.05 * (len(mild) - 1), 0.65) ELSE 0 END, 2)::DOUBLE AS lexicon_score FROM lex0)"""


def rule_hits(column: str, rules: Iterable[tuple[str, float, str]], ignore_case: bool = True) -> str:
    items = ", ".join(
        f"CASE WHEN {match(column, pattern, ignore_case)} THEN {{'rule': {lit(name)}, 'score': {score}::DOUBLE}} END"
        for name, score, pattern in rules
    )
    return f"list_filter([{items}], lambda zz: zz IS NOT NULL)"


def best(hits: str) -> str:
    return f"coalesce(list_max(list_transform({hits}, lambda zz: zz.score)), 0.0)"


def names(hits: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_transform({hits}, lambda zz: zz.rule))), ',')"


def embedding(name: str, source: str, id_col: str = "id", text_col: str = "text", stopwords: bool = False) -> str:
    """CTEs ending in ``name(id, b, v)``: sparse unit vectors of the texts of a source."""
    raw = f"regexp_extract_all(lower({text_col}), {WORDS})"
    kept = f"list_filter(w0, lambda t: NOT list_contains({strings(fixed.STOPWORDS)}, t))" if stopwords else "w0"
    return f"""
    {name}_w AS (SELECT id, CASE WHEN len(k) > 0 THEN k ELSE w0 END AS w FROM
        (SELECT {id_col} AS id, {raw} AS w0, {kept.replace('w0', raw)} AS k FROM {source})),
    {name}_t AS (SELECT id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM {name}_w),
    {name}_g AS (SELECT id, t AS g, 1.0::DOUBLE AS x FROM {name}_t UNION ALL
        SELECT id, p || '_' || t, 1.5 FROM (SELECT id, t, lag(t) OVER (PARTITION BY id ORDER BY i) AS p FROM {name}_t) WHERE p IS NOT NULL),
    {name}_s AS (SELECT id, ('0x' || substr(md5(g), 1, 8))::BIGINT % 384 AS b, sum(x) AS v FROM {name}_g GROUP BY ALL),
    {name} AS (SELECT id, b, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM {name}_s)"""
