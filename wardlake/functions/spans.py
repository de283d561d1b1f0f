"""Match positions from built-in functions: gap lengths plus match lengths.

The expression is written as SQL text: it is one call to the JVM instead of one
per operator, which matters when eight patterns are built for every query.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


def sql_string(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def find_spans(name: str, pattern: str, group: bool = False, needs: str = "true", extra: str = "") -> Column:
    """Array of (start, end, value) for every match of a pattern in the text column ``name``.

    With ``group`` the span narrows to capture group 1 where that took part.
    ``needs`` is a cheap SQL condition any match implies; ``extra`` adds
    constant fields. Texts without a match cost one search and build nothing.
    """
    p = sql_string(pattern)
    found = f"regexp_extract_all({name}, {p}, 0)"
    inner = f"regexp_extract_all({name}, {p}, 1)" if group else f"transform({found}, m -> '')"
    pairs = (
        f"zip_with(zip_with({found}, slice(split({name}, {p}, -1), 1, size({found})), (m, gap) -> named_struct('m', m, 'gap', gap)), {inner}, "
        "(x, g) -> named_struct('m', x.m, 'gap', x.gap, 'g', coalesce(g, '')))"
    )
    fields = "".join(f", {f}" for f in [extra] if f)
    kind = f"array<struct<start:int,end:int,value:string{', entity_type:string, score:double' if extra else ''}>>"
    begin = "(a.at + length(z.gap) + if(z.g <> '', instr(z.m, z.g) - 1, 0))"
    value = "if(z.g <> '', z.g, z.m)"
    step = (
        "(a, z) -> named_struct('at', a.at + length(z.gap) + length(z.m), 'spans', concat(a.spans, array(named_struct("
        f"'start', {begin}, 'end', {begin} + length({value}), 'value', {value}{fields}))))"
    )
    empty = f"cast(array() AS {kind})"
    return F.expr(
        f"CASE WHEN {needs} AND {name} RLIKE {p} THEN aggregate({pairs}, named_struct('at', 0, 'spans', {empty}), {step}, a -> a.spans) ELSE {empty} END"
    )
