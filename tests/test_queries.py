"""Every registered query runs over its whole tables and agrees with its SQL."""

from __future__ import annotations

from decimal import Decimal

import pytest

import __spark_entry__ as entry

QUERIES = entry.queries()
CHECKS = entry.oracle_sql()


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.6g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in CHECKS:
        assert rows
        return
    result = duck.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["action"] for r in rows} >= {"block", "allow"}
