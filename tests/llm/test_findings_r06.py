"""op1_iblt_fingerprints: words are cut without looking up every character's script, and parts that are tried again are flat arrays."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from wardlake.llm import fingerprints


def test_words_end_where_the_scripts_say(spark):
    """The guard before the scripts leaves out no character of them, on both sides of the first one (U+0E01)."""
    points = [*range(1, 0x1100), *range(0x1780, 0x1800), *range(0x2E80, 0x3200), *range(0x4DF0, 0x4E10), 0xA9E0, 0xAA60, 0xF900, 0xFF66, 0x16FF0, 0x1B001, 0x20000, 0x2F800, 0x1F600]
    rows = spark.createDataFrame([(f"a{chr(p)}b {chr(p)}{chr(p)}",) for p in points], "text string")
    plain = rf"(?<=[\s{fingerprints.SCRIPTS}])"
    assert rows.where(F.split("text", fingerprints.WORD_END) != F.split("text", plain)).count() == 0
    assert fingerprints.WORD_END != plain


def test_retried_parts_are_flat(spark):
    """No struct is built, and copied, for a part; counts stay right with many common digests, whose sums pass 64 bits."""
    rng = random.Random(7)
    sizes = [(0, 0, 0), (3000, 0, 0), (3000, 1, 2), (2000, 40, 60), (0, 700, 0), (0, 0, 500), (10, 900, 1100), (1, 15, 15)]
    made = [([f"{rng.random()}" for _ in range(n)] for n in s) for s in sizes]
    pairs = [(i, "\n".join(c + a), "\n".join(b + c), len(a) + len(b)) for i, (c, a, b) in enumerate(made)]
    rows = spark.createDataFrame(pairs, "i int, a string, b string, want int")
    rows = rows.withColumns({c: fingerprints.digests(F.col(x)) for c, x in (("da", "a"), ("db", "b"))})
    rows = rows.withColumns({c: fingerprints.sketch(F.col(x)) for c, x in (("sa", "da"), ("sb", "db"))}).drop("a", "b")
    got = fingerprints.differing(rows, {"n": ("da", "db", "sa", "sb")})
    assert got.where(F.col("n") != F.col("want")).count() == 0
    assert "struct(" not in got._jdf.queryExecution().analyzed().toString()
    signed = spark.range(1).select(fingerprints.sketch(F.array(F.lit(1 << 55), F.lit(-(1 << 55))), 4, signed=True).alias("s"))
    assert set(signed.first()["s"]) == {0}
