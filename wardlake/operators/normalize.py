"""Text normalisation jobs over tables of texts and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions import ordered, text
from wardlake.functions.rows import spread, spread_structs

CODE_HINT = r"[+=({;]"
TURN_BLOCK = 1024


def variants(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """One row per (id, variant, text): original, canonical, leet, compressed and each decoded payload."""
    wide = text.with_variants(df.select(id_col, text_col), text_col)
    forms = F.concat(
        F.array(
            *[
                F.struct(F.lit(name).alias("variant"), F.lit(0).alias("part"), F.col(source).alias("form"))
                for name, source in (
                    ("original", text_col),
                    ("canonical", "canonical"),
                    ("leet", "leet"),
                    ("compressed", "compressed"),
                )
            ]
        ),
        F.transform(
            "decoded",
            lambda d, i: F.struct(F.lit("decoded").alias("variant"), i.alias("part"), d.alias("form")),
        ),
    )
    return spread_structs(wide, [id_col], forms).withColumn("form", F.coalesce("form", F.lit("")))


def _printable(value: Column) -> Column:
    return F.replace(F.make_valid_utf8(value.cast("string")), F.lit("\uFFFD"), F.lit(""))


def unpacked_strings(code: Column) -> Column:
    """Strings that a piece of code assembles from parts, without running or parsing it.

    Adjacent literals joined by ``+`` (16 characters or more), ``fromhex`` and
    base64 arguments and lists of ``chr`` calls (12 or more).
    """
    quote = "[\"']"
    joined = F.regexp_replace(code, rf"{quote}\s*\+\s*{quote}", "")
    fold = F.when(code.rlike(rf"{quote}\s*\+\s*{quote}"), joined).otherwise(F.lit(""))
    before = F.regexp_extract_all(code, F.lit(rf"{quote}([^\"']*){quote}"), F.lit(1))
    literals = F.array_except(F.regexp_extract_all(fold, F.lit(rf"{quote}([^\"']{{16,}}){quote}"), F.lit(1)), before)

    hexed = F.transform(
        F.regexp_extract_all(code, F.lit(rf"fromhex\(\s*{quote}((?:[0-9A-Fa-f]{{2}})+){quote}\s*\)"), F.lit(1)),
        lambda h: _printable(F.unhex(h)),
    )
    encoded = F.transform(
        F.filter(
            F.regexp_extract_all(
                code,
                F.lit(rf"(?:atob|b64decode|FromBase64String)\s*\(\s*{quote}([A-Za-z0-9+/=]+){quote}\s*\)"),
                F.lit(1),
            ),
            lambda b: F.length(b) % 4 == 0,
        ),
        lambda b: _printable(F.try_to_binary(b, F.lit("base64"))),
    )
    chr_lists = F.transform(
        F.regexp_extract_all(code, F.lit(r"\[\s*(chr\(\s*\d+\s*\)(?:\s*,\s*chr\(\s*\d+\s*\))*)\s*\]"), F.lit(1)),
        lambda calls: F.array_join(
            F.transform(
                F.regexp_extract_all(calls, F.lit(r"\d+"), F.lit(0)), lambda n: F.char(F.try_to_number(n, F.lit("9999999")).cast("int"))
            ),
            "",
        ),
    )
    short = F.filter(F.concat(hexed, encoded, chr_lists), lambda s: F.length(s) >= 12)
    return F.when(code.rlike(CODE_HINT), F.array_distinct(F.concat(literals, short))).otherwise(
        F.array().cast("array<string>")
    )


def sentence_rows(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    return spread(df, [id_col], text.sentences(F.col(text_col)), "sentence", "pos")


def collapse_messages(turns: DataFrame, greeting: str = "Hello") -> DataFrame:
    """Conversations as model-ready turns.

    The last system text is hoisted, other roles become user or model, adjacent
    turns of one role merge with a blank line and leading model turns go. A
    conversation with nothing left gets one greeting.
    """
    spoken = turns.where(F.col("role") != "system").withColumn(
        "speaker", F.when(F.col("role") == "user", "user").otherwise("model")
    )
    chunk = ordered.block_chunk(F.col("turn"), TURN_BLOCK)
    first_user = spoken.where("speaker = 'user'").groupBy("conv_id").agg(F.min("turn").alias("from_turn"))
    kept = spoken.join(first_user, "conv_id").where("turn >= from_turn")
    marked = ordered.previous(kept, ["conv_id"], chunk, ["turn"], "speaker", "before")
    marked = marked.withColumn("starts", (F.col("before").isNull() | (F.col("before") != F.col("speaker"))).cast("long"))
    runs = ordered.running_sum(marked, ["conv_id"], chunk, [F.col("turn")], F.col("starts"), "run")
    merged = runs.groupBy("conv_id", "run", "speaker").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n\n"
        ).alias("content")
    )
    heads = turns.groupBy("conv_id").agg(
        F.max_by("text", F.when(F.col("role") == "system", F.col("turn"))).alias("system_text")
    )
    empty = F.col("run").isNull()
    return heads.join(merged, "conv_id", "left").select(
        "conv_id",
        F.when(empty, F.lit(1)).otherwise(F.col("run")).cast("long").alias("run"),
        F.when(empty, F.lit("user")).otherwise(F.col("speaker")).alias("speaker"),
        F.when(empty, F.lit(greeting)).otherwise(F.col("content")).alias("content"),
        "system_text",
    )


def last_user_message(turns: DataFrame) -> DataFrame:
    """Latest user turn of each conversation, else its latest turn."""
    is_user = F.col("role") == "user"
    return turns.groupBy("conv_id").agg(
        F.coalesce(
            F.max_by("text", F.when(is_user, F.col("turn"))),
            F.max_by("text", "turn"),
        ).alias("text"),
        F.coalesce(F.max(F.when(is_user, F.col("turn"))), F.max("turn")).alias("turn"),
    )


def current_message(turns: DataFrame) -> DataFrame:
    """Only the newest message of each conversation; the history plays no part."""
    newest = F.max_by(F.struct("turn", "role", "text"), "turn")
    return turns.groupBy("conv_id").agg(newest.alias("m")).select("conv_id", "m.*")


def system_prompts(turns: DataFrame) -> DataFrame:
    """First system-role message of each conversation."""
    return (
        turns.where(F.col("role") == "system")
        .groupBy("conv_id")
        .agg(F.min_by("text", "turn").alias("system_prompt"))
    )
