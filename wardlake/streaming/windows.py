"""Event-time windows: alerts, vault expiry, de-duplication, token windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions import ordered
from wardlake.functions.rows import settle, spread, spread_structs
from wardlake.operators import analytics, leakage

WINDOW = 30
TOKEN = r"\s*\S+"
#: Ids shared by several texts that are sent to every task; more are joined by shuffling the texts.
MAX_SHARED = 100_000


def windowed_rates(events: DataFrame, width: str = "60 seconds", delay: str = "10 minutes", watermark: bool = True) -> DataFrame:
    """Event counts and rates per tumbling window; rows later than ``delay`` are dropped by a stream.

    Two exact steps, so a stream can run it: events of one interaction in a
    window first, then the window.
    """
    df = events.withWatermark("created_at", delay) if watermark else events
    span = F.window("created_at", width)
    per_interaction = df.groupBy(span, "interaction_id").agg(
        F.count_if(F.col("decision_action") == "block").alias("blocks"), F.count_if(F.col("decision_action") == "escalate").alias("escalations")
    )
    per_window = per_interaction.groupBy("window").agg(
        F.count(F.lit(1)).alias("total_interactions"), F.sum("blocks").alias("b"), F.sum("escalations").alias("e")
    )
    return per_window.select(
        F.col("window.start").alias("window_start"), "total_interactions",
        (F.col("b") / F.col("total_interactions")).alias("block_rate"), (F.col("e") / F.col("total_interactions")).alias("escalation_rate"),
    )


def with_open_windows(closed: DataFrame, events: DataFrame, width: str = "60 seconds") -> DataFrame:
    """Rates a stream has emitted, and those of the windows that the watermark has not closed, from the events since the last closed one.

    The closing pass reads only events of open windows; run again later, it replaces them.
    """
    width_s = F.expr(f"INTERVAL {width}")
    last = closed.agg((F.max("window_start") + width_s).alias("_from"))
    rest = events.join(F.broadcast(last), F.col("_from").isNull() | (F.col("created_at") >= F.col("_from"))).drop("_from")
    return closed.unionByName(windowed_rates(rest, width, watermark=False))


def windowed_alerts(rates: DataFrame) -> DataFrame:
    return analytics.sigma_alerts(rates)


def live_vault(entries: DataFrame, ttl: str = "600 seconds") -> DataFrame:
    """First entry of each (key, placeholder) within the time to live; state expires with the watermark."""
    return entries.withWatermark("created_at", ttl).dropDuplicatesWithinWatermark(["doc_id", "placeholder"])


def tokens(df: DataFrame, id_col: str, source: str = "text") -> DataFrame:
    """Texts as token streams: (id, seq, token), separators kept so that tokens join back to the text."""
    parts = F.regexp_extract_all(F.col(source), F.lit(TOKEN), F.lit(0))
    return spread(df, [id_col], parts, "token", "seq")


# Characters with which a secret marker or a tripwire can end. The first window
# that leaks ends with the token that completes the match, so only tokens with
# one of these have to be tried.
ENDINGS = r"[-_A\]>]"


def _stop_kind(window_text: Column, markers: tuple[str, ...]) -> Column:
    secret = F.lit(False)
    for marker in markers:
        secret = secret | window_text.contains(marker)
    return F.when(leakage.canary(window_text), "prompt_leak").when(secret, "secret")


def guard_tokens(stream_tokens: DataFrame, id_col: str, markers: tuple[str, ...], size: int = WINDOW, block: int = 2048) -> DataFrame:
    """Tokens up to the first window of ``size`` tokens that leaks, then one block marker.

    A long stream is cut into blocks of tokens; the tail of each block is
    repeated at the head of the next, so every window is seen whole and no
    stream is held in one task. A block's list is bounded by the block size.
    """
    home = ordered.block_chunk(F.col("seq"), block)
    spill = F.when((F.col("seq") + size - 1) >= (home + 1) * block, home + 1)
    copies = stream_tokens.withColumn("_blk", F.explode(F.array_compact(F.array(home, spill))))
    blocks = copies.groupBy(id_col, "_blk").agg(F.array_sort(F.collect_list(F.struct("seq", "token"))).alias("t"))
    places = F.filter(
        F.sequence(F.lit(1), F.size("t")),
        lambda i: F.element_at("t", i)["token"].rlike(ENDINGS) & (F.element_at("t", i)["seq"] >= F.col("_blk") * block),
    )
    blocks = settle(blocks.withColumn("_places", places))

    def tried(i: Column) -> Column:
        first = F.greatest(i - (size - 1), F.lit(1))
        window_text = F.array_join(F.transform(F.slice("t", first, i - first + 1), lambda x: x["token"]), "")
        return F.struct(F.element_at("t", i)["seq"].alias("seq"), _stop_kind(window_text, markers).alias("kind"))

    stops = F.filter(F.transform("_places", tried), lambda s: s["kind"].isNotNull())
    found = spread_structs(blocks, [id_col], stops)
    first = found.groupBy(id_col).agg(F.min("seq").alias("_at"), F.min_by("kind", "seq").alias("_kind"))
    out = stream_tokens.join(first, id_col, "left").where(F.col("_at").isNull() | (F.col("seq") <= F.col("_at")))
    return _stopped(out, id_col)


def _stopped(out: DataFrame, id_col: str) -> DataFrame:
    hit = F.col("seq") == F.col("_at")
    return out.select(
        id_col, "seq", F.when(hit, F.concat(F.lit(" [BLOCKED: "), F.upper("_kind"), F.lit("]"))).otherwise(F.col("token")).alias("content"),
        F.when(hit, "content_filter").alias("finish_reason"),
    )


def guard_texts(texts: DataFrame, id_col: str, markers: tuple[str, ...], source: str = "text", size: int = WINDOW) -> DataFrame:
    """As ``guard_tokens`` over the tokens of texts, judged in the row of the text: no token is shuffled.

    Rows that share an id are one stream, whose tokens come in turn; they go by ``guard_tokens``. Only ids are
    counted to find them. As there, texts without an id are not judged.
    """
    texts = texts.select(id_col, F.col(source).alias("text"))
    shared = texts.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").select(id_col)
    few = shared.limit(MAX_SHARED + 1).count()
    if not few:
        return _guard_rows(texts, id_col, markers, size)
    shared = F.broadcast(shared) if few <= MAX_SHARED else shared
    one = _guard_rows(texts.join(shared, id_col, "left_anti"), id_col, markers, size)
    several = tokens(texts.join(shared, id_col, "left_semi"), id_col)
    return one.unionByName(guard_tokens(several, id_col, markers, size))


def _guard_rows(texts: DataFrame, id_col: str, markers: tuple[str, ...], size: int) -> DataFrame:
    rows = settle(texts.select(id_col, F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("t")))
    numbers = F.when(F.col(id_col).isNotNull() & (F.size("t") > 0), F.sequence(F.lit(1), F.size("t")))
    rows = settle(rows.withColumn("_places", F.filter(numbers, lambda i: F.element_at("t", i).rlike(ENDINGS))))

    def tried(i: Column) -> Column:
        first = F.greatest(i - (size - 1), F.lit(1))
        return F.struct((i - 1).alias("seq"), _stop_kind(F.array_join(F.slice("t", first, i - first + 1), ""), markers).alias("kind"))

    none = F.struct(F.lit(None).cast("int").alias("seq"), F.lit(None).cast("string").alias("kind"))
    first = F.aggregate("_places", none, lambda found, i: F.when(found["kind"].isNotNull(), found).otherwise(tried(i)))
    rows = settle(rows.withColumn("_first", first))
    kind = F.col("_first.kind")
    rows = rows.select(id_col, "t", kind.alias("_kind"), F.when(kind.isNotNull(), F.col("_first.seq")).alias("_at"))
    said = F.when(F.col("_at").isNull(), F.col("t")).otherwise(F.slice("t", F.lit(1), F.col("_at") + 1))
    return _stopped(spread(rows, [id_col, "_at", "_kind"], said, "token", "seq"), id_col)
