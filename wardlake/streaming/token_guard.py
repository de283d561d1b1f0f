"""Token streams cut off at the first window that leaks, by the whole leak rule.

State per stream is its last tokens and whether it was stopped, as a table in the shared folder: each batch reads the state that
the batch before it left and writes its own, so a batch that is repeated gives the same rows in the same places. A stream
that has been silent for ``keep`` batches is forgotten.

Only windows that can be the first to leak are tried by the rule. Tokens that begin with a space are read one by one: as long as no
single letters are joined, the canonical form of a window is that of its tokens, so words, hashed pairs and literals are found
once for a stream and not anew for each of its windows. Where this doesn't hold, every window is tried.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from wardlake import fixed
from wardlake.functions import rules, text, vectors
from wardlake.functions.rows import settle, spread_structs
from wardlake.operators import leakage

WINDOW = 30
KEEP = 1000
STATE = "stream_id string, tail array<struct<seq:int,token:string>>, stopped boolean, seen long"
OUT = "stream_id string, seq int, content string, finish_reason string"

#: One of these is in the token with which a tripwire or a marker of a secret ends.
ENDS = ("]", "-->", "__", *fixed.STREAM_SECRET_MARKERS)
#: Literals one of which each rule of announced prompts needs; without any, the empty one is in every token.
ANNOUNCED = tuple(sorted({x for name, _, _ in fixed.EXFIL_RULES for x in rules.REQUIRED.get(name, (("",),))[0]}))
#: A window fails by likeness alone from the first number on, by reordered words from the second on (together with full likeness).
LIKE, REUSED = 0.9399, 0.599
#: Characters that are read alike here and by the rule: NFKC leaves them, and their small letters don't depend on neighbours.
_OTHER = re.compile(f"[^{text.NFKC_STABLE}]|[\u0130\u03A3]")
_FOLD: dict[int, str | None] = {}
for _from, _to in zip(fixed.HOMOGLYPHS_FROM + fixed.ZERO_WIDTH, [*fixed.HOMOGLYPHS_TO, *[None] * len(fixed.ZERO_WIDTH)], strict=True):
    _FOLD.setdefault(ord(_from), _to)
#: Single letters that may be joined; more than the rule joins.
_JOINED = re.compile(r"(?<![a-z])[a-z](?=[\s._\-]+[a-z](?![a-z]))")
_JOINED_END = re.compile(r"[\s._\-]+[a-z]")
_ENDS = re.compile("|".join(map(re.escape, ENDS)))
_WORD = re.compile(r"\w+")
_SPACES = " \t\n\x0b\f\r"


def _bucket(token: str) -> int:
    return int(hashlib.md5(token.encode(), usedforsecurity=False).hexdigest()[:8], 16) % vectors.DIMS


_word_bucket = lru_cache(1 << 16)(_bucket)


def _places(tokens: list, tail: int, size: int, literals: list, prompts: list, sentences: np.ndarray) -> np.ndarray:
    """Numbers (from 1) of the tokens after the tail whose windows may be the first to leak.

    A tripwire or marker is first seen with its last token. What else a window may leak by is found in the whole stream, and
    all windows that hold it are tried: a prompt as it is, an announcement's literal, letters that may be joined, enough
    words of a prompt, or a run of words that may be like a sentence of a prompt. The cosine of such a run is at most
    its scalar product with the sentence's unit vector by the least length that so many words and pairs can have.
    """
    n = len(tokens)
    every = np.arange(1, n - tail + 1)
    if None in tokens or any(not t or t[0] not in _SPACES for t in tokens[1:]):
        return every
    said = "".join(tokens)
    if not said.isascii() and _OTHER.search(said):
        return every
    begin = np.cumsum([0, *map(len, tokens)])
    ends = np.unique(np.searchsorted(begin, [m.start() for m in _ENDS.finditer(said)], side="right") - 1)
    whole = said.lower()
    if not said.isascii():
        folded = [t.translate(_FOLD).lower() for t in tokens]
        whole, begin = "".join(folded), np.cumsum([0, *map(len, folded)])
    tried = np.zeros(n + 1, np.int64)

    def hold(first: np.ndarray, last: np.ndarray) -> None:
        """Tries the windows that hold the tokens of a range."""
        fits = last - first < size
        np.add.at(tried, last[fits], 1)
        np.add.at(tried, np.minimum(first[fits] + size, n), -1)

    def found(spans: list[tuple[int, int]]) -> None:
        if spans:
            at = np.array(spans)
            hold(*(np.searchsorted(begin, x, side="right") - 1 for x in (at[:, 0], at[:, 1] - 1)))

    np.add.at(tried, ends, 1)
    np.add.at(tried, ends + 1, -1)
    found([(m.start(), _JOINED_END.match(whole, m.end()).end()) for m in _JOINED.finditer(whole)])
    for literal in [*ANNOUNCED, *literals]:
        at = whole.find(literal)
        spans = []
        while 0 <= at < len(whole):
            spans.append((at, at + max(1, len(literal))))
            at = whole.find(literal, at + 1)
        found(spans)
    words = _WORD.findall(whole)
    owner = np.searchsorted(begin, [m.start() for m in _WORD.finditer(whole)], side="right") - 1
    near = np.zeros(n, bool)
    first = np.maximum(np.arange(n) - size + 1, 0)
    for prompt in prompts:
        known = set(prompt)
        count = np.concatenate([[0], np.cumsum(np.bincount(owner[[w in known for w in words]], minlength=n))])
        near |= count[1:] - count[first] >= max(leakage.MIN_COMMON_WORDS, math.ceil(REUSED * len(prompt)))
    if len(sentences) and words:
        per = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
        most = int((per[1:] - per[first]).max())
        one = sentences[:, [_word_bucket(w) for w in words]] * vectors.WORD_WEIGHT
        two = sentences[:, [_bucket(f"{a}_{b}") for a, b in zip(words, words[1:], strict=False)]] * vectors.PAIR_WEIGHT
        none = np.zeros((len(sentences), 1))
        # Sums up to each word, with and without the pair that ends in it.
        sums = np.cumsum(np.hstack([none, one + np.hstack([none, two])]), axis=1)
        alone = sums[:, :-1] + np.hstack([none, two])
        for m in range(1, most + 1):
            least = LIKE * math.sqrt(vectors.WORD_WEIGHT**2 * m + vectors.PAIR_WEIGHT**2 * (m - 1))
            x = np.flatnonzero((sums[:, m:] - alone[:, : len(words) - m + 1] >= least).any(axis=0))
            if len(x):
                hold(owner[x], owner[x + m - 1])
    may = near | (np.cumsum(tried)[:n] > 0)
    return every[may[tail:]]


def with_places(rows: DataFrame, prompts: Column, size: int) -> DataFrame:
    """Adds ``_places``: which of a stream's tokens (``_all``, after its ``tail``) end windows that have to be tried."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def find(tokens: pa.Array, tail: pa.Array, literals: pa.Array, prompts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        out, known = [], {}
        for k in range(len(tokens)):
            said, skip, whole, words = (x[k].as_py() for x in (tokens, tail, literals, prompts))
            if whole is None or None in whole:
                out.append(list(range(1, len(said) - skip + 1)))
                continue
            key = tuple(whole)  # small letters and edges aside, the prompts, and so their sentences
            if key not in known:
                known[key] = vectors.dense_batch(*(x.slice(k, 1).flatten() for x in (one, two)))
            out.append(_places(said, skip, size, [x for x in whole if len(x) > leakage.MIN_PROMPT_CHARS], words, known[key]).tolist())
        return pa.array(out, pa.list_(pa.int32()))

    stripped = F.transform(F.col("_prompts"), lambda p: F.lower(text.strip(p)))
    told = rows.withColumn("_prompts", prompts)
    told = leakage._sentence_buckets(told, F.flatten(F.transform("_prompts", text.sentences)), "_ps")
    said = F.transform("_all", lambda x: x["token"])
    words = F.transform(stripped, leakage._long_words)
    told = told.withColumn("_places", find(said, F.size("tail"), stripped, words, "_ps_one", "_ps_two"))
    return settle(told).drop("_prompts", "_ps_one", "_ps_two")


def leaks(windows: DataFrame, prompts: Column) -> DataFrame:
    """Adds ``kind``: what stops a window (column text), or null. Tripwires, the leak rule, then markers of secrets."""
    marked = F.exists(F.array(*[F.lit(m) for m in fixed.STREAM_SECRET_MARKERS]), lambda m: F.contains(F.col("text"), m))
    scored = leakage.with_leak_score(text.with_variants(windows.withColumn("prompts", prompts), decoded=False))
    kind = F.when(F.col("leak_verdict") == "fail", "prompt_leak").when(marked, "secret")
    return scored.select(*windows.columns, kind.alias("kind"))


def guarded(tokens: DataFrame, state: DataFrame, prompts: Column, batch: int, size: int = WINDOW, keep: int = KEEP, once: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Tokens (stream_id, seq, token) of a batch up to the first window that leaks, and the state after the batch.

    The windows of a stream's tokens are made in its row, from the tail of the batch before and the tokens of this one; the trigger's input
    limit bounds them. Both results need the streams' rows and the windows that leak, one row per stopped stream: ``once`` may keep them.
    """
    came = tokens.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "token"))).alias("_new"))
    none = F.array().cast("array<struct<seq:int,token:string>>")
    rows = state.join(came, "stream_id", "full")
    # A stopped stream stays stopped: what comes after is let go unread.
    rows = rows.select(
        "stream_id", F.coalesce("stopped", F.lit(False)).alias("stopped"), F.coalesce("tail", none).alias("tail"), F.when(F.coalesce("stopped", F.lit(False)), none).otherwise(F.coalesce("_new", none)).alias("_new"),
        F.when(F.col("_new").isNotNull(), F.lit(batch)).otherwise(F.col("seen")).alias("seen"),
    )
    rows = once(settle(rows.withColumn("_all", F.concat("tail", "_new"))))

    def window(i: Column) -> Column:
        end = F.size("tail") + i
        first = F.greatest(end - (size - 1), F.lit(1))
        held = F.slice("_all", first, end - first + 1)
        return F.struct(F.element_at("_all", end)["seq"].alias("seq"), F.array_join(F.transform(held, lambda x: x["token"]), "").alias("text"))

    # The rows are few bytes but much work: as many tasks as cores, whatever their size.
    wide = rows.where(F.size("_new") > 0).repartition(state.sparkSession.sparkContext.defaultParallelism, "stream_id")
    tried = leaks(spread_structs(with_places(wide, prompts, size), ["stream_id"], F.transform("_places", window)), prompts)
    hits = once(tried.where(F.col("kind").isNotNull()).groupBy("stream_id").agg(F.min("seq").alias("_at"), F.min_by("kind", "seq").alias("_kind")))
    met = rows.join(hits, "stream_id", "left")
    shown = F.filter("_new", lambda x: F.col("_at").isNull() | (x["seq"] <= F.col("_at")))
    out = spread_structs(met.select("stream_id", "_at", "_kind", shown.alias("_shown")), ["stream_id", "_at", "_kind"], "_shown")
    hit = F.coalesce(F.col("seq") == F.col("_at"), F.lit(False))
    out = out.select(
        "stream_id", "seq", F.when(hit, F.concat(F.lit(" [BLOCKED: "), F.upper("_kind"), F.lit("]"))).otherwise(F.col("token")).alias("content"),
        F.when(hit, "content_filter").alias("finish_reason"),
    )
    stopped = F.col("stopped") | F.col("_at").isNotNull()
    tail = F.when(stopped, none).otherwise(F.slice("_all", F.greatest(F.size("_all") - (size - 2), F.lit(1)), F.lit(size - 1)))
    after = met.where(F.col("seen") > batch - keep).select("stream_id", tail.alias("tail"), stopped.alias("stopped"), "seen")
    return out, after


def step(path: str, prompts: Column | None = None, size: int = WINDOW, keep: int = KEEP) -> Callable[[DataFrame, int], None]:
    """A batch function for token rows: writes what is let through to ``path``/out and the state to ``path``/state."""
    prompts = F.array(F.lit(leakage.DEFAULT_PROMPT)) if prompts is None else prompts

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(STATE).parquet(f"{path}/state/{batch_id - 1}") if batch_id else spark.createDataFrame([], STATE)
        kept: list[DataFrame] = []

        def once(df: DataFrame) -> DataFrame:
            kept.append(df.persist())
            return kept[-1]

        out, after = guarded(batch, before, prompts, batch_id, size, keep, once)
        try:
            after.write.mode("overwrite").parquet(f"{path}/state/{batch_id}")
            out.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")
        finally:
            for df in kept:
                df.unpersist()

    return run
