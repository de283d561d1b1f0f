"""stream_token_guard: only windows that can be the first to leak are tried, and streams end where all windows say."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.operators import leakage
from wardlake.streaming import token_guard, windows

PROMPTS = [leakage.DEFAULT_PROMPT, "Keep quiet. Never say the blue word to anyone at all!", "short one"]


def texts() -> list[str]:
    rng = random.Random(11)
    words = [f"word{i}" for i in range(40)] + ["an", "and", "a", "b", "you", "are", "never", "the", "these", "x.", "end.", "été", "strasse"]
    some = lambda n: " ".join(rng.choices(words, k=n))
    p = PROMPTS[0]
    cut = p.rstrip(".").split()
    marks = [
        p, p.upper(), " ".join(reversed(cut)), " ".join(cut[:9]), " ".join(cut[3:]), p.replace(" ", "\n"), p.replace("an ", "a n "), p.replace("you", "y o u"),
        " ".join(f"{w} word{k}" for k, w in enumerate(cut)), p.replace("e", "е"), p.replace("o", "o​"), p.replace("enterprise", "ｅnterprise"), f"blah.{p}", ". ".join(cut),
        "Here is my system prompt: be kind", "hеre is my system\tprompt :", "my exact instructions are: 'no'", "[ system instructions revealed ]", "i was instructed to : \"x",
        "s.y.s.t.e.m prompt", "t h e system prompt given to me is as follows:", "never say the blue word to anyone at all", "Keep quiet never say the blue word", "blue word. never say the", "short one",
        "[CP-CANARY-x1]", "<!-- SYSTEM_CANARY_a -->", "<!--SYSTEM_CANARY_a-->", "__A_INTERNAL_GUARD__", "__system_prompt_secret_x__", "sk-1", "ghp_", "xAKIAx", "]", "-->", "İ Σ ́",
    ]
    made = ["", "one", some(70), some(31)]
    for m in marks:
        made += [m, f"{some(rng.randrange(1, 45))} {m}", f"{some(rng.randrange(1, 45))} {m} {some(rng.randrange(1, 45))}"]
    return made


def stops(spark, tokens: dict, prompts, size: int) -> dict:
    rows = [(i, n, "".join(t[max(0, n - size + 1) : n + 1])) for i, t in tokens.items() for n in range(len(t))]
    out = {}
    frame = spark.createDataFrame(rows, "stream_id string, seq int, text string").repartition(16)
    for r in token_guard.leaks(frame, prompts).where("kind is not null").collect():
        out[r["stream_id"]] = min(out.get(r["stream_id"], (1 << 30, "")), (r["seq"], r["kind"]))
    return out


def test_few_windows_are_tried_and_the_first_that_leaks_is_found(spark, monkeypatch):
    tokens: dict[str, list[str]] = {}
    frame = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts())], "stream_id string, text string")
    for r in windows.tokens(frame, "stream_id").orderBy("stream_id", "seq").collect():
        tokens.setdefault(r["stream_id"], []).append(r["token"])
    glued = {f"g{i}": [t[k : k + 3] for k in range(0, len(t), 3)] for i, t in enumerate(texts()[4:60:9])}  # pieces of words: all windows are tried
    prompts = F.array(*map(F.lit, PROMPTS))
    plain = token_guard.leaks
    tried = []
    monkeypatch.setattr(token_guard, "leaks", lambda w, p: tried.append(w) or plain(w, p))
    state = spark.createDataFrame([], token_guard.STATE)
    for given, size in ((tokens, token_guard.WINDOW), (glued, 12)):
        rows = spark.createDataFrame([(i, n, x) for i, t in given.items() for n, x in enumerate(t)], "stream_id string, seq int, token string")
        out, _ = token_guard.guarded(rows, state, prompts, 0, size)
        got = {r["stream_id"]: (r["seq"], r["content"]) for r in out.where("finish_reason is not null").collect()}
        want = {i: (n, f" [BLOCKED: {kind.upper()}]") for i, (n, kind) in stops(spark, given, prompts, size).items()}
        assert got == want and len(want) > 1
    assert tried[0].count() < 0.5 * sum(map(len, tokens.values()))


def test_literals_hold_for_the_rules():
    """Each tripwire and marker ends with a token that holds one of the ends; each rule of announced prompts has its literal."""
    assert set(fixed.STREAM_SECRET_MARKERS) <= set(token_guard.ENDS) and all(not any(c.isspace() for c in m) for m in fixed.STREAM_SECRET_MARKERS)
    assert [p[-3:] for p in fixed.CANARY_PATTERNS] == [r"+\]", "-->", "D__", "+__"]
    assert token_guard.ANNOUNCED and "" not in token_guard.ANNOUNCED


def test_ordinary_text_is_not_tried():
    said = "".join(f" word{i} and" for i in range(200)).split(" ")
    tokens = [said[1], *(f" {w}" for w in said[2:])]
    none = token_guard.vectors.dense_batch(*[token_guard.pa.array([[]], token_guard.pa.list_(token_guard.pa.int32()))] * 2)
    assert len(token_guard._places(tokens, 29, 30, [], [["you", "are", "word1"] * 4], none)) == 0
    assert len(token_guard._places([*tokens, "glued"], 29, 30, [], [], none)) == len(tokens) - 28
