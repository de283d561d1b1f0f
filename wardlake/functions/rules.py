"""Rule tables as one narrow projection: no row is multiplied by the number of rules."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake import fixed

Rule = tuple[str, float, str]

UNICODE = "(?U)"
UNICODE_NOCASE = "(?Ui)"


# Literal parts that any match of a built-in rule must contain: one of each group. A byte
# search for them is far cheaper than the pattern and settles most texts. They hold for the
# rule's own pattern only: another rule that reuses a name is searched for in full.
REQUIRED: dict[str, tuple[tuple[str, ...], ...]] = {
    "command_chaining": ((";",),),
    "pipe_execution": (("|",),),
    "backtick_execution": (("`",),),
    "subshell_execution": (("$(",),),
    "path_traversal": (("/etc/", "/proc/"),),
    "ssrf_protocol": (("://",),),
    "override_instructions": (("ignore", "disregard", "forget"), ("instructions", "prompts", "rules")),
    "dan_jailbreak": (("now", "act", "roleplay"), ("dan", "jailbreak", "unfiltered", "without")),
    "system_tag_injection": (("[", "<system>", "```system"),),
    "prompt_exfiltration": (("reveal", "show", "print", "display", "output", "echo", "repeat"), ("instructions", "prompt")),
    "mode_override": (("mode",),),
    "instruction_override": (("ignore", "disregard", "forget"), ("instructions", "prompts", "rules")),
    "roleplay_jailbreak": (("act", "pretend", "roleplay"), ("unfiltered", "dan", "stan", "evilai", "jailbroken", "unrestricted")),
    "delimiter_injection": (("[", "<system_instruction>", "```system"),),
    "system_prompt_exfiltration": (("print", "output", "repeat", "show", "reveal", "echo"), ("instructions", "prompt")),
    "encoding_bypass": (("following",),),
    "fictional_framing_bypass": (("hypothetically", "educational", "fictional"),),
    "marginalization": (("people",),),
    "dehumanization": (("you",), ("trash", "garbage", "shit", "scum", "parasite", "cancer", "disease", "waste")),
    "self_harm_encouragement": (("miss",),),
    "self_harm_encouragement_end": (("end",),),
    "group_hate": (("belong",),),
    "prompt_announced": (("prompt", "instructions"),),
    "instructions_quoted": (("instruct",),),
    "reveal_marker": (("revealed",),),
    "prompt_follows": (("follows",),),
    "aws_access_key": (("AKIA",),),
    "github_token": (("gh",),),
    "openai_style_key": (("sk-",),),
    "google_api_key": (("AIza",),),
    "slack_token": (("xox",),),
    "private_key_block": (("PRIVATE KEY",),),
    "uri_credentials": (("://",), ("@",)),
    "assigned_secret": (("=", ":"), ('"', "'")),
    "json_web_token": (("eyJ",),),
    "safe_technical_context": (("kill", "terminate", "execute", "drop", "abort", "destroy", "hang"),),
    "safe_pop_culture_context": (("kill", "rabbit", "monty"),),
    "safe_positive_emphasis": (("fuckin", "freaking", "fricking", "damn", "hell", "badass", "holy"),),
}


_BUILT_IN: dict[str, set[str]] = {}


def built_in(table: Iterable[Rule]) -> None:
    """Names rules to whose patterns the literal parts of their names belong."""
    for name, _, pattern in table:
        _BUILT_IN.setdefault(name, set()).add(pattern)


for _table in (fixed.COMMAND_RULES, fixed.INJECTION_FAST_RULES, fixed.INJECTION_CONTEXT_RULES, fixed.HOSTILITY_RULES, fixed.EXFIL_RULES):
    built_in(_table)


def possible(text: Column, name: str, pattern: str | None = None) -> Column:
    """Whether a text has the literal parts a rule needs; patterns that ignore case need lower-case text."""
    met = F.lit(True)
    own = pattern is None or pattern in _BUILT_IN.get(name, ())
    for group in REQUIRED.get(name, ()) if own else ():
        met = met & contains_any(text, group)
    return met


_LED = re.compile(r"\\b([a-z]+)(?![a-z?*+{])")


def _whole(pattern: str) -> bool:
    """Whether a pattern has no alternatives outside groups."""
    depth = 0
    for part in re.findall(r"\\.|\[(?:\\.|[^\]\\])+\]|.", pattern, re.S):
        depth += (part == "(") - (part == ")")
        if part == "|" and depth == 0:
            return False
    return True


def _first_letters(pattern: str) -> str | None:
    """Plain letters with which every match begins, after a word edge."""
    m = _LED.match(pattern)
    return m[1] if m and _whole(pattern) else None


def led(pattern: str) -> str:
    """The pattern with its first letters looked for before its word edge, whose test costs far more."""
    first = _first_letters(pattern)
    return f"(?={first}){pattern}" if first else pattern


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike((UNICODE_NOCASE if ignore_case else UNICODE) + led(pattern))


def any_of(text: Column, patterns: Iterable[str], ignore_case: bool = True) -> Column:
    found, rest = F.lit(False), []
    for p in patterns:
        first = None if ignore_case else _first_letters(p)
        if first:
            found = found | (text.contains(first) & matches(text, p, ignore_case))
        else:
            rest.append(f"(?:{p})")
    return found | matches(text, "|".join(rest), ignore_case) if rest else found


def hits(text: Column, rules: Iterable[Rule], ignore_case: bool = True) -> Column:
    """Array of (rule, score) for the rules that match, in rule order.

    The text is lower case, or the patterns mind case.
    """
    return F.array_compact(
        F.array(
            *[
                F.when(
                    possible(text, name, pattern) & matches(text, pattern, ignore_case),
                    F.struct(F.lit(name).alias("rule"), F.lit(score).alias("score")),
                )
                for name, score, pattern in rules
            ]
        )
    )


def hits_any(texts: list[Column], rules: Iterable[Rule], ignore_case: bool = True) -> Column:
    """As ``hits``, where a rule counts when any of several texts matches it."""
    entries = []
    for name, score, pattern in rules:
        found = F.lit(False)
        for text in texts:
            found = found | F.coalesce(possible(text, name, pattern) & matches(text, pattern, ignore_case), F.lit(False))
        entries.append(F.when(found, F.struct(F.lit(name).alias("rule"), F.lit(score).alias("score"))))
    return F.array_compact(F.array(*entries))


def best_score(hit_array: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(hit_array, lambda h: h["score"])), F.lit(0.0))


def rule_names(hit_array: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(hit_array, lambda h: h["rule"]))), ",")


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.contains(phrase)
    return found


def present(text: Column, table: Iterable[tuple[str, tuple[str, ...]]]) -> Column:
    """Names of the keyword groups with at least one phrase in the text, in table order."""
    return F.array_compact(
        F.array(*[F.when(contains_any(text, phrases), F.lit(name)) for name, phrases in table])
    )


def verdict(score: Column, fail: float, warn: float | None = None) -> Column:
    out = F.when(score >= fail, F.lit("fail"))
    if warn is not None:
        out = out.when(score >= warn, F.lit("warn"))
    return out.otherwise(F.lit("pass"))
