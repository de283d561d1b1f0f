"""Assignment-aware secret scan.

Source and configuration text is lexed into name-literal pairs (``name = "value"``,
``name: value``, ``"name": "value"``, ``name := value``, ``name => value``), constants are
propagated (a literal that is first stored under a plain name and then assigned, also as
part of a concatenation, to a sensitive one; of any number of literals, under names of any length), and every literal is scored by the sensitive
names it reaches. Three plain patterns (assignments, access keys, long hex runs) are
reported always; the method adds spans of kind ``literal``.

Defined results: a null text is an empty text and has no spans; a very long text is scanned
whole; spans of the same place are reported once per kind; rows that repeat are scanned each
for itself; an empty table gives an empty table. Columns that the scan adds replace columns
of the same name; all other columns are kept.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "literal")

# The three plain patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Weight of a word in a target's name; two-word names are looked up joined.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "passcode": 2, "secret": 3, "token": 2, "apikey": 3, "accesskey": 3, "privatekey": 3,
    "secretkey": 3, "signingkey": 3, "encryptionkey": 3, "authkey": 3, "masterkey": 3, "credential": 2, "credentials": 2, "auth": 1, "bearer": 2,
}
#: Words that tell that a name holds something about a secret, not the secret.
HARMLESS = {"name", "file", "path", "url", "uri", "length", "len", "count", "type", "id", "field", "label", "policy", "hint", "prompt", "limit", "max", "min"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|changeme|change_me|example|placeholder|none|null|true|false|undefined|todo|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\).*)$")
LEAST_SCORE = 4
#: Rows of a batch that are rewritten at once, so that texts are not held several times.
OUT_ROWS = 500
#: Characters kept of either end of a value; longer than every word of PLACEHOLDER.
ENDS = 16

_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_HINT = re.compile(r"(?i)pass|pwd|secret|token|key|cred|auth|bearer", re.ASCII)
_QUOTED = r'"(?:[^"\\\n]|\\.)*"' + r"|'(?:[^'\\\n]|\\.)*'" + r"|`(?:[^`\\\n]|\\.)*`"
_TRIPLE = r'"""[\s\S]*?"""' + r"|'''[\s\S]*?'''"
# A term: a quoted literal, with a prefix or without, or all up to the next blank, separator, bracket or quote.
_TERM = re.compile(rf"(?:[fFrRbBuU]{{1,2}}(?=[\"']))?({_TRIPLE}|{_QUOTED})|[^\s,;()\[\]{{}}\"'`]+")
_OPEN = re.compile(r"(?:[(\[{]\s*)+")
_KEY_SIGN = re.compile(r"[ \t]*[:=]")
_PLUS = re.compile(r"\s*\+(?:[ \t]|\\?\n)*|[ \t]*\\\n[ \t]*(?=[\"'])")
_RUN = r"[A-Za-z_$][A-Za-z0-9_$.-]*+"
# A name is taken from the first place in its run of name characters where it can begin, so that each run is read once.
_PAIR = re.compile(
    rf"""(?:(?<![A-Za-z0-9_$])(["'])({_RUN})\1|(?<![A-Za-z0-9_$.-])(?:[.-]|[0-9][A-Za-z0-9_$]*+)*+({_RUN}))[ \t]*(?::=|=>|=(?!=)|:(?![/:]))[ \t]*"""
)
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.]*\Z")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the plain patterns as (start, kind number, end), in that order."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    return sorted(found)


def name_weight(name: str) -> int:
    """How much a target's name says that its value is secret."""
    parts = [w.lower() for w in _WORD.findall(name.rpartition(".")[2] or name)]
    if not parts or parts[-1] in HARMLESS:
        return 0
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(w, 0) for w in [*parts, *joined]), default=0)


class Value:
    """A literal or a concatenation: its places, the values it is made of, and what its score needs of the whole text.

    The text itself may double with each assignment, so only its length, its characters' counts and its ends are kept.
    """

    __slots__ = ("counts", "head", "of", "size", "spans", "tail")

    def __init__(self, text: str = "", spans: Iterable[tuple[int, int]] = ()) -> None:
        self.size, self.counts, self.head, self.tail = len(text), Counter(text), text[:ENDS], text[-ENDS:]
        self.spans, self.of = list(spans), []

    def add(self, other: Value) -> None:
        self.size += other.size
        self.counts.update(other.counts)
        self.head, self.tail = (self.head + other.head)[:ENDS], (self.tail + other.tail)[-ENDS:]
        self.of.append(other)

    def weight(self) -> int:
        """How much the text looks like a key rather than a word: length, character classes and entropy."""
        n, counts = self.size, self.counts
        # A longer text matches a placeholder by its ends and the characters it has.
        sample = self.head if n <= ENDS else self.head + "".join(counts) + self.tail
        if n < 6 or any(c.isspace() for c in counts) or PLACEHOLDER.match(sample):
            return -9
        shares = [c / n for c in counts.values()]
        entropy = -sum(p * math.log2(p) for p in shares if p)
        classes = sum(any(map(f, counts)) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
        return (classes >= 2) + (classes >= 3) + (n >= 16) + (entropy >= 3)


def value_weight(value: str) -> int:
    """How much a literal looks like a key rather than a word."""
    return Value(value).weight()


def _term(text: str, t: re.Match) -> tuple[str, str, int, int]:
    """('text', 'name' or 'names', value, start, end) of a term."""
    if quoted := t.group(1):
        size = 3 if quoted[:3] in ('"""', "'''") and len(quoted) >= 6 else 1
        value, start = quoted[size:-size], t.start(1) + size
        if size == 3:
            start += len(value) - len(value.lstrip())
            value = value.strip()
        return "text", value, start, start + len(value)
    word, end = t.group(), t.end()
    if word[-1] == "+" and text[end : end + 1] in ("\"", "'", "`"):
        word, end = word.rstrip("+"), t.start() + len(word.rstrip("+"))  # the sign of a sum, not a character of the value
    if _NAME.match(word):
        return "name", word, t.start(), end
    return ("names" if "+" in word and all(map(_NAME.match, word.split("+"))) else "text"), word, t.start(), end


def pairs(text: str) -> Iterator[tuple[str, list[tuple[str, str, int, int]]]]:
    """Names with the terms assigned to them: ('text', 'name' or 'names' for a sum without blanks, value, start, end) each.

    An unquoted value goes up to the next blank or separator; assignments within it are looked at too, for sensitive names.
    """
    at = covered = 0
    while m := _PAIR.search(text, at):
        name = m.group(2) or m.group(3)
        if m.start() < covered and not name_weight(name):
            at = max(m.end(), at + 1)
            continue
        terms: list[tuple[str, str, int, int]] = []
        here = m.end()
        if bracket := _OPEN.match(text, here):
            here = bracket.end()
        while t := _TERM.match(text, here):
            terms.append(_term(text, t))
            if terms[-1][3] == terms[-1][2] and not t.group(1):
                terms.pop()
            here = t.end() if t.group(1) or not terms else terms[-1][3]
            plus = _PLUS.match(text, here)
            if not plus:
                break
            here = plus.end()
        if bracket and terms and _KEY_SIGN.match(text, here):  # a key within the bracket, not a value
            at = m.end()
            continue
        if terms:
            yield name, terms
        if terms and text[terms[-1][3] : terms[-1][3] + 1] in ("\"", "'", "`"):
            at = max(here, m.end())
        else:
            at, covered = max(m.end(), at + 1), max(covered, here)


def literal_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of literals that reach a sensitive name, directly or through constants."""
    if not _HINT.search(text) or not (":" in text or "=" in text):
        return []
    constants: dict[str, Value] = {}
    found: set[tuple[int, int, int]] = set()
    told: dict[int, Value] = {}  # holds the values, so that no number is given again
    for name, terms in pairs(text):
        whole = Value()
        for kind, value, start, end in terms:
            names = value.split("+")
            if kind != "text" and all(n in constants for n in names):
                for n in names:
                    whole.add(constants[n])
            elif kind != "name" or len(terms) == 1:  # also an unquoted value of a configuration line
                whole.add(Value(value, [(start, end)]))
        constants[name] = whole
        weight = name_weight(name)
        if weight and weight + whole.weight() >= LEAST_SCORE:
            reached = [whole]
            while reached:  # every value is visited once in a text
                v = reached.pop()
                if id(v) not in told:
                    told[id(v)] = v
                    found.update((s, 3, e) for s, e in v.spans if e > s)
                    reached += v.of
    return sorted(found)


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The plain spans, and all spans."""
    text = text or ""
    base = base_spans(text)
    return base, sorted({*base, *literal_spans(text)})


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span replaced; overlapping spans are one."""
    spans = scan(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _put(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    keep = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in columns}
    return pa.RecordBatch.from_pydict(keep | columns)


def _schema(df: DataFrame, added: list[T.StructField]) -> T.StructType:
    names = {f.name for f in added}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + added)


def with_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_assign, n_access, n_hex, n_literal, base_sha256 and spans to every row."""
    added = [T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex", "n_literal")]
    added += [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py()) for t in batch.column(text)]
            counts = [Counter(k for _, k, _ in both) for _, both in rows]
            out = {f"n_{kind}": pa.array([c[i] for c in counts], pa.int64()) for i, kind in enumerate(KINDS)}
            out["base_sha256"] = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in rows], pa.string())
            out["spans"] = pa.array([written(a) for _, a in rows], pa.string())
            yield _put(batch, out)

    return df.mapInArrow(work, _schema(df, added))


def redact(df: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """Replaces every span in the texts; the length column follows where a text changed. Rows and columns stay."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, OUT_ROWS) for b in batches for i in range(0, b.num_rows, OUT_ROWS)):
            old = batch.column(text).to_pylist()
            new = [redacted(t) for t in old]
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            columns[text] = pa.array(new, columns[text].type)
            if length in columns:
                sizes = [n if a == b else len(b) for a, b, n in zip(old, new, columns[length].to_pylist(), strict=True)]
                columns[length] = pa.array(sizes, columns[length].type)
            yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(work, df.schema)
