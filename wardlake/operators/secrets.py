"""Secrets: pattern rules, token entropy, structural checks, keyed fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions import hashing, rules
from wardlake.functions.rows import spread

# Our own rule table: (name, confidence, pattern), case matters.
SECRET_RULES = (
    ("aws_access_key", 0.95, r"\bAKIA[0-9A-Z]{16}\b"),
    ("github_token", 0.95, r"\bgh[pousr]_[A-Za-z0-9]{30,}\b"),
    ("openai_style_key", 0.95, r"\bsk-(?:proj-)?[A-Za-z0-9]{20,}\b"),
    ("google_api_key", 0.95, r"\bAIza[0-9A-Za-z_\-]{35}\b"),
    ("slack_token", 0.95, r"\bxox[abprs]-[0-9A-Za-z\-]{10,}"),
    ("private_key_block", 1.0, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    ("uri_credentials", 0.90, r"\b[a-z][a-z0-9+.\-]*://[^\s:/@]+:[^\s:/@]+@[^\s/]+"),
    ("assigned_secret", 0.85, r"(?i:token|secret|api_key|apikey|password|passwd)\s*[:=]\s*[\"'][A-Za-z0-9_\-+/=.]{16,}[\"']"),
    ("json_web_token", 1.0, r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]*"),
)
rules.built_in(SECRET_RULES)

TOKEN = r"[A-Za-z0-9_+/=-]+(?:\.[A-Za-z0-9_+/=-]+)*"
MIN_TOKEN = 20
MIN_BITS = 4.3
MIN_CANDIDATE = 8
HEX40 = r"token = \"([0-9a-f]{40})\""


def pattern_hits(source: Column) -> Column:
    return rules.hits(source, SECRET_RULES, ignore_case=False)


def tokens(source: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(source, F.lit(TOKEN), F.lit(0)))


def entropy_bits(token: Column) -> Column:
    """Shannon entropy of a token's characters, in bits per character."""
    size = F.length(token).cast("double")
    return F.aggregate(
        F.transform(
            F.array_distinct(F.split(token, "")),
            lambda c: (size - F.length(F.replace(token, c, F.lit("")))) / size,
        ),
        F.lit(0.0),
        lambda acc, p: acc - p * F.log2(p),
    )


def most_bits(found: Column) -> Column:
    """The greatest entropy of an array's tokens, 0 if there is none.

    A token of n characters has at most log2(n) bits, so most need not be counted; the margin is for rounding.
    """
    return F.aggregate(
        found,
        F.lit(0.0),
        lambda top, t: F.when(F.log2(F.length(t)) + 1e-9 > top, F.greatest(top, entropy_bits(t))).otherwise(top),
    )


def is_jwt(token: Column) -> Column:
    """Three base64url parts whose first decodes to a JSON object with an ``alg``."""
    head = F.translate(F.split_part(token, F.lit("."), F.lit(1)), "-_", "+/")
    padded = F.rpad(head, (F.ceil(F.length(head) / F.lit(4)) * 4).cast("int"), F.lit("="))
    decoded = F.make_valid_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    shaped = token.rlike(r"^[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+$")
    return F.coalesce(shaped & F.get_json_object(F.when(shaped, decoded), "$.alg").isNotNull(), F.lit(False))


def with_secret_scan(df: DataFrame, source: str = "text") -> DataFrame:
    """Add matched names, high-entropy count and ``secret_score``."""
    df = df.withColumn("_hits", pattern_hits(F.col(source))).withColumn("_tokens", tokens(F.col(source)))
    df = df.withColumn("_long", F.filter("_tokens", lambda t: (F.length(t) >= MIN_TOKEN) & ~t.startswith("http")))
    df = df.withColumn("_strong", F.filter("_long", lambda t: entropy_bits(t) >= MIN_BITS)).withColumn(
        "_jwt", F.exists("_long", is_jwt)
    )
    names = F.array_union(
        F.transform("_hits", lambda h: h["rule"]),
        F.array_compact(
            F.array(
                F.when(F.size("_strong") > 0, F.lit("high_entropy_credential")),
                F.when(F.col("_jwt"), F.lit("json_web_token")),
            )
        ),
    )
    found = F.greatest(
        rules.best_score(F.col("_hits")),
        F.when(F.size("_strong") > 0, F.lit(0.90)).otherwise(F.lit(0.0)),
        F.when(F.col("_jwt"), F.lit(1.0)).otherwise(F.lit(0.0)),
    )
    df = df.withColumn("secret_names", F.array_sort(names)).withColumn("_found", found)
    top = most_bits(F.filter("_tokens", lambda t: F.length(t) > 3))
    quiet = F.round(F.least(F.coalesce(top, F.lit(0.0)) / 5.5 * 0.08, F.lit(0.08)), 4)
    return (
        df.withColumn("high_entropy_count", F.size("_strong").cast("long"))
        .withColumn("secret_score", F.round(F.when(F.col("_found") > 0, F.col("_found")).otherwise(quiet), 4))
        .withColumn("secret_verdict", rules.verdict(F.col("secret_score"), 0.50))
        .drop("_hits", "_tokens", "_long", "_strong", "_jwt", "_found")
    )


def fingerprints(df: DataFrame, keep: list[str], source: str, key: bytes, pattern: str = TOKEN, group: int = 0) -> DataFrame:
    """Distinct keyed fingerprints of the candidate tokens (8 characters or more) of each row."""
    found = F.filter(
        F.array_distinct(F.regexp_extract_all(F.col(source), F.lit(pattern), F.lit(group))), lambda t: F.length(t) >= MIN_CANDIDATE
    )
    return spread(df, keep, found, "token").select(
        *keep, hashing.hmac_sha256(F.col("token"), key).alias("fingerprint")
    )


def match_fingerprints(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """Candidates whose fingerprint an active secret has registered.

    An equi join on a digest. The registry holds one row per fingerprint, so a
    fingerprint many texts share multiplies nothing; its side is small at run
    time for most deployments and adaptive execution then broadcasts it.
    """
    active = registry.where(F.col("status") == "active").select(
        "fingerprint", "secret_id", "secret_type", "action_on_match"
    )
    return candidates.join(active, "fingerprint")


def mark_last_matched(registry: DataFrame, matches: DataFrame, seen_at: str) -> DataFrame:
    """Registry with ``date_last_matched`` moved forward to the newest match."""
    newest = matches.groupBy("secret_id").agg(F.max(seen_at).alias("_seen"))
    return (
        registry.join(newest, "secret_id", "left")
        .withColumn("date_last_matched", F.greatest(F.col("date_last_matched"), F.col("_seen")))
        .drop("_seen")
    )


def releaked(inputs: DataFrame, outputs: DataFrame, key: bytes, min_length: int = 12) -> DataFrame:
    """Outputs that echo a token from an earlier input of the same session."""

    def prints(df: DataFrame) -> DataFrame:
        long_tokens = F.filter(tokens(F.col("text")), lambda t: F.length(t) >= min_length)
        return spread(df, ["session_id", "turn"], long_tokens, "token").select(
            "session_id", "turn", hashing.hmac_sha256(F.col("token"), key).alias("fingerprint")
        )

    first_seen = prints(inputs).groupBy("session_id", "fingerprint").agg(F.min("turn").alias("first_turn"))
    echoed = prints(outputs).join(first_seen, ["session_id", "fingerprint"]).where("turn > first_turn")
    return echoed.groupBy("session_id", "turn").agg(F.countDistinct("fingerprint").alias("n_releaked"))


def register(changes: DataFrame) -> DataFrame:
    """Registry state from a log of register and revoke requests.

    Columns in: fingerprint, op, secret_id, secret_type, action_on_match,
    created_by, seq. The first registration keeps its id and date; the latest
    request decides status, and the latest registration type and action.
    """
    reg = F.col("op") == "register"
    asked = F.struct("secret_id", "requested_at", "created_by")
    return (
        changes.groupBy("fingerprint")
        .agg(
            F.min_by(asked, F.when(reg, F.col("seq"))).alias("first"),
            F.max_by(F.struct("secret_type", "action_on_match"), F.when(reg, F.col("seq"))).alias("latest"),
            F.max_by("op", "seq").alias("last_op"),
        )
        .where(F.col("first").isNotNull())
        .select(
            "fingerprint",
            F.col("first.secret_id").alias("secret_id"),
            F.col("latest.secret_type").alias("secret_type"),
            F.col("latest.action_on_match").alias("action_on_match"),
            F.when(F.col("last_op") == "register", "active").otherwise("revoked").alias("status"),
            F.col("first.requested_at").alias("date_registered"),
            F.col("first.created_by").alias("created_by"),
        )
    )
