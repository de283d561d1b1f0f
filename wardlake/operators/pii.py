"""Personal data: detection with spans, merging, permissions, anonymising, vault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.functions import rules, spans
from wardlake.functions.rows import settle, spread_structs

MIN_LENGTH = 4
MIN_SCORE = 0.4
ENTITY = "array<struct<start:int,end:int,value:string,entity_type:string,score:double>>"


def with_plain(df: DataFrame, source: str = "text") -> DataFrame:
    """Add ``_plain``: the text with a sign that is no word character for each one beyond ASCII, and for vertical tabs.

    Positions stay as they are and a match holds ASCII alone, so patterns see word edges and spaces as the checking SQL does.
    The Kelvin sign and the long s are no letters here.
    """
    return settle(df.withColumn("_plain", F.regexp_replace(source, r"[^\x00-\x0A\x0C-\x7F]", "\u00B6")))


def entities(source: str = "text", types: tuple[str, ...] | None = None, flags: str = rules.UNICODE_NOCASE) -> Column:
    """All entities of the text column ``source`` in pattern order, as an array column."""
    found = []
    for name, score, pattern in fixed.PII_PATTERNS:
        if types and name not in types:
            continue
        needs = f"contains({source}, '@')" if name == "EMAIL_ADDRESS" else f"{source} RLIKE '(?U)\\\\d'"
        extra = f"'entity_type', '{name}', 'score', cast({score} AS double)"
        found.append(spans.find_spans(source, flags + pattern, name == "US_SSN", needs, extra))
    return F.filter(F.concat(*found), lambda e: e["end"] - e["start"] >= MIN_LENGTH)


def with_entities(df: DataFrame, source: str = "text", types: tuple[str, ...] | None = None, ascii_edges: bool = False) -> DataFrame:
    """Add ``entities``. A word ends where no letter of any script follows; with ``ascii_edges`` also before a letter beyond ASCII."""
    if ascii_edges:
        return with_plain(df, source).withColumn("entities", entities("_plain", types, "(?i)")).drop("_plain")
    return df.withColumn("entities", entities(source, types))


def detect(df: DataFrame, id_col: str, source: str = "text", types: tuple[str, ...] | None = None, ascii_edges: bool = False) -> DataFrame:
    """One row per entity."""
    found = with_entities(df.select(id_col, source), source, types, ascii_edges)
    return spread_structs(found, [id_col], "entities").select(id_col, "entity_type", "start", "end", "value", "score")


def merge(primary: DataFrame, second: DataFrame, id_col: str, max_gap: int = 3) -> DataFrame:
    """Union of two recognisers: a second-source entity stays only when no
    same-type primary entity starts within ``max_gap`` characters.

    The distance test is an equi join on (document, type, position bin): two
    starts closer than the bin width lie in the same or in adjacent bins.
    """
    first = primary.where((F.col("score") >= MIN_SCORE) & (F.col("end") - F.col("start") >= MIN_LENGTH))
    bin_of = F.floor(F.col("start") / F.lit(max_gap)).cast("int")
    near = first.select(
        id_col,
        "entity_type",
        F.col("start").alias("_near"),
        F.explode(F.array(bin_of - 1, bin_of, bin_of + 1)).alias("_bin"),
    )
    extra = second.withColumn("_bin", bin_of)
    fresh = extra.alias("s").join(
        near.alias("p"),
        (F.col(f"s.{id_col}") == F.col(f"p.{id_col}"))
        & (F.col("s.entity_type") == F.col("p.entity_type"))
        & (F.col("s._bin") == F.col("p._bin"))
        & (F.abs(F.col("s.start") - F.col("p._near")) < max_gap),
        "left_anti",
    ).drop("_bin")
    return first.unionByName(fresh.where(F.col("end") - F.col("start") >= MIN_LENGTH))


def policy_key(entity_type: Column, egress: bool = False) -> Column:
    """Permission key of an entity type; the first matching part decides."""
    upper = F.upper(entity_type)
    out = None
    for parts, key in fixed.PII_TYPE_KEYS:
        if egress:
            if key == "GOVERNMENT_ID":
                continue
            parts = tuple(p for p in parts if p != "IBAN")
        found = rules.contains_any(upper, parts)
        out = F.when(found, F.lit(key)) if out is None else out.when(found, F.lit(key))
    return out.otherwise(upper)


def permission_table(spark: SparkSession) -> DataFrame:
    """One row per use case: (use_case, permissions map)."""
    rows = [
        (case, {**fixed.PII_DEFAULT_PERMISSIONS, **fixed.PII_PERMISSION_OVERRIDES.get(case, {})})
        for case in fixed.USE_CASES
    ]
    return spark.createDataFrame(rows, "use_case string, permissions map<string,string>")


DEFAULT_ALLOWED = {"EMAIL": "allow", "PHONE": "allow", "ADDRESS": "allow"}


def _map_literal(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def with_permissions(df: DataFrame, table: DataFrame, keys_are_use_cases: bool = True) -> DataFrame:
    """Attach the permission map of the row's use case (a closed list of names)."""
    known = table.where(F.col("use_case").isin(*fixed.USE_CASES)) if keys_are_use_cases else table
    return df.join(F.broadcast(known), "use_case", "left").withColumn(
        "permissions", F.coalesce("permissions", _map_literal(DEFAULT_ALLOWED))
    )


def evaluate(df: DataFrame, strict: Column | None = None) -> DataFrame:
    """Permission outcome per row from ``entities``, ``permissions`` and ``declared``.

    Adds detected, blocked, allowed and warned types, findings, and
    ``pii_blocks``. Everything is row-local: no shuffle.
    """
    strict = F.coalesce(strict, F.lit(False)) if strict is not None else F.lit(False)
    df = df.withColumn("_declared", F.transform("declared", lambda d: policy_key(d))).withColumn(
        "_keyed",
        F.transform(
            "entities",
            lambda e: F.struct(policy_key(e["entity_type"]).alias("key"), e["start"], e["end"], e["score"]),
        ),
    )

    def outcome(e: Column) -> Column:
        permitted = F.coalesce(F.try_element_at(F.col("permissions"), e["key"]), F.lit("block")) == "allow"
        return (
            F.when(~permitted, F.lit("blocked"))
            .when(F.array_contains("_declared", e["key"]), F.lit("acknowledged"))
            .when(strict, F.lit("blocked_undeclared"))
            .otherwise(F.lit("warned"))
        )

    df = df.withColumn(
        "_out",
        F.transform(
            "_keyed",
            lambda e: F.struct(
                e["key"].alias("key"), e["start"].alias("start"), e["end"].alias("end"), e["score"].alias("score"),
                outcome(e).alias("outcome"),
            ),
        ),
    )

    def keys(*outcomes: str) -> Column:
        return F.array_distinct(
            F.transform(F.filter("_out", lambda o: o["outcome"].isin(*outcomes)), lambda o: o["key"])
        )

    findings = F.transform(
        "_out",
        lambda o: F.struct(
            F.lit("PII").alias("type"),
            o["key"].alias("subtype"),
            o["score"].alias("confidence"),
            o["start"].alias("start"),
            o["end"].alias("end"),
            F.lit("pii_patterns").alias("engine"),
            F.when(o["outcome"].isin("blocked", "blocked_undeclared"), F.lit("fail"))
            .when(o["outcome"] == "acknowledged", F.lit("pass"))
            .otherwise(F.lit("flag"))
            .alias("verdict"),
        ),
    )
    return (
        df.withColumn("detected_pii", F.array_distinct(F.transform("_out", lambda o: o["key"])))
        .withColumn("blocked_pii", keys("blocked", "blocked_undeclared"))
        .withColumn("allowed_pii", keys("acknowledged", "warned"))
        .withColumn("warned_pii", keys("warned"))
        .withColumn("findings", findings)
        .withColumn("pii_blocks", F.size("blocked_pii") > 0)
        .drop("_declared", "_keyed", "_out")
    )


def must_block(findings: Column, pii_blocks: Column) -> Column:
    """Whether any finding forces a block: blocked PII or a failed secret or injection."""
    return pii_blocks | F.exists(findings, lambda f: f["type"].isin("SECRET", "INJECTION") & (f["verdict"] == "fail"))


def calibrated_score(blocked: Column, warned: Column) -> Column:
    return F.when(F.size(blocked) > 0, 1.0).when(F.size(warned) > 0, 0.35).otherwise(F.lit(0.0))


def calibrated_verdict(blocked: Column, warned: Column) -> Column:
    return F.when(F.size(blocked) > 0, "fail").when(F.size(warned) > 0, "warn").otherwise(F.lit("pass"))


def raw_score(found: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(found, lambda e: e["score"])), F.lit(0.0))


def egress_blocked(found: Column, permissions: Column) -> Column:
    """Types on the way out that are not allowed."""
    keyed = F.transform(found, lambda e: policy_key(e["entity_type"], egress=True))
    return F.array_distinct(
        F.filter(keyed, lambda k: F.coalesce(F.try_element_at(permissions, k), F.lit("block")) != "allow")
    )


def without_overlaps(found: Column) -> Column:
    """Entities by position; of overlapping ones the earliest, then longest, stays."""
    ordered = F.array_sort(
        found,
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
        .when(a["end"] != b["end"], b["end"] - a["end"])
        .otherwise(F.when(a["entity_type"] < b["entity_type"], -1).when(a["entity_type"] > b["entity_type"], 1).otherwise(0)),
    )
    start = F.struct(F.lit(0).alias("until"), F.array().cast(ENTITY).alias("kept"))
    return F.aggregate(
        ordered,
        start,
        lambda acc, e: F.when(
            e["start"] >= acc["until"],
            F.struct(e["end"].alias("until"), F.concat(acc["kept"], F.array(e)).alias("kept")),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )


def anonymise(source: Column, found: Column, action: str = "redact") -> Column:
    """Text with every entity replaced: redact, mask, mask_last4 or hash."""

    def stand_in(e: Column) -> Column:
        width = e["end"] - e["start"]
        if action == "redact":
            return F.concat(F.lit("<"), e["entity_type"], F.lit(">"))
        if action == "mask_last4":
            return F.concat(F.substring(e["value"], F.lit(1), F.greatest(width - 4, F.lit(0))), F.repeat(F.lit("*"), F.least(width, F.lit(4))))
        if action == "hash":
            return F.sha2(e["value"], 256)
        return F.repeat(F.lit("*"), width)

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    return F.when(F.size(found) == 0, source).otherwise(
        F.aggregate(
            without_overlaps(found),
            start,
            lambda acc, e: F.struct(
                e["end"].alias("at"),
                F.concat(acc["done"], F.substring(source, acc["at"] + 1, e["start"] - acc["at"]), stand_in(e)).alias("done"),
            ),
            lambda acc: F.concat(acc["done"], F.substring(source, acc["at"] + 1, F.length(source))),
        )
    )
