"""Keyed and versioned tables as snapshots and change rows; no table format needed.

Latest-per-key is always an aggregate (max_by), which combines before the
shuffle, so a key with very many versions does not land in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.functions import ordered

VAULT_TTL_SECONDS = 600


def append_versions(existing: DataFrame, arrivals: DataFrame, key: str, order: list[Column], chunk: Column) -> DataFrame:
    """Arrivals numbered after the newest existing version of their key.

    A key without versions starts from its first arrival's supplied version,
    or 1. ``chunk`` is a coarse form of the arrival order.
    """
    newest = existing.groupBy(key).agg(F.max("version").alias("_max"))
    numbered = ordered.running_count(arrivals, [key], chunk, order, "_n")
    first = (
        numbered.where("_n = 1").select(key, F.coalesce("version", F.lit(1)).alias("_first"))
        if "version" in arrivals.columns
        else None
    )
    joined = numbered.join(newest, key, "left")
    if first is not None:
        joined = joined.join(first, key, "left")
        base = F.coalesce(F.col("_max"), F.col("_first") - 1)
    else:
        base = F.coalesce(F.col("_max"), F.lit(0))
    return joined.withColumn("version", (base + F.col("_n")).cast("long")).drop("_max", "_n", "_first")


def latest(df: DataFrame, key: str, version: str = "version", status: str | None = None) -> DataFrame:
    """Newest version per key; a status filter applies after the pick."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("r")).select(key, "r.*")
    return picked.where(F.col("status") == status) if status else picked


def as_of(events: DataFrame, versions: DataFrame, keys: list[str], at: str, since: str, tie: str, out: str = "known") -> DataFrame:
    """Every event with ``out``, the version of its key that was in force at its own time.

    That is the newest version whose ``since`` is not after ``at``; of several at one moment the one with the largest
    ``tie``. ``out`` holds all columns of ``versions``; it is null for events before the first version and for events
    with a null key or time. Versions with a null key or time are never in force. Both tables are cut into minutes
    and one row per key and minute carries the version on, so a key with most of the events is spread.
    """
    known = versions.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in [*keys, since]]))
    event, version = F.struct(*events.columns), F.struct(*versions.columns)
    left = events.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(versions.schema[tie].dataType).alias("_tie"),
                         event.alias("_event"), F.lit(None).cast(known.select(version.alias("v")).schema["v"].dataType).alias("_known"))
    right = known.select(*keys, F.col(since).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"),
                         F.lit(None).cast(events.select(event.alias("e")).schema["e"].dataType).alias("_event"), version.alias("_known"))
    carried = ordered.last_known(left.unionByName(right), keys, ordered.minute_chunk(F.col("_at")), ["_at", "_side", "_tie"], "_known", "_in_force")
    return carried.where("_side = 1").select("_event.*", F.col("_in_force").alias(out))


def history(df: DataFrame, key: str, value, version: str = "version") -> DataFrame:
    """All versions of one key, newest first."""
    return df.where(F.col(key) == value).orderBy(F.desc(version))


def archive(df: DataFrame, key: str, archived: DataFrame) -> DataFrame:
    """Status ``archived`` on every version of the keys in ``archived``."""
    marked = archived.select(key).distinct().withColumn("_hit", F.lit(True))
    return (
        df.join(marked, key, "left")
        .withColumn("status", F.when(F.col("_hit"), "archived").otherwise(F.col("status")))
        .drop("_hit")
    )


def merge(snapshot: DataFrame, changes: DataFrame, key: str, update_cols: list[str]) -> DataFrame:
    """Upsert of change rows (one per key): new keys are inserted whole, known keys change ``update_cols`` only."""
    s, c = snapshot.alias("s"), changes.alias("c")
    known = F.col(f"s.{key}").isNotNull()
    changed = F.col(f"c.{key}").isNotNull()
    columns = [F.coalesce(f"s.{key}", f"c.{key}").alias(key)]
    for name in snapshot.columns:
        if name == key:
            continue
        new = F.col(f"c.{name}") if name in changes.columns else F.lit(None)
        if name in update_cols:
            columns.append(F.when(changed, new).otherwise(F.col(f"s.{name}")).alias(name))
        else:
            columns.append(F.when(known, F.col(f"s.{name}")).otherwise(new).alias(name))
    return s.join(c, F.col(f"s.{key}") == F.col(f"c.{key}"), "full_outer").select(*columns)


def overlay(existing: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Key/value document merge: new entries replace, other entries stay."""
    e, n = existing.alias("e"), new.alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"e.{k}") == F.col(f"n.{k}") for k in keys])
    return e.join(n, on, "full_outer").select(
        *[F.coalesce(f"n.{k}", f"e.{k}").alias(k) for k in keys], F.coalesce(f"n.{value}", f"e.{value}").alias(value)
    )


def resolve_configs(requests: DataFrame, configs: DataFrame, permissions: DataFrame) -> DataFrame:
    """Permissions and detectors for each request.

    A model-specific configuration counts when it names permissions, then the
    newest configuration of the use case, then the baseline. Configs hold
    config_id, version, pii_permissions (map, nullable), detectors (string).
    """
    newest = latest(configs.select("config_id", "version", "pii_permissions", "detectors"), "config_id")
    by_model = newest.where(F.size(F.coalesce("pii_permissions", F.create_map().cast("map<string,string>"))) > 0).select(
        F.col("config_id").alias("model_requested"), F.struct("pii_permissions", "detectors", "version").alias("m")
    )
    by_case = newest.select(F.col("config_id").alias("use_case"), F.struct("pii_permissions", "detectors", "version").alias("u"))
    default = F.create_map(*[F.lit(x) for kv in fixed.PII_DEFAULT_PERMISSIONS.items() for x in kv])
    baseline = F.lit(",".join(name for name, _, _ in fixed.BASELINE_DETECTORS))

    def filled(column: Column) -> Column:
        return F.when(F.size(F.coalesce(column, F.create_map().cast("map<string,string>"))) > 0, column)

    return (
        requests.join(by_model, "model_requested", "left")
        .join(by_case, "use_case", "left")
        .join(permissions, "use_case", "left")
        .withColumn(
            "config_source",
            F.when(F.col("m").isNotNull(), "model").when(F.col("u").isNotNull(), "use_case").otherwise("baseline"),
        )
        .withColumn("permissions", F.coalesce(filled(F.col("m.pii_permissions")), filled(F.col("u.pii_permissions")), F.col("permissions"), default))
        .withColumn("detectors", F.coalesce("m.detectors", "u.detectors", baseline))
        .withColumn("config_version", F.coalesce("m.version", "u.version", F.lit(1)))
        .drop("m", "u")
    )


def vault_store(entities: DataFrame, key: str) -> DataFrame:
    """Vault entries: placeholder → value map per key, with expiry. The newest store of a key replaces older ones."""
    newest = entities.groupBy(key).agg(F.max("created_at").alias("created_at"))
    return (
        entities.join(newest, [key, "created_at"], "left_semi")
        .groupBy(key, "created_at")
        .agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("placeholder", "value")))).alias("entities"))
        .withColumn("expires_at", F.col("created_at") + F.make_dt_interval(secs=F.lit(VAULT_TTL_SECONDS)))
    )


def vault_reveal(requests: DataFrame, vault: DataFrame, key: str, now: Column) -> DataFrame:
    """Status and value of each (key, placeholder) request at ``now``."""
    joined = requests.join(vault, key, "left")
    live = F.col("expires_at") >= now
    value = F.when(live, F.try_element_at("entities", F.col("placeholder")))
    return joined.select(
        key,
        "placeholder",
        F.when(F.col("expires_at").isNull(), "not_found")
        .when(~live, "expired")
        .when(value.isNull(), "unknown_placeholder")
        .otherwise("revealed")
        .alias("status"),
        value.alias("raw_value"),
    )


def upsert_escalations(snapshot: DataFrame, items: DataFrame) -> DataFrame:
    """Queue after new items: denied interactions accept no re-submission, known ones
    change status, reason, checks and payload only."""
    denied = snapshot.where((F.col("status") == "resolved") & (F.col("resolution") == "deny")).select("interaction_id")
    accepted = items.join(denied, "interaction_id", "left_anti")
    return merge(snapshot, accepted, "interaction_id", ["status", "escalation_reason", "checks", "payload"])


def enqueue(combined: DataFrame) -> DataFrame:
    """Review rows from combined decisions: flagged or escalated inputs and combined flags.

    Needs interaction_id, input_action, input_reason, input_payload,
    output_payload, action, reason, tier and flag_direction. The combined row
    comes last, so its fields win where both apply.
    """
    from_combined = F.col("action") == "flag"
    from_input = F.col("input_action").isin("flag", "escalate")
    out_side = from_combined & (F.col("flag_direction") == "output")
    return combined.where(from_combined | from_input).select(
        "interaction_id",
        F.when(out_side, "output").otherwise("input").alias("direction"),
        F.when(from_combined, F.col("reason")).otherwise(F.coalesce("input_reason", F.lit("Flagged for human verification"))).alias("escalation_reason"),
        F.when(out_side, F.col("output_payload")).otherwise(F.col("input_payload")).alias("payload"),
        F.when(from_combined, F.col("tier")).otherwise("medium").alias("risk_tier"),
        F.lit("pending").alias("status"),
    )


def resolve_escalations(queue: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queue, outcomes) after review actions; ``seq`` orders the actions of one interaction."""
    fields = F.struct("action", "reviewer_id", "reason", "flag_correct", "seq")
    last = actions.groupBy("interaction_id").agg(F.max_by(fields, "seq").alias("a"))
    acted = F.col("a").isNotNull()
    resolved = queue.join(last, "interaction_id", "left").select(
        *[c for c in queue.columns if c not in ("status", "resolution", "resolved_by", "resolution_reason", "flag_correct")],
        F.when(acted, "resolved").otherwise(F.col("status")).alias("status"),
        F.when(acted, F.col("a.action")).otherwise(F.col("resolution")).alias("resolution"),
        F.when(acted, F.coalesce("a.reviewer_id", F.lit("human_operator_1"))).alias("resolved_by"),
        F.col("a.reason").alias("resolution_reason"),
        F.col("a.flag_correct").alias("flag_correct"),
    )
    outcomes = actions.join(queue.select("interaction_id"), "interaction_id", "left_semi").select(
        "interaction_id",
        F.coalesce("reviewer_id", F.lit("human_operator_1")).alias("reviewer_id"),
        "action",
        F.col("flag_correct").alias("was_original_flag_correct"),
        "reason",
    )
    return resolved, outcomes


def appeals(requests: DataFrame, events: DataFrame, queue: DataFrame) -> DataFrame:
    """Review rows for appeals, enriched from the earliest audit event of the interaction.

    Requests: interaction_id, content, reason. Events: interaction_id,
    direction, payload, tier, created_at, event_id. Denied ones are rejected.
    """
    first = events.groupBy("interaction_id").agg(
        F.min_by(F.struct("direction", "payload", "tier"), F.struct("created_at", "event_id")).alias("e")
    )
    denied = queue.where((F.col("status") == "resolved") & (F.col("resolution") == "deny")).select("interaction_id")
    return (
        requests.join(denied, "interaction_id", "left_anti")
        .join(first, "interaction_id", "left")
        .select(
            "interaction_id",
            F.coalesce("e.direction", F.lit("input")).alias("direction"),
            F.coalesce("e.payload", "content", F.lit("")).alias("payload"),
            F.when(F.coalesce("e.direction", F.lit("input")) == "input", "user").otherwise("assistant").alias("role"),
            F.coalesce("e.tier", F.lit("high")).alias("risk_tier"),
            F.concat(
                F.lit("Manual User Appeal (Blocked): "), F.coalesce("reason", F.lit("User requested appeal for blocked message"))
            ).alias("escalation_reason"),
        )
    )


def list_escalations(queue: DataFrame, status: str | None = None) -> DataFrame:
    """Queue rows of one status (any case; all or None for every one), invalid values defaulted, newest first."""
    df = queue
    if status and status.lower() != "all":
        df = df.where(F.col("status") == status.lower())

    def valid(name: str, values: tuple[str, ...], default: str) -> Column:
        return F.when(F.col(name).isin(*values), F.col(name)).otherwise(default).alias(name)

    fixes = {
        "direction": valid("direction", fixed.DIRECTIONS, "input"),
        "use_case": valid("use_case", fixed.USE_CASES, "customer_support"),
        "geography": valid("geography", fixed.GEOGRAPHIES, "US"),
        "risk_tier": valid("risk_tier", fixed.RISK_TIERS, "medium"),
        "status": F.coalesce("status", F.lit("pending")).alias("status"),
    }
    return df.select(*[fixes.get(c, F.col(c)) for c in df.columns]).orderBy(F.desc("created_at"), "interaction_id")
