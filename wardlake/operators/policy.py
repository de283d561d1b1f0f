"""Threshold policies: resolution, verdicts, decisions, overrides and combination."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.functions import rules
from wardlake.session import bounded_rows

THRESHOLDS = "block_threshold double, flag_threshold double, on_timeout string"
RULE_SCHEMA = f"pos int, use_case string, geography string, check_name string, {THRESHOLDS}"


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(fixed.POLICY_RULES)], RULE_SCHEMA)


def _aliases(check: Column) -> Column:
    other = F.create_map(*[F.lit(x) for kv in fixed.CHECK_ALIASES.items() for x in kv])
    return F.array_compact(F.array(check, F.try_element_at(other, check)))


def resolve_keys(keys: DataFrame, rules_table: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Thresholds for each (use_case, geography, check_name) of a key table.

    Alias order dominates, then exact before wildcard, then list order. Each
    key looks up eight exact combinations by equi join; no rule is compared
    with a key it cannot match.
    """
    defaults = defaults or fixed.POLICY_DEFAULTS
    key_cols = ["use_case", "geography", "check_name"]
    star = F.lit("*")
    first_rule = (
        rules_table.select(
            F.coalesce("use_case", star).alias("_u"),
            F.coalesce("geography", star).alias("_g"),
            F.col("check_name").alias("_c"),
            F.struct("block_threshold", "flag_threshold", "on_timeout").alias("rule"),
            "pos",
        )
        .groupBy("_u", "_g", "_c")
        .agg(F.min_by("rule", "pos").alias("rule"))
    )
    levels = F.array(
        *[
            F.struct(F.lit(level).alias("level"), u.alias("_u"), g.alias("_g"))
            for level, (u, g) in enumerate(product((F.col("use_case"), star), (F.col("geography"), star)))
        ]
    )
    looked_up = (
        keys.select(*key_cols)
        .distinct()
        .select(*key_cols, F.posexplode(_aliases(F.col("check_name"))).alias("alias", "_c"))
        .select(*key_cols, "alias", "_c", F.inline(levels))
        .join(first_rule, ["_u", "_g", "_c"])
        .groupBy(*key_cols)
        .agg(F.min_by("rule", F.struct("alias", "level")).alias("rule"))
    )
    found = F.col("rule").isNotNull()

    def value(name: str, missing: Column) -> Column:
        return F.when(found, F.coalesce(F.col(f"rule.{name}"), missing)).otherwise(F.lit(defaults[name])).alias(name)

    return (
        keys.select(*key_cols)
        .distinct()
        .join(looked_up, key_cols, "left")
        .select(
            *key_cols,
            value("block_threshold", F.lit(0.85)),
            value("flag_threshold", F.lit(0.4)),
            value("on_timeout", F.lit(None).cast("string")),
        )
    )


#: Stands for a null key and for any value that no rule names: only wildcard rules and defaults hold for it.
OTHER = "\u0000other"
#: Largest number of key combinations that is resolved beforehand and broadcast.
MAX_DOMAIN = 100_000
KEYS = ("use_case", "geography", "check_name")


def _named(rules_table: DataFrame) -> dict[str, list[str]] | None:
    """The values that rules name for each key, or None where they have too many combinations to be resolved beforehand."""
    rows = bounded_rows(rules_table.select(*KEYS).distinct(), 1000)
    if rows is None:
        return None
    named = {k: sorted({r[k] for r in rows if r[k] not in (None, "*")}) for k in KEYS}
    named["check_name"] = sorted({*named["check_name"], *fixed.CHECK_ALIASES})
    size = 1
    for values in named.values():
        size *= len(values) + 1
    return named if size <= MAX_DOMAIN else None


def _stand_in(name: str, values: list[str] | None) -> Column:
    """The key as rules see it."""
    if values is None:
        return F.coalesce(F.col(name), F.lit(OTHER))
    return F.when(F.col(name).isin(*values), F.col(name)).otherwise(F.lit(OTHER)) if values else F.lit(OTHER)


def resolve(checks: DataFrame, rules_table: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Attach thresholds to check rows.

    Values that no rule names, and nulls, resolve alike: by wildcard rules, else by the defaults. With a rule table
    within the size limit all combinations are resolved beforehand and broadcast, so no check moves; beyond it the
    distinct keys of the checks are resolved and joined. Both give the same rows.
    """
    named = _named(rules_table)
    keyed = checks.withColumns({f"_{k}": _stand_in(k, None if named is None else named[k]) for k in KEYS})
    if named is None:
        keys = keyed.select(*[F.col(f"_{k}").alias(k) for k in KEYS])
    else:
        keys = checks.sparkSession.createDataFrame(list(product(*[[*named[k], OTHER] for k in KEYS])), ", ".join(f"{k} string" for k in KEYS))
    found = resolve_keys(keys, rules_table, defaults).withColumnsRenamed({k: f"_{k}" for k in KEYS})
    return keyed.join(found if named is None else F.broadcast(found), [f"_{k}" for k in KEYS], "left").drop(*[f"_{k}" for k in KEYS])


def with_verdict(checks: DataFrame) -> DataFrame:
    """Re-assign verdicts by threshold; skipped checks stay skipped, and a missing threshold is the default one."""
    return checks.withColumn(
        "verdict",
        F.when(F.col("verdict") == "skipped", "skipped")
        .when(F.col("score") >= F.coalesce("block_threshold", F.lit(fixed.POLICY_DEFAULTS["block_threshold"])), "fail")
        .when(F.col("score") >= F.coalesce("flag_threshold", F.lit(fixed.POLICY_DEFAULTS["flag_threshold"])), "warn")
        .otherwise("pass"),
    )


def _stop(verdict: Column, on_timeout: Column) -> Column:
    return (verdict == "fail") | ((verdict == "skipped") & (F.coalesce(on_timeout, F.lit("")) == "block"))


def _warns(verdict: Column, on_timeout: Column) -> Column:
    return (verdict == "warn") | ((verdict == "skipped") & (F.coalesce(on_timeout, F.lit("")) == "allow_with_flag"))


def _fail_reason(name: Column, score: Column, threshold: Column, blocked_pii: Column) -> Column:
    plain = F.concat(
        F.lit("Failed "), name, F.lit(" check (score: "), F.format_string("%.2f", score), F.lit(" >= "),
        threshold.cast("string"), F.lit(")"),
    )
    prohibited = F.concat(
        F.lit("Blocked by enterprise PII policy: prohibited PII detected ("), F.array_join(blocked_pii, ", "), F.lit(")")
    )
    return F.when((name == "pii") & (F.size(F.coalesce(blocked_pii, F.array().cast("array<string>"))) > 0), prohibited).otherwise(plain)


def _warn_reason(name: Column, score: Column, verdict: Column) -> Column:
    return F.when(verdict == "skipped", F.concat(F.lit("Timeout on "), name)).otherwise(
        F.concat(F.lit("Warning on "), name, F.lit(" (score: "), F.format_string("%.2f", score), F.lit(")"))
    )


def _decision(stop: Column, warns: Column, top: Column, version: str) -> Column:
    """Decision struct from the first stopping check and the ordered warnings."""
    n = F.size(warns)
    reasons = F.array_join(F.transform(warns, lambda w: w["reason"]), ", ")
    action = F.when(stop.isNotNull(), "block").when(n > 1, "escalate").when(n == 1, "flag").otherwise("allow")
    first = F.try_element_at(warns, F.lit(1))
    return F.struct(
        action.alias("action"),
        F.when(stop.isNotNull(), "high").when(n > 0, "medium").otherwise("low").alias("tier"),
        F.when(stop.isNotNull(), stop["confidence"]).otherwise(top).alias("confidence"),
        F.when(stop.isNotNull(), stop["reason"])
        .when(n > 1, F.concat(F.lit("Multiple warnings: "), reasons))
        .when(n == 1, first["reason"])
        .otherwise("All checks passed")
        .alias("reason"),
        F.when(stop.isNotNull(), stop["layer"]).when(n > 0, first["layer"]).alias("blocked_by_layer"),
        F.lit(version).alias("policy_version"),
    )


def _stop_struct(name: Column, score: Column, verdict: Column, threshold: Column, layer: Column, blocked_pii: Column) -> Column:
    timeout = verdict == "skipped"
    return F.struct(
        F.when(timeout, F.concat(F.lit("Timeout on "), name)).otherwise(_fail_reason(name, score, threshold, blocked_pii)).alias("reason"),
        F.when(timeout, F.lit(1.0)).otherwise(score).alias("confidence"),
        F.when(~timeout, F.coalesce(layer, F.lit("L1_lexicon"))).alias("layer"),
    )


def decide(checks: DataFrame, keys: list[str], version: str = "default") -> DataFrame:
    """Decision per interaction from check rows in ``pos`` order.

    The first stopping check is a minimum over (pos), so it combines before the
    shuffle; only warnings are listed, at most one per scanner.
    """
    blocked = F.col("blocked_pii") if "blocked_pii" in checks.columns else F.lit(None).cast("array<string>")
    verdict, timeout = F.col("verdict"), F.col("on_timeout")
    stops, warning = _stop(verdict, timeout), _warns(verdict, timeout)
    stop = _stop_struct(F.col("check_name"), F.col("score"), verdict, F.col("block_threshold"), F.col("layer"), blocked)
    warn = F.struct(
        "pos",
        _warn_reason(F.col("check_name"), F.col("score"), verdict).alias("reason"),
        F.when(verdict != "skipped", F.coalesce("layer", F.lit("L1_lexicon"))).alias("layer"),
    )
    folded = checks.groupBy(*keys).agg(
        F.min_by(F.when(stops, stop), F.when(stops, F.col("pos"))).alias("stop"),
        F.array_sort(F.collect_list(F.when(warning, warn))).alias("warns"),
        F.coalesce(F.max(F.when(verdict != "skipped", F.col("score"))), F.lit(0.0)).alias("top"),
    )
    return folded.select(*keys, _decision(F.col("stop"), F.col("warns"), F.col("top"), version).alias("d")).select(*keys, "d.*")


def with_thresholds(requests: DataFrame, rules_table: DataFrame, check_names: list[str], defaults: dict | None = None) -> DataFrame:
    """Add ``thresholds``, a map check → thresholds, to rows with use_case and geography; unnamed values and nulls as in ``resolve``."""
    spark, pair = requests.sparkSession, ("use_case", "geography")
    named = _named(rules_table)
    keyed = requests.withColumns({f"_{k}": _stand_in(k, None if named is None else named[k]) for k in pair})
    if named is None:
        places = keyed.select(*[F.col(f"_{k}").alias(k) for k in pair]).distinct()
    else:
        places = spark.createDataFrame(list(product(*[[*named[k], OTHER] for k in pair])), "use_case string, geography string")
    keys = places.withColumn("check_name", F.explode(F.array(*[F.lit(c) for c in check_names])))
    entry = F.struct("check_name", F.struct("block_threshold", "flag_threshold", "on_timeout"))
    maps = resolve_keys(keys, rules_table, defaults).groupBy(*pair).agg(F.map_from_entries(F.collect_list(entry)).alias("thresholds"))
    maps = maps.withColumnsRenamed({k: f"_{k}" for k in pair})
    return keyed.join(maps if named is None else F.broadcast(maps), [f"_{k}" for k in pair], "left").drop(*[f"_{k}" for k in pair])


def decide_row(checks: Column, thresholds: Column, blocked_pii: Column, version: str = "default") -> Column:
    """The same decision for checks held as an array in their row: no shuffle at all."""
    standard = F.struct(*[F.lit(fixed.POLICY_DEFAULTS[k]).alias(k) for k in ("block_threshold", "flag_threshold", "on_timeout")])
    judged = F.transform(
        checks,
        lambda c: F.struct(
            c["check_name"].alias("check_name"), c["score"].alias("score"), c["layer"].alias("layer"),
            F.coalesce(F.try_element_at(thresholds, c["check_name"]), standard).alias("t"), c["verdict"].alias("given"),
        ),
    )
    judged = F.transform(
        judged,
        lambda c: F.struct(
            c["check_name"].alias("check_name"), c["score"].alias("score"), c["layer"].alias("layer"), c["t"].alias("t"),
            F.when(c["given"] == "skipped", "skipped")
            .when(c["score"] >= c["t"]["block_threshold"], "fail")
            .when(c["score"] >= c["t"]["flag_threshold"], "warn")
            .otherwise("pass")
            .alias("verdict"),
        ),
    )
    stops = F.transform(
        F.filter(judged, lambda c: _stop(c["verdict"], c["t"]["on_timeout"])),
        lambda c: _stop_struct(c["check_name"], c["score"], c["verdict"], c["t"]["block_threshold"], c["layer"], blocked_pii),
    )
    warns = F.transform(
        F.filter(judged, lambda c: _warns(c["verdict"], c["t"]["on_timeout"])),
        lambda c: F.struct(
            _warn_reason(c["check_name"], c["score"], c["verdict"]).alias("reason"),
            F.when(c["verdict"] != "skipped", F.coalesce(c["layer"], F.lit("L1_lexicon"))).alias("layer"),
        ),
    )
    top = F.coalesce(
        F.array_max(F.transform(F.filter(judged, lambda c: c["verdict"] != "skipped"), lambda c: c["score"])), F.lit(0.0)
    )
    return _decision(F.try_element_at(stops, F.lit(1)), warns, top, version)


def override(df: DataFrame, direction: str = "direction") -> DataFrame:
    """Apply hard blocks to decisions that may be missing.

    Needs action, reason, tier, confidence, blocked_by_layer (nullable when the
    engine gave no decision), ``blocked_pii`` and ``finding_blocks``.
    """
    missing = F.col("action").isNull()
    closed = missing & (F.col(direction) == "input")
    df = (
        df.withColumn("reason", F.when(closed, "Policy Engine unavailable").when(missing, "").otherwise(F.col("reason")))
        .withColumn("tier", F.when(closed, "high").when(missing, "low").otherwise(F.col("tier")))
        .withColumn("confidence", F.when(closed, F.lit(1.0)).when(missing, F.lit(0.0)).otherwise(F.col("confidence")))
        .withColumn("action", F.when(closed, "block").when(missing, "allow").otherwise(F.col("action")))
    )
    by_pii = F.size("blocked_pii") > 0
    by_finding = ~by_pii & F.col("finding_blocks") & (F.col("action") != "block")
    return (
        df.withColumn(
            "reason",
            F.when(
                by_pii,
                F.concat(
                    F.lit("Blocked by enterprise PII policy: prohibited PII detected ("),
                    F.array_join("blocked_pii", ", "),
                    F.lit(")"),
                ),
            )
            .when(by_finding, "Blocked by perimeter security finding")
            .otherwise(F.col("reason")),
        )
        .withColumn("blocked_by_layer", F.when(by_pii, "enterprise_pii_policy").otherwise(F.col("blocked_by_layer")))
        .withColumn("blocked_entities", F.when(by_pii, F.col("blocked_pii")).otherwise(F.array().cast("array<string>")))
        .withColumn("action", F.when(by_pii | by_finding, "block").otherwise(F.col("action")))
    )


SEVERITY = ("allow", "flag", "escalate", "block")


def combine(decisions: DataFrame, key: str = "interaction_id") -> DataFrame:
    """Merge input and output decisions of each interaction into one row.

    Of several decisions of one direction the most severe counts, of equal ones the latest.
    """
    pick = F.struct("action", "reason", "confidence", "policy_version")
    severity = F.coalesce(*[F.when(F.col("action") == a, F.lit(i)) for i, a in enumerate(SEVERITY)], F.lit(-1))
    late = [c for c in ("created_at", "event_id") if c in decisions.columns]
    rank = F.struct(severity.alias("severity"), *late, "reason")
    pair = decisions.groupBy(key).agg(
        F.max_by(pick, F.when(F.col("direction") == "input", rank)).alias("i"),
        F.max_by(pick, F.when(F.col("direction") == "output", rank)).alias("o"),
    )
    return pair.select(key, *merged(F.col("i"), F.col("o")))


def merged(i: Column, o: Column) -> list[Column]:
    """The columns of a combined decision from those of the two directions (structs, null where there is none)."""
    blocked = F.coalesce(o["action"] == "block", F.lit(False))
    in_flag = F.coalesce(i["action"] == "flag", F.lit(False))
    out_flag = F.coalesce(o["action"] == "flag", F.lit(False))
    flag_reason = F.when(in_flag, i["reason"]).otherwise(o["reason"])
    return [
        F.when(blocked, "block").when(in_flag | out_flag, "flag").otherwise("allow").alias("action"),
        F.when(blocked, F.coalesce(o["reason"], F.lit("Response blocked by output safety policy")))
        .when(in_flag | out_flag, F.concat(F.lit("Warning flagged: "), flag_reason))
        .otherwise("All checks passed")
        .alias("reason"),
        F.when(blocked, "high").when(in_flag | out_flag, "medium").otherwise("low").alias("tier"),
        F.greatest(F.coalesce(i["confidence"], F.lit(0.0)), F.coalesce(o["confidence"], F.lit(0.0))).alias("confidence"),
        F.coalesce(o["policy_version"], i["policy_version"], F.lit("default")).alias("policy_version"),
        blocked.alias("content_replaced"),
        (F.coalesce(i["action"] == "escalate", F.lit(False)) | F.coalesce(o["action"] == "escalate", F.lit(False))).alias("escalated"),
        F.when(out_flag, "output").otherwise("input").alias("flag_direction"),
    ]


def combine_checks(checks: DataFrame, key: str = "interaction_id") -> DataFrame:
    """One check per name and interaction: the output one only when it scored above zero or stands alone."""
    row = F.struct("direction", "score", "verdict", "layer")
    both = checks.groupBy(key, "check_name").agg(
        F.max_by(row, F.when(F.col("direction") == "input", F.col("pos"))).alias("i"),
        F.max_by(row, F.when(F.col("direction") == "output", F.col("pos"))).alias("o"),
    )
    chosen = F.when(F.col("i").isNull() | (F.col("o.score") > 0), F.col("o")).otherwise(F.col("i"))
    return both.select(key, "check_name", chosen.alias("c")).select(key, "check_name", "c.*")


ALLOWED_IN_CONDITION = ("use_case", "geography", "direction", "role", "tier", "action")


def apply_conditions(df: DataFrame, conditions: list[tuple[str, str, str, str]]) -> DataFrame:
    """First true conditional rule per row.

    Each rule is (id, condition, action, reason); conditions are Spark SQL
    boolean expressions over the named envelope columns only.
    """
    out = None
    for rule_id, condition, action, reason in conditions:
        probe = df.sparkSession.createDataFrame([], ", ".join(f"{c} string" for c in ALLOWED_IN_CONDITION))
        probe.where(condition)
        value = F.struct(F.lit(rule_id).alias("rule_id"), F.lit(action).alias("rule_action"), F.lit(reason).alias("rule_reason"))
        out = F.when(F.expr(condition), value) if out is None else out.when(F.expr(condition), value)
    return df.withColumn("_r", out).select("*", "_r.*").drop("_r")


def extract_rules(df: DataFrame, text_col: str = "text", title: str | None = None) -> DataFrame:
    """Structured rule columns from plain-language policy text."""
    raw = F.trim(F.col(text_col))
    df = df.withColumn("_raw", raw).withColumn("_lower", F.lower(raw))
    low = F.col("_lower")
    found = rules.present(low, fixed.POLICY_ENTITY_KEYWORDS)
    acts = rules.present(low, fixed.POLICY_ACTION_KEYWORDS)
    df = df.withColumn("_entities", found).withColumn("_acts", acts)
    short = F.concat(F.substring("_raw", 1, 80), F.when(F.length("_raw") > 80, "...").otherwise(""))
    return (
        df.withColumn("entities", F.when(F.size("_entities") > 0, F.col("_entities")).otherwise(F.array(F.lit("CONFIDENTIAL_DATA"))))
        .withColumn(
            "prohibited_actions",
            F.when(F.size("_acts") > 0, F.col("_acts")).otherwise(F.array(F.lit("share"), F.lit("send"), F.lit("upload"))),
        )
        .withColumn(
            "destination",
            F.array_compact(
                F.array(
                    F.lit("EXTERNAL_AI"),
                    *[F.when(rules.contains_any(low, words), F.lit(name)) for name, words in fixed.POLICY_DESTINATIONS],
                )
            ),
        )
        .withColumn(
            "action",
            F.coalesce(*[F.when(rules.contains_any(low, words), F.lit(name)) for name, words in fixed.POLICY_ACTIONS], F.lit("BLOCK")),
        )
        .withColumn("short_description", F.coalesce(F.col(title), short) if title else short)
        .where(F.length("_raw") > 0)
        .drop("_raw", "_lower", "_entities", "_acts")
    )


def latency_budget_table(spark: SparkSession) -> DataFrame:
    rows = [
        (case, stage, budget)
        for case, budgets in fixed.LATENCY_BUDGETS.items()
        for stage, budget in zip(fixed.LATENCY_STAGES, budgets, strict=True)
    ]
    return spark.createDataFrame(rows, "use_case string, stage string, budget_ms int")


def with_latency_budget(df: DataFrame) -> DataFrame:
    """Budget of (use_case, stage): unknown use cases use customer_support, unknown stages 100 ms."""
    table = latency_budget_table(df.sparkSession)
    known = list(fixed.LATENCY_BUDGETS)
    return (
        df.withColumn("_case", F.when(F.col("use_case").isin(*known), F.col("use_case")).otherwise("customer_support"))
        .join(F.broadcast(table.withColumnRenamed("use_case", "_case")), ["_case", "stage"], "left")
        .withColumn("budget_ms", F.coalesce("budget_ms", F.lit(100)))
        .drop("_case")
    )


def token_cap(use_case: Column, requested: Column | None = None) -> Column:
    caps = F.create_map(*[F.lit(x) for kv in fixed.TOKEN_CAPS.items() for x in kv])
    default = F.coalesce(F.try_element_at(caps, use_case), F.lit(500))
    return F.least(F.coalesce(requested, default) if requested is not None else default, F.lit(2048))
