"""Audit queries, trust and health statistics, proposals, tool risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.functions import ordered

ACTIONS = ("block", "flag", "escalate", "allow")


def query_events(
    events: DataFrame,
    use_case: str | None = None,
    action: str | None = None,
    direction: str | None = None,
    since: str | None = None,
    limit: int | None = 200,
) -> DataFrame:
    """Filtered audit rows, newest first; every filter is optional and ``all`` means none. Without a limit all rows are kept."""
    for column, wanted in (("use_case", use_case), ("decision_action", action), ("direction", direction)):
        if wanted and wanted.lower() != "all":
            events = events.where(F.lower(column) == wanted.lower())
    if since:
        events = events.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    newest = events.orderBy(F.desc("created_at"), F.desc("event_id"))
    return newest if limit is None else newest.limit(limit)


def interaction_events(events: DataFrame, interaction_id) -> DataFrame:
    return events.where(F.col("interaction_id") == interaction_id).orderBy("created_at", "event_id")


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _count(name: str) -> Column:
    return F.coalesce(F.count_if(F.col("decision_action") == name), F.lit(0)).alias(f"n_{name}")


def audit_stats(events: DataFrame) -> DataFrame:
    """One row: distinct interactions, events by action, block and escalation rate.

    Rates divide event counts by distinct interactions, as published.
    """
    totals = events.agg(
        F.countDistinct("interaction_id").alias("total_interactions"), F.count(F.lit(1)).alias("n_events"), *[_count(a) for a in ACTIONS]
    )
    return totals.withColumn("block_rate", _rate(F.col("n_block"), F.col("total_interactions"))).withColumn(
        "escalation_rate", _rate(F.col("n_escalate"), F.col("total_interactions"))
    )


def audit_breakdown(events: DataFrame) -> DataFrame:
    """Event counts by action and by use case, long form."""
    by_action = events.groupBy(F.lit("action").alias("kind"), F.col("decision_action").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    by_case = events.groupBy(F.lit("use_case").alias("kind"), F.col("use_case").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return by_action.unionByName(by_case).where(F.col("name").isNotNull())


def dashboard_rates(stats: DataFrame) -> DataFrame:
    total = F.col("total_interactions")
    return stats.select(
        "total_interactions",
        F.round(F.col("block_rate") * 100, 1).alias("block_rate"),
        F.round(_rate(F.col("n_flag"), total) * 100, 1).alias("flag_rate"),
        F.round(_rate(F.col("n_flag") + F.col("n_escalate"), total) * 100, 1).alias("escalate_rate"),
        (F.col("n_flag") + F.col("n_escalate")).alias("escalate_count"),
    )


def outcome_stats(outcomes: DataFrame) -> DataFrame:
    correct = F.col("was_original_flag_correct")
    counts = outcomes.agg(
        F.count(F.lit(1)).alias("total_reviews"),
        F.count_if(correct).alias("correct_flags"),
        F.count_if(~F.coalesce(correct, F.lit(False))).alias("incorrect_flags"),
    )
    return counts.withColumn("false_positive_rate", _rate(F.col("incorrect_flags"), F.col("total_reviews"))).withColumn(
        "false_negative_rate", F.lit(0.0)
    )


def trust_score(stats: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row joined from two one-row tables (a constant key, one row per side)."""
    rates = dashboard_rates(stats)
    one = rates.withColumn("_k", F.lit(1)).join(
        outcomes.select("total_reviews", "false_positive_rate", "false_negative_rate", F.lit(1).alias("_k")), "_k"
    )
    reviewed = F.col("total_reviews") > 0
    fpr = F.when(reviewed, F.round(F.col("false_positive_rate") * 100, 1))
    penalty = F.coalesce(fpr, F.lit(0.0)) * 0.35
    raw = 100.0 - penalty - F.col("flag_rate") * 0.20 - F.least(F.col("block_rate") * 0.15, F.lit(15.0))
    return one.select(
        F.col("total_interactions").alias("total"),
        fpr.alias("fpr"),
        F.when(reviewed, F.round(F.col("false_negative_rate") * 100, 1)).alias("fnr"),
        F.when(F.col("total_interactions") == 0, 100.0)
        .otherwise(F.round(F.greatest(F.lit(15.0), F.least(F.lit(100.0), raw)), 1))
        .alias("trust_score"),
        "block_rate",
        "flag_rate",
        "escalate_rate",
        "total_reviews",
    )


def action_trend(events: DataFrame, end_date: str, days: int = 7) -> DataFrame:
    """Counts per day and action for the last ``days`` days, zero where nothing happened."""
    end = F.lit(end_date).cast("date")
    spine = events.sparkSession.range(days).select(F.date_sub(end, F.col("id").cast("int")).alias("day"))
    counted = (
        events.where((F.to_date("created_at") > F.date_sub(end, days)) & (F.to_date("created_at") <= end))
        .groupBy(F.to_date("created_at").alias("day"))
        .agg(*[F.count_if(F.col("decision_action") == a).alias(a) for a in ACTIONS])
    )
    return spine.join(counted, "day", "left").fillna(0, subset=list(ACTIONS)).orderBy("day")


def queue_stats(queue: DataFrame) -> DataFrame:
    counts = queue.agg(
        F.count_if(F.col("status") == "pending").alias("queue_depth"), F.count_if(F.col("status") == "resolved").alias("resolved_total")
    )
    total = F.col("queue_depth") + F.col("resolved_total")
    return counts.withColumn("resolution_percent", F.round(_rate(F.col("resolved_total"), total) * 100, 0))


def percentiles(df: DataFrame, keys: list[str], value: str, points: tuple[float, ...]) -> DataFrame:
    """Exact percentiles (linear interpolation) per key.

    Equal values are counted first, then a running count in chunks of the value
    finds the two order statistics around each point; no group is held in one
    task or one buffer.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordered.running_sum(counted, keys, F.floor(F.col(value)), [F.col(value)], F.col("_n"), "_upto")
    totals = ranked.groupBy(*keys).agg(F.max("_upto").alias("_total"))
    joined = ranked.join(totals, keys) if keys else ranked.withColumn("_k", F.lit(1)).join(totals.withColumn("_k", F.lit(1)), "_k")
    columns = []
    for p in points:
        place = (F.col("_total") - 1) * F.lit(p)
        low, high = F.floor(place), F.ceil(place)

        def at(rank: Column) -> Column:
            return F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank), F.col(value)))

        lo, hi = at(low), at(high)
        weight = F.max(place - low)
        columns.append((lo + (hi - lo) * weight).alias(f"p{round(p * 100)}"))
    return joined.groupBy(*keys).agg(*columns, F.max("_total").alias("n"))


def sigma_alerts(rates: DataFrame, baselines: tuple = fixed.ALERT_BASELINES) -> DataFrame:
    """Alert rows from rows with total_interactions, block_rate and escalation_rate; other columns are kept."""
    keep = [c for c in rates.columns if c not in ("block_rate", "escalation_rate")]
    metric = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("metric"), F.col(source).alias("rate"), F.lit(mean).alias("mean"), F.lit(std).alias("std"),
                    F.lit(hard).alias("hard"), F.lit(critical).cast("double").alias("critical"),
                )
                for (name, mean, std, hard, critical), source in zip(baselines, ("block_rate", "escalation_rate"), strict=True)
            ]
        )
    )
    df = rates.select(*keep, metric.alias("m")).select(*keep, "m.*")
    sigma = (F.col("rate") - F.col("mean")) / F.col("std")
    return df.where((F.col("total_interactions") >= 5) & ((sigma > 3.0) | (F.col("rate") > F.col("hard")))).select(
        *keep,
        "metric",
        F.round(F.col("rate") * 100, 1).alias("current_value"),
        F.round(F.col("mean") * 100, 1).alias("baseline_mean"),
        F.round(F.col("std") * 100, 1).alias("baseline_std"),
        F.round(sigma, 2).alias("sigma_breach"),
        F.when(F.col("rate") > F.col("critical"), "critical").otherwise("medium").alias("severity"),
    )


def check_profile(checks: DataFrame) -> DataFrame:
    """Scores above zero per check: count and mean. The caller chooses the window of events."""
    return (
        checks.where((F.col("score") > 0) & F.col("check_name").isNotNull())
        .groupBy("check_name")
        .agg(F.count(F.lit(1)).alias("n_scores"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"))
    )


def target_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(i, *t) for i, t in enumerate(fixed.PROPOSAL_TARGETS)],
        "target_no int, id_prefix string, check_name string, use_case string, kind string, fallback double, target double",
    )


def proposals(rules_table: DataFrame, profile: DataFrame, outcomes: DataFrame, decided: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Threshold proposals that improve on the current rules and are not decided yet.

    ``keys`` names columns that identify a rule set (a tenant) in all inputs
    but the target table.
    """
    keys = keys or []
    targets = target_table(rules_table.sparkSession)
    rule = F.struct("block_threshold", "flag_threshold")
    wanted = F.broadcast(targets.select("target_no", "check_name", F.col("use_case").alias("_case")))
    current = (
        rules_table.join(wanted, "check_name")
        .where((F.col("use_case") == "*") | (F.col("use_case") == F.col("_case")))
        .groupBy(*keys, "target_no")
        .agg(F.min_by(rule, "pos").alias("rule"))
    )
    if keys:
        sets = rules_table.select(*keys).distinct()
        grid = sets.select(*keys, F.explode(F.array(*[F.lit(i) for i in range(len(fixed.PROPOSAL_TARGETS))])).alias("target_no")).join(
            F.broadcast(targets), "target_no"
        )
    else:
        grid = targets
    joined = grid.join(current, [*keys, "target_no"], "left")
    now = F.coalesce(F.when(F.col("kind") == "block_threshold", F.col("rule.block_threshold")).otherwise(F.col("rule.flag_threshold")), F.col("fallback"))
    better = F.when(F.col("kind") == "block_threshold", now > F.col("target")).otherwise(now < F.col("target"))
    pid = F.concat_ws(
        "_", "id_prefix", F.floor(F.round(now * 100, 6)).cast("string"), F.lpad(F.round(F.col("target") * 100).cast("int").cast("string"), 3, "0")
    )
    proposed = joined.withColumn("current_threshold", now).where(better).withColumn("proposal_id", pid)
    open_ones = proposed.join(decided.select(*keys, "proposal_id"), [*keys, "proposal_id"], "left_anti")
    scored = open_ones.join(profile.select("check_name", "mean_score"), "check_name", "left")
    reviews = outcomes.select("total_reviews", "false_positive_rate", F.lit(1).alias("_k"))
    return (
        scored.withColumn("_k", F.lit(1))
        .join(F.broadcast(reviews), "_k")
        .select(
            *keys,
            "proposal_id",
            "use_case",
            F.lit("US").alias("geography"),
            "check_name",
            F.col("kind").alias("target_threshold_type"),
            "current_threshold",
            F.col("target").alias("proposed_threshold"),
            F.concat(
                F.lit("Mean score "), F.format_string("%.2f", F.coalesce("mean_score", F.lit(0.83))), F.lit(" over "),
                F.col("total_reviews").cast("string"), F.lit(" reviews; move "), F.col("kind"), F.lit(" from "),
                F.col("current_threshold").cast("string"), F.lit(" to "), F.col("target").cast("string"),
            ).alias("reason"),
            F.greatest(F.lit(1), F.floor(F.col("total_reviews") / 10)).cast("long").alias("cycle"),
            F.col("total_reviews").alias("review_count"),
        )
    )


def accept_proposals(rules_table: DataFrame, accepted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rules after accepted proposals: the first exact rule changes, else a new rule is added."""
    keys = keys or []
    on = [*keys, "use_case", "geography", "check_name"]
    wide = accepted.groupBy(*on).agg(
        F.max(F.when(F.col("target_threshold_type") == "block_threshold", F.col("proposed_threshold"))).alias("_block"),
        F.max(F.when(F.col("target_threshold_type") == "flag_threshold", F.col("proposed_threshold"))).alias("_flag"),
    )
    first = rules_table.groupBy(*on).agg(F.min("pos").alias("pos"))
    hit = wide.join(first, on)
    changed = rules_table.join(hit, [*on, "pos"], "left").select(
        *[c for c in rules_table.columns if c not in ("block_threshold", "flag_threshold")],
        F.coalesce("_block", "block_threshold").alias("block_threshold"),
        F.coalesce("_flag", "flag_threshold").alias("flag_threshold"),
    )
    added = wide.join(first.select(*on), on, "left_anti").select(
        *on,
        F.lit(None).cast("int").alias("pos"),
        F.coalesce("_block", F.lit(0.85)).alias("block_threshold"),
        F.coalesce("_flag", F.lit(0.40)).alias("flag_threshold"),
        F.lit("allow").alias("on_timeout"),
    )
    return changed.unionByName(added.select(*changed.columns))


def approval_rate(outcomes: DataFrame) -> DataFrame:
    return outcomes.select(
        "total_reviews",
        _rate(F.col("incorrect_flags"), F.col("total_reviews")).alias("approval_rate"),
        F.greatest(F.lit(1), F.floor(F.col("total_reviews") / 10)).cast("long").alias("review_cycle"),
    )


def filter_counts(events: DataFrame, direction: str | None = None, use_case: str | None = None) -> DataFrame:
    """Counters per action under the chosen direction and use case filters."""
    for column, wanted in (("direction", direction), ("use_case", use_case)):
        if wanted and wanted.lower() != "all":
            events = events.where(F.lower(column) == wanted.lower())
    return events.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("decision_action") == a).alias(a) for a in ACTIONS])


BLAST_COST = {"irreversible_action": "0.50", "reversible_write": "0.25", "read_only": "0.05"}


def blast_radius(tool: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.TOOL_BLAST_RADIUS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, tool), F.lit("irreversible_action"))


def _cost(radius: Column) -> Column:
    return (
        F.when(radius == "irreversible_action", F.lit("0.50"))
        .when(radius == "reversible_write", F.lit("0.25"))
        .otherwise(F.lit("0.05"))
        .cast("decimal(18,2)")
    )


def tool_risk(calls: DataFrame, session: str, request: str, order: list[str], request_chunk: Column) -> DataFrame:
    """Verdict of every tool call from the session's risk before it.

    The increments do not depend on the verdicts, and clamping at the end of a
    request is monotone, so risk before a call is min(1, sum over the session's
    earlier requests) plus the earlier calls of its own request. A session with
    very many calls is summed in chunks of requests.
    """
    calls = calls.withColumn("blast_radius", blast_radius(F.col("tool_name")))
    calls = calls.withColumn("_cost", _cost(F.col("blast_radius")))
    per_request = calls.groupBy(session, request).agg(F.sum("_cost").alias("_spent"))
    before = ordered.running_sum(
        per_request, [session], request_chunk, [F.col(request)], F.col("_spent"), "_earlier", before=True
    ).select(session, request, F.least(F.lit(1).cast("decimal(18,2)"), F.col("_earlier")).alias("_earlier"))
    inside = F.sum("_cost").over(
        Window.partitionBy(session, request).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    df = calls.join(before, [session, request]).withColumn(
        "risk_before", (F.col("_earlier") + F.coalesce(inside, F.lit(0))).cast("decimal(18,2)")
    )
    radius, risk = F.col("blast_radius"), F.col("risk_before")
    return df.withColumn(
        "guard_verdict",
        F.when((radius == "irreversible_action") & (risk > 0.70), "block")
        .when(radius == "irreversible_action", "escalate")
        .when((radius == "reversible_write") & (risk > 0.60), "block")
        .otherwise("allow"),
    ).drop("_cost", "_earlier")


def session_risk(calls: DataFrame, session: str) -> DataFrame:
    """Current risk per session; a session without calls has none."""
    cost = _cost(blast_radius(F.col("tool_name")))
    return calls.groupBy(session).agg(F.least(F.lit(1).cast("decimal(18,2)"), F.sum(cost)).alias("cumulative_risk"))


def flag_milestones(events: DataFrame, every: int = 10) -> DataFrame:
    """Running number of flags over time, with the step to the next evaluation."""
    flags = events.where(F.col("decision_action") == "flag").select("event_id", "created_at")
    counted = ordered.running_count(
        flags, [], ordered.minute_chunk(F.col("created_at")), [F.col("created_at"), F.col("event_id")], "flag_count"
    )
    left = F.lit(every) - F.col("flag_count") % every
    return counted.withColumn("is_milestone", F.col("flag_count") % every == 0).withColumn("next_evaluation_in", left)


def usage_rollup(responses: DataFrame, profiles: DataFrame) -> DataFrame:
    """Tokens and cost by model and use case with subtotals; word counts stand in for missing counts.

    Responses: model, use_case, prompt, completion, prompt_tokens, completion_tokens (nullable).
    """

    def n_words(text: Column) -> Column:
        return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+", -1), lambda w: w != "")).cast("long")

    counted = responses.select(
        "model",
        "use_case",
        F.coalesce("prompt_tokens", n_words(F.col("prompt"))).alias("p"),
        F.coalesce("completion_tokens", n_words(F.col("completion"))).alias("c"),
    )
    summed = counted.groupBy("model", "use_case").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p"), F.sum("c").alias("c"))
    priced = summed.join(profiles, "model", "left").withColumn(
        "cost", (F.col("p") + F.col("c")) / 1000.0 * F.coalesce("cost_per_1k_tokens", F.lit(0.0))
    )
    return priced.rollup("model", "use_case").agg(
        F.sum("n").alias("responses"), F.sum("p").alias("prompt_tokens"), F.sum("c").alias("completion_tokens"), F.sum("cost").alias("cost")
    )
