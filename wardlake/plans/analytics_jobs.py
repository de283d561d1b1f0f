"""Registered queries: audit reports, trust and health statistics, search, requests in plain language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.functions import ordered
from wardlake.operators import analytics, envelopes, search, workflows
from wardlake.plans import inputs, sql
from wardlake.plans.catalog import query
from wardlake.plans.inputs import pick, pick_sql
from wardlake.plans.text_jobs import policy_load
from wardlake.sources.tables import table

A, O = inputs.AUDIT, inputs.OUTCOMES
STATS = f"""{A}, stats AS (SELECT count(DISTINCT interaction_id) AS total_interactions, count(*) AS n_events,
    {', '.join(f"count(*) FILTER (decision_action = '{a}') AS n_{a}" for a in analytics.ACTIONS)} FROM audit),
    rates AS (SELECT *, n_block / total_interactions AS block_rate, n_escalate / total_interactions AS escalation_rate FROM stats),
    dash AS (SELECT total_interactions, round(block_rate * 100, 1) AS block_rate, round(n_flag / total_interactions * 100, 1) AS flag_rate,
      round((n_flag + n_escalate) / total_interactions * 100, 1) AS escalate_rate, n_flag + n_escalate AS escalate_count FROM rates)"""
OUT = f"""{O}, outs AS (SELECT count(*) AS total_reviews, count(*) FILTER (was_original_flag_correct) AS correct_flags, count(*) FILTER (NOT was_original_flag_correct) AS incorrect_flags,
    count(*) FILTER (NOT was_original_flag_correct) / count(*) AS false_positive_rate, 0.0::DOUBLE AS false_negative_rate FROM outcomes)"""


@query(
    "audit_query",
    f"""WITH {A} SELECT event_id, use_case, direction, decision_action, {inputs.stamp_sql('created_at')} FROM
      (SELECT * FROM audit WHERE lower(use_case) = 'customer_support' AND decision_action = 'block' AND created_at >= TIMESTAMP '2024-01-10' ORDER BY created_at DESC, event_id DESC LIMIT 200)""",
)
def audit_query(spark: SparkSession, sf: str) -> DataFrame:
    out = analytics.query_events(inputs.audit_events(spark, sf), "Customer_Support", "BLOCK", "all", "2024-01-10 00:00:00")
    return out.select("event_id", "use_case", "direction", "decision_action", inputs.stamp("created_at"))


@query(
    "interaction_drill",
    f"""WITH {A}, pick AS (SELECT interaction_id FROM audit GROUP BY 1 ORDER BY max(created_at) DESC, interaction_id DESC LIMIT 1)
    SELECT event_id, direction, decision_action, {inputs.stamp_sql('created_at')} FROM audit WHERE interaction_id IN (SELECT interaction_id FROM pick)""",
)
def interaction_drill(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the newest interaction; a top-1 row joined back."""
    ev = inputs.audit_events(spark, sf)
    newest = ev.groupBy("interaction_id").agg(F.max("created_at").alias("t")).orderBy(F.desc("t"), F.desc("interaction_id")).limit(1)
    hits = ev.join(newest.select("interaction_id"), "interaction_id", "left_semi").orderBy("created_at", "event_id")
    return hits.select("event_id", "direction", "decision_action", inputs.stamp("created_at"))


@query("audit_stats", f"WITH {STATS} SELECT * REPLACE (round(block_rate, 6) AS block_rate, round(escalation_rate, 6) AS escalation_rate) FROM rates")
def audit_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = analytics.audit_stats(inputs.audit_events(spark, sf))
    return s.withColumn("block_rate", F.round("block_rate", 6)).withColumn("escalation_rate", F.round("escalation_rate", 6))


@query(
    "audit_breakdown",
    f"""WITH {A} SELECT 'action' AS kind, decision_action AS name, count(*) AS n FROM audit GROUP BY ALL UNION ALL SELECT 'use_case', use_case, count(*) FROM audit GROUP BY ALL""",
)
def audit_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.audit_breakdown(inputs.audit_events(spark, sf))


@query("dashboard_rates", f"WITH {STATS} SELECT * FROM dash")
def dashboard_rates(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.dashboard_rates(analytics.audit_stats(inputs.audit_events(spark, sf)))


@query("outcome_stats", f"WITH {OUT} SELECT * REPLACE (round(false_positive_rate, 6) AS false_positive_rate) FROM outs")
def outcome_stats(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.outcome_stats(inputs.outcomes(spark, sf)).withColumn("false_positive_rate", F.round("false_positive_rate", 6))


@query(
    "trust_score",
    f"""WITH {STATS}, {OUT} SELECT total_interactions AS total, round(false_positive_rate * 100, 1) AS fpr, 0.0::DOUBLE AS fnr,
    round(greatest(15.0, least(100.0, 100 - round(false_positive_rate * 100, 1) * 0.35 - flag_rate * 0.2 - least(block_rate * 0.15, 15.0))), 1) AS trust_score, block_rate, flag_rate, escalate_rate, total_reviews FROM dash, outs""",
)
def trust_score(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.trust_score(analytics.audit_stats(inputs.audit_events(spark, sf)), analytics.outcome_stats(inputs.outcomes(spark, sf)))


@query(
    "action_trend_7d",
    f"""WITH {A}, days AS (SELECT DATE '{inputs.END_DATE}' - i::INTEGER AS day FROM range(7) r(i))
    SELECT strftime(d.day, '%Y-%m-%d') AS day, {', '.join(f"count(*) FILTER (decision_action = '{a}') AS {a}" for a in analytics.ACTIONS)}
    FROM days d LEFT JOIN audit ON created_at::DATE = d.day GROUP BY d.day""",
)
def action_trend_7d(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.action_trend(inputs.audit_events(spark, sf), inputs.END_DATE).withColumn("day", F.col("day").cast("string"))


@query(
    "queue_stats",
    f"""WITH {inputs.ESCALATIONS} SELECT count(*) FILTER (status = 'pending') AS queue_depth, count(*) FILTER (status = 'resolved') AS resolved_total,
    round(count(*) FILTER (status = 'resolved') / count(*) * 100, 0) AS resolution_percent FROM queue""",
)
def queue_stats(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.queue_stats(inputs.escalations(spark, sf))


POINTS = (0.50, 0.90, 0.95, 0.99)
_PCT = ", ".join(f"round(quantile_cont(latency_ms, {p}), 6) AS p{round(p * 100)}" for p in POINTS)


def _rounded(df: DataFrame) -> DataFrame:
    for p in POINTS:
        df = df.withColumn(f"p{round(p * 100)}", F.round(f"p{round(p * 100)}", 6))
    return df


@query("latency_percentiles", f"WITH {A} SELECT use_case, direction, {_PCT}, count(*) AS n FROM audit GROUP BY ALL")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(analytics.percentiles(inputs.audit_events(spark, sf), ["use_case", "direction"], "latency_ms", POINTS))


@query("latency_profile", f"WITH {A} SELECT {_PCT}, count(*) AS n FROM audit")
def latency_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(analytics.percentiles(inputs.audit_events(spark, sf), [], "latency_ms", POINTS))


def alerts_sql(rates: str, keep: str) -> str:
    arms = " UNION ALL ".join(
        f"""SELECT {keep}, '{name}' AS metric, round({col} * 100, 1) AS current_value, {round(mean * 100, 1)}::DOUBLE AS baseline_mean, {round(std * 100, 1)}::DOUBLE AS baseline_std,
        round(({col} - {mean}) / {std}, 2) AS sigma_breach, {f"CASE WHEN {col} > {critical} THEN 'critical' ELSE 'medium' END" if critical else "'medium'"} AS severity
        FROM {rates} WHERE total_interactions >= 5 AND (({col} - {mean}) / {std} > 3 OR {col} > {hard})"""
        for (name, mean, std, hard, critical), col in zip(fixed.ALERT_BASELINES, ("block_rate", "escalation_rate"), strict=True)
    )
    return arms


DAILY = f"""{A}, daily AS (SELECT strftime(created_at, '%Y-%m-%d') AS day, use_case, count(DISTINCT interaction_id) AS total_interactions,
    count(*) FILTER (decision_action = 'block') / count(DISTINCT interaction_id) AS block_rate, count(*) FILTER (decision_action = 'escalate') / count(DISTINCT interaction_id) AS escalation_rate FROM audit GROUP BY ALL)"""


@query("sigma_alerts", f"WITH {DAILY} {alerts_sql('daily', 'day, use_case, total_interactions')}")
def sigma_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts per day and use case."""
    ev = inputs.audit_events(spark, sf).withColumn("day", F.date_format("created_at", "yyyy-MM-dd"))
    total = F.countDistinct("interaction_id")
    daily = ev.groupBy("day", "use_case").agg(
        total.alias("total_interactions"),
        (F.count_if(F.col("decision_action") == "block") / total).alias("block_rate"),
        (F.count_if(F.col("decision_action") == "escalate") / total).alias("escalation_rate"),
    )
    return analytics.sigma_alerts(daily)


PROFILE = f"""{inputs.CHECKS}, profile AS (SELECT check_name, count(*) AS n_scores, avg(score) AS mean_score, max(score) AS max_score FROM checks WHERE score > 0 GROUP BY 1)"""


@query("check_score_profile", f"WITH {PROFILE} SELECT check_name, n_scores, round(mean_score, 6) AS mean_score, max_score FROM profile")
def check_score_profile(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.check_profile(inputs.checks(spark, sf)).withColumn("mean_score", F.round("mean_score", 6))


_TARGETS = sql.values([(i, *t) for i, t in enumerate(fixed.PROPOSAL_TARGETS)], "target_no, id_prefix, check_name, use_case, kind, fallback, target")
PROPOSED = f"""{inputs.TENANT_RULES}, {PROFILE}, {OUT}, targets AS {_TARGETS},
    cur AS (SELECT tenant, target_no, min_by({{'b': block_threshold, 'f': flag_threshold}}, pos) AS r FROM tenant_rules r JOIN targets t ON t.check_name = r.check_name AND (r.use_case = '*' OR r.use_case = t.use_case) GROUP BY ALL),
    now AS (SELECT d.tenant, t.*, coalesce(CASE WHEN kind = 'block_threshold' THEN c.r.b ELSE c.r.f END, fallback)::DOUBLE AS cur FROM docs d CROSS JOIN targets t LEFT JOIN cur c ON c.tenant = d.tenant AND c.target_no = t.target_no),
    props AS (SELECT tenant, id_prefix || '_' || floor(round(cur * 100, 6))::INTEGER || '_' || lpad(round(target * 100)::INTEGER::VARCHAR, 3, '0') AS proposal_id, use_case, 'US' AS geography, n.check_name,
      kind AS target_threshold_type, cur AS current_threshold, target::DOUBLE AS proposed_threshold, coalesce(mean_score, 0.83) AS mean_score
      FROM now n LEFT JOIN profile p ON p.check_name = n.check_name WHERE CASE WHEN kind = 'block_threshold' THEN cur > target ELSE cur < target END),
    decided_ids AS (SELECT s_suppkey AS tenant, 'prop_leak_block_70_060' AS proposal_id FROM supplier WHERE s_suppkey % 2 = 0),
    open_props AS (SELECT * FROM props ANTI JOIN decided_ids USING (tenant, proposal_id))"""


def decided(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").where(F.col("s_suppkey") % 2 == 0)
    return s.select(F.col("s_suppkey").alias("tenant"), F.lit("prop_leak_block_70_060").alias("proposal_id"))


def tenant_proposals(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.proposals(
        policy_load(spark, sf), analytics.check_profile(inputs.checks(spark, sf)), analytics.outcome_stats(inputs.outcomes(spark, sf)),
        decided(spark, sf), keys=["tenant"],
    )


@query(
    "threshold_proposals",
    f"""WITH {PROPOSED} SELECT tenant, proposal_id, use_case, geography, check_name, target_threshold_type, current_threshold, proposed_threshold,
    'Mean score ' || printf('%.2f', mean_score) || ' over ' || total_reviews || ' reviews; move ' || target_threshold_type || ' from ' || current_threshold || ' to ' || proposed_threshold AS reason,
    greatest(1, total_reviews // 10)::BIGINT AS cycle, total_reviews AS review_count FROM open_props, outs""",
)
def threshold_proposals(spark: SparkSession, sf: str) -> DataFrame:
    return tenant_proposals(spark, sf)


@query(
    "proposal_decide",
    f"""WITH {PROPOSED}, acc AS (SELECT tenant, use_case, geography, check_name, max(proposed_threshold) FILTER (target_threshold_type = 'block_threshold') AS b,
        max(proposed_threshold) FILTER (target_threshold_type = 'flag_threshold') AS f FROM open_props WHERE tenant % 3 = 0 GROUP BY ALL)
    SELECT r.tenant, r.use_case, r.geography, r.check_name, coalesce(b, r.block_threshold) AS block_threshold, coalesce(f, r.flag_threshold) AS flag_threshold, r.on_timeout
    FROM tenant_rules r LEFT JOIN acc USING (tenant, use_case, geography, check_name)
    UNION ALL SELECT tenant, use_case, geography, check_name, coalesce(b, 0.85), coalesce(f, 0.4), 'allow' FROM acc ANTI JOIN tenant_rules USING (tenant, use_case, geography, check_name)""",
)
def proposal_decide(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of all tenants after every third tenant accepts its open proposals."""
    accepted = tenant_proposals(spark, sf).where(F.col("tenant") % 3 == 0)
    out = analytics.accept_proposals(policy_load(spark, sf).drop("version"), accepted, keys=["tenant"])
    return out.select("tenant", "use_case", "geography", "check_name", "block_threshold", "flag_threshold", "on_timeout")


@query("review_approval_rate", f"WITH {OUT} SELECT total_reviews, round(incorrect_flags / total_reviews, 6) AS approval_rate, greatest(1, total_reviews // 10)::BIGINT AS review_cycle FROM outs")
def review_approval_rate(spark: SparkSession, sf: str) -> DataFrame:
    out = analytics.approval_rate(analytics.outcome_stats(inputs.outcomes(spark, sf)))
    return out.withColumn("approval_rate", F.round("approval_rate", 6))


WEIGHTS = {"interaction_id": 2.8, "text": 2.4, "direction": 1.3, "use_case": 1.5, "geography": 1.4}
SEARCHES = ("the customer", "cpilot in", "ds eu output", "ation us")


def _token_sql(token: str, name: str) -> str:
    f, w, n = f"lower({name}::VARCHAR)", f"list_filter(string_split_regex(lower({name}::VARCHAR), {sql.lit(search.SEPARATORS + '+')}), lambda x: x <> '')", float(len(token))
    t = sql.lit(token)
    starts = f"list_filter({w}, lambda x: starts_with(x, {t}))"
    acro = f"array_to_string(list_transform({w}, lambda x: substr(x, 1, 1)), '')"
    out = f"""CASE WHEN length({f}) = 0 THEN 0.0 WHEN {f} = {t} THEN 100.0 WHEN starts_with({f}, {t}) THEN 90 + {n} / length({f}) * 10
      WHEN instr({f}, {t}) > 0 THEN CASE WHEN regexp_matches(substr({f}, instr({f}, {t}) - 1, 1), {sql.lit(search.SEPARATORS)}) THEN 80.0 ELSE 65.0 END + {n} / length({f}) * 10
      WHEN len({starts}) > 0 THEN 75 + {n} / length({starts}[1]) * 10"""
    if len(token) >= 2:
        out += f" WHEN contains({acro}, {t}) THEN 70.0"
    if len(token) >= 4:
        spans = f"list_filter(list_transform({w}, lambda x: length(regexp_extract(x, {sql.lit(search.subsequence_pattern(token))}, 1))), lambda x: x > 0 AND x <= {len(token) + 2})"
        out += f" WHEN len({spans}) > 0 THEN greatest(30.0, least(80.0, 50 + {n} / {spans}[1] * 20))"
    return out + " ELSE 0.0 END"


def _search_sql(text: str) -> str:
    tokens = text.split()
    cols = ", ".join("greatest(" + ", ".join(f"coalesce({_token_sql(t, n)}, 0.0) * {w}" for n, w in WEIGHTS.items()) + f") AS t{i}" for i, t in enumerate(tokens))
    every = " AND ".join(f"t{i} > 0" for i in range(len(tokens)))
    total = " + ".join(f"t{i}" for i in range(len(tokens)))
    return f"SELECT {sql.lit(text)} AS search, interaction_id, round({total}, 6) AS search_score FROM (SELECT interaction_id, {cols} FROM interactions) WHERE {every}"


@query("fuzzy_search", f"WITH {inputs.INTERACTIONS} {' UNION ALL '.join(_search_sql(s) for s in SEARCHES)}")
def fuzzy_search(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for text in SEARCHES:
        hits = search.fuzzy(inputs.interactions(spark, sf), text, WEIGHTS).select(
            F.lit(text).alias("search"), "interaction_id", F.round("search_score", 6).alias("search_score")
        )
        out = hits if out is None else out.unionByName(hits)
    return out.orderBy("search", F.desc("search_score"))


@query(
    "categorical_filter_counts",
    f"""WITH {A} SELECT count(*) AS "all", {', '.join(f"count(*) FILTER (decision_action = '{a}') AS {a}" for a in analytics.ACTIONS)} FROM audit WHERE direction = 'input' AND use_case = 'internal_copilot'""",
)
def categorical_filter_counts(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.filter_counts(inputs.audit_events(spark, sf), direction="Input", use_case="internal_copilot")


_COST = "CASE r WHEN 'irreversible_action' THEN 0.50 WHEN 'reversible_write' THEN 0.25 ELSE 0.05 END::DECIMAL(18, 2)"
_RADIUS = "CASE " + " ".join(f"WHEN tool_name = '{t}' THEN '{r}'" for t, r in fixed.TOOL_BLAST_RADIUS.items()) + " ELSE 'irreversible_action' END"
RISK = f"""{inputs.TOOL_CALLS}, rad AS (SELECT *, {_RADIUS} AS r FROM tool_calls), cost AS (SELECT *, {_COST} AS c FROM rad),
    before AS (SELECT *, least(1, coalesce(sum(c) OVER (PARTITION BY session_id ORDER BY request_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      + coalesce(sum(c) OVER (PARTITION BY session_id, request_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS risk_before FROM cost)"""


@query(
    "tool_guard_risk",
    f"""WITH {RISK} SELECT event_id, session_id, tool_name, r AS blast_radius, risk_before::DOUBLE AS risk_before, CASE WHEN r = 'irreversible_action' AND risk_before > 0.70 THEN 'block' WHEN r = 'irreversible_action' THEN 'escalate'
    WHEN r = 'reversible_write' AND risk_before > 0.60 THEN 'block' ELSE 'allow' END AS guard_verdict FROM before""",
)
def tool_guard_risk(spark: SparkSession, sf: str) -> DataFrame:
    out = analytics.tool_risk(inputs.tool_calls(spark, sf), "session_id", "request_id", ["ts", "event_id"], ordered.block_chunk(F.col("request_id")))
    return out.select("event_id", "session_id", "tool_name", "blast_radius", F.col("risk_before").cast("double").alias("risk_before"), "guard_verdict")


@query("session_risk", f"WITH {RISK} SELECT session_id, least(1, sum(c))::DOUBLE AS cumulative_risk FROM cost GROUP BY session_id")
def session_risk(spark: SparkSession, sf: str) -> DataFrame:
    out = analytics.session_risk(inputs.tool_calls(spark, sf), "session_id")
    return out.withColumn("cumulative_risk", F.col("cumulative_risk").cast("double"))


LEAVE_TAILS = ("I need leave for 2 days", "leave from September 2 to September 5", "9 days please", "off tomorrow and the day after", "off today", "two weeks away", "sick, room 12", "nothing", "0 days")
_SPAN = r"(\d+)(?:st|nd|rd|th)?\s*(?:to|-|until|through)\s*(\d+)(?:st|nd|rd|th)?"


def _num(pattern: str, group: int = 1) -> str:
    return f"TRY_CAST(nullif(regexp_extract(low, {sql.lit(pattern)}, {group}), '') AS INTEGER)"


_DAYS = "CASE " + " ".join(f"WHEN contains(low, {sql.lit(p)}) THEN {n}" for p, n in fixed.NUMBER_PHRASES) + rf""" WHEN {_num(r'\b(\d+)\s*(?:day|days|working\s+days)\b')} IS NOT NULL THEN {_num(r'\b(\d+)\s*(?:day|days|working\s+days)\b')}
    WHEN contains(low, 'tomorrow and') AND contains(low, 'day after') THEN 2 WHEN contains(low, 'tomorrow') OR contains(low, 'today') THEN 1
    WHEN {_num(_SPAN, 2)} >= {_num(_SPAN)} THEN {_num(_SPAN, 2)} - {_num(_SPAN)} + 1 ELSE {_num(r'\b(\d+)\b')} END"""


@query(
    "leave_decision",
    f"""WITH {inputs.INTERACTIONS}, t AS (SELECT interaction_id, lower({pick_sql('conv_id + turn', LEAVE_TAILS)} || CASE WHEN conv_id % 2 = 0 THEN '. ' || text ELSE '' END) AS low FROM interactions),
    d AS (SELECT interaction_id, ({_DAYS})::INTEGER AS leave_days FROM t)
    SELECT interaction_id, leave_days, CASE WHEN coalesce(leave_days, 0) <= 0 THEN 'ERROR' WHEN leave_days <= 2 THEN 'AUTO_APPROVED' WHEN leave_days <= 5 THEN 'MANAGER_APPROVAL_REQUIRED' ELSE 'REJECTED' END AS leave_decision FROM d""",
)
def leave_decision(spark: SparkSession, sf: str) -> DataFrame:
    t = inputs.interactions(spark, sf)
    asked = F.concat(pick(F.col("conv_id") + F.col("turn"), LEAVE_TAILS), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(". "), "text")).otherwise(""))
    return workflows.leave_decisions(t.withColumn("text", asked)).select("interaction_id", "leave_days", "leave_decision")


MAIL_HEADS = (
    "Send an email to jo@example.com saying that the meeting is at 4 PM.",
    "please draft a message to billing@shop.example about the renewal date.",
    "email asking for a refund on order number A-77",
    "Write an email with subject: Status and body: All done",
    "mail requesting access to o'neil's board.",
    "hello there",
)


@query("mail_field_extract")
def mail_field_extract(spark: SparkSession, sf: str) -> DataFrame:
    d = inputs.documents(spark, sf).select("doc_id", F.concat(pick(F.col("doc_id"), MAIL_HEADS), F.lit("\n"), "text").alias("text"))
    return workflows.mail_fields(d).select("doc_id", "recipient", "mail_kind", "subject", "topic", "mail_status")


PLACES_ASKED = ("What is the weather in Boston right now?", "temperature for New Delhi.", "how hot is it in the?", "Will it rain near Rio de Janeiro tomorrow", "hello")


def _place(pattern: str) -> str:
    found = sql.strip(f"regexp_extract(q, {sql.lit('(?i)' + pattern)}, 1)")
    return f"CASE WHEN {found} <> '' AND lower({found}) NOT IN {fixed.LOCATION_STOPWORDS} THEN {found} END"


@query(
    "location_extract",
    f"""WITH {inputs.INTERACTIONS}, t AS (SELECT {pick_sql('conv_id + turn', PLACES_ASKED)} || CASE WHEN turn % 2 = 1 THEN ' ' || text ELSE '' END AS q FROM interactions),
    p AS (SELECT coalesce({', '.join(_place(p) for p in fixed.LOCATION_PATTERNS)}) AS place FROM t) SELECT place, count(*) AS n FROM p GROUP BY place""",
)
def location_extract(spark: SparkSession, sf: str) -> DataFrame:
    t = inputs.interactions(spark, sf)
    asked = F.concat(pick(F.col("conv_id") + F.col("turn"), PLACES_ASKED), F.when(F.col("turn") % 2 == 1, F.concat(F.lit(" "), "text")).otherwise(""))
    return t.select(workflows.location(asked).alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n"))


_LABELS = sql.values(sorted(fixed.WEATHER_LABELS.items()), "code, label")


@query(
    "observation_enrich",
    f"""WITH o AS (SELECT event_id, CASE WHEN event_id % 9 > 0 THEN value ELSE 0 END::DOUBLE AS temp_c, CASE WHEN event_id % 7 = 0 THEN 0 ELSE (props::JSON ->> 'k')::INTEGER END AS code, event_id % 5 = 0 AS feels FROM events)
    SELECT event_id, temp_c, round(temp_c * 9.0 / 5.0 + 32.0, 1) AS temp_f, CASE WHEN feels THEN 20.5 ELSE temp_c END::DOUBLE AS apparent_c, o.code AS weather_code, coalesce(label, 'Partly Cloudy') AS condition FROM o LEFT JOIN {_LABELS} w ON w.code = o.code""",
)
def observation_enrich(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    obs = inputs.events(spark, sf).select(
        "event_id", F.when(e % 9 > 0, F.col("value")).alias("temp_c"), F.when(e % 7 > 0, F.get_json_object("props", "$.k").cast("int")).alias("weather_code"),
        F.when(e % 5 == 0, F.lit(20.5)).alias("apparent_c"), F.lit(None).cast("double").alias("humidity"), F.lit(None).cast("double").alias("wind_speed"),
    )
    return workflows.enrich_observations(obs).select("event_id", "temp_c", "temp_f", "apparent_c", "weather_code", "condition")


PROFILES = (("small", 0.000075), ("medium", 0.0001), ("large", 0.00015))
MODEL_OF = ("small", "medium", "large", "unlisted")


@query(
    "usage_rollup",
    rf"""WITH {inputs.INTERACTIONS}, r AS (SELECT {pick_sql('o.conv_id', MODEL_OF)} AS model, o.use_case, CASE WHEN o.conv_id % 3 = 0 THEN 100 ELSE len(list_filter(string_split_regex(coalesce(i.text, ''), '\s+'), lambda x: x <> '')) END AS p,
        len(list_filter(string_split_regex(o.text, '\s+'), lambda x: x <> '')) AS c FROM interactions o LEFT JOIN interactions i ON i.conv_id = o.conv_id AND i.turn = o.turn - 1 WHERE o.direction = 'output')
    SELECT r.model, use_case, count(*) AS responses, sum(p)::BIGINT AS prompt_tokens, sum(c)::BIGINT AS completion_tokens, round(sum((p + c) / 1000.0 * coalesce(cost, 0)), 6) AS cost
    FROM r LEFT JOIN {sql.values(PROFILES, 'model, cost')} pr ON pr.model = r.model GROUP BY ROLLUP (r.model, use_case)""",
)
def usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    t = inputs.interactions(spark, sf)
    asked = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    replies = (
        t.where("direction = 'output'")
        .join(asked, ["conv_id", "turn"], "left")
        .select(
            pick(F.col("conv_id"), MODEL_OF).alias("model"), "use_case", "prompt", F.col("text").alias("completion"),
            F.when(F.col("conv_id") % 3 == 0, F.lit(100)).cast("long").alias("prompt_tokens"), F.lit(None).cast("long").alias("completion_tokens"),
        )
    )
    profiles = spark.createDataFrame(list(PROFILES), "model string, cost_per_1k_tokens double")
    return analytics.usage_rollup(replies, profiles).withColumn("cost", F.round("cost", 6))


@query(
    "flag_milestone",
    f"""WITH {A}, c AS (SELECT event_id, row_number() OVER (ORDER BY created_at, event_id) AS flag_count FROM audit WHERE decision_action = 'flag')
    SELECT event_id, flag_count, flag_count % 10 = 0 AS is_milestone, 10 - flag_count % 10 AS next_evaluation_in FROM c""",
)
def flag_milestone(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.flag_milestones(inputs.audit_events(spark, sf)).select("event_id", "flag_count", "is_milestone", "next_evaluation_in")


@query(
    "geo_context",
    f"""WITH {inputs.INTERACTIONS} SELECT interaction_id, CASE geography WHEN 'EU' THEN 'EUR' WHEN 'IN' THEN 'INR' ELSE 'USD' END AS currency, CASE geography WHEN 'EU' THEN 'European Union' WHEN 'IN' THEN 'India' ELSE 'United States' END AS residency,
    'Data zone: ' || CASE geography WHEN 'EU' THEN 'European Union' WHEN 'IN' THEN 'India' ELSE 'United States' END || '. Follow ' || CASE geography WHEN 'EU' THEN 'GDPR' WHEN 'IN' THEN 'DPDP Act' ELSE 'US Federal/State law' END
    || '. Amounts in ' || CASE geography WHEN 'EU' THEN 'EUR' WHEN 'IN' THEN 'INR' ELSE 'USD' END || '.' AS prompt_prefix FROM interactions""",
)
def geo_context(spark: SparkSession, sf: str) -> DataFrame:
    return envelopes.geography_context(inputs.interactions(spark, sf)).select("interaction_id", "currency", "residency", "prompt_prefix")
