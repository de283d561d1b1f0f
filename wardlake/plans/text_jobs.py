"""Registered queries: envelopes, audit rows, text normalisation, conversation shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.functions import text
from wardlake.functions.rows import spread
from wardlake.operators import datasets, envelopes, normalize, policy, registry
from wardlake.plans import inputs, sql
from wardlake.plans.catalog import CHECKS, query
from wardlake.plans.inputs import pick, pick_sql
from wardlake.plans.policy_sql import DECIDED
from wardlake.session import shared_folder
from wardlake.sources import audit, policies
from wardlake.sources.tables import table

HEADERS = ("INTERNAL_COPILOT", "bogus", None, None, None)
PLACE_HEADERS = ("eu", "xx", None, None, None, None, None)
MODELS = ("", "general-large", None, None)
ENDPOINTS = (None, None, "email_service", "")


def chat_requests(spark: SparkSession, sf: str) -> DataFrame:
    newest = normalize.current_message(inputs.conversations(spark, sf))
    c = F.col("conv_id")
    none = F.lit(None).cast("array<string>")
    return newest.select(
        c.cast("string").alias("request_id"),
        c.cast("string").alias("session_id"),
        "role",
        F.col("text").alias("content"),
        F.when(c % 4 == 0, pick(c, inputs.CASES)).alias("use_case"),
        F.when(c % 4 == 1, pick(c, inputs.PLACES)).alias("geography"),
        pick(c, HEADERS).alias("header_use_case"),
        pick(c, PLACE_HEADERS).alias("header_geography"),
        F.when(c % 2 == 0, F.array(F.lit("EMAIL"))).when(c % 5 == 0, F.array().cast("array<string>")).otherwise(none).alias("pii"),
        F.when(c % 3 == 0, F.array(F.lit("PHONE"), F.lit("EMAIL"))).otherwise(none).alias("allowed_pii"),
        pick(c, MODELS).alias("model"),
        pick(c, ENDPOINTS).alias("endpoint_id"),
    )


@query(
    "envelope_build",
    f"""
    WITH newest AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
    SELECT conv_id::VARCHAR AS interaction_id, conv_id::VARCHAR AS session_id,
      CASE WHEN lower({pick_sql('conv_id', HEADERS)}) IN {tuple(fixed.USE_CASES)} THEN lower({pick_sql('conv_id', HEADERS)})
           WHEN conv_id % 4 = 0 THEN {pick_sql('conv_id', inputs.CASES)} ELSE 'customer_support' END AS use_case,
      CASE WHEN upper({pick_sql('conv_id', PLACE_HEADERS)}) IN {tuple(fixed.GEOGRAPHIES)} THEN upper({pick_sql('conv_id', PLACE_HEADERS)})
           WHEN conv_id % 4 = 1 THEN {pick_sql('conv_id', inputs.PLACES)} ELSE 'US' END AS geography,
      'input' AS direction, role, text AS content,
      CASE WHEN conv_id % 2 = 0 THEN 'EMAIL' WHEN conv_id % 3 = 0 THEN 'PHONE,EMAIL' ELSE '' END AS pii_declaration,
      coalesce(nullif({pick_sql('conv_id', MODELS)}, ''), nullif({pick_sql('conv_id', ENDPOINTS)}, '')) AS model_requested
    FROM newest""",
)
def envelope_build(spark: SparkSession, sf: str) -> DataFrame:
    built = envelopes.build(chat_requests(spark, sf))
    return built.select(
        "interaction_id", "session_id", "use_case", "geography", "direction", "payload.role", "payload.content",
        F.array_join("pii_declaration", ",").alias("pii_declaration"), "model_requested",
    )


def event_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decision of every audit event from its check rows."""
    checks = inputs.checks(spark, sf)
    judged = policy.with_verdict(policy.resolve(checks, policy.default_rules(spark)))
    return policy.decide(
        judged, ["event_id", "interaction_id", "session_id", "direction", "use_case", "geography", "created_at"], version="v1"
    )


@query(
    "audit_append",
    f"""
    WITH {DECIDED},
    stopped AS (SELECT interaction_id FROM decided WHERE direction = 'input' AND action = 'block')
    SELECT interaction_id, session_id, direction, use_case, geography,
      to_json({{'interaction_id': interaction_id, 'use_case': use_case, 'geography': geography, 'direction': direction,
        'risk': {{'tier': tier}}, 'decision': {{'action': action, 'reason': reason}}}})::VARCHAR AS envelope,
      action AS decision_action, policy_version, {inputs.stamp_sql('created_at')}, strftime(created_at, '%Y-%m-%d') AS event_date
    FROM decided WHERE direction = 'input' OR interaction_id NOT IN (SELECT interaction_id FROM stopped)""",
)
def audit_append(spark: SparkSession, sf: str) -> DataFrame:
    events = envelopes.audit_events(event_decisions(spark, sf))
    return events.select(
        "interaction_id", "session_id", "direction", "use_case", "geography", "envelope", "decision_action", "policy_version",
        inputs.stamp("created_at"), F.col("event_date").cast("string").alias("event_date"),
    )


@query("audit_commit", CHECKS["audit_append"])
def audit_commit(spark: SparkSession, sf: str) -> DataFrame:
    """The audit table after two batches, a repeat of the first, and an attempt that never committed: each event once."""
    events = envelopes.audit_events(event_decisions(spark, sf))
    path = shared_folder(spark, "audit")
    parts = {name: events.where(F.col("direction") == name) for name in ("input", "output")}
    for name in ("input", "output", "input"):
        audit.commit(parts[name], path, f"day-1:{name}")
    audit.append(audit.committed(spark, path).where("direction = 'input'"), f"{path}/events/attempt=died")
    out = audit.committed(spark, path)
    return out.select(
        "interaction_id", "session_id", "direction", "use_case", "geography", "envelope", "decision_action", "policy_version",
        inputs.stamp("created_at"), F.col("event_date").cast("string").alias("event_date"),
    )


def stored_events(spark: SparkSession, sf: str) -> DataFrame:
    """Audit events with an envelope as JSON text; parts of it are missing in places."""
    ev = inputs.audit_events(spark, sf)
    risk = F.when(F.col("event_id") % 3 == 0, F.lit('{"tier":"high","confidence":0.75}')).when(
        F.col("event_id") % 3 == 1, F.lit('{"tier":"medium"}')
    )
    envelope = F.when(
        risk.isNotNull(),
        F.concat(
            F.lit('{"interaction_id":"'), F.col("interaction_id").cast("string"), F.lit('","payload":{"role":"user","content":'),
            "props", F.lit('},"checks":[{"check_name":"pii","score":0.5,"verdict":"warn"}],"risk":'), risk,
            F.lit(',"model":{"routed_to":"m'), F.col("session_id"), F.lit('"}}'),
        ),
    ).otherwise(F.col("props"))
    return ev.withColumn("envelope", envelope)


@query(
    "audit_flatten",
    f"""
    WITH {inputs.AUDIT}
    SELECT interaction_id, {inputs.stamp_sql('created_at').replace('AS created_at', 'AS timestamp')}, use_case, geography, direction, decision_action,
      CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk_tier,
      CASE event_id % 3 WHEN 0 THEN 0.75 ELSE 0.0 END::DOUBLE AS risk_confidence,
      CASE WHEN event_id % 3 < 2 THEN 'm' || session_id END AS model_used,
      CASE WHEN event_id % 3 < 2 THEN replace(props, ' ', '') ELSE '' END AS content,
      CASE WHEN event_id % 3 < 2 THEN 1 ELSE 0 END::BIGINT AS n_checks
    FROM audit""",
)
def audit_flatten(spark: SparkSession, sf: str) -> DataFrame:
    flat = envelopes.flatten(stored_events(spark, sf))
    return flat.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")).withColumn(
        "content", F.replace("content", F.lit(" "), F.lit(""))
    )


@query("policy_load", f"WITH {inputs.TENANT_RULES} SELECT * FROM tenant_rules")
def policy_load(spark: SparkSession, sf: str) -> DataFrame:
    return policies.rule_rows(inputs.tenant_rules(spark, sf), "tenant")


@query(
    "policy_list",
    f"""WITH {inputs.TENANT_RULES} SELECT tenant, use_case || ':' || geography || ':' || check_name AS rule_id, use_case, geography, check_name,
    block_threshold, flag_threshold, CASE WHEN on_timeout = 'block' THEN 'block' ELSE 'allow' END AS on_timeout FROM tenant_rules""",
)
def policy_list(spark: SparkSession, sf: str) -> DataFrame:
    return policies.listing(policy_load(spark, sf), ["tenant"])


CUT = "1997-01-01"


@query(
    "policy_merge_save",
    f"""
    WITH entries AS (SELECT o_custkey AS document, o_orderpriority AS entry, o_orderdate < TIMESTAMP '{CUT}' AS old,
        max_by(o_orderstatus || ':' || o_orderkey, o_orderkey) AS value FROM orders GROUP BY ALL)
    SELECT coalesce(n.document, e.document) AS document, coalesce(n.entry, e.entry) AS entry, coalesce(n.value, e.value) AS value
    FROM (SELECT * FROM entries WHERE old) e FULL OUTER JOIN (SELECT * FROM entries WHERE NOT old) n
      ON e.document = n.document AND e.entry = n.entry""",
)
def policy_merge_save(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("document"),
        F.col("o_orderpriority").alias("entry"),
        (F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz")).alias("old"),
        F.concat_ws(":", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("value"),
        "o_orderkey",
    )
    entries = orders.groupBy("document", "entry", "old").agg(F.max_by("value", "o_orderkey").alias("value"))
    return registry.overlay(
        entries.where("old").drop("old"), entries.where("NOT old").drop("old"), ["document", "entry"], "value"
    )


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """All labelled corpora as one table."""
    docs = inputs.documents(spark, sf).select("doc_id", "text").join(table(spark, sf, "labels"), "doc_id")
    turns = inputs.conversations(spark, sf).where(F.col("role") != "system")
    turn_id = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return datasets.union_sources(
        (docs, "documents", F.col("doc_id"), F.col("text"), F.col("toxic")),
        (turns, "conversations", turn_id, F.col("text"), F.lit(0)),
    )


LABELLED = """labelled AS (
    SELECT 'documents:' || doc_id AS sample_id, text, toxic::INTEGER AS label, 'documents' AS source FROM documents JOIN labels USING (doc_id)
    UNION ALL SELECT 'conversations:' || conv_id || ':' || turn, text, 0, 'conversations' FROM conversations WHERE role <> 'system')"""


@query("labelled_sources", f"WITH {LABELLED} SELECT sample_id, md5(text) AS text_md5, label, source FROM labelled")
def labelled_sources(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).select("sample_id", F.md5("text").alias("text_md5"), "label", "source")


# --- text normalisation -----------------------------------------------------

SWAP_FROM, SWAP_TO = "aeopcyx", "аеорсух"


@query(
    "norm_homoglyph",
    f"""
    WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN translate(text, '{SWAP_FROM}', '{SWAP_TO}') ELSE text END AS text FROM documents)
    SELECT doc_id, translate(text, {sql.lit(fixed.HOMOGLYPHS_FROM)}, {sql.lit(fixed.HOMOGLYPHS_TO)}) AS folded,
      text <> translate(text, {sql.lit(fixed.HOMOGLYPHS_FROM)}, {sql.lit(fixed.HOMOGLYPHS_TO)}) AS changed FROM t""",
)
def norm_homoglyph(spark: SparkSession, sf: str) -> DataFrame:
    swapped = F.when(F.col("doc_id") % 2 == 0, F.translate("text", SWAP_FROM, SWAP_TO)).otherwise(F.col("text"))
    df = inputs.documents(spark, sf).select("doc_id", swapped.alias("text"))
    df = df.withColumn("folded", text.fold_homoglyphs(text.nfkc(F.col("text"))))
    return df.select("doc_id", "folded", (F.col("text") != F.col("folded")).alias("changed"))


@query(
    "norm_zero_width",
    r"""SELECT doc_id, regexp_replace(replace(text, 'a', 'a' || chr(8203) || chr(173)), '[\x{200B}-\x{200D}\x{FEFF}\x{AD}]', '', 'g') AS text FROM documents""",
)
def norm_zero_width(spark: SparkSession, sf: str) -> DataFrame:
    hidden = F.replace("text", F.lit("a"), F.lit("a​­"))
    return inputs.documents(spark, sf).select("doc_id", text.strip_zero_width(hidden).alias("text"))


@query(
    "norm_spaced_letters",
    f"WITH t AS (SELECT doc_id, text || ' b.a.d w-o-r d s p  e l' AS text FROM documents) SELECT doc_id, {sql.joined_letters('text')} AS text FROM t",
)
def norm_spaced_letters(spark: SparkSession, sf: str) -> DataFrame:
    spaced = F.concat("text", F.lit(" b.a.d w-o-r d s p  e l"))
    return inputs.documents(spark, sf).select("doc_id", text.join_spaced_letters(spaced).alias("text"))


@query("norm_leet", f"SELECT doc_id, {sql.leet('text')} AS text FROM documents")
def norm_leet(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.documents(spark, sf).select("doc_id", text.fold_leet(F.col("text")).alias("text"))


@query(
    "norm_compress",
    """
    WITH t AS (SELECT doc_id, replace(text, 'an', 'aaaan!!!') AS text FROM documents),
    c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM t),
    p AS (SELECT doc_id, c, i, lag(c, 1) OVER w AS p1, lag(c, 2) OVER w AS p2 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    SELECT doc_id, string_agg(c, '' ORDER BY i) AS text FROM p
    WHERE c = chr(10) OR p1 IS NULL OR p2 IS NULL OR NOT (c = p1 AND c = p2) GROUP BY doc_id""",
)
def norm_compress(spark: SparkSession, sf: str) -> DataFrame:
    stretched = F.replace("text", F.lit("an"), F.lit("aaaan!!!"))
    return inputs.documents(spark, sf).select("doc_id", text.compress_repeats(stretched).alias("text"))


@query("decode_payloads")
def decode_payloads(spark: SparkSession, sf: str) -> DataFrame:
    decoded = text.decoded_payloads(F.col("text"))
    return spread(inputs.probed(spark, sf), ["doc_id"], decoded, "payload", "part")


@query("norm_variants")
def norm_variants(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.variants(inputs.probed(spark, sf), "doc_id")


def code_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = F.md5("text")
    half = F.concat(F.lit('token = "'), F.substring(d, 1, 16), F.lit('" + "'), F.substring(d, 17, 16), F.lit('"'))
    hexed = F.concat(F.lit("x = bytes.fromhex('"), F.lower(F.hex(F.encode(F.substring(d, 1, 14), "UTF-8"))), F.lit("')"))
    encoded = F.concat(F.lit('y = base64.b64decode("'), F.base64(F.encode(F.substring(d, 3, 15), "UTF-8")), F.lit('")'))
    listed = F.concat(
        F.lit('z = "".join(['),
        F.array_join(F.transform(F.split(F.substring(d, 1, 13), ""), lambda c: F.concat(F.lit("chr("), F.ascii(c).cast("string"), F.lit(")"))), ", "),
        F.lit("])"),
    )
    k = F.col("doc_id") % 4
    return inputs.documents(spark, sf).select(
        "doc_id",
        F.concat("text", F.lit("\n"), F.when(k == 0, half).when(k == 1, hexed).when(k == 2, encoded).otherwise(listed)).alias("text"),
    )


@query(
    "code_unpack",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN md5(text) WHEN 1 THEN substr(md5(text), 1, 14)
       WHEN 2 THEN substr(md5(text), 3, 15) ELSE substr(md5(text), 1, 13) END AS unpacked FROM documents""",
)
def code_unpack(spark: SparkSession, sf: str) -> DataFrame:
    return spread(code_texts(spark, sf), ["doc_id"], normalize.unpacked_strings(F.col("text")), "unpacked")


@query("clean_text", f"SELECT doc_id, {sql.clean('text')} AS text FROM documents")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.documents(spark, sf).select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query(
    "sentence_split",
    rf"""
    WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?\n]){sql.SPACE}+', '\1' || chr(1), 'g'), chr(1)),
        lambda x: {sql.strip('x')}), lambda x: len(string_split_regex(x, '{sql.SPACE}+')) >= 3) AS s FROM documents)
    SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM s""",
)
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.sentence_rows(inputs.documents(spark, sf), "doc_id").withColumn("pos", F.col("pos").cast("long"))


@query(
    "message_collapse",
    """
    WITH spoken AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'user' ELSE 'model' END AS speaker FROM conversations WHERE role <> 'system'),
    kept AS (SELECT * FROM spoken s WHERE turn >= (SELECT min(turn) FROM spoken u WHERE u.conv_id = s.conv_id AND u.speaker = 'user')),
    marked AS (SELECT *, CASE WHEN lag(speaker) OVER w IS DISTINCT FROM speaker THEN 1 ELSE 0 END AS starts FROM kept WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    runs AS (SELECT *, sum(starts) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM marked),
    merged AS (SELECT conv_id, run, speaker, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content FROM runs GROUP BY ALL),
    heads AS (SELECT conv_id, max_by(text, turn) FILTER (role = 'system') AS system_text FROM conversations GROUP BY conv_id)
    SELECT h.conv_id, coalesce(run, 1)::BIGINT AS run, coalesce(speaker, 'user') AS speaker, coalesce(content, 'Hello') AS content, system_text
    FROM heads h LEFT JOIN merged m ON h.conv_id = m.conv_id""",
)
def message_collapse(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.collapse_messages(inputs.conversations(spark, sf))


@query(
    "last_user_message",
    """SELECT conv_id, coalesce(max_by(text, turn) FILTER (role = 'user'), max_by(text, turn)) AS text,
       coalesce(max(turn) FILTER (role = 'user'), max(turn)) AS turn FROM conversations GROUP BY conv_id""",
)
def last_user_message(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.last_user_message(inputs.conversations(spark, sf))


@query(
    "current_message_isolation",
    "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
)
def current_message_isolation(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.current_message(inputs.conversations(spark, sf))


@query(
    "system_prompt_pick",
    "SELECT conv_id, min_by(text, turn) AS system_prompt FROM conversations WHERE role = 'system' GROUP BY conv_id",
)
def system_prompt_pick(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.system_prompts(inputs.conversations(spark, sf))
