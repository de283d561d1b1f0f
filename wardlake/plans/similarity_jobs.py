"""Registered queries: hashed vectors, corpora, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.operators import routing, similarity
from wardlake.plans import inputs, sql
from wardlake.plans.catalog import query
from wardlake.plans.inputs import pick, pick_sql
from wardlake.plans.policy_jobs import corpus
from wardlake.sources.tables import table


@query(
    "hashed_embedding",
    f"""WITH {inputs.INTERACTIONS}, {sql.embedding('e', 'interactions', 'interaction_id')}, {sql.embedding('r', 'interactions', 'interaction_id', stopwords=True)}
    SELECT 'plain' AS variant, id AS interaction_id, b::INTEGER AS bucket, round(v, 6) AS weight FROM e UNION ALL SELECT 'router', id, b::INTEGER, round(v, 6) FROM r""",
)
def hashed_embedding(spark: SparkSession, sf: str) -> DataFrame:
    t = inputs.interactions(spark, sf)
    parts = [
        similarity.sparse_rows(t, "interaction_id", stopwords=stop).select(
            F.lit(name).alias("variant"), "interaction_id", F.col("bucket").cast("int").alias("bucket"), F.round("weight", 6).alias("weight")
        )
        for name, stop in (("plain", False), ("router", True))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "corpus_topk",
    """WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL), cn AS (SELECT label, i, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS m FROM c),
    q AS (SELECT vec_id, i, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS v FROM x),
    s AS (SELECT vec_id, label, round(sum(v * m), 6) AS sim FROM q JOIN cn USING (i) GROUP BY ALL)
    SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label)::INTEGER AS rank, label::VARCHAR AS match_id, sim AS similarity FROM s QUALIFY rank <= 3""",
)
def corpus_topk(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors against one prototype per label, the mean of its vectors."""
    vecs = table(spark, sf, "embeddings")
    mean = (
        vecs.select("label", F.posexplode("embedding").alias("i", "v"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("v").cast("double")).alias("m"))
        .groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("vector"))
    )
    out = similarity.top_k(vecs, "vec_id", mean.select(F.col("label").alias("corpus_id"), "vector"), 3, vector_col="embedding")
    return out.select("vec_id", "rank", "match_id", "similarity")


@query(
    "corpus_topk_text",
    f"""WITH {sql.embedding('qv', 'documents', 'doc_id')}, {sql.embedding('cv', 'benchmark', 'item_id')},
    s AS (SELECT qv.id, cv.id AS cid, round(sum(qv.v * cv.v), 6) AS sim FROM qv JOIN cv USING (b) GROUP BY ALL)
    SELECT id AS doc_id, row_number() OVER (PARTITION BY id ORDER BY sim DESC, cid)::INTEGER AS rank, cid::VARCHAR AS match_id, sim AS similarity FROM s QUALIFY rank <= 3""",
)
def corpus_topk_text(spark: SparkSession, sf: str) -> DataFrame:
    out = similarity.top_k(inputs.documents(spark, sf), "doc_id", corpus(spark, sf), 3)
    return out.select("doc_id", "rank", "match_id", "similarity")


@query(
    "corpus_vector_topk",
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    u AS (SELECT vec_id, i, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS v FROM x),
    s AS (SELECT q.vec_id, c.vec_id AS cid, round(sum(q.v * c.v), 6) AS sim FROM u q JOIN u c USING (i) WHERE q.vec_id % 100 = 0 GROUP BY ALL)
    SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cid)::INTEGER AS rank, cid::VARCHAR AS match_id, sim AS similarity FROM s QUALIFY rank <= 5""",
)
def corpus_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """A stated query set (ids divisible by 100) against a corpus of all vectors, which grows with the table."""
    vecs = table(spark, sf, "embeddings")
    corpus_rows = vecs.select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("vector"))
    return similarity.top_k(vecs.where("vec_id % 100 = 0"), "vec_id", corpus_rows, 5, vector_col="embedding").select("vec_id", "rank", "match_id", "similarity")


KINDS = ("prompt_injection", "toxicity", "api_key", "data_leak")


@query(
    "corpus_seed",
    f"""WITH {sql.embedding('e', 'benchmark', 'item_id')} SELECT 'seed_' || item_id AS corpus_id, {pick_sql('item_id', KINDS)} AS pattern_type, 'seed' AS source, count(b) AS n_weights, round(max(v), 6) AS top_weight
    FROM benchmark LEFT JOIN e ON e.id = item_id GROUP BY ALL""",
)
def corpus_seed(spark: SparkSession, sf: str) -> DataFrame:
    seeds = table(spark, sf, "benchmark").select(
        F.concat(F.lit("seed_"), F.col("item_id").cast("string")).alias("corpus_id"), pick(F.col("item_id"), KINDS).alias("pattern_type"), "text"
    )
    built = similarity.seed_corpus(seeds)
    return built.select(
        "corpus_id", "pattern_type", "source", F.size(F.filter("vector", lambda v: v != 0)).cast("long").alias("n_weights"),
        F.round(F.array_max("vector"), 6).alias("top_weight"),
    )


_REVIEWED = f"""reviewed AS (SELECT doc_id AS item_id, CASE WHEN doc_id % 5 = 4 THEN 'output' ELSE 'input' END AS direction, CASE WHEN toxic = 1 THEN 'deny' ELSE 'approve' END AS action, quality = 0 AS flag_correct, text
    FROM documents JOIN labels USING (doc_id) UNION ALL SELECT item_id, 'input', 'block', TRUE, text FROM benchmark)"""


@query(
    "corpus_ingest",
    f"""WITH {_REVIEWED}, ok AS (SELECT *, sha256(text) AS d FROM reviewed WHERE direction = 'input' AND (flag_correct OR action IN ('deny', 'block')) AND length(text) > 0)
    SELECT 'custom_' || substr(d, 1, 12) AS corpus_id, 'confirmed_human_review' AS pattern_type, 'review_console' AS source, md5(text) AS text_md5
    FROM (SELECT DISTINCT d, text FROM ok) WHERE d NOT IN (SELECT sha256(text) FROM benchmark)""",
)
def corpus_ingest(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.documents(spark, sf).select("doc_id", "text").join(table(spark, sf, "labels"), "doc_id")
    reviewed = docs.select(
        F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 5 == 4, "output").otherwise("input").alias("direction"),
        F.when(F.col("toxic") == 1, "deny").otherwise("approve").alias("action"), (F.col("quality") == 0).alias("flag_correct"), "text",
    )
    bench = table(spark, sf, "benchmark")
    again = bench.select("item_id", F.lit("input").alias("direction"), F.lit("block").alias("action"), F.lit(True).alias("flag_correct"), "text")
    out = similarity.ingest_confirmed(bench, reviewed.unionByName(again))
    return out.select("corpus_id", "pattern_type", "source", F.md5("text").alias("text_md5"))


@query(
    "endpoint_index",
    f"""WITH n AS (SELECT item_id, 'service ' || item_id AS name, text FROM benchmark),
    parts AS (SELECT item_id, name, list_slice(list_filter(list_transform(string_split(text, '.'), lambda x: {sql.strip('x')}), lambda x: length(x) > 15), 1, 6) AS cut, split_part(text, '.', 1) AS head FROM n),
    idx AS (SELECT item_id, 'primary' AS kind, 0 AS ordinal, name || ': ' || head AS text FROM parts UNION ALL
      SELECT item_id, 'exemplar', generate_subscripts(s, 1), unnest(s) FROM (SELECT item_id, CASE WHEN len(cut) > 0 THEN cut ELSE [name] END AS s FROM parts)),
    keyed AS (SELECT *, item_id * 100 + ordinal AS id FROM idx), {sql.embedding('e', 'keyed', stopwords=True)}
    SELECT item_id::VARCHAR AS endpoint, kind, ordinal::INTEGER AS ordinal, text, round(max(v), 6) AS top_weight FROM keyed LEFT JOIN e USING (id) GROUP BY ALL""",
)
def endpoint_index(spark: SparkSession, sf: str) -> DataFrame:
    """An endpoint per benchmark text, indexed by its summary and sentences."""
    endpoints = table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("endpoint"), F.concat(F.lit("service "), F.col("item_id").cast("string")).alias("name"),
        F.col("text").alias("instructions"), F.array().cast("array<string>").alias("exemplars"),
    )
    return routing.index_endpoints(endpoints).select("endpoint", "kind", "ordinal", "text", F.round(F.array_max("vector"), 6).alias("top_weight"))


ASKS = (
    "what is the weather in oslo right now? ", "how many people work in the company? ", "Send an email to rahul@example.com that the deadline moved. ",
    "I need 4 days off next week. ", "tell me about quantum computing. ", "", "   ",
)


def asked(spark: SparkSession, sf: str) -> DataFrame:
    t = inputs.interactions(spark, sf).where("direction = 'input'")
    k = F.col("conv_id") + F.col("turn")
    return t.select("interaction_id", F.when(k % len(ASKS) == 6, "   ").otherwise(F.concat(pick(k, ASKS), "text")).alias("text"), "conv_id")


_ENDPOINTS = sql.values(
    [(i, e, n, ins, f"/{e}/complete") for i, (e, n, ins, _) in enumerate(routing.ENDPOINTS)], "position, endpoint, name, instructions, target"
)
_INDEX = sql.values(
    [(i * 100, i, "primary", f"{n}: {ins.split('.')[0]}") for i, (_, n, ins, _) in enumerate(routing.ENDPOINTS)]
    + [(i * 100 + j + 1, i, "exemplar", s) for i, (_, _, _, samples) in enumerate(routing.ENDPOINTS) for j, s in enumerate(samples)],
    "id, position, kind, text",
)
_KEYWORDS = sql.values([(i, k) for i, (e, _, _, _) in enumerate(routing.ENDPOINTS) for k in routing.KEYWORDS[e]], "position, keyword")
_INTENT = "CASE " + " ".join(
    f"WHEN endpoint = '{e}' AND {e} THEN 0.45" for e in fixed.INTENT_PHRASES
) + " WHEN endpoint = 'general_query' AND NOT (" + " OR ".join(fixed.INTENT_PHRASES) + ") THEN 0.35 ELSE 0 END"


def _phrases(e: str) -> str:
    found = " OR ".join(f"contains(q, {sql.lit(p)})" for p in fixed.INTENT_PHRASES[e])
    return f"({found}{' OR regexp_matches(text, ' + sql.lit(fixed.EMAIL_INTENT_PATTERN) + ')' if e == 'email_service' else ''}) AS {e}"


ROUTED = f"""{inputs.INTERACTIONS}, asked AS (SELECT interaction_id, conv_id, CASE WHEN (conv_id + turn) % 7 = 6 THEN '   ' ELSE {pick_sql('conv_id + turn', ASKS)} || text END AS text FROM interactions WHERE direction = 'input'),
    lowq AS (SELECT *, lower({sql.strip('text')}) AS q FROM asked), qq AS (SELECT *, {', '.join(_phrases(e) for e in fixed.INTENT_PHRASES)} FROM lowq WHERE q <> ''),
    eps AS {_ENDPOINTS}, idx AS {_INDEX}, kws AS {_KEYWORDS},
    {sql.embedding('qe', 'qq', 'interaction_id', 'q', stopwords=True)}, {sql.embedding('xe', 'idx', stopwords=True)},
    dots AS (SELECT qe.id AS interaction_id, xe.id AS xid, sum(qe.v * xe.v) AS sim FROM qe JOIN xe USING (b) GROUP BY ALL),
    sims AS (SELECT a.interaction_id, i.position, i.kind, coalesce(d.sim, 0) AS sim FROM qq a CROSS JOIN idx i LEFT JOIN dots d ON d.interaction_id = a.interaction_id AND d.xid = i.id),
    dense AS (SELECT interaction_id, position, 0.30 * max(sim) FILTER (kind = 'primary') + 0.50 * max(sim) FILTER (kind = 'exemplar')
        + 0.20 * list_avg(list_slice(list(sim ORDER BY sim DESC) FILTER (kind = 'exemplar'), 1, 3)) AS dense FROM sims GROUP BY ALL),
    qw AS (SELECT interaction_id, list_filter(list_distinct(regexp_extract_all(q, {sql.WORDS})), lambda w: NOT list_contains({sql.strings(fixed.STOPWORDS)}, w)) AS ws FROM qq),
    ew AS (SELECT position, list_distinct(regexp_extract_all(lower(instructions), {sql.WORDS})) AS iw FROM eps),
    kw AS (SELECT a.interaction_id, k.position, count(*) AS n, string_agg(keyword, ',' ORDER BY keyword) AS matched FROM qq a JOIN kws k ON contains(a.q, k.keyword) GROUP BY ALL),
    raws AS (SELECT a.interaction_id, a.conv_id, e.position, e.endpoint, e.name, e.target, dense, coalesce(matched, '') AS matched, round(dense * 0.55 + least(0.5, coalesce(n, 0) * 0.15 + least(0.2, len(list_intersect(ws, iw)) * 0.05)) * 0.2 + {_INTENT} * 0.25, 6) AS raw
      FROM qq a CROSS JOIN eps e JOIN dense d ON d.interaction_id = a.interaction_id AND d.position = e.position JOIN qw ON qw.interaction_id = a.interaction_id JOIN ew ON ew.position = e.position
      LEFT JOIN kw ON kw.interaction_id = a.interaction_id AND kw.position = e.position),
    ranked AS (SELECT *, row_number() OVER w AS rank, first_value(raw) OVER w AS top FROM raws WINDOW w AS (PARTITION BY interaction_id ORDER BY raw DESC, position)),
    routed AS (SELECT *, round(CASE WHEN rank = 1 THEN least(0.98, greatest(0.88, 0.85 + top * 0.15)) ELSE greatest(0.12, least(0.55, 0.70 - (top - raw) * 1.5)) END, 4) AS score FROM ranked)"""


def ranked(spark: SparkSession, sf: str) -> DataFrame:
    return routing.with_ranking(asked(spark, sf), routing.default_endpoints(spark))


def ranking_rows(spark: SparkSession, sf: str) -> DataFrame:
    from wardlake.functions.rows import spread_structs

    return spread_structs(ranked(spark, sf), ["interaction_id"], "ranking")


@query("hybrid_route", f"WITH {ROUTED} SELECT interaction_id, endpoint, raw, round(dense, 4) AS similarity, matched FROM routed")
def hybrid_route(spark: SparkSession, sf: str) -> DataFrame:
    return ranking_rows(spark, sf).select(
        "interaction_id", "endpoint", "raw", "similarity", F.array_join(F.array_sort("matched_keywords"), ",").alias("matched")
    )


@query("route_calibrate", f"WITH {ROUTED} SELECT interaction_id, endpoint, rank::INTEGER AS rank, score, round(greatest(0, 1 - dense), 4) AS distance FROM routed")
def route_calibrate(spark: SparkSession, sf: str) -> DataFrame:
    return ranking_rows(spark, sf).select("interaction_id", "endpoint", "rank", "score", "distance")


REQUESTED = (None, "auto", "weather_service", "general-large", "https://models.example/v1", "unknown-model")


@query(
    "route_resolve",
    f"""WITH {ROUTED}, best AS (SELECT * FROM routed WHERE rank = 1), r AS (SELECT a.interaction_id, {pick_sql('a.conv_id', REQUESTED)} AS req, b.endpoint, b.target, b.score FROM asked a LEFT JOIN best b USING (interaction_id))
    SELECT interaction_id, CASE WHEN req = 'weather_service' THEN req WHEN req IN ('general-large', 'https://models.example/v1') THEN 'custom' ELSE endpoint END AS routed_endpoint,
      CASE WHEN req = 'weather_service' THEN '/weather_service/complete' WHEN req IN ('general-large', 'https://models.example/v1') THEN req ELSE coalesce(target, '{routing.DEFAULT_MODEL}') END AS routed_to,
      CASE WHEN req IN ('weather_service', 'general-large', 'https://models.example/v1') THEN 1.0 ELSE coalesce(score, 1.0) END::DOUBLE AS route_score,
      CASE WHEN req IN ('weather_service', 'general-large', 'https://models.example/v1') THEN 'explicit_selection' WHEN endpoint IS NOT NULL THEN 'ranked' ELSE 'default_fallback' END AS route_reason FROM r""",
)
def route_resolve(spark: SparkSession, sf: str) -> DataFrame:
    df = ranked(spark, sf).withColumn("requested", pick(F.col("conv_id"), REQUESTED))
    out = routing.resolve(df, routing.default_endpoints(spark))
    return out.select("interaction_id", "routed_endpoint", "routed_to", "route_score", "route_reason")


@query(
    "route_match_report",
    f"""WITH {ROUTED} SELECT interaction_id, max(name) FILTER (rank = 1) AS winner, string_agg(endpoint || '=' || printf('%.4f', score) || '[' || matched || ']', ' ' ORDER BY rank) AS report FROM routed GROUP BY interaction_id""",
)
def route_match_report(spark: SparkSession, sf: str) -> DataFrame:
    line = F.transform(
        F.filter("ranking", lambda e: e["active"]),
        lambda e: F.concat(
            e["endpoint"], F.lit("="), F.format_string("%.4f", e["score"]), F.lit("["), F.array_join(F.array_sort(e["matched_keywords"]), ","), F.lit("]")
        ),
    )
    return ranked(spark, sf).where(F.size("ranking") > 0).select(
        "interaction_id", F.col("ranking")[0]["name"].alias("winner"), F.array_join(line, " ").alias("report")
    )
