"""Registered queries of the operators in this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import chat_format, fingerprints, jaccard_join, k2_treap, packing, periodic_runs, posting_lists, secret_scan, token_counts, token_files, topk, toxicity, unigram_codec
from wardlake.plans.catalog import query
from wardlake.sources.tables import table


def fold(doc_id: Column) -> Column:
    """The remainder that tells rows for fitting from held-out ones; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id")) != 2)
    held_out = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    return toxicity.with_toxicity(docs, model).select("doc_id", held_out, "score", "predicted")


@query("op6_secret_scans")
def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.with_secrets(docs).drop("text")


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(docs))


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.read(token_files.write(docs))


@query("op8_exact_topk")
def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op9_chat_format")
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    back = chat_format.read_back(chat_format.conversations(chat_format.chains(rows), None))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    conv_id = F.when(F.col("tree") != "none", F.col("tree")).cast("long").alias("conv_id")
    return back.select(
        conv_id, F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op1_iblt_fingerprints")
def op1_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.with_next(table(spark, sf_dir, "documents"), digest="digests").withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    # Taken here, so that no step after the digests carries the texts on.
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    found = fingerprints.compared(rows, "text", {"edited": "edited", "next": "next_text"}, {"self": "digests", "next": "next_digests"})
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("op10_unigram_codec")
def op10_unigram_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = unigram_codec.round_trip(docs)
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), (F.col("decoded") == F.replace("text", F.lit("▁"), F.lit(" "))).alias("round_trip"),
    )


@query("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = jaccard_join.Rule(words=3, num=90, den=100)
    return jaccard_join.join_components(table(spark, sf_dir, "documents"), rule).select("doc_id", "n_shingles", "component_id")


@query("op11_posting_lists")
def op11_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query(
    "op12_k2_treap",
    """
with words as (
  select doc_id, row_number() over () as row_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
  from documents),
sizes as (select row_id, count(*) as n from words group by row_id),
totals as (select count(*) as n_docs, sum(n)::bigint as n_terms from sizes),
cells as (select any_value(doc_id) as doc_id, row_id, term, count(*) as tf from words group by row_id, term),
weights as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::bigint as w from cells, totals group by term),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term
  from benchmark),
scored as (
  select item_id, any_value(doc_id) as doc_id, row_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::bigint as score
  from asked join cells using (term) join weights using (term) join sizes using (row_id), totals group by item_id, row_id),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50
""",
)
def op12_k2_treap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k2_treap.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def rewritten(doc_id: Column, text: Column) -> Column:
    """The text of op13: of about every tenth document, chosen by the checksum of its id, the words from some place on repeat."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        word = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p)))
        return F.when(n == 0, text).otherwise(F.array_join(word, " "))

    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")
    return F.when(h % 10 == 0, fingerprints.let(words, repeated)).otherwise(text)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", rewritten(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.with_runs(docs)
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(0))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("_most", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_most.s").alias("start"), (-F.col("_most.l")).alias("length"), F.col("_most.p").alias("period"),
        F.floor(-1000 * F.col("_most.l") / F.col("_most.p")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
