"""Policy documents: a bare list of rules, or rules under ``policies`` or ``rules``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = (
    "struct<use_case:string,geography:string,check_name:string,check:string,"
    "block_threshold:double,flag_threshold:double,on_timeout:string>"
)


def rule_rows(documents: DataFrame, id_col: str, body: str = "body") -> DataFrame:
    """Rules of JSON policy documents with defaults filled in and a content version."""
    document = F.col(body)
    bare = F.from_json(document, f"array<{RULE}>")
    wrapped = F.from_json(document, f"struct<policies:array<{RULE}>,rules:array<{RULE}>>")
    df = documents.withColumn("_w", F.when(~F.ltrim(document).startswith("["), wrapped)).withColumn(
        "_b", F.when(F.ltrim(document).startswith("["), bare)
    )

    def filled(column: Column) -> Column:
        return F.when(F.size(F.coalesce(column, F.array().cast(f"array<{RULE}>"))) > 0, column)

    found = F.coalesce(F.col("_b"), filled(F.col("_w.policies")), filled(F.col("_w.rules")))
    return df.select(
        id_col, F.substring(F.sha2(document, 256), 1, 8).alias("version"), F.posexplode(found).alias("pos", "r")
    ).select(
        id_col,
        "version",
        "pos",
        F.coalesce("r.use_case", F.lit("*")).alias("use_case"),
        F.coalesce("r.geography", F.lit("*")).alias("geography"),
        F.coalesce(F.nullif("r.check_name", F.lit("")), "r.check", F.lit("")).alias("check_name"),
        F.coalesce("r.block_threshold", F.lit(0.7)).alias("block_threshold"),
        F.coalesce("r.flag_threshold", F.lit(0.4)).alias("flag_threshold"),
        F.when(F.col("r.on_timeout") == "block", "block").otherwise("allow_with_flag").alias("on_timeout"),
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON policy files, one document per row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("policy_file"), F.col("value").alias("body"))


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """A YAML policy file as rule rows; the file is read once on the driver."""
    import json

    import yaml

    with open(path, encoding="utf-8") as handle:
        document = yaml.safe_load(handle)
    body = json.dumps(document if isinstance(document, list) else {k: document[k] for k in ("policies", "rules") if k in document})
    return rule_rows(spark.createDataFrame([(path, body)], "policy_file string, body string"), "policy_file")


def listing(rules: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Rules for display: a readable id, and block or allow on timeout."""
    return rules.select(
        *(keep or []),
        F.concat_ws(":", "use_case", "geography", "check_name").alias("rule_id"),
        "use_case",
        "geography",
        "check_name",
        "block_threshold",
        "flag_threshold",
        F.when(F.col("on_timeout") == "block", "block").otherwise("allow").alias("on_timeout"),
    )
