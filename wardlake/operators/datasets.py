"""Labelled dataset preparation: sources, cleaning, hold-out, balance, splits.

Random choices are ranks of a seeded digest, so they repeat on any cluster.
Ranks are found in chunks of the digest; a class is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.functions import ordered, text
from wardlake.functions.rows import settle

LENGTHS = {"general": (5, 2000), "jailbreak": (10, 2500), "toxicity": (4, 1000)}


def union_sources(*sources: tuple[DataFrame, str, Column, Column, Column]) -> DataFrame:
    """Corpora with differing columns as (sample_id, text, label, source)."""
    out = None
    for df, name, sample_id, body, label in sources:
        part = df.select(
            F.concat(F.lit(f"{name}:"), sample_id.cast("string")).alias("sample_id"),
            body.alias("text"),
            label.cast("int").alias("label"),
            F.lit(name).alias("source"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def clean(samples: DataFrame) -> DataFrame:
    return settle(samples.withColumn("text", text.clean_text(F.col("text"))))


def any_label(*flags: Column) -> Column:
    return F.when(F.greatest(*[F.coalesce(f.cast("int"), F.lit(0)) for f in flags]) > 0, 1).otherwise(0)


def string_label(raw: Column) -> Column:
    return F.when(F.lower(raw).isin(*fixed.TRUE_LABEL_STRINGS), 1).otherwise(0)


def length_filter(samples: DataFrame, bounds: tuple[int, int]) -> DataFrame:
    return samples.where(F.length("text").between(*bounds))


def with_digest(samples: DataFrame) -> DataFrame:
    return samples.withColumn("digest", F.md5("text"))


def dedupe(samples: DataFrame) -> DataFrame:
    """One row per (text, label): the smallest id stays. Only digests and ids are shuffled for the choice."""
    keep = samples.select("digest", "label", "sample_id").groupBy("digest", "label").agg(F.min("sample_id").alias("sample_id"))
    return samples.join(keep.select("sample_id"), "sample_id", "left_semi")


def dedupe_index(samples: DataFrame) -> DataFrame:
    """The same choice for samples without their texts: one aggregate, no join back."""
    first = F.min(F.struct("sample_id", "source")).alias("s")
    return samples.groupBy("digest", "label").agg(first).select("s.sample_id", "label", "s.source", "digest")


def exclude(samples: DataFrame, holdout: DataFrame) -> DataFrame:
    """Samples whose text is not in the hold-out set."""
    held = with_digest(clean(holdout.select("text"))).select("digest").distinct()
    return samples.join(held, "digest", "left_anti")


def _draw(seed: int, salt: str = "") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}{salt}:"), F.col("digest"), F.lit(":"), F.col("sample_id")))


def ranked(samples: DataFrame, seed: int, salt: str = "", keys: tuple[str, ...] = ("label",)) -> DataFrame:
    """Add ``rank``: position of each sample in its class's seeded order."""
    return ordered.running_count(
        samples.withColumn("draw", _draw(seed, salt)),
        list(keys),
        ordered.digest_chunk(F.col("draw")),
        [F.col("draw"), F.col("sample_id")],
        "rank",
    ).drop("draw")


def class_sizes(samples: DataFrame) -> DataFrame:
    return samples.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def balance(samples: DataFrame, seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smaller one; with one class empty, at most max(size, 10) stay."""
    sizes = samples.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    target = F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.least("pos", "neg")).otherwise(F.greatest("pos", "neg", F.lit(10)))
    limit = sizes.select(target.alias("_limit"), F.lit(1).alias("_k"))
    return (
        ranked(samples, seed)
        .withColumn("_k", F.lit(1))
        .join(F.broadcast(limit), "_k")
        .where("rank <= _limit")
        .drop("_k", "_limit", "rank")
    )


def split(samples: DataFrame, seed: int = 42, holdout_share: float = 0.15, three_way: bool = False) -> DataFrame:
    """Stratified split: the first share of each class is held out; three-way splits the rest again."""
    sizes = F.broadcast(class_sizes(samples))
    placed = ranked(samples, seed, "split").join(sizes, "label")
    held = F.round(F.col("n") * holdout_share)
    rest = F.col("n") - held
    second = F.round(rest * holdout_share)
    name = (
        F.when(F.col("rank") <= held, "test").when(F.col("rank") <= held + second, "val").otherwise("train")
        if three_way
        else F.when(F.col("rank") <= held, "val").otherwise("train")
    )
    return placed.withColumn("split", name).drop("rank", "n")


def folds(samples: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    return ranked(samples, seed, "fold").withColumn("fold", (F.col("rank") % k).cast("int")).drop("rank")


def manifest(samples: DataFrame, task: str) -> DataFrame:
    return samples.groupBy("split").agg(
        F.lit(task).alias("task"),
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(F.col("label") == 1).alias("n_positive"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
    )


# Our own polite phrases in several languages for the safe class.
CURATED_SAFE = (
    "Guten Tag, danke für die Auskunft.",
    "Vielen Dank und einen schönen Abend.",
    "Bonjour, merci pour votre réponse.",
    "Bonne journée et merci encore.",
    "Hola, gracias por la ayuda.",
    "Muchas gracias, hasta luego.",
    "Ciao, grazie per il supporto.",
    "Namaste, shukriya for the help.",
)


def add_curated(samples: DataFrame) -> DataFrame:
    spark = samples.sparkSession
    phrases = spark.createDataFrame([(f"curated:{i}", t) for i, t in enumerate(CURATED_SAFE)], "sample_id string, text string")
    rows = with_digest(clean(phrases)).select("sample_id", "text", F.lit(0).alias("label"), F.lit("curated").alias("source"), "digest")
    return dedupe(samples.unionByName(rows.select(*samples.columns)))


def class_weight(samples: DataFrame) -> DataFrame:
    return samples.agg(
        F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg")
    ).withColumn("positive_weight", F.greatest("n_neg", F.lit(1)) / F.greatest("n_pos", F.lit(1)))
