"""Text classifiers with pyspark.ml: class weights, choice by validation F1, batch scoring."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.operators import datasets, metrics
from wardlake.session import shared_folder

FEATURES = 1 << 14


def counting(features: int = FEATURES) -> list[Transformer]:
    """Words and word pairs of ``text`` as hashed counts (``tf``); nothing is learned here."""
    return [
        RegexTokenizer(inputCol="text", outputCol="w", pattern=r"[^\p{L}\p{N}_]+", toLowercase=True),
        NGram(n=2, inputCol="w", outputCol="pairs"),
        HashingTF(inputCol="w", outputCol="tf1", numFeatures=features),
        HashingTF(inputCol="pairs", outputCol="tf2", numFeatures=features),
        VectorAssembler(inputCols=["tf1", "tf2"], outputCol="tf"),
    ]


def learning(reg: float) -> Pipeline:
    """What is fitted to the counts."""
    return Pipeline(
        stages=[
            IDF(inputCol="tf", outputCol="features", minDocFreq=2),
            LogisticRegression(
                featuresCol="features", labelCol="label", weightCol="weight", maxIter=15, regParam=reg, aggregationDepth=2
            ),
        ]
    )


def pipeline(reg: float, features: int = FEATURES) -> Pipeline:
    return Pipeline(stages=[*counting(features), *learning(reg).getStages()])


def counted(samples: DataFrame, features: int = FEATURES) -> DataFrame:
    """The samples with their counts instead of their text, written once: every fit and pass reads these."""
    rows = PipelineModel(counting(features)).transform(samples).select(*[c for c in samples.columns if c != "text"], "tf")
    path = shared_folder(samples.sparkSession, "counts")
    rows.write.parquet(path)
    return samples.sparkSession.read.schema(rows.schema).parquet(path)


def train(samples: DataFrame, regs: tuple[float, ...] = (0.01, 0.1)) -> tuple[PipelineModel, dict]:
    """Best model by F1 on the ``val`` split, with its metadata.

    Samples: text, label, split. Only one row of counts and one of measures per
    candidate reach the driver.
    """
    weight = datasets.class_weight(samples.where("split = 'train'")).first()["positive_weight"]
    weighted = counted(samples).withColumn("weight", F.when(F.col("label") == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))
    train_rows, val_rows = weighted.where("split = 'train'"), weighted.where("split = 'val'")
    best = None
    for reg in regs:
        model = learning(reg).fit(train_rows)
        f1 = metrics.confusion(score(model, val_rows), [], "probability_1").first()["f1"]
        if best is None or f1 > best[1]:
            best = (model, f1, reg)
    model, f1, reg = best
    return PipelineModel([*counting(), *model.stages]), {"val_f1": f1, "reg_param": reg, "positive_weight": weight}


def cross_validate(samples: DataFrame, reg: float = 0.01, parallelism: int = 2) -> DataFrame:
    """Measures of each fold by a model that was fitted without it (fold, tp, fp, ..., f1).

    Samples: text, label, fold. Words, document frequencies and class weights are learned anew for every fold from
    the other folds alone. Words are hashed, so the counts of a text are the same for every fold and are taken
    once. Folds are fitted side by side; one row per fold reaches the driver.
    """
    samples = counted(samples)
    numbers = sorted(r["fold"] for r in samples.select("fold").distinct().collect())

    def held_out(fold: int) -> DataFrame:
        rest = samples.where(F.col("fold") != fold)
        weight = datasets.class_weight(rest).first()["positive_weight"]
        weighted = rest.withColumn("weight", F.when(F.col("label") == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))
        return score(learning(reg).fit(weighted), samples.where(F.col("fold") == fold))

    with ThreadPool(parallelism) as pool:
        judged = pool.map(inheritable_thread_target(samples.sparkSession)(held_out), numbers)
    return metrics.confusion(reduce(DataFrame.unionByName, judged), ["fold"], "probability_1")


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``probability_1``: the model's probability of class 1."""
    keep = [c for c in df.columns]
    return model.transform(df).select(*keep, vector_to_array("probability")[1].alias("probability_1"))
