"""Evaluation of scores against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake import fixed
from wardlake.functions.ordered import running_sum
from wardlake.sources.tables import stored


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def confusion(df: DataFrame, keys: list[str], score: str = "score", label: str = "label", threshold: Column | float = 0.5) -> DataFrame:
    """Confusion counts and derived measures per key."""
    cut = threshold if isinstance(threshold, Column) else F.lit(threshold)
    hit = F.col(score) >= cut
    pos = F.col(label) == 1
    counted = df.groupBy(*keys).agg(
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & ~pos).alias("tn"),
        F.count_if(~hit & pos).alias("fn"),
    )
    return with_measures(counted)


def with_measures(counted: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision = _share(tp, tp + fp)
    recall = _share(tp, tp + fn)
    return (
        counted.withColumn("accuracy", _share(tp + tn, tp + fp + tn + fn))
        .withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn("f1", _share(2 * tp, 2 * tp + fp + fn))
        .withColumn("false_positive_rate", _share(fp, fp + tn))
    )


def sweep(df: DataFrame, score: str = "score", label: str = "label", thresholds: tuple[float, ...] = fixed.SWEEP_THRESHOLDS) -> DataFrame:
    """Measures at each threshold, from one pass over the scores."""
    hit = lambda t: F.col(score) >= F.lit(t)
    pos = F.col(label) == 1
    counts = df.agg(
        *[F.count_if(hit(t) & pos).alias(f"tp{i}") for i, t in enumerate(thresholds)],
        *[F.count_if(hit(t) & ~pos).alias(f"fp{i}") for i, t in enumerate(thresholds)],
        F.count_if(pos).alias("pos"),
        F.count_if(~pos).alias("neg"),
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"),
                    (F.col("neg") - F.col(f"fp{i}")).alias("tn"), (F.col("pos") - F.col(f"tp{i}")).alias("fn"),
                )
                for i, t in enumerate(thresholds)
            ]
        )
    )
    return with_measures(counts.select(rows.alias("r")).select("r.*"))


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve by rank sums over the exact scores; 1.0 when a class is missing.

    Scores are counted per distinct value first; running counts go by chunks of the score, so no task
    meets all of them. The counts are read twice, so they are stored: the scores are computed once.
    """
    per_score = df.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    per_score = stored(per_score, "scores")
    wins = running_sum(per_score, [], F.floor(F.col("s") * 4096), [F.col("s")], F.col("n"), "below", before=True)
    total = wins.agg(
        F.sum(F.col("p") * (F.col("below") + F.col("n") * 0.5)).alias("won"), F.sum("p").alias("pos"), F.sum("n").alias("neg")
    )
    pairs = F.col("pos") * F.col("neg")
    return total.select("pos", "neg", F.when(pairs > 0, F.col("won") / pairs).otherwise(F.lit(1.0)).alias("roc_auc"))


def fold_summary(per_fold: DataFrame) -> DataFrame:
    """Mean and population deviation of each measure over folds."""
    return per_fold.agg(
        F.count(F.lit(1)).alias("n_folds"),
        *[
            column
            for m in ("accuracy", "precision", "recall", "f1")
            for column in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))
        ],
    )


def calibrate(raw: Column, floor: float = 0.80) -> Column:
    """Map a raw probability so that everything below the noise floor is close to 0."""
    return (
        F.when(raw <= 0, F.lit(0.0)).when(raw < floor, raw / floor * 0.02).otherwise(0.02 + (raw - floor) / (1.0 - floor) * 0.98)
    )
