"""Exact evaluation metrics as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from stratafold.operators.prefix import counts_below, value_cells
from stratafold.session import stage

LOSS_CLIP = 1e-15


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per group, ties counted half; null for a one-class group."""
    return areas(score_cells(df, score, label, by), score, by)


def fold_auc_summary(df: DataFrame, score: str, label: str, fold: str) -> DataFrame:
    """AUC of every fold and of all folds pooled (``Overall``), not the mean of the folds.

    Folds are named from 1 on, as readers count; their numbers start at 0.
    Pooled cells are a roll-up of the fold cells, so the rows are grouped once.
    """
    cells = score_cells(df, score, label, [fold])
    named = cells.select(
        F.concat(F.lit("Fold "), (F.col(fold) + 1).cast("string")).alias("label"), score, "_pos", "_neg"
    )
    pooled = cells.groupBy(score).agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    both = stage(named.unionByName(pooled.select(F.lit("Overall").alias("label"), score, "_pos", "_neg")))
    return areas(both, score, ["label"])


def fold_auc_range(summary: DataFrame) -> DataFrame:
    """One row from ``fold_auc_summary``: lowest, highest and mean AUC of the folds and how many there are."""
    folds = summary.where(F.col("label") != "Overall")
    return folds.agg(
        F.min("auc").alias("lowest"), F.max("auc").alias("highest"), F.avg("auc").alias("mean"), F.count("auc").alias("folds")
    )


def score_cells(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Staged: one row per group and distinct score with the number of labels 1 (``_pos``) and 0 (``_neg``)."""
    return stage(value_cells(df, score, {"_pos": F.col(label) == 1, "_neg": F.col(label) == 0}, by), "score-cells")


def areas(cells: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``roc_auc`` from stored ``score_cells``."""
    ranked = counts_below(cells, score, ["_neg"], by)
    pos = F.col("_pos").cast("double")
    wins = F.sum(pos * (F.col("_neg_below") + F.col("_neg") / 2))
    pairs = F.sum(pos) * F.sum(F.col("_neg").cast("double"))
    return ranked.groupBy(*by).agg(F.when(pairs > 0, wins / pairs).alias("auc"))


def log_loss(df: DataFrame, probability: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean negative log-likelihood; probabilities are clipped away from 0 and 1."""
    p = F.least(F.greatest(F.col(probability), F.lit(LOSS_CLIP)), F.lit(1 - LOSS_CLIP))
    y = F.col(label)
    return df.groupBy(*by).agg(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"))


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed; empty bins are kept.

    A constant column is widened by a half on both sides.
    """
    spark = df.sparkSession
    span = df.agg(F.min(value).cast("double").alias("_a"), F.max(value).cast("double").alias("_b"))
    edges = F.broadcast(
        span.select(
            F.when(F.col("_a") == F.col("_b"), F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_low"),
            F.when(F.col("_a") == F.col("_b"), F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_high"),
        )
    )
    place = F.floor((F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins)
    counts = (
        df.where(F.col(value).isNotNull())
        .crossJoin(edges)
        .groupBy(F.least(place, F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    width = (F.col("_high") - F.col("_low")) / bins
    return (
        spark.range(bins)
        .withColumnRenamed("id", "bin")
        .join(counts, "bin", "left")
        .crossJoin(edges)
        .select(
            "bin",
            (F.col("_low") + width * F.col("bin")).alias("low"),
            (F.col("_low") + width * (F.col("bin") + 1)).alias("high"),
            F.coalesce("_n", F.lit(0)).alias("n_rows"),
        )
    )


def top_scores(df: DataFrame, name: str, score: str, limit: int = 20) -> DataFrame:
    """The ``limit`` highest scores, ties by name; one placeholder row for an empty table."""
    spark = df.sparkSession
    best = df.select(name, F.col(score).cast("double").alias(score)).orderBy(F.desc(score), name).limit(limit)
    blank = spark.range(1).select(
        F.lit("no_feature_importance").alias("_blank_name"), F.lit(0.0).alias("_blank_score")
    )
    return blank.join(best, F.lit(True), "left").select(
        F.coalesce(name, "_blank_name").alias(name), F.coalesce(score, "_blank_score").alias(score)
    )
