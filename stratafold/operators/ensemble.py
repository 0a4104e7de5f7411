"""Combining the predictions of several folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union of tables with the same columns."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def coverage(oof: DataFrame, key: str) -> DataFrame:
    """One row: predictions, and keys predicted more than once (0 for a valid union)."""
    seen = oof.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return seen.agg(
        F.sum("_n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("_n") > 1).alias("n_repeated"),
    )


def ensemble_mean(predictions: DataFrame, key: str, prediction: str, name: str) -> DataFrame:
    """Mean prediction per key over all folds, in single precision."""
    return predictions.groupBy(key).agg(F.avg(prediction).cast("float").alias(name))
