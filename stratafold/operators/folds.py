"""Exact stratified folds from a distributed global rank."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from stratafold.session import shuffle_width


def _bucket_digits(df: DataFrame) -> int:
    return max(1, math.ceil(math.log(4 * shuffle_width(df.sparkSession), 16)))


def _ranked(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Zero-based rank by (label, hash of the key), with each class's first rank and size.

    The leading hex digits of the hash are even, order-preserving buckets. The bucket table has
    at most (classes x buckets) rows; it is the only table that one task sorts and the only one
    that is broadcast.
    """
    digits = _bucket_digits(df)
    hashed = df.withColumn(
        "_hash", F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed))))
    ).withColumn("_bucket", F.substring("_hash", 1, digits))
    counts = hashed.groupBy(F.col(label).alias("_class"), F.col("_bucket").alias("_in")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    before = Window.orderBy("_class", "_in").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_class")
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(
        "_class",
        "_in",
        "_start",
        F.min("_start").over(whole).alias("_first"),
        F.sum("_n").over(whole).alias("_size"),
    )
    inside = Window.partitionBy(label, "_bucket").orderBy("_hash", key)
    return (
        hashed.withColumn("_local", F.row_number().over(inside) - 1)
        .join(
            F.broadcast(starts),
            F.col(label).eqNullSafe(F.col("_class")) & (F.col("_bucket") == F.col("_in")),
        )
        .withColumn("_rank", F.col("_start") + F.col("_local"))
    )


def stratified_folds(
    df: DataFrame, label: str, key: str, folds: int, seed: int = 42, name: str = "fold"
) -> DataFrame:
    """Add a fold number; fold sizes differ by at most one, in total and per class."""
    ranked = _ranked(df, label, key, seed)
    return ranked.select(*df.columns, F.pmod("_rank", F.lit(folds)).cast("int").alias(name))


def nested_folds(
    df: DataFrame,
    label: str,
    key: str,
    folds: int,
    inner_folds: int,
    seed: int = 42,
    name: str = "fold",
    inner_name: str = "inner_fold",
) -> DataFrame:
    """Add an outer and an inner fold from one rank, hence one shuffle of the rows.

    The inner number is the rank by (label, outer fold, hash) modulo ``inner_folds``. Outer folds
    deal the ranks of a class out in turn, so that rank follows from the class's first rank and
    size. It runs on across outer folds, so without any one of them the inner folds stay even.
    """
    ranked = _ranked(df, label, key, seed)
    rank, first, size = F.col("_rank"), F.col("_first"), F.col("_size")
    outer = F.pmod(rank, F.lit(folds))
    gap = F.pmod(outer - first, F.lit(folds))
    turn = F.floor((rank - first - gap) / folds)
    inner = F.pmod(first + _rows_in_earlier_folds(outer, first, size, folds) + turn, F.lit(inner_folds))
    return ranked.select(
        *df.columns, outer.cast("int").alias(name), inner.cast("int").alias(inner_name)
    )


def _rows_in_earlier_folds(outer: Column, first: Column, size: Column, folds: int) -> Column:
    """Rows of a class in the outer folds numbered below ``outer``.

    Every fold holds ``size // folds`` of them; the rest go to the folds from ``first`` onwards,
    wrapping round to fold 0.
    """
    rest = F.pmod(size, F.lit(folds))
    opening = F.pmod(first, F.lit(folds))
    wrapped = F.greatest(opening + rest - folds, F.lit(0))
    extra = F.least(outer, opening + rest) - F.least(outer, opening) + F.least(outer, wrapped)
    return outer * F.floor(size / folds) + extra
