"""Exact counts below a value, without a window over the whole table.

Rows are first reduced to distinct values, so a value held by a third of all rows is one cell.
Cells go to ordered buckets with frozen bounds; a bucket's start is the sum of the buckets
before it. Only the per-bucket totals pass through one task, and their number follows the
session's shuffle width, not the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stratafold.session import shuffle_width, stage

#: Column that holds the bucket of a value.
BUCKET = "_bucket"


def value_cells(
    df: DataFrame, value: str, counters: Mapping[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """One row per distinct non-null ``(by, value)`` with a count per named condition."""
    present = F.col(value).isNotNull()
    for name in by:
        present = present & F.col(name).isNotNull()
    counts = [F.count_if(condition).alias(name) for name, condition in counters.items()]
    return df.where(present).groupBy(*by, value).agg(*counts)


def bounds_of(value: str, spark: SparkSession) -> Column:
    """Aggregate over cells for the bounds of even buckets; the number follows the session."""
    width = 4 * shuffle_width(spark)
    shares = [step / width for step in range(1, width)]
    return F.percentile_approx(F.col(value).cast("double"), shares, F.lit(4 * width))


def bucketed(cells: DataFrame, value: str, bounds: Sequence[float]) -> DataFrame:
    """Add the bucket of every value; ``bounds`` rise strictly."""
    inner = [bound for bound in bounds if abs(bound) != float("inf")]
    if not inner:
        return cells.withColumn(BUCKET, F.lit(0.0))
    probe = "_bucket_input"
    splits = [float("-inf"), *inner, float("inf")]
    cut = Bucketizer(splits=splits, inputCol=probe, outputCol=BUCKET)
    return cut.transform(cells.withColumn(probe, F.col(value).cast("double"))).drop(probe)


def counts_below(
    cells: DataFrame,
    value: str,
    counters: Sequence[str],
    by: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Add ``<counter>_below``, the strictly-less sum of each counter within ``by``, and
    ``<counter>_total``, its whole sum there. Both come with the bucket's start, in one join by group
    and bucket: no row is ever shuffled by the group alone.

    ``cells`` is read by several jobs; pass a kept or staged table.
    """
    if bounds is None:
        bounds = sorted(set(cells.agg(bounds_of(value, cells.sparkSession)).first()[0] or []))
    placed = bucketed(cells, value, bounds)
    place = [*by, BUCKET]
    before = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*place).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*place).agg(*[F.sum(c).alias(c) for c in counters])
    whole = Window.partitionBy(*by)
    starts = totals.select(
        *place,
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_start_{c}") for c in counters],
        *[F.sum(c).over(whole).alias(f"{c}_total") for c in counters],
    )
    running = placed.select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_run_{c}") for c in counters]
    )
    return running.join(starts, place).select(
        *cells.columns,
        *[(F.col(f"_start_{c}") + F.col(f"_run_{c}")).alias(f"{c}_below") for c in counters],
        *[F.col(f"{c}_total") for c in counters],
    )


def quantile_at(value: str, counter: str, total: Column, share: float) -> Column:
    """Aggregate for the linearly interpolated quantile of a counter over ranked cells."""
    position = (total - 1) * F.lit(float(share))
    low, high = F.floor(position), F.ceil(position)
    below, through = F.col(f"{counter}_below"), F.col(f"{counter}_below") + F.col(counter)

    def holder(index: Column) -> Column:
        return F.max(F.when((below <= index) & (index < through), F.col(value).cast("double")))

    left, right = holder(low), holder(high)
    return left + (right - left) * F.max(position - low)


def exact_quantiles(
    df: DataFrame, value: str, shares: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact interpolated quantiles per group; no group is gathered in one task."""
    cells = stage(value_cells(df, value, {"n": F.lit(True)}, by))
    ranked = counts_below(cells, value, ["n"], by)
    return ranked.groupBy(*by).agg(
        *[quantile_at(value, "n", F.col("n_total"), q).alias(name) for name, q in shares.items()]
    )
