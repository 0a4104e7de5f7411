"""Features that place a row within a reference population."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stratafold.functions import as_feature
from stratafold.operators.keyed import KeyedNumbers, lookup_text, unpivoted
from stratafold.operators.lookup import lookup_join
from stratafold.operators.prefix import bounds_of, counts_below, quantile_at, value_cells
from stratafold.schema import UNSEEN_RATE
from stratafold.session import stage

QUARTILES = {"q25": 0.25, "q50": 0.50, "q75": 0.75}
# A group column with at most this many values gets one counter per value in a shared pass.
COUNTED_GROUPS = 64


def stack_values(tables: Sequence[DataFrame], column: str) -> DataFrame:
    """Bag union of one column of several tables."""
    stacked = tables[0].select(column)
    for table in tables[1:]:
        stacked = stacked.unionByName(table.select(column))
    return stacked


def frequencies(tables: Sequence[DataFrame], column: str) -> DataFrame:
    """Share of every value among the non-missing values of all tables."""
    counts = (
        stack_values(tables, column)
        .select(F.col(column).cast("double").alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select("value", (F.col("n") / F.col("_total")).alias("share"))


def frequency_encode(df: DataFrame, tables: Sequence[DataFrame], column: str, **options) -> DataFrame:
    """Add ``FREQ_<column>``; a value that no table holds gets 0."""
    name = f"FREQ_{column}"
    table = stage(frequencies(tables, column)).withColumnRenamed("share", name)
    joined = lookup_join(df, table, {"value": F.col(column).cast("double")}, **options)
    return joined.withColumn(name, as_feature(F.coalesce(name, F.lit(0.0))))


def value_shares(df: DataFrame, profile: ValueProfile, counter: str = "all", **options) -> DataFrame:
    """Add ``FREQ_<column>`` from a counter of a value profile; a value without a count gets 0."""
    share = F.col(counter) / F.lit(profile.totals[counter] or 1)
    return _from_values(df, profile, f"FREQ_{profile.column}", share, 0.0, options)


def value_rates(df: DataFrame, profile: ValueProfile, positive: str, labelled: str, **options) -> DataFrame:
    """Add ``ORIG_proba_<column>`` from two counters of a value profile."""
    rate = F.when(F.col(labelled) > 0, F.col(positive) / F.col(labelled))
    return _from_values(df, profile, f"ORIG_proba_{profile.column}", rate, UNSEEN_RATE, options)


def _from_values(df: DataFrame, profile: ValueProfile, name: str, number: Column, missing: float, options: dict) -> DataFrame:
    table = profile.table.select("value", number.alias(name))
    joined = lookup_join(df, table, {"value": F.col(profile.column).cast("double")}, 48 * profile.rows, **({"population": df} | options))
    return joined.withColumn(name, as_feature(F.coalesce(name, F.lit(missing))))


@dataclass(frozen=True)
class CategoryProfile:
    """Per value of the reference population's columns: means, the label's first."""

    numbers: KeyedNumbers
    means: list[str]

    def size(self, column: str) -> int:
        return self.numbers.sizes.get(column, 0)

    def on_driver(self, column: str) -> bool:
        """Whether the column's values are few and short enough to be held on the driver."""
        return column in self.numbers.small

    def values(self, column: str) -> list[str]:
        """All values of a column that is held on the driver; any other column is an error."""
        return sorted(self.numbers.small[column])


def category_profile(
    reference: DataFrame, columns: Sequence[str], label: str, means: Sequence[str] = ()
) -> CategoryProfile:
    """One grouping pass for all columns; missing values form no group."""
    averaged = [label, *means]
    table = (
        unpivoted(reference, columns, [F.col(c).alias(f"_mean_{c}") for c in averaged])
        .groupBy("column", "value")
        .agg(F.array(*[F.avg(f"_mean_{c}") for c in averaged]).alias("numbers"))
    )
    return CategoryProfile(KeyedNumbers.of(table), averaged)


def reference_rates(
    df: DataFrame, profile: CategoryProfile, columns: Sequence[str], **options
) -> DataFrame:
    """Add ``ORIG_proba_<column>``: the label mean of the value in the reference population."""
    found = profile.numbers.find(df, columns, **options)
    rates = {c: F.get(F.col(f"_found_{c}"), F.lit(0)) for c in columns}
    return found.withColumns(
        {f"ORIG_proba_{c}": as_feature(F.coalesce(rate, F.lit(UNSEEN_RATE))) for c, rate in rates.items()}
    ).drop(*[f"_found_{c}" for c in columns])


def group_residual(
    df: DataFrame, profile: CategoryProfile, group: str, value: str, name: str, **options
) -> DataFrame:
    """Add the distance of ``value`` to its mean in the row's reference group (0 if unseen)."""
    found = profile.numbers.find(df, [group], **options)
    mean = F.get(F.col(f"_found_{group}"), F.lit(profile.means.index(value)))
    residual = F.col(value) - F.coalesce(mean, F.lit(0.0))
    return found.withColumn(name, as_feature(residual)).drop(f"_found_{group}")


@dataclass(frozen=True)
class ValueProfile:
    """Distinct values of a column with counts of the rows at and below them.

    ``totals`` holds every counter's sum, ``rows`` the number of distinct values.
    """

    column: str
    table: DataFrame
    totals: dict[str, int]
    rows: int

    def rank(self, counter: str) -> Column:
        """Share of the counted rows that lie strictly below the value; 0 if there are none."""
        total = self.totals[counter]
        return F.col(f"{counter}_below") / F.lit(total) if total else F.lit(0.0)


def value_profiles(
    population: DataFrame, columns: Sequence[str], counters: Mapping[str, Column], ranked: Mapping[str, Sequence[str]]
) -> dict[str, ValueProfile]:
    """Count all conditions per distinct value of every column in one pass.

    ``ranked`` names, per column, the counters to rank. One driver action returns the totals, the
    numbers of distinct values and the bucket bounds.
    """
    flags = [condition.alias(f"_is_{name}") for name, condition in counters.items()]
    numbers = [F.col(c).cast("double").alias(c) for c in columns]
    long = population.select(*flags, *numbers).unpivot(
        [f"_is_{name}" for name in counters], list(columns), "column", "value"
    )
    cells = stage(value_cells(long, "value", {n: F.col(f"_is_{n}") for n in counters}, ["column"]), "values")
    wanted = [F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(c) for c in counters]]
    bounds = bounds_of("value", cells.sparkSession).alias("_bounds")
    found = {row["column"]: row for row in cells.groupBy("column").agg(*wanted, bounds).collect()}
    profiles = {}
    for column in columns:
        table = cells.where(F.col("column") == column).drop("column")
        row = found.get(column)
        totals = {c: int(row[c]) if row else 0 for c in counters}
        if ranked.get(column):
            cuts = sorted(set(row["_bounds"])) if row else []
            table = stage(counts_below(table, "value", list(ranked[column]), bounds=cuts), "ranks")
        profiles[column] = ValueProfile(column, table, totals, int(row["_rows"]) if row else 0)
    return profiles


def reference_quantiles(profile: ValueProfile, counters: Mapping[str, str]) -> DataFrame:
    """One row of exact quartiles, ``<name>_<quartile>``, for each named ranked counter."""
    return profile.table.agg(
        *[
            quantile_at("value", counter, F.lit(profile.totals[counter]), share).alias(f"{name}_{q}")
            for name, counter in counters.items()
            for q, share in QUARTILES.items()
        ]
    )


def quantile_distances(df: DataFrame, column: str, quantiles: Mapping[str, float | None]) -> DataFrame:
    """Distances to the class quartiles (``ch_*``, ``nc_*``) and the gap between the two."""
    near: dict[str, Column] = {}
    gaps: dict[str, Column] = {}
    for q in QUARTILES:
        for name in ("ch", "nc"):
            near[f"dist_To_{name}_{q}"] = as_feature(
                F.abs(F.col(column) - F.lit(quantiles[f"{name}_{q}"]).cast("double"))
            )
        gaps[f"qdist_gap_To_{q}"] = as_feature(F.col(f"dist_To_nc_{q}") - F.col(f"dist_To_ch_{q}"))
    return df.withColumns(near).withColumns(gaps)


def class_moments(reference: DataFrame, column: str, label: str) -> DataFrame:
    """One row: mean and population deviation of ``column`` in both classes."""
    groups = {"ch": F.col(label) == 1, "nc": F.col(label) == 0}
    return reference.agg(
        *[
            f(F.when(test, F.col(column))).alias(f"{name}_{stat}")
            for name, test in groups.items()
            for stat, f in (("mean", F.avg), ("std", F.stddev_pop))
        ]
    )


def z_score(value: Column, mean: float | None, deviation: float | None) -> Column:
    """Distance to ``mean`` in deviations; 0 where the sample does not vary."""
    if deviation == 0:
        return as_feature(F.lit(0.0))
    scale = F.lit(deviation).cast("double")
    return as_feature((value - F.lit(mean).cast("double")) / scale)


def z_score_gap(df: DataFrame, column: str, moments: Mapping[str, float | None]) -> DataFrame:
    """Z-score against the negative class, and how much farther the positive class is."""
    score = {n: z_score(F.col(column), moments[f"{n}_mean"], moments[f"{n}_std"]) for n in ("ch", "nc")}
    return df.withColumns(
        {
            "zscore_churn_gap_TC": as_feature(F.abs(score["ch"]) - F.abs(score["nc"])),
            "zscore_nonchurner_TC": score["nc"],
        }
    )


def ecdf_against(
    df: DataFrame,
    reference: DataFrame,
    column: str,
    subsets: Mapping[str, Column],
    group: str | None = None,
    **options,
) -> DataFrame:
    """Add, per named subset of the reference, the share of it strictly below the row's value.

    With ``group``, only reference rows of the row's group count; a group that the reference
    lacks, a missing value and an empty subset give 0. Probe values join the cells with zero
    counts, so ranks come back by an equi-join instead of a range join.
    """
    by = ["_group"] if group else []

    def narrow(table: DataFrame, inside: bool) -> DataFrame:
        flags = [
            (F.coalesce(test, F.lit(False)) if inside else F.lit(False)).alias(f"_in_{name}")
            for name, test in subsets.items()
        ]
        keys = [lookup_text(table, group).alias("_group")] if group else []
        return table.select(*keys, F.col(column).cast("double").alias("value"), *flags)

    pooled = narrow(reference, True).unionByName(narrow(df, False))
    names = list(subsets)
    cells = stage(value_cells(pooled, "value", {n: F.col(f"_in_{n}") for n in names}, by))
    ranked = counts_below(cells, "value", names, by)
    table = ranked.select(
        *by,
        "value",
        *[
            F.when(F.col(f"{n}_total") > 0, F.col(f"{n}_below") / F.col(f"{n}_total"))
            .otherwise(0.0)
            .alias(n)
            for n in names
        ],
    )
    keys = {"value": F.col(column).cast("double")}
    if group:
        keys["_group"] = lookup_text(df, group)
    joined = lookup_join(df, stage(table, "ranks"), keys, **options)
    return joined.withColumns({n: as_feature(F.coalesce(n, F.lit(0.0))) for n in names})
