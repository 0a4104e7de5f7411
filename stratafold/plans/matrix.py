"""The feature matrix: population, row and key features of the training and test tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stratafold.functions import as_feature
from stratafold.operators import population as pop
from stratafold.operators import rowwise as row
from stratafold.operators.clean import impute_medians
from stratafold.operators.lookup import lookup_join
from stratafold.schema import CATEGORICAL, LABEL, NUMERIC, UNSEEN_RATE, MatrixColumns

_TOTAL = "TotalCharges"
_SOURCE = "_source"
# Output name and group column of the ranks within a reference group.
_GROUP_RANKS = {"cond_pctrank_IS_TC": "InternetService", "cond_pctrank_C_TC": "Contract"}


def matrix_columns() -> MatrixColumns:
    """Keys to encode: the number keys, the categories and the n-grams."""
    base = [f"CAT_{c}" for c in NUMERIC] + CATEGORICAL
    return MatrixColumns(base, list(row.all_ngram_groups()))


@dataclass(frozen=True)
class Population:
    """Everything the matrix takes from other rows; small scalars and lookup tables."""

    reference: DataFrame
    categories: pop.CategoryProfile
    values: dict[str, pop.ValueProfile]
    groups: dict[str, list[str] | None]
    scalars: dict[str, float | None]


def fit_population(train: DataFrame, test: DataFrame, reference: DataFrame, label: str) -> Population:
    """Aggregate the three tables (``TotalCharges`` imputed) into a :class:`Population`."""
    categories = pop.category_profile(reference, CATEGORICAL, label, means=["MonthlyCharges"])
    groups = {
        column: categories.values(column)
        if categories.on_driver(column) and categories.size(column) <= pop.COUNTED_GROUPS
        else None
        for column in _GROUP_RANKS.values()
    }
    pooled = _pool(train, test, reference, label)
    inside = F.col("_reference")
    positive, negative = inside & (F.col("_label") == 1), inside & (F.col("_label") == 0)
    shared = {
        "all": F.lit(True),
        "labelled": inside & F.col("_label").isNotNull(),
        "positive": positive,
    }
    ranked: dict[str, Column] = {"ch": positive, "nc": negative, "orig": inside}
    for column, found in groups.items():
        for place, value in enumerate(found or []):
            ranked[f"{column}_{place}"] = inside & (F.col(column) == value)
    values = pop.value_profiles(pooled, NUMERIC, shared | ranked, {_TOTAL: list(ranked)})
    quartiles = pop.reference_quantiles(values[_TOTAL], {"ch": "ch", "nc": "nc"})
    scalars = quartiles.crossJoin(pop.class_moments(reference, _TOTAL, label)).first().asDict()
    return Population(reference, categories, values, groups, scalars)


def _pool(train: DataFrame, test: DataFrame, reference: DataFrame, label: str) -> DataFrame:
    """The numbers of all rows, and the label and groups of the reference rows."""
    groups = list(_GROUP_RANKS.values())
    numbers = [F.col(c).cast("double").alias(c) for c in NUMERIC]
    inside = reference.select(
        *numbers,
        F.lit(True).alias("_reference"),
        F.col(label).alias("_label"),
        *[pop.lookup_text(reference, c).alias(c) for c in groups],
    )
    outside = train.select(*numbers).unionByName(test.select(*numbers)).select(
        "*",
        F.lit(False).alias("_reference"),
        F.lit(None).cast("int").alias("_label"),
        *[F.lit(None).cast("string").alias(c) for c in groups],
    )
    return inside.unionByName(outside)


def add_population_features(
    df: DataFrame, fitted: Population, options: dict | None = None
) -> DataFrame:
    """Frequencies, reference rates, ranks, z-scores, residual and quartile distances."""
    options = {"population": df} | (options or {})
    for column in NUMERIC:
        df = _add_value_features(df, fitted, column, options)
    for name, group in _GROUP_RANKS.items():
        if fitted.groups[group] is None:
            df = pop.ecdf_against(df, fitted.reference, _TOTAL, {name: F.lit(True)}, group=group, **options)
    df = pop.reference_rates(df, fitted.categories, CATEGORICAL, **options)
    df = pop.group_residual(
        df, fitted.categories, "InternetService", "MonthlyCharges", "resid_IS_MC", **options
    )
    df = df.withColumn(
        "pctrank_churn_gap_TC", as_feature(F.col("pctrank_churner_TC") - F.col("pctrank_nonchurner_TC"))
    )
    df = pop.z_score_gap(df, _TOTAL, fitted.scalars)
    return pop.quantile_distances(df, _TOTAL, fitted.scalars)


def _add_value_features(df: DataFrame, fitted: Population, column: str, options: dict) -> DataFrame:
    """All features that depend on one number (and the row's group), from a single lookup."""
    profile = fitted.values[column]
    share = {f"FREQ_{column}": F.col("all") / F.lit(profile.totals["all"] or 1)}
    rate = {f"ORIG_proba_{column}": F.when(F.col("labelled") > 0, F.col("positive") / F.col("labelled"))}
    ranks: dict[str, Column] = {}
    per_group: dict[str, Column] = {}
    if column == _TOTAL:
        for name, counter in (("nonchurner", "nc"), ("churner", "ch"), ("orig", "orig")):
            ranks[f"pctrank_{name}_TC"] = profile.rank(counter)
        for name, group in _GROUP_RANKS.items():
            if fitted.groups[group]:
                per_group[name] = F.array(
                    [profile.rank(f"{group}_{place}") for place in range(len(fitted.groups[group]))]
                )
    looked_up = share | rate | ranks | per_group
    table = profile.table.select("value", *[c.alias(n) for n, c in looked_up.items()])
    numbers = 1 + len(share | rate | ranks) + sum(len(fitted.groups[_GROUP_RANKS[n]]) for n in per_group)
    size = profile.rows * (32 + 8 * numbers)
    joined = lookup_join(df, table, {"value": F.col(column).cast("double")}, size, **options)
    filled = {n: as_feature(F.coalesce(n, F.lit(0.0))) for n in (*share, *ranks)}
    filled |= {n: as_feature(F.coalesce(n, F.lit(UNSEEN_RATE))) for n in rate}
    for name, group in _GROUP_RANKS.items():
        if column == _TOTAL and fitted.groups[group] is not None:
            own = F.lit(0.0)
            for place, value in enumerate(fitted.groups[group]):
                held = pop.lookup_text(df, group) == value
                own = F.when(held, F.get(F.col(name), F.lit(place))).otherwise(own)
            filled[name] = as_feature(own)
    return joined.withColumns(filled)


def add_row_features(df: DataFrame) -> DataFrame:
    """Features that depend on the row alone, and its keys."""
    wide = row.service_features(row.ratio_features(df))
    for plan in (row.TENURE_DIGITS, row.MONTHLY_DIGITS, row.TOTAL_DIGITS):
        wide = row.digit_features(wide, plan)
    wide = row.numeric_keys(row.per_tenure_features(wide))
    return row.ngram_keys(wide, row.all_ngram_groups())


def build_feature_matrices(
    train: DataFrame,
    test: DataFrame,
    reference: DataFrame,
    label: str = LABEL,
    options: dict | None = None,
) -> tuple[DataFrame, DataFrame, MatrixColumns]:
    """Add all features to the training and the test table.

    Labels are 0/1 codes. ``options`` are passed to every lookup join (broadcast limit, spread
    column). The tables are read several times; pass stored tables. Both outputs share one plan;
    the filter on the source reaches the scans, so each reads its own table only.
    """
    filled = impute_medians({"train": train, "test": test, "reference": reference}, _TOTAL)
    fitted = fit_population(filled["train"], filled["test"], filled["reference"], label)
    return (*population_matrices(filled["train"], filled["test"], fitted, options), matrix_columns())


def population_matrices(train: DataFrame, test: DataFrame, fitted: Population, options: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Both matrices from imputed tables and a fitted population."""
    both = train.withColumn(_SOURCE, F.lit("train")).unionByName(
        test.withColumn(_SOURCE, F.lit("test")), allowMissingColumns=True
    )
    wide = add_row_features(add_population_features(both, fitted, options))
    train_only = [c for c in train.columns if c not in test.columns]
    train_features = wide.where(F.col(_SOURCE) == "train").drop(_SOURCE)
    return train_features, wide.where(F.col(_SOURCE) == "test").drop(_SOURCE, *train_only)
