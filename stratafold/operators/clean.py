"""Label and number cleaning, imputation and table profiles."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from stratafold.functions import label_code, parse_number
from stratafold.operators.prefix import exact_quantiles


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Raise if the schema lacks a column."""
    lacking = [name for name in names if name not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")


def map_label(df: DataFrame, label: str) -> DataFrame:
    """Replace the label text by its 0/1 code."""
    return df.withColumn(label, label_code(F.col(label)))


def unmapped_labels(df: DataFrame, label: str) -> DataFrame:
    """One row: how many labels have no code."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(label).isNull()).alias("n_unmapped")
    )


def require_labels(df: DataFrame, label: str) -> None:
    """Raise if a label has no code."""
    bad = unmapped_labels(df, label).first()["n_unmapped"]
    if bad:
        raise ValueError(f"{bad} rows have no valid {label}")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def number(df: DataFrame, name: str) -> Column:
    """A column as double: numeric columns are cast, text is parsed; NaN is missing."""
    if is_numeric(df, name):
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)
    return parse_number(F.col(name))


def impute_median(df: DataFrame, column: str) -> DataFrame:
    """Parse ``column`` and fill its gaps with the exact median of this table."""
    parsed = df.withColumn(column, number(df, column))
    middle = exact_quantiles(parsed.select(column), column, {"_median": 0.5})
    return (
        parsed.crossJoin(F.broadcast(middle))
        .withColumn(column, F.coalesce(column, "_median"))
        .drop("_median")
    )


def medians(tables: dict[str, DataFrame], column: str) -> dict[str, float | None]:
    """Exact median of ``column`` in each table, in one ranking pass; None for a table without a number."""
    stacked = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("_table"), number(df, column).alias(column))
        stacked = part if stacked is None else stacked.unionByName(part)
    found = exact_quantiles(stacked, column, {"_median": 0.5}, by=["_table"]).collect()
    return dict.fromkeys(tables) | {row["_table"]: row["_median"] for row in found}


def imputed(df: DataFrame, column: str, middle: float | None) -> DataFrame:
    """Parse ``column`` and fill its gaps with a number."""
    return df.withColumn(column, F.coalesce(number(df, column), F.lit(middle).cast("double")))


def impute_medians(tables: dict[str, DataFrame], column: str) -> dict[str, DataFrame]:
    """``impute_median`` of several tables, each with its own median, in one ranking pass."""
    found = medians(tables, column)
    return {name: imputed(df, column, found[name]) for name, df in tables.items()}


def fill_constants(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    """Replace nulls by one constant per column."""
    return df.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in fills.items()})


def class_profile(df: DataFrame, label: str) -> DataFrame:
    """Rows and share of every class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg(F.sum("n_rows").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(
        label, "n_rows", (F.col("n_rows") / F.col("_total")).alias("share")
    )


def table_shape(df: DataFrame, name: str) -> DataFrame:
    """One row: table name, row count and column count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns")
    )


def schema_profile(df: DataFrame) -> DataFrame:
    """Per column: whether it is text (categorical) or numeric, and its distinct values.

    Distinct values are counted per (column, value) pair with map-side combining, so no task
    holds all values of a column.
    """
    kinds = {f.name: "numeric" if is_numeric(df, f.name) else "categorical" for f in df.schema.fields}
    long = df.select([F.col(c).cast("string").alias(c) for c in df.columns]).unpivot(
        [], df.columns, "column_name", "value"
    )
    kind = F.lit("categorical")
    for name, found in kinds.items():
        kind = F.when(F.col("column_name") == name, found).otherwise(kind)
    return (
        long.groupBy("column_name", "value")
        .agg(F.lit(1).alias("seen"))
        .groupBy("column_name")
        .agg(F.count("value").alias("n_distinct"))
        .select("column_name", kind.alias("kind"), "n_distinct")
    )
