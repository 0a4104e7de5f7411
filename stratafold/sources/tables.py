"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stratafold.functions import parse_number
from stratafold.operators.clean import require_columns
from stratafold.schema import NA_TOKENS

# Fixed value: the texts that count as whole numbers; a fraction of zeros is allowed.
WHOLE_TEXT = r"^\s*[+-]?\d+(\.0*)?\s*$"


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, form: str = "csv", extra: bool = False, multiline: bool = False
) -> DataFrame:
    """A stored table with the given columns and types; missing cells are null, missing columns an error.

    Delimited files are read as text without inference: their numbers and missing-value tokens
    follow fixed rules. Blank but non-empty cells stay text. Quotes inside quoted cells are doubled;
    ``multiline`` allows line ends in them. Whole numbers are never taken through a double; a
    fraction where a whole number is due is null. With ``extra`` all other columns are kept behind
    the given ones: as double if every present cell is a number, else as text.
    """
    names = [f.name for f in schema.fields]
    if form != "csv":
        stored = spark.read.format(form).load(path)
        require_columns(stored, names)
        others = [c for c in stored.columns if c not in names] if extra else []
        return stored.select(*[_without_nan(F.col(f.name), f).alias(f.name) for f in schema.fields], *others)
    text = spark.read.options(header=True, escape='"', multiLine=multiline).csv(path)
    require_columns(text, names)
    others = [c for c in text.columns if c not in names] if extra else []
    return text.select(*[_cell(F.col(f.name), f.dataType).alias(f.name) for f in schema.fields], *_typed(text, others))


def _without_nan(column: Column, cell: T.StructField) -> Column:
    value = column.cast(cell.dataType)
    return F.when(~F.isnan(value), value) if isinstance(cell.dataType, T.DoubleType) else value


def _present(column: Column) -> Column:
    return F.when(~column.isin(NA_TOKENS), column)


def _cell(column: Column, kind: T.DataType) -> Column:
    present = _present(column)
    if isinstance(kind, T.StringType):
        return present
    if isinstance(kind, T.IntegralType):
        digits = F.regexp_replace(F.trim(present), r"\.0*$", "")
        return F.when(present.rlike(WHOLE_TEXT), digits.try_cast(kind))
    return parse_number(present).try_cast(kind)


def _typed(text: DataFrame, names: list[str]) -> list[Column]:
    """Further columns, as double where one pass finds nothing but numbers."""
    if not names:
        return []
    column = lambda name: _present(F.col(f"`{name}`"))
    numeric = [F.every(column(n).isNull() | parse_number(column(n)).isNotNull()).alias(str(i)) for i, n in enumerate(names)]
    found = text.agg(*numeric).first()
    return [(parse_number(column(n)) if found[i] else column(n)).alias(n) for i, n in enumerate(names)]
