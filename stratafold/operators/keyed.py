"""Lookup tables for many key columns at once: (column, value) -> numbers."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stratafold.operators.clean import is_numeric
from stratafold.operators.lookup import BROADCAST_BYTES, lookup_join, row_bytes
from stratafold.session import apart, stage

# A key column within both limits is looked up in a map literal, without a join.
DICTIONARY_ROWS = 256
DICTIONARY_BYTES = 1 << 20


def lookup_text(df: DataFrame, name: str) -> Column:
    """Lookup key of a column as text; numbers compare by value (1 equals 1.0, -0.0 equals 0.0)."""
    if is_numeric(df, name):
        return (F.col(name).cast("double") + F.lit(0.0)).cast("string")
    return F.col(name).cast("string")


def unpivoted(df: DataFrame, columns: Iterable[str], others: Iterable[Column]) -> DataFrame:
    """One row per row and non-missing key: ``others``, ``column`` and ``value``."""
    columns, others = list(columns), list(others)
    keys = df.select(*others, *[lookup_text(df, c).alias(c) for c in columns])
    carried = [c for c in keys.columns if c not in columns]
    return keys.unpivot(carried, columns, "column", "value").where(F.col("value").isNotNull())


@dataclass(frozen=True)
class KeyedNumbers:
    """``table`` holds ``column``, ``value`` and an array ``numbers``, one row per pair.

    ``sizes`` and ``weights`` are the number of values and their bytes per column. Columns of few
    and short values are held in ``small`` as well: they are the only rows on the driver.
    """

    table: DataFrame
    sizes: dict[str, int]
    weights: dict[str, int]
    small: dict[str, dict[str, list[float | None]]]

    @classmethod
    def of(cls, table: DataFrame, stored: bool = False) -> KeyedNumbers:
        """From a table of ``column``, ``value`` and ``numbers``, which is written to files unless it is ``stored``."""
        table = table if stored else stage(table, "lookups")
        counted = table.groupBy("column").agg(
            F.count("value").alias("rows"), F.sum(row_bytes(table)).alias("bytes")
        ).collect()
        sizes = {row["column"]: row["rows"] for row in counted}
        weights = {row["column"]: row["bytes"] for row in counted}
        few = [c for c in sizes if sizes[c] <= DICTIONARY_ROWS and weights[c] <= DICTIONARY_BYTES]
        small: dict[str, dict[str, list[float | None]]] = {c: {} for c in few}
        for row in table.where(F.col("column").isin(few)).collect():
            small[row["column"]][row["value"]] = row["numbers"]
        return cls(table, sizes, weights, small)

    def shuffled(self, columns: Iterable[str], broadcast_bytes: int = BROADCAST_BYTES) -> list[str]:
        """Columns whose tables are too large to be broadcast."""
        return [c for c in columns if c not in self.small and self.weights.get(c, 0) > broadcast_bytes]

    def ordinals(self, df: DataFrame, columns: Iterable[str]) -> Column:
        """The places of a row's values in the dictionaries of small columns, an array; null where there is none."""
        places = [json.dumps({value: place for place, value in enumerate(self.small[c])}) for c in columns]
        found = [F.try_element_at(F.from_json(F.lit(p), "map<string,smallint>"), lookup_text(df, c)) for p, c in zip(places, columns)]
        return F.array(*found) if found else F.array().cast("array<smallint>")

    def find(
        self, df: DataFrame, columns: Iterable[str], dictionaries: bool = True, kept: Mapping[str, Column] | None = None,
        ordinals: tuple[str, Sequence[str]] | None = None, **options,
    ) -> DataFrame:
        """Add ``_found_<column>``: the numbers of the row's value, null if there are none.

        Without ``dictionaries`` every lookup is a join. ``kept`` replaces what a column found as soon as it is
        there, so that shuffles for further columns carry that only. ``ordinals`` names an array of ``ordinals()`` and
        its columns, whose texts ``df`` need not have.
        """
        placed = {c: place for place, c in enumerate(ordinals[1])} if ordinals else {}
        literals = {}
        options = {"population": df} | options
        # Large tables first: their joins may shuffle the rows, which are narrow before the others' arrays are there.
        for column in sorted(columns, key=lambda c: -self.weights.get(c, 0)):
            name = f"_found_{column}"
            if column in placed:
                listed = F.from_json(F.lit(json.dumps(list(self.small[column].values()))), "array<array<double>>")
                place = F.get(ordinals[0], F.lit(placed[column])).cast("int")
                literals[name] = F.get(listed, place if literals else apart(place))
                continue
            key = lookup_text(df, column)
            if not self.sizes.get(column):
                literals[name] = F.lit(None).cast("array<double>")
            elif dictionaries and column in self.small:
                text = json.dumps(self.small[column])
                key = key if literals else apart(key)
                literals[name] = F.try_element_at(F.from_json(F.lit(text), "map<string,array<double>>"), key)
            else:
                table = self.table.where(F.col("column") == column).select("value", F.col("numbers").alias(name))
                df = lookup_join(df, table, {"value": key}, size=self.weights[column], **options)
                if kept and column in kept:
                    df = df.withColumn(name, kept[column])
        return df.withColumns(literals) if literals else df
