"""A stored index of a reference column that ranks any value, also those the reference does not hold.

The reference is reduced to distinct values in ordered buckets with frozen bounds. To rank a table, its
distinct values go to the same buckets and are merged with the reference's inside each: a running sum in
value order is the number of reference rows below. Sums of earlier buckets are added; they are merged
over the buckets of a group, of which there are few. No join compares ranges of values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stratafold.functions import as_feature
from stratafold.operators.keyed import lookup_text
from stratafold.operators.lookup import lookup_join
from stratafold.operators.prefix import BUCKET, bounds_of, bucketed, value_cells
from stratafold.session import stage


def _number(column: str) -> Column:
    """A column as double; NaN is missing."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value + F.lit(0.0))


@dataclass(frozen=True)
class RankIndex:
    """``cells``: one row per (group, value) with a count per named subset; ``bounds`` of the buckets."""

    cells: DataFrame
    bounds: list[float]
    subsets: list[str]
    group: str | None

    @classmethod
    def fit(
        cls, reference: DataFrame, column: str, subsets: Mapping[str, Column], group: str | None = None
    ) -> RankIndex:
        """Count the reference rows of every subset per distinct value; missing values and groups do not count."""
        keys = [lookup_text(reference, group).alias("group")] if group else []
        flags = [F.coalesce(test, F.lit(False)).alias(f"_in_{name}") for name, test in subsets.items()]
        narrow = reference.select(*keys, _number(column).alias("value"), *flags)
        cells = stage(value_cells(narrow, "value", {n: F.col(f"_in_{n}") for n in subsets}, ["group"] if group else []), "rank-cells")
        bounds = cells.agg(bounds_of("value", cells.sparkSession)).first()[0] or []
        return cls(cells, sorted(set(bounds)), list(subsets), group)

    def save(self, path: str) -> None:
        """Write the index; an existing one is an error."""
        spark = self.cells.sparkSession
        self.cells.write.parquet(f"{path}/cells")
        facts = spark.createDataFrame(
            [(self.bounds, self.subsets, self.group)], "bounds array<double>, subsets array<string>, `group` string"
        )
        facts.coalesce(1).write.parquet(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RankIndex:
        facts = spark.read.parquet(f"{path}/facts").first()
        return cls(spark.read.parquet(f"{path}/cells"), list(facts["bounds"]), list(facts["subsets"]), facts["group"])

    def ranked(self, df: DataFrame, column: str) -> DataFrame:
        """Staged: every distinct (group, value) of ``df`` with the share of each subset strictly below it."""
        by = ["group"] if self.group else []
        keys = [lookup_text(df, self.group).alias("group")] if self.group else []
        probes = df.select(*keys, _number(column).alias("value")).dropna().distinct()
        probes = stage(bucketed(probes, "value", self.bounds), "rank-probes")
        cells = bucketed(self.cells, "value", self.bounds)
        lanes = _lanes(probes)
        counts = [F.lit(0).cast("bigint").alias(n) for n in self.subsets]
        dealt = probes.select(*by, "value", BUCKET, F.lit(True).alias("_probe"), F.pmod(F.xxhash64("value"), lanes).alias("_lane"), *counts)
        held = cells.select(
            *by, "value", BUCKET, F.lit(False).alias("_probe"), F.explode(F.sequence(F.lit(0).cast("bigint"), lanes - 1)).alias("_lane"), *self.subsets
        )
        # a probe comes before the reference rows of its own value, which are not below it
        inside = Window.partitionBy(*by, BUCKET, "_lane").orderBy("value", F.desc("_probe")).rowsBetween(Window.unboundedPreceding, -1)
        merged = held.unionByName(dealt).select(
            *by, "value", BUCKET, "_probe", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_run_{n}") for n in self.subsets]
        )
        starts = self._starts(cells, probes, by)
        found = merged.where("_probe").join(starts, [*by, BUCKET])
        shares = [
            F.when(F.col(f"_total_{n}") > 0, (F.col(f"_start_{n}") + F.col(f"_run_{n}")) / F.col(f"_total_{n}")).otherwise(0.0).alias(n)
            for n in self.subsets
        ]
        return stage(found.select(*by, "value", *shares), "ranks")

    def _starts(self, cells: DataFrame, probes: DataFrame, by: Sequence[str]) -> DataFrame:
        """Per group and bucket that holds cells or probes: sums of the earlier buckets and of all."""
        sums = cells.groupBy(*by, BUCKET).agg(*[F.sum(n).alias(n) for n in self.subsets])
        asked = probes.select(*by, BUCKET).distinct().select("*", *[F.lit(0).cast("bigint").alias(n) for n in self.subsets])
        both = sums.unionByName(asked).groupBy(*by, BUCKET).agg(*[F.sum(n).alias(n) for n in self.subsets])
        whole = Window.partitionBy(*by)
        before = whole.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        return both.select(
            *by, BUCKET,
            *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_start_{n}") for n in self.subsets],
            *[F.sum(n).over(whole).alias(f"_total_{n}") for n in self.subsets],
        )

    def apply(self, df: DataFrame, column: str, **options) -> DataFrame:
        """Add, per subset, the share of it strictly below the row's value.

        A missing value, an empty subset and a group that the reference lacks give 0.
        """
        keys = {"value": _number(column)}
        if self.group:
            keys["group"] = lookup_text(df, self.group)
        joined = lookup_join(df, self.ranked(df, column), keys, **({"population": df} | options))
        return joined.withColumns({n: as_feature(F.coalesce(n, F.lit(0.0))) for n in self.subsets})


def _lanes(probes: DataFrame) -> Column:
    """Into how many lanes a bucket's probes are dealt: one, or as many as they are even loads of a bucket.

    The reference's cells of the bucket are repeated per lane. There is a number per bucket, and buckets
    follow the shuffle width of the session that fitted the index.
    """
    sizes = {int(row[BUCKET]): row["n"] for row in probes.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).collect()}
    even = max(1.0, sum(sizes.values()) / max(1, len(sizes)))
    listed = [F.lit(int(-(-sizes.get(place, 0) // even)) or 1).cast("bigint") for place in range(max(sizes, default=0) + 1)]
    return F.coalesce(F.get(F.array(*listed), F.col(BUCKET).cast("int")), F.lit(1).cast("bigint"))
