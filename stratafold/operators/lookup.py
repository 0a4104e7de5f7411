"""Left join of a table with one row per key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from stratafold.session import shuffle_width, stage

BROADCAST_BYTES = 64 << 20
_ROW_BYTES = 32


def quoted(name: str) -> str:
    """A column name that may hold dots and back quotes, as a reference."""
    return "`" + name.replace("`", "``") + "`"


def row_bytes(table: DataFrame) -> Column:
    """Estimated bytes of a row: texts, bytes and arrays by their length, other values by eight."""
    size = F.lit(_ROW_BYTES).cast("bigint")
    for cell in table.schema.fields:
        if isinstance(cell.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(quoted(cell.name)), F.lit(0))
        elif isinstance(cell.dataType, T.ArrayType):
            size = size + F.coalesce(F.size(quoted(cell.name)), F.lit(0)) * 8
        else:
            size = size + 8
    return size


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    keys: Mapping[str, Column],
    size: int | None = None,
    spread: str | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    population: DataFrame | None = None,
) -> DataFrame:
    """Add the non-key columns of ``table`` to ``df``; rows without a match get nulls.

    ``keys`` maps the key columns of ``table`` to expressions over ``df``. ``size`` is the measured
    size of ``table`` in bytes if the caller knows it. Up to ``broadcast_bytes`` the table is
    broadcast; beyond, both sides are shuffled and hot keys are split over several partitions.
    These are counted in ``population``: the rows of ``df`` before earlier joins, so as not to
    repeat them. Rows are split by the column ``spread`` or by all columns.
    """
    if size is None:
        size = table.agg(F.sum(row_bytes(table))).first()[0] or 0
    probes = df.withColumns({f"_probe_{name}": column for name, column in keys.items()})
    sides = table.withColumnsRenamed({name: f"_side_{name}" for name in keys})
    if size <= broadcast_bytes:
        joined = probes.join(F.broadcast(sides), _match(keys), "left")
    else:
        hot = _hot_keys(df if population is None else population, keys)
        joined = _fanned_join(probes, sides, hot, list(keys), [quoted(c) for c in ([spread] if spread else df.columns)])
    added = [c for c in table.columns if c not in keys]
    return joined.select(*[quoted(c) for c in (*df.columns, *added)])


def _match(keys) -> Column:
    matched = F.lit(True)
    for name in keys:
        matched = matched & (F.col(f"_probe_{name}") == F.col(f"_side_{name}"))
    return matched


def _hot_keys(population: DataFrame, keys: Mapping[str, Column]) -> DataFrame:
    """Keys with more than one even partition load of rows, and how many loads they have.

    There are at most as many such keys as shuffle partitions, which bounds their broadcast.
    """
    width = shuffle_width(population.sparkSession)
    named = population.select(*[column.alias(f"_hot_{name}") for name, column in keys.items()])
    counted = named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("_n"))
    total = population.agg(F.count(F.lit(1)).alias("_total"))
    loads = F.ceil(F.col("_n") * width / F.col("_total")).cast("int")
    hot = counted.dropna().crossJoin(F.broadcast(total)).where(F.col("_n") * width > F.col("_total"))
    return stage(hot.select(*named.columns, loads.alias("_fan")), "hot-keys")


def _fanned_join(
    probes: DataFrame, sides: DataFrame, hot: DataFrame, keys: list[str], spread: list[str]
) -> DataFrame:
    """Shuffle join in which a hot key gets as many partitions as it has loads of rows.

    Its table row is repeated once per lane and its probe rows are dealt out to the lanes. Rows
    with a missing key match nothing and are dealt out over all partitions.
    """
    width = shuffle_width(probes.sparkSession)
    missing = F.lit(False)
    for name in keys:
        missing = missing | F.col(f"_probe_{name}").isNull()

    def same(prefix: str) -> Column:
        matched = F.lit(True)
        for name in keys:
            matched = matched & (F.col(f"{prefix}{name}") == F.col(f"_hot_{name}"))
        return matched

    lanes = F.when(missing, F.lit(width)).otherwise(F.coalesce("_fan", F.lit(1)))
    left = probes.join(F.broadcast(hot), same("_probe_"), "left").withColumn(
        "_lane", F.pmod(F.xxhash64(*spread), lanes).cast("int")
    )
    right = sides.join(F.broadcast(hot), same("_side_"), "left").withColumn(
        "_side_lane", F.explode(F.sequence(F.lit(0), F.coalesce("_fan", F.lit(1)) - 1))
    )
    matched = _match(keys) & (F.col("_lane") == F.col("_side_lane"))
    return left.drop(*hot.columns).join(right.drop(*hot.columns), matched, "left")
