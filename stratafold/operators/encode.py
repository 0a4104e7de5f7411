"""Target encoding: nested out-of-fold statistics and smoothed means."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stratafold.functions import as_feature
from stratafold.operators.keyed import KeyedNumbers, unpivoted
from stratafold.session import apart


def target_cells(
    rows: DataFrame, columns: Sequence[str], label: str, folds: Sequence[str] = ()
) -> DataFrame:
    """Row count ``n`` and label sum ``s`` per (column, value, folds) in one grouping pass."""
    return (
        unpivoted(rows, columns, [*[F.col(c) for c in folds], F.col(label).alias("_label")])
        .groupBy("column", "value", *folds)
        .agg(F.count("_label").alias("n"), F.sum("_label").cast("bigint").alias("s"))
    )


def rolled_up_cells(
    rows: DataFrame,
    sources: Sequence[str],
    derive: Callable[[DataFrame], DataFrame],
    columns: Sequence[str],
    label: str,
    folds: Sequence[str] = (),
) -> DataFrame:
    """``target_cells`` of keys that are functions of ``sources``.

    Rows are grouped by the sources once; the keys are derived from those groups, so the unpivot
    multiplies the groups and not the rows.
    """
    groups = rows.groupBy(*sources, *folds).agg(
        F.count(label).alias("_n"), F.sum(label).cast("bigint").alias("_s")
    )
    return (
        unpivoted(derive(groups), columns, [F.col(c) for c in (*folds, "_n", "_s")])
        .groupBy("column", "value", *folds)
        .agg(F.sum("_n").alias("n"), F.sum("_s").alias("s"))
    )


@dataclass(frozen=True)
class TargetStats:
    """Encodings per key value, with one slot per inner fold and a last one for the rest.

    Slot ``i`` leaves inner fold ``i`` out; the last slot uses every training row. The numbers
    run over the slots of the first statistic, then of the next. ``prior`` is the label mean of
    the training rows.
    """

    numbers: KeyedNumbers
    stats: list[str]
    prior: float | list[float]
    inner_folds: int

    def slots(self) -> int:
        """Slots of a statistic; with a prior per outer fold, those of all outer folds in turn."""
        return (self.inner_folds + 1) * (len(self.prior) if isinstance(self.prior, list) else 1)

    def fill(self, slot: str = "_slot") -> str:
        """The prior of the row's slot as SQL."""
        if not isinstance(self.prior, list):
            return f"double('{float(self.prior)!r}')"
        listed = ", ".join(f"double('{float(p)!r}')" for p in self.prior)
        return f"get(array({listed}), int({slot} div {self.inner_folds + 1}))"


def closed_form(count: Column, hits: Column, stat: str) -> Column:
    """A statistic of a 0/1 label from its row count and sum; null for no rows."""
    n, s = count.cast("double"), hits.cast("double")
    if stat == "mean":
        return F.when(count > 0, s / n)
    if stat == "std":
        return F.when(count > 1, F.sqrt(F.greatest(s - s * s / n, F.lit(0.0)) / (n - 1)))
    if stat == "min":
        return F.when(count > 0, (count == hits).cast("double"))
    if stat == "max":
        return F.when(count > 0, (hits > 0).cast("double"))
    raise ValueError(f"unknown statistic: {stat}")


def out_of_fold_stats(
    cells: DataFrame, inner: str, inner_folds: int, prior: float, stats: Sequence[str]
) -> TargetStats:
    """Turn cells of the training rows into encodings for every left-out inner fold.

    A cell without an inner fold from 0 to ``inner_folds`` - 1 is an error.
    """

    def held(counter: str, fold: int) -> Column:
        return F.sum(F.when(F.col(inner) == fold, F.col(counter)).otherwise(0))

    sums = cells.groupBy("column", "value").agg(
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        *[held(c, i).alias(f"{c}{i}") for c in ("n", "s") for i in range(inner_folds)],
    )
    slots = [(F.col("n") - F.col(f"n{i}"), F.col("s") - F.col(f"s{i}")) for i in range(inner_folds)]
    slots.append((F.col("n"), F.col("s")))
    encoded = [closed_form(n, s, stat) for stat in stats for n, s in slots]
    known = sum((F.col(f"n{i}") for i in range(inner_folds)), F.lit(0)) == F.col("n")
    numbers = F.when(known, F.array(*encoded)).otherwise(
        F.raise_error(F.lit(f"inner folds must run from 0 to {inner_folds - 1}")).cast("array<double>")
    )
    table = sums.select("column", "value", numbers.alias("numbers"))
    return TargetStats(KeyedNumbers.of(table), list(stats), prior, inner_folds)


def all_out_of_fold_stats(
    cells: DataFrame, fold: str, inner: str, inner_folds: int, priors: Sequence[float], stats: Sequence[str]
) -> TargetStats:
    """Encodings for every outer fold in one table, so that one lookup per key serves all of them.

    Slot ``held_out * (inner_folds + 1) + i`` belongs to the encoder that leaves outer fold ``held_out``
    out; ``priors`` are those encoders' label means. Cells outside both fold ranges are an error.
    """
    per_slot = _slot_counts(cells, fold, inner, inner_folds, len(priors))
    slots = range(len(priors) * (inner_folds + 1))
    numbers = F.array(*[closed_form(F.col(f"_n{j}"), F.col(f"_s{j}"), stat) for stat in stats for j in slots])
    return TargetStats(KeyedNumbers.of(per_slot.select("column", apart(F.col("value")).alias("value"), numbers.alias("numbers"))), list(stats), list(priors), inner_folds)


def _slot_counts(cells: DataFrame, fold: str, inner: str, inner_folds: int, folds: int) -> DataFrame:
    """Per (column, value) the counts ``_n0``, ``_n1``, ... and sums ``_s0``, ``_s1``, ... of the rows outside each slot's folds.

    Counts can be subtracted: all rows less those of the outer and those of the inner fold, and the cell of both, which
    was taken away twice. Each is compiled code; lambdas over the list would be interpreted for every slot and cell.
    """
    listed = _listed_cells(cells, fold, inner, inner_folds, folds, ["n", "s"])
    places = [(o, i) for o in range(folds) for i in range(inner_folds)]
    apart_key = [apart(F.col("column")).alias("column"), F.col("value")]
    at = F.transform("_cells", lambda c: c["_o"] * inner_folds + c["_i"])
    found = listed.select(*apart_key, at.cast("array<int>").alias("_at"), F.col("_cells.n").alias("_n"), F.col("_cells.s").alias("_s"))

    def cell(kind: str, o: int, i: int) -> Column:
        place = F.array_position("_at", F.lit(o * inner_folds + i)).cast("int") - 1
        return F.coalesce(F.get(F.col(kind), place), F.lit(0).cast("bigint"))

    def total(kind: str, kept: Callable[[int, int], bool]) -> Column:
        held = [F.col(f"{kind}{o}_{i}") for o, i in places if kept(o, i)]
        return sum(held[1:], held[0])

    kinds = ("_n", "_s")
    dense = found.select(*apart_key, *[cell(kind, o, i).alias(f"{kind}{o}_{i}") for kind in kinds for o, i in places])
    sums = dense.select(
        *apart_key, *[f"{kind}{o}_{i}" for kind in kinds for o, i in places],
        *[total(kind, lambda o, i: True).alias(f"{kind}_all") for kind in kinds],
        *[total(kind, lambda o, i, k=k: o == k).alias(f"{kind}_outer{k}") for kind in kinds for k in range(folds)],
        *[total(kind, lambda o, i, k=k: i == k).alias(f"{kind}_inner{k}") for kind in kinds for k in range(inner_folds)],
    )

    def slot(kind: str, j: int) -> Column:
        o, i = divmod(j, inner_folds + 1)
        outside = F.col(f"{kind}_all") - F.col(f"{kind}_outer{o}")
        return outside if i == inner_folds else outside - F.col(f"{kind}_inner{i}") + F.col(f"{kind}{o}_{i}")

    return sums.select(*apart_key, *[slot(kind, j).alias(f"{kind}{j}") for kind in kinds for j in range(folds * (inner_folds + 1))])


def _listed_cells(cells: DataFrame, fold: str, inner: str, inner_folds: int, folds: int, held: Sequence[str]) -> DataFrame:
    """The cells of every (column, value) as a list ``_cells`` of ``_o``, ``_i`` and ``held``; folds out of range are an error.

    A key has one cell per outer and inner fold at most, so its list is short; rows were merged before.
    """
    listed = cells.groupBy("column", "value").agg(
        F.collect_list(F.struct(F.col(fold).alias("_o"), F.col(inner).alias("_i"), *held)).alias("_cells")
    )
    known = F.forall("_cells", lambda c: F.coalesce(c["_o"].between(0, folds - 1) & c["_i"].between(0, inner_folds - 1), F.lit(False)))
    checked = F.when(known, F.col("_cells")).otherwise(F.raise_error(F.lit("fold numbers beyond their counts")).cast(listed.schema["_cells"].dataType))
    return listed.select("column", "value", checked.alias("_cells"))


def _slots(
    cells: DataFrame, fold: str, inner: str, inner_folds: int, folds: int, merged: Mapping[str, tuple[str, str, str]]
) -> DataFrame:
    """Per (column, value) one array per entry of ``merged``, with what all cells outside a slot's outer and
    inner fold add up to. An entry names a cell column, its type and how the sum ``s`` takes a cell ``c`` in."""
    held = [c for c in dict.fromkeys(column for column, _, _ in merged.values())]
    width = inner_folds + 1
    kept = _listed_cells(cells, fold, inner, inner_folds, folds, held).select(
        "column", "value",
        F.expr(
            f"transform(sequence(0, {folds * width - 1}), k -> "
            f"filter(_cells, c -> c._o <> k div {width} AND c._i <> k % {width}))"
        ).alias("_kept"),
    )
    start = {kind: "0L" if kind == "bigint" else f"CAST(NULL AS {kind})" for _, kind, _ in merged.values()}
    return kept.select(
        "column", "value",
        *[
            F.expr(f"transform(_kept, cells -> aggregate(cells, {start[kind]}, (s, c) -> {step}))").alias(name)
            for name, (_, kind, step) in merged.items()
        ],
    )


def numeric_cells(
    rows: DataFrame, columns: Sequence[str], label: str, folds: Sequence[str] = ()
) -> DataFrame:
    """Cells of a label of any numbers: count ``n``, ``mean``, ``spread`` (sum of squared distances to it),
    ``low`` and ``high`` per (column, value, folds). Missing labels and NaN count nowhere."""
    number = F.col(label).cast("double")
    long = unpivoted(rows, columns, [*[F.col(c) for c in folds], F.when(~F.isnan(number), number).alias("_label")])
    return long.where("_label IS NOT NULL").groupBy("column", "value", *folds).agg(
        F.count("_label").alias("n"), F.avg("_label").alias("mean"), (F.var_pop("_label") * F.count("_label")).alias("spread"),
        F.min("_label").alias("low"), F.max("_label").alias("high"),
    )


def numeric_out_of_fold_stats(
    cells: DataFrame, fold: str, inner: str, inner_folds: int, priors: Sequence[float], stats: Sequence[str]
) -> TargetStats:
    """``all_out_of_fold_stats`` of ``numeric_cells``.

    Extremes cannot be subtracted, so every slot merges the cells it keeps: least and largest values,
    and means and spreads by the pairwise formula, which does not cancel as differences of sums would.
    """
    merged = {
        "n": ("n", "bigint", "s + c.n"),
        "total": ("mean", "double", "coalesce(s, 0D) + c.n * c.mean"),
        "low": ("low", "double", "least(s, c.low)"),
        "high": ("high", "double", "greatest(s, c.high)"),
        "moments": (
            "spread", "struct<n: double, mean: double, spread: double>",
            "named_struct('n', coalesce(s.n, 0D) + c.n, "
            "'mean', coalesce(s.mean + (c.mean - s.mean) * c.n / (s.n + c.n), c.mean), "
            "'spread', coalesce(s.spread + c.spread + power(c.mean - s.mean, 2) * s.n * c.n / (s.n + c.n), c.spread))",
        ),
    }
    per_slot = _slots(cells, fold, inner, inner_folds, len(priors), merged)
    found = {
        "mean": F.zip_with("total", "n", lambda total, n: F.when(n > 0, total / n)),
        "std": F.transform("moments", lambda m: F.when(m["n"] > 1, F.sqrt(m["spread"] / (m["n"] - 1)))),
        "min": F.col("low"),
        "max": F.col("high"),
    }
    numbers = F.concat(*[found[stat] for stat in stats])
    return TargetStats(KeyedNumbers.of(per_slot.select("column", "value", numbers.alias("numbers"))), list(stats), list(priors), inner_folds)


def apply_target_stats(
    rows: DataFrame,
    encodings: TargetStats,
    wanted: Mapping[str, Sequence[str]],
    slot: Column,
    **options,
) -> DataFrame:
    """Add ``TE_<column>_<stat>`` read from the row's slot; a miss gets the prior or 0.

    A slot beyond those of the encodings, and a missing one, is an error.
    """
    found = encodings.numbers.find(rows.withColumn("_slot", _checked_slot(encodings, slot)), wanted, **options)
    return found.selectExpr(*[f"`{c}`" for c in rows.columns], *_read_slots(encodings, wanted))


def apply_all_folds(
    rows: DataFrame,
    encodings: TargetStats,
    wanted: Mapping[str, Sequence[str]],
    held_out: str,
    fold: str | None = None,
    inner: str | None = None,
    **options,
) -> DataFrame:
    """``apply_target_stats`` for every outer fold: one row per row and fold ``held_out``, one lookup per key.

    With ``fold`` and ``inner`` a row is a training row: it gets the encodings that leave its inner fold
    out, and those of all training rows where its own fold is held out. Without them it is a test row.
    """
    width = encodings.inner_folds + 1
    found, slots, own = _with_slots(rows, encodings, wanted, fold, inner, options)
    # A row's own slots are read before the folds multiply it, so that no array is copied per fold.
    listed = [
        F.struct(
            F.floor(apart(F.col(name)) / width).cast("int").alias(held_out),
            *[F.expr(value).alias(feature) for feature, value in _slot_values(encodings, wanted, name, k, own)],
        )
        for k, name in enumerate(slots)
    ]
    kept = [F.col(f"`{c}`") for c in rows.columns]
    every = found.select(*kept, F.array(*listed).alias("_folds"))
    return every.select(*kept, F.explode_outer("_folds").alias("_fold")).select(*kept, "_fold.*")


def numbers_of_folds(
    rows: DataFrame,
    encodings: TargetStats,
    wanted: Mapping[str, Sequence[str]],
    kept: Sequence[str],
    others: Sequence[str],
    plain: Callable[[str], str],
    fold: str | None = None,
    inner: str | None = None,
    **options,
) -> tuple[DataFrame, list[str]]:
    """What ``apply_all_folds`` reads as one array of numbers per outer fold; no row is multiplied.

    An array holds the columns ``others`` and then the encodings, each as the SQL that ``plain`` makes of its
    own. Returns the columns ``kept`` with the arrays ``numbers_0``, ``numbers_1``, ... and the names of the numbers.
    """
    # Numbers in one array, and ordinals for the texts of small columns: large lookups shuffle the rows.
    small = [c for c in wanted if c in encodings.numbers.small] if options.get("dictionaries", True) else []
    places = [c for c in (fold, inner) if c is not None and c not in kept]
    first, *rest = [*kept, *places, *[c for c in wanted if c not in small]]
    narrow = rows.select(
        apart(F.col(f"`{first}`")).alias(first), *[F.col(f"`{c}`") for c in rest],
        F.array(*[F.expr(plain(f"`{c}`")) for c in others]).alias("_shared"), encodings.numbers.ordinals(rows, small).alias("_ordinals"),
    )
    found, slots, own = _with_slots(narrow, encodings, wanted, fold, inner, options | {"ordinals": ("_ordinals", small)})
    shared, arrays, names = F.col("_shared"), [], list(others)
    for k, slot in enumerate(slots):
        values = _slot_values(encodings, wanted, slot, k, own)
        encoded = F.array(*[F.expr(plain(value)) for _, value in values])
        arrays.append(F.concat(shared, encoded).alias(f"numbers_{k}"))
        names = [*others, *[name for name, _ in values]]
    first, *rest = kept
    return found.select(apart(F.col(f"`{first}`")).alias(first), *[F.col(f"`{c}`") for c in rest], *arrays), names


def _with_slots(
    rows: DataFrame, encodings: TargetStats, wanted: Mapping[str, Sequence[str]], fold: str | None, inner: str | None, options: Mapping
) -> tuple[DataFrame, list[str], list[str]]:
    """The rows with what their keys find and their slot for every outer fold, the names of the slots, and the columns
    that found no more than the row's own slots.

    Those are the columns with large tables. Their lookups shuffle the rows one after another, and the numbers of all
    slots are several times as long as the rows.
    """
    width = encodings.inner_folds + 1
    slots = {}
    for k in range(encodings.slots() // width):
        place = F.lit(encodings.inner_folds)
        if fold is not None:
            place = F.when(F.col(fold) != k, F.col(inner)).when(F.col(fold) == k, place)
        slots[f"_slot_{k}"] = _checked_slot(encodings, k * width + place)
    limit = {name: options[name] for name in ("broadcast_bytes",) if name in options}
    own = encodings.numbers.shuffled(wanted, **limit)
    kept = {
        column: F.array(*[F.expr(value) for name in slots for _, value in _slot_values(encodings, {column: wanted[column]}, name)])
        for column in own
    }
    return encodings.numbers.find(rows.withColumns(slots), wanted, kept=kept, **options), list(slots), own


def _checked_slot(encodings: TargetStats, slot: Column) -> Column:
    width = encodings.slots()
    return F.when(slot.between(0, width - 1), slot).otherwise(
        F.raise_error(F.lit(f"slots must run from 0 to {width - 1}")).cast("int")
    )


def _read_slots(encodings: TargetStats, wanted: Mapping[str, Sequence[str]]) -> list[str]:
    """The features as SQL over the looked-up arrays and ``_slot``."""
    return [f"{value} AS `{name}`" for name, value in _slot_values(encodings, wanted, "_slot")]


def _slot_values(
    encodings: TargetStats, wanted: Mapping[str, Sequence[str]], slot: str, place: int = 0, own: Sequence[str] = ()
) -> list[tuple[str, str]]:
    """The features and their values as SQL over the looked-up arrays. Those of the columns ``own`` hold the values of
    the row's slots only, one slot after another, of which ``slot`` is number ``place``."""
    added = []
    for column, stats in wanted.items():
        for at, stat in enumerate(stats):
            start = encodings.stats.index(stat) * encodings.slots()
            fill = encodings.fill(slot) if stat == "mean" else "double('0')"
            value = f"cast(coalesce(get(`_found_{column}`, {slot} + {start}), {fill}) as float)"
            added.append((f"TE_{column}_{stat}", f"get(`_found_{column}`, {place * len(stats) + at})" if column in own else value))
    return added


def fold_priors(rows: DataFrame, label: str, fold: str) -> DataFrame:
    """Per outer fold: size and label mean of the training rows that leave it out."""
    per = rows.groupBy(fold).agg(F.count(label).alias("_n"), F.sum(label).alias("_s"))
    total = per.agg(F.sum("_n").alias("_tn"), F.sum("_s").alias("_ts"))
    kept_n, kept_s = F.col("_tn") - F.col("_n"), F.col("_ts") - F.col("_s")
    return per.crossJoin(F.broadcast(total)).select(
        fold, kept_n.alias("n_train"), F.when(kept_n > 0, kept_s / kept_n).alias("prior")
    )


@dataclass(frozen=True)
class SmoothedTargetEncoder:
    """Means shrunk to the prior: weight 1 / (1 + exp(-(n - min_samples_leaf) / smoothing))."""

    columns: list[str]
    min_samples_leaf: float = 20.0
    smoothing: float = 10.0

    def fit(self, train: DataFrame, label: str) -> SmoothedTargetModel:
        prior = train.agg(F.avg(label)).first()[0]
        weight = 1 / (1 + F.exp(-(F.col("n") - self.min_samples_leaf) / self.smoothing))
        shrunk = weight * F.col("s") / F.col("n") + (1 - weight) * F.lit(prior)
        cells = target_cells(train, self.columns, label)
        table = cells.select("column", "value", F.array(shrunk).alias("numbers"))
        return SmoothedTargetModel(KeyedNumbers.of(table), prior, list(self.columns))


@dataclass(frozen=True)
class SmoothedTargetModel:
    numbers: KeyedNumbers
    prior: float
    columns: list[str]

    def transform(self, df: DataFrame, **options) -> DataFrame:
        """Replace the encoded columns; unseen and missing values get the prior."""
        found = self.numbers.find(df, self.columns, **options)
        means = {c: F.get(F.col(f"_found_{c}"), F.lit(0)) for c in self.columns}
        return found.withColumns(
            {c: F.coalesce(mean, F.lit(self.prior)) for c, mean in means.items()}
        ).drop(*[f"_found_{c}" for c in self.columns])


def smoothed_pair(
    train: DataFrame, other: DataFrame, columns: Sequence[str], label: str, **settings
) -> tuple[DataFrame, DataFrame]:
    """Fit on ``train`` and replace the columns of both tables by their smoothed means."""
    model = SmoothedTargetEncoder(list(columns), **settings).fit(train, label)
    return model.transform(train), model.transform(other)
