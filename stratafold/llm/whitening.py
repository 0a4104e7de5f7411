"""Embedding whitening from an exact bit-sliced scatter matrix.

Entries become integers. A task shifts every dimension of a slice of rows by the slice's least value and
packs the bit planes that are left across rows into 64-bit words. The product sum of two dimensions is
the weighted sum of the bits that their planes share: an AND and a popcount per pair of planes. Sums of
slices, tasks and partitions are integers, so neither order nor partition counts change them; they are
centred as integers before the eigenvectors are taken.

What reaches the driver grows with the square of the dimensions only, never with the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Rows whose bit planes are packed at once.
SLICE = 4096
#: Integers travel as digits of so many bits, each a long; sums of digits stay exact over millions of tasks.
_DIGIT = 40
_DIGITS = 4
#: Components with less than this share of the variance have none that doubles can tell from zero.
LEAST_SHARE = 1e-13
_LARGEST = (1 << 63) - 1


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def _vectors(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """``key`` and ``vector`` (doubles) of the rows that take part, and their dimensions."""
    cells = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).alias("key"), cells.alias("vector")).where(_usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.where("size > 0").orderBy(F.desc("n"), F.desc("size")).first()
    size = usual["size"] if usual else 0
    return rows.where(F.size("vector") == size), size


def whole_numbers(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of floor(64 * c) + 1000000; what a long cannot hold becomes its largest or least value."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    cells = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, size)
    with np.errstate(over="ignore"):
        scaled = np.floor(cells * SCALE)
    return np.clip(scaled, -(2.0**63), 2.0**63 - 2.0**21).astype(np.int64) + OFFSET


def bit_planes(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of non-negative numbers (unsigned, rows by dimensions) as words, and each plane's dimension and bit."""
    rows, size = numbers.shape
    padded = np.zeros((-(-rows // 64) * 64, size), np.uint64)
    padded[:rows] = numbers
    planes, dimensions, bits = [], [], []
    for bit in range(int(numbers.max()).bit_length()):
        held = ((padded >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
        used = np.flatnonzero(held.any(axis=0))
        packed = np.ascontiguousarray(np.packbits(held[:, used], axis=0).T)
        planes.append(packed.view(np.uint64))
        dimensions.append(used)
        bits.append(np.full(len(used), bit))
    if not planes:
        return np.empty((0, len(padded) // 64), np.uint64), np.empty(0, int), np.empty(0, int)
    order = np.lexsort((np.concatenate(bits), np.concatenate(dimensions)))
    return np.concatenate(planes)[order], np.concatenate(dimensions)[order], np.concatenate(bits)[order]


def slice_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums per dimension and product sums per pair of dimensions (the upper triangle counts)."""
    rows, size = x.shape
    low = x.min(axis=0)
    shifted = x.astype(np.uint64) - low.astype(np.uint64)
    planes, dimensions, bits = bit_planes(shifted)
    largest = int(shifted.max())
    small = largest < 1 << 24 and int(np.abs(low).max()) < 1 << 24  # then longs hold every sum of a slice
    kind = np.int64 if small else object
    weights = np.array([1 << int(b) for b in bits], kind)
    shared = np.zeros((len(planes), len(planes)), np.int64)
    for at in range(len(planes)):
        shared[at, at:] = np.bitwise_count(planes[at:] & planes[at]).sum(axis=1, dtype=np.int64)
    ones = shared.diagonal().copy()
    shared += np.triu(shared, 1).T
    held, starts = np.unique(dimensions, return_index=True)
    sums, products = np.zeros(size, kind), np.zeros((size, size), kind)
    if len(held):
        sums[held] = np.add.reduceat(ones.astype(kind) * weights, starts)
        weighted = shared.astype(kind) * weights[:, None] * weights[None, :]
        products[np.ix_(held, held)] = np.add.reduceat(np.add.reduceat(weighted, starts, axis=0), starts, axis=1)
    low = low.astype(kind)
    products = products + np.multiply.outer(low, sums) + np.multiply.outer(sums, low) + rows * np.multiply.outer(low, low)
    return sums + rows * low, products


def _digits(value: int) -> list[int]:
    return [(value >> _DIGIT * d) & ((1 << _DIGIT) - 1) for d in range(_DIGITS - 1)] + [value >> _DIGIT * (_DIGITS - 1)]


def scatter(rows: DataFrame, size: int) -> DataFrame:
    """Sums over all rows as (``i``, ``j``, ``d0`` to ``d3``): rows at (-1, -1), sums at (i, -1), products at i <= j."""

    def summed(batches):
        count, sums, products = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                x = whole_numbers(batch.column(0).slice(at, SLICE), size)
                one, two = slice_sums(x)
                count, sums, products = count + len(x), sums + one, products + two
        if not count:
            return
        places = [(-1, -1, count), *[(i, -1, sums[i]) for i in range(size)]]
        for i in range(size):
            places += [(i, j, products[i, j]) for j in range(i, size)]
            if len(places) > 65536 or i == size - 1:
                digits = list(zip(*[_digits(int(value)) for _, _, value in places]))
                first = [pa.array([p[k] for p in places], pa.int32()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*first, *[pa.array(d, pa.int64()) for d in digits]], ["i", "j", *[f"d{d}" for d in range(_DIGITS)]]
                )
                places = []

    names = ", ".join(f"d{d} bigint" for d in range(_DIGITS))
    parts = rows.select("vector").mapInArrow(summed, f"i int, j int, {names}")
    return parts.groupBy("i", "j").agg(*[F.sum(f"d{d}").alias(f"d{d}") for d in range(_DIGITS)])


@dataclass(frozen=True)
class Whitening:
    """``count`` vectors with ``sums`` per dimension; unit ``vectors`` (columns) by falling ``values``.

    ``explained`` is the share of the whole variance. A component without variance has a value of 0.
    """

    count: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> Whitening | None:
    """Principal components of the rows' whole numbers; None if there is no row."""
    found = {(r["i"], r["j"]): sum(r[f"d{d}"] << _DIGIT * d for d in range(_DIGITS)) for r in scatter(rows, size).collect()}
    if not found:
        return None
    count = found[-1, -1]
    sums = [found[i, -1] for i in range(size)]
    covariance = np.empty((size, size))
    for i in range(size):
        for j in range(i, size):
            covariance[i, j] = covariance[j, i] = (count * found[i, j] - sums[i] * sums[j]) / (count * count)
    # a power of two brings all entries below one and changes no digit
    scale = 2.0 ** -np.ceil(np.log2(covariance.max())) if covariance.max() > 0 else 1.0
    values, vectors = np.linalg.eigh(covariance * scale)
    kept = slice(None, -min(components, size) - 1, -1)
    values, vectors = values[kept] / scale, vectors[:, kept]
    trace = covariance.trace()
    values = np.where(values > LEAST_SHARE * trace, values, 0.0)
    return Whitening(count, sums, vectors, values, values / trace if trace else values)


def _deviations(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Exact n * x - S."""
    sums = np.array(model.sums, object)
    bound = max(int(np.abs(x).max(initial=0)), 1) * model.count + max(map(abs, model.sums))
    if bound <= _LARGEST:
        return model.count * x - sums.astype(np.int64)
    return model.count * x.astype(object) - sums


def _squared(deviations: np.ndarray) -> list[int | None]:
    """Exact sums of squares; None where a long cannot hold it."""
    if not len(deviations):
        return []
    if deviations.dtype != object and int(np.abs(deviations).max()) ** 2 * deviations.shape[1] <= _LARGEST:
        return (deviations * deviations).sum(axis=1).tolist()
    exact = deviations.astype(object)
    return [s if s <= _LARGEST else None for s in (exact * exact).sum(axis=1)]


def _whitened(deviations: np.ndarray, model: Whitening) -> np.ndarray:
    """Projections over the components' deviations; NaN for a component without variance."""
    projected = (deviations.astype(float) / model.count) @ model.vectors
    roots = np.sqrt(model.values)
    return np.divide(projected, roots, out=np.full_like(projected, np.nan), where=roots > 0)


def identity_error(rows: DataFrame, size: int, model: Whitening) -> float:
    """Largest absolute entry of the covariance of all whitened rows minus the identity."""
    varied = np.flatnonzero(model.values > 0)

    def summed(batches):
        sums, products = np.zeros(len(varied)), np.zeros((len(varied), len(varied)))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                w = _whitened(_deviations(whole_numbers(batch.column(0).slice(at, SLICE), size), model), model)[:, varied]
                sums, products = sums + w.sum(axis=0), products + w.T @ w
        i, j = np.indices(products.shape)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.arange(len(varied)), i.ravel()]).astype(np.int32)),
                pa.array(np.concatenate([np.full(len(varied), -1), j.ravel()]).astype(np.int32)),
                pa.array(np.concatenate([sums, products.ravel()])),
            ],
            ["i", "j", "s"],
        )

    parts = rows.select("vector").mapInArrow(summed, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    found = {(r["i"], r["j"]): r["s"] / model.count for r in parts.collect()}
    return max(
        (abs(found[i, j] - found[i, -1] * found[j, -1] - (i == j)) for i in range(len(varied)) for j in range(len(varied))),
        default=0.0,
    )


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row that takes part and component (from 1, at most ``components``): the key, ``component``,
    ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    Vectors that are missing or empty or hold a missing or non-finite entry are left out, and so are those
    that have not the usual number of entries (the commonest, of equally common ones the largest).
    Missing and repeated keys are carried through row by row; equal vectors get equal results. Other
    columns are not read, so their names cannot clash. A component without variance explains 0, is
    missing in ``whitened`` and does not count in ``identity_error``. ``deviation`` is missing where a
    long cannot hold it. An empty table, or one without a usable vector, gives none.
    """
    key_type = df.schema[key].dataType.simpleString()
    schema = (
        f"`{key}` {key_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    rows, size = _vectors(df, key, vector)
    model = fit(rows, size, components) if size else None
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, size, model)
    wide = len(model.values)

    def projected(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                deviations = _deviations(whole_numbers(part.column(1), size), model)
                places = pa.array(np.repeat(np.arange(part.num_rows), wide))
                whitened = _whitened(deviations, model).ravel()
                total = part.num_rows * wide
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(places),
                        pa.array(np.tile(np.arange(1, wide + 1, dtype=np.int32), part.num_rows)),
                        pa.array(np.full(total, model.count, np.int64)),
                        pa.array(_squared(deviations), pa.int64()).take(places),
                        pa.array(whitened, mask=np.isnan(whitened)),
                        pa.array(np.tile(model.explained, part.num_rows)),
                        pa.array(np.full(total, error)),
                    ],
                    [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(projected, schema)
