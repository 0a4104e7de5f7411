"""Whitening against exact integer arithmetic and a dense eigenvalue solver."""

import math

import numpy as np
import pytest

from odd_rows import SF_DIR
from stratafold.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n string, key string, vector string, i int"


def usable(rows):
    kept = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in kept]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s), default=0)
    return [(k, v) for k, v in kept if len(v) == size]


def brute(rows):
    """Keys with exact numbers, the covariance and its eigenvalues."""
    kept = usable(rows)
    x = [[math.floor(64 * float(np.float32(c))) + 1000000 for c in v] for _, v in kept]
    n, size = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(size)]
    centred = [[n * r[d] - sums[d] for d in range(size)] for r in x]
    covariance = np.array([[sum(c[i] * c[j] for c in centred) / n**3 for j in range(size)] for i in range(size)])
    deviations = [sum(c * c for c in row) for row in centred]
    return [k for k, _ in kept], np.array(centred, float) / n, covariance, deviations


def check(df, rows):
    keys, centred, covariance, deviations = brute(rows)
    found = sorted(df.collect(), key=lambda r: r.component)
    values = np.linalg.eigvalsh(covariance)[::-1]
    wide = min(32, len(values))
    assert len(found) == wide * len(keys)
    assert sorted(map(str, {(r.vec_id, r.deviation) for r in found})) == sorted(map(str, set(zip(keys, deviations))))
    for place in range(wide):
        part = [r for r in found if r.component == place + 1]
        assert {r.n for r in part} == {len(keys)} and len({r.identity_error for r in found}) == 1
        if values[place] < 1e-9 * values.sum():
            assert {r.whitened for r in part} == {None}
            continue
        assert part[0].explained == pytest.approx(values[place] / values.sum(), rel=1e-9)
        w = np.array([r.whitened for r in part])
        assert abs((w * w).mean() - 1) < 1e-6 and abs(w.mean()) < 1e-6
    assert all(r.identity_error < 1e-4 for r in found)
    return found, keys, centred, covariance


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    found, keys, centred, covariance = check(whitening.whiten(table), rows)
    values, vectors = np.linalg.eigh(covariance)
    by = {(r.vec_id, r.component): r.whitened for r in found}
    for component in (1, 2, 32):
        mine = np.array([by[k, component] for k in keys])
        expected = centred @ vectors[:, -component] / values[-component] ** 0.5
        assert min(abs(mine - expected).max(), abs(mine + expected).max()) < 1e-9


def test_odd_rows_and_partitions(spark):
    rng = np.random.default_rng(3)
    rows = [(n % 40, [float(c) for c in rng.normal(size=5) * [1, 10, 0.1, 0, 300]]) for n in range(300)]
    rows += [(1, None), (None, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, []), (3, [1.0, None, 3.0, 4.0, 5.0]), (4, [float("nan")] * 5), (5, [float("-inf"), 1.0, 2.0, 3.0, 4.0]), (6, [1.0, 2.0])]
    rows += [(7, rows[0][1])] * 50
    build = lambda part: spark.createDataFrame([(k, v, "x", "x", "x", "x", 1) for k, v in part], SCHEMA)
    one, *_ = check(whitening.whiten(build(rows).coalesce(1)), rows)
    many, *_ = check(whitening.whiten(build(rows).repartition(7)), rows)
    assert {(r.vec_id, r.deviation, r.component) for r in one} == {(r.vec_id, r.deviation, r.component) for r in many}
    assert whitening.whiten(build([])).collect() == []
    assert whitening.whiten(build([(1, None), (2, [])])).collect() == []
    single = whitening.whiten(build([(1, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in single] == [(1, 0, None, 0.0, 0.0)] * 2


@pytest.mark.parametrize("scale", [1.0, 1e6, 2.0**55])
def test_sums_are_exact(scale):
    rng = np.random.default_rng(int(np.log2(scale)))
    x = np.floor(rng.normal(size=(201, 6)) * scale * [1, 2, 3, 100, 0, 50]).astype(np.int64)
    sums, products = whitening.slice_sums(x)
    exact = x.astype(object)
    assert (sums.astype(object) == exact.sum(axis=0)).all()
    upper = np.triu_indices(6)
    assert (products.astype(object)[upper] == exact.T.dot(exact)[upper]).all()


def test_planes_hold_every_bit():
    x = np.array([[5, 0], [2, 1], [7, 0]] * 50, np.uint64)
    planes, dimensions, bits = whitening.bit_planes(x)
    assert list(zip(dimensions.tolist(), bits.tolist())) == [(0, 0), (0, 1), (0, 2), (1, 0)]
    assert np.bitwise_count(planes).sum(axis=1).tolist() == [100, 100, 100, 50]


def test_numbers_beyond_longs(spark):
    df = spark.createDataFrame([(n, [float(n) * 2.0**100, float(n % 3)]) for n in range(9)], "vec_id long, embedding array<float>")
    found = whitening.whiten(df).collect()
    assert len(found) == 18 and {r.n for r in found} == {9}
    assert sum(r.deviation is None for r in found) >= 9
