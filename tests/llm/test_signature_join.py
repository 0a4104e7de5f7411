"""The signature-tree join against brute force over all pairs of shingle sets."""

import random
import re

import numpy as np
import pytest

from odd_rows import ODD, SF_DIR, docs  # noqa: F401
from stratafold.llm import signature_join as join

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingle_set(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    keys = {}
    for i, (key, _) in enumerate(rows):
        keys.setdefault(root(i), []).append(key)
    smallest = [min((k for k in keys[root(i)] if k is not None), default=None) for i in range(len(rows))]
    return sorted((str(k), len(s), str(c)) for (k, _), s, c in zip(rows, sets, smallest))


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in join.similar_rows(df).collect())


def edited(words, share, rng):
    return [f"x{rng.random()}" if rng.random() < share else w for w in words]


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    assert found(table) == brute([(r.doc_id, r.text) for r in table.collect()])


def groups(rng):
    rows = list(ODD)
    for group in range(4):
        base = [f"g{group}w{n}" for n in range(rng.choice([12, 60, 150]))]
        for n in range(30):
            rows.append((1000 * (group + 1) + n, " ".join(edited(base, rng.choice([0, 0.005, 0.01, 0.02, 0.04]), rng))))
        chain = list(base)
        for n in range(10):
            chain[5 * n + 2 if len(base) > 60 else n] = f"c{n}"
            rows.append((10_000 + 100 * group + n, " ".join(chain)))
    base = [f"w{n}" for n in range(200)]  # links that no hub has part in
    for pair in range(12):
        left = edited(base, 0.05, rng)
        right = list(left)
        right[rng.randrange(200)] = "other"
        rows += [(40_000 + 2 * pair, " ".join(left)), (40_001 + 2 * pair, " ".join(right))]
    lines = [" ".join(f"line{n}w{w}" for w in range(12)) for n in range(8)]  # texts of shared passages only
    rows += [(15_000 + n, " ".join(rng.sample(lines, rng.choice([3, 5, 7])))) for n in range(40)]
    long = [f"l{n}" for n in range(1300)]  # signatures of several widths meet
    rows += [(16_000 + n, " ".join(edited(long, 0.01 if n % 3 else 0.03, rng)[: 1300 - 60 * (n % 5)])) for n in range(25)]
    rows += [(20_000 + n, "same short text") for n in range(30)] + [(30_000, "Same  SHORT text"), (30_001, "one"), (30_002, "one")]
    return rows


@pytest.mark.parametrize("part,broadcast", [(2048, 24 << 20), (7, 0)])
def test_groups_chains_and_odd_rows(docs, monkeypatch, part, broadcast):
    rows = groups(random.Random(part))
    monkeypatch.setattr(join, "PART", part)
    monkeypatch.setattr(join, "BROADCAST", broadcast)
    assert found(docs(rows)) == brute(rows)


def test_no_rows_and_missing_texts(docs):
    assert found(docs([])) == []


def random_sets(rng, count):
    """Sets around some centres, with a component each."""
    centres = [rng.integers(0, 1 << 63, rng.integers(5, 400), dtype=np.uint64) for _ in range(5)]
    sets = []
    for _ in range(count):
        centre = centres[rng.integers(len(centres))]
        kept = centre[rng.random(len(centre)) < rng.choice([1, 0.97, 0.9])]
        sets.append(np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, rng.integers(0, 8), dtype=np.uint64)])))
    return [s if len(s) else np.array([1], np.uint64) for s in sets]


@pytest.mark.parametrize("count,other", [(3, None), (200, None), (300, 5), (5, 300), (290, 17)])
def test_trees_prune_no_link(count, other):
    rng = np.random.default_rng(count)

    def tree(size):
        sets = random_sets(rng, size)
        roots = rng.integers(0, 4, size)
        order = np.lexsort(([len(s) for s in sets], roots))
        sets, roots = [sets[o] for o in order], roots[order]
        bits = np.array([join.folded(join.signature(s)[None, :], 32)[0] for s in sets]).view(np.uint64)
        return sets, roots, join.Tree(bits, np.array([len(s) for s in sets]), roots)

    left = tree(count)
    right = tree(other) if other else None
    x, y, room = join.traverse(left[2], right[2] if right else None)
    met = set(zip(x.tolist(), y.tolist()))
    assert len(met) == len(x)
    second = right or left
    linked = total = 0
    for i, a in enumerate(left[0]):
        for j, b in enumerate(second[0]):
            if (right is None and j <= i) or left[1][i] == second[1][j]:
                assert (i, j) not in met
                continue
            total += 1
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                linked += 1
                assert (i, j) in met
    assert linked <= len(met) < max(total, 4)


def test_linked_sets_share_a_prefix_shingle():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 9, join.COUNTERS)
    for _ in range(300):
        base = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 120), dtype=np.uint64))
        lost = int(len(base) * 0.15 * rng.random())
        a = base[rng.permutation(len(base))[lost:]]
        both = len(a)
        if both and 100 * both >= 85 * len(base):
            assert len(np.intersect1d(join.prefix(np.sort(a), counts), join.prefix(base, counts)))


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    order = rng.sample(range(1000), 300)
    links = list(zip(order[:150], order[1:150])) + [(order[150], b) for b in order[151:]]
    got = {r.id: r.root for r in join.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: min(part) for part in (order[:150], order[150:]) for n in part}
    assert join.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_wide_signatures_fold_to_narrow_ones():
    rng = np.random.default_rng(6)
    for count in (1, 1024, 1025, 5000, 100_000):
        found = np.unique(rng.integers(0, 1 << 63, count, dtype=np.uint64))
        wide = join.signature(found)
        assert len(wide) * 64 == min(max(2048, 1 << (2 * len(found) - 1).bit_length()), 1 << 17)
        plain = np.zeros(2048, np.uint8)
        plain[(found & np.uint64(2047)).astype(np.int64)] = 1
        assert (join.folded(wide[None, :], 32)[0] == np.packbits(plain).view(np.int64)).all()
