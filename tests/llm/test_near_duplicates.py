"""Near duplicates against brute force over all pairs of shingle sets."""

import random

import numpy as np
import pytest

from odd_rows import ODD, SF_DIR, docs  # noqa: F401
from stratafold.llm import near_duplicates as near
from stratafold.llm.wordhash import LETTERS, NO_SPACE, word_hashes

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


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
    least = {}
    for i, (key, _) in enumerate(rows):
        least.setdefault(root(i), []).append(key)
    smallest = [min((k for k in least[root(i)] if k is not None), default=None) for i in range(len(rows))]
    return sorted(((str(k), len(s), str(c), k == c) for (k, _), s, c in zip(rows, sets, smallest)))


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near.near_duplicates(df).collect())


def edited(words, share, rng):
    return [f"x{rng.random()}" if rng.random() < share else w for w in words]


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    assert found(table) == brute([(r.doc_id, r.text) for r in table.collect()])


def test_groups_chains_and_odd_rows(docs):
    rng = random.Random(5)
    rows = list(ODD)
    for group in range(4):
        base = [f"g{group}w{n}" for n in range(rng.choice([12, 60, 150]))]
        for n in range(25):
            rows.append((1000 * (group + 1) + n, " ".join(edited(base, rng.choice([0, 0.005, 0.01, 0.02, 0.04]), rng))))
        chain = list(base)
        for n in range(10):
            chain[5 * n + 2 if len(base) > 60 else n] = f"c{n}"
            rows.append((10_000 + 100 * group + n, " ".join(chain)))
    rows += [(20_000 + n, "same short text") for n in range(30)] + [(30_000, "Same  SHORT text"), (30_001, "one"), (30_002, "one")]
    assert found(docs(rows)) == brute(rows)


@pytest.mark.parametrize("few", [0, 1000])
def test_links_inside_small_and_large_groups(docs, monkeypatch, few):
    """Pairs that no hub shows are found pair by pair in small groups and by the join in large ones."""
    joined = []
    real = near._hidden_pairs
    monkeypatch.setattr(near, "FEW", few)
    monkeypatch.setattr(near, "_hidden_pairs", lambda rooted, sets: (joined.append(rooted.count()), real(rooted, sets))[1])
    rng = random.Random(3)
    base = [f"w{n}" for n in range(120)]
    rows = []
    for pair in range(8):
        left = edited(base, 0.03, rng)
        right = list(left)
        right[rng.randrange(120)] = "other"
        rows += [(2 * pair, " ".join(left)), (2 * pair + 1, " ".join(right))]
    assert found(docs(rows)) == brute(rows)
    assert (joined[0] == 0) == (few > 0)


def test_one_set_per_class_of_repeated_keys(docs):
    one, other = (" ".join(f"{c}{n}" for n in range(30)) for c in "ab")
    df = docs([(1, one), (1, other), (0, other), (None, one), (2, "c " + one)])
    rows = near._hashed_rows(df, "doc_id", "text").localCheckpoint()
    wanted = rows.groupBy("cls").agg(near.F.min("key").alias("key")).localCheckpoint()
    sets = near._sets(df, "doc_id", "text", rows, wanted)
    assert sorted(r.cls for r in sets.collect()) == sorted(r.cls for r in wanted.collect())


def test_links_hidden_from_the_centres_are_found(docs):
    """Without any registers to compare, only the similarity join can find links beyond the hubs'."""
    rng = random.Random(9)
    base = [f"w{n}" for n in range(200)]
    rows = []
    for pair in range(12):
        left = edited(base, 0.05, rng)
        right = list(left)
        right[rng.randrange(200)] = "other"
        rows += [(2 * pair, " ".join(left)), (2 * pair + 1, " ".join(right))]
    rows.append((100, " ".join(base)))
    assert found(docs(rows)) == brute(rows)


def test_keep_one_keeps_columns_and_one_row(docs):
    text = " ".join(f"w{n}" for n in range(50))
    df = docs([(3, text), (3, text), (5, text.upper()), (6, "else"), (6, "else"), (7, None), (None, None)])
    kept = near.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "6", "7", "None"]
    assert near.keep_one(docs([])).collect() == []


def test_components_of_paths_and_stars(spark):
    def key(n):
        return n.to_bytes(4, "big")

    rng = random.Random(1)
    order = rng.sample(range(1000), 300)
    links = [(key(a), key(b)) for a, b in zip(order[:150], order[1:150])] + [(key(order[150]), key(b)) for b in order[151:]]
    got = {r.cls: r.root for r in near.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    for part in (order[:150], order[150:]):
        assert {bytes(got[key(n)]) for n in part} == {key(min(part))}


@pytest.mark.parametrize("shared,own", [(80, 10), (400, 300), (30, 90), (1000, 0)])
def test_estimates_are_unbiased(shared, own):
    rng = np.random.default_rng(shared)
    errors = []
    for _ in range(60):
        s, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (shared, own, own))
        rows = [near.registers(np.concatenate([s, x]))[None, :] for x in (a, b)]
        size = np.array([shared + own])
        errors.append(near.estimate(*rows, size, size)[0] - shared / (shared + 2 * own))
    assert abs(np.mean(errors)) < 0.02


def test_registers_are_leading_zeros_and_mantissa():
    values = np.array([1 << 63, (1 << 63) - 1, (1 << 60) | (1 << 59), 2**64 - 1, 1 << 40], np.uint64)
    expected = []
    for v in values.tolist():
        zeros = 64 - v.bit_length()
        expected.append(zeros << 10 | (((v << (zeros + 1)) & (2**64 - 1)) >> 54))
    assert near.compress(values).tolist() == expected


def test_word_hashes_do_not_depend_on_place_or_slices(monkeypatch):
    import stratafold.llm.wordhash as wordhash

    text = "Alpha  beta\tgamma alpha été été\nlooooooooooong beta".encode()
    whole = word_hashes(text, NO_SPACE)
    assert whole[1] == whole[-1] and whole[4] == whole[5] and len(set(whole.tolist())) == 6
    for size in (1, 3, 7):
        monkeypatch.setattr(wordhash, "SLICE", size)
        assert np.array_equal(word_hashes(text, NO_SPACE), whole)
        assert len(word_hashes(b",,a-b,, c", LETTERS)) == 3
