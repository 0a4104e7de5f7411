"""Jaccard self-join of word n-gram sets with signature trees.

1. Every text becomes its set of four-word shingles (64-bit hashes). Texts with equal sets are one class.
2. A counting sketch of all shingles, of fixed size, gives every shingle a place in one order, rare ones
   first. Any order keeps the results exact; this one keeps frequent passages out of the prefixes. Two
   sets that link share a shingle among the first ``n - ceil(0.85 n) + 1`` of both.
3. Of the classes that share a prefix shingle the one whose prefix is the commonest is their hub and is
   compared with each: as many pairs as members. Verified links make components.
4. Classes with a common hub that are not one component yet are searched by signature trees. A class's
   signature is a bitmap of its shingles; a tree node holds the OR of its members' bitmaps, their least
   and largest size and the most shingles that any member has beyond its bits. No member of one node can
   share more with one of another than the common bits of both and the lesser of these excesses, which
   prunes pairs of nodes from the top down. Members are ordered by component, so nodes of one and the same
   component fall away at once.
5. Pairs that the trees leave are verified on full sets: first the most promising one of each class, then
   all that still lie between components.

Large trees are split into parts by size and hash. The parts' roots meet in a join on the hub, where the
same bound applies; a task builds the trees of two parts and descends in both.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratafold.llm.wordhash import NO_SPACE, joined, word_hashes
from stratafold.operators.lookup import lookup_join, row_bytes
from stratafold.session import stage

WORDS = 4
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Least and largest bits of a signature; it has at least two bits per shingle up to the largest.
BITS, MOST_BITS = 2048, 1 << 17
#: Counters of the sketch that orders shingles, a power of two.
COUNTERS = 1 << 18
#: Children of a node, and members of a part of a tree.
FAN, PART = 16, 2048
#: Node pairs that are compared at once.
AT_ONCE = 1 << 15
BROADCAST = 24 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SHIFT = np.uint64(64 - (COUNTERS.bit_length() - 1))
_LONGS = BITS // 64


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's four-word shingles; fewer words are one shingle."""
    words = word_hashes((text or "").encode("utf-8", "replace").translate(_LOWER), NO_SPACE)
    if not len(words):
        return words
    if len(words) < WORDS:
        return joined(np.array([len(words)], np.uint64), *[words[n : n + 1] for n in range(len(words))])
    return np.unique(joined(*[words[n : len(words) - WORDS + 1 + n] for n in range(WORDS)]))


def digest(found: np.ndarray) -> bytes | None:
    return blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def signature(found: np.ndarray) -> np.ndarray:
    """The bitmap of a set, as longs. A shingle's place in a wider bitmap is that in a narrower one but for leading bits."""
    bits = BITS
    while bits < min(2 * len(found), MOST_BITS):
        bits *= 2
    held = np.zeros(bits, np.uint8)
    held[(found & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(held).view(np.int64)


def folded(bitmaps: np.ndarray, longs: int) -> np.ndarray:
    """Bitmaps (rows of longs) in the narrower width."""
    return np.bitwise_or.reduce(bitmaps.reshape(len(bitmaps), -1, longs), axis=1)


def prefix(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of which a set must share one with every partner, by rising count and then hash."""
    length = len(found) + (-PERCENT * len(found) // 100) + 1
    return found[np.lexsort((found, counts[(found >> _SHIFT).astype(np.int64)]))[:length]]


def _small(table: DataFrame, most: int | None = None) -> bool:
    """Whether a stored table measures at most ``BROADCAST`` bytes, or ``most``."""
    return (table.agg(F.sum(row_bytes(table))).first()[0] or 0) <= (BROADCAST if most is None else most)


def _hashed_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Staged: ``key``, ``n`` and ``cls`` per row; per task one more row with its part of the sketch."""

    def hashed(batches):
        counts, empty = np.zeros(COUNTERS, np.int64), None
        for batch in batches:
            empty = pa.nulls(1, batch.column(0).type)
            sizes, classes = [], []
            for cell in batch.column(1):
                found = shingles(cell.as_py())
                np.add.at(counts, (found >> _SHIFT).astype(np.int64), 1)
                sizes.append(len(found))
                classes.append(digest(found))
            nothing = pa.nulls(len(sizes), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), nothing, nothing],
                ["key", "n", "cls", "counter", "counted"],
            )
        held = np.flatnonzero(counts)
        if len(held):
            made = [pa.array([x], pa.list_(pa.int64())) for x in (held, counts[held])]
            yield pa.RecordBatch.from_arrays(
                [empty, pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *made], ["key", "n", "cls", "counter", "counted"]
            )

    schema = f"key {df.schema[key].dataType.simpleString()}, n bigint, cls binary, counter array<bigint>, counted array<bigint>"
    return stage(df.select(F.col(key), F.col(text)).mapInArrow(hashed, schema), "hashed-rows")


def _sketch(rows: DataFrame) -> np.ndarray:
    """Counts of all shingles by counter; ``COUNTERS`` numbers at most reach the driver."""
    parts = rows.where("counter IS NOT NULL").select(F.explode(F.arrays_zip("counter", "counted")).alias("x"))
    counts = np.zeros(COUNTERS, np.int64)
    summed = parts.groupBy("x.counter").agg(F.sum("x.counted").alias("n")).toArrow()
    counts[summed.column("counter").to_numpy()] = summed.column("n").to_numpy()
    return counts


def _classes(df: DataFrame, text: str, counts: np.ndarray) -> DataFrame:
    """Staged: ``id``, ``cls``, ``n``, ``signature``, ``narrow`` (the signature in the least width), ``prefix`` and
    ``weight`` (mean count of the prefix) of every distinct set."""
    shared = df.sparkSession.sparkContext.broadcast(counts)

    def described(batches):
        for batch in batches:
            found = [s for s in (shingles(cell.as_py()) for cell in batch.column(0)) if len(s)]
            first = [prefix(s, shared.value) for s in found]
            bitmaps = [signature(s) for s in found]
            weights = [int(1000 * shared.value[(p >> _SHIFT).astype(np.int64)].mean()) for p in first]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([digest(s) for s in found], pa.binary()), pa.array([len(s) for s in found], pa.int64()),
                    pa.array(bitmaps, pa.list_(pa.int64())),
                    pa.array([p.view(np.int64) for p in first], pa.list_(pa.int64())), pa.array(weights, pa.int64()),
                ],
                ["cls", "n", "signature", "prefix", "weight"],
            )

    schema = "cls binary, n bigint, signature array<bigint>, prefix array<bigint>, weight bigint"
    rows = df.select(F.col(text)).mapInArrow(described, schema)
    distinct = rows.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("n", "signature", "prefix", "weight")])
    whole = F.expr(f"transform(sequence(0, {_LONGS - 1}), i -> aggregate(sequence(i, size(signature) - 1, {_LONGS}), 0L, (s, k) -> s | signature[k]))")
    narrow = F.when(F.size("signature") == _LONGS, F.col("signature")).otherwise(whole)
    return stage(distinct.withColumn("narrow", narrow).withColumn("id", F.monotonically_increasing_id()), "classes")


def _hubs(classes: DataFrame) -> DataFrame:
    """Staged: ``id`` and ``hub`` of classes that share a prefix shingle. Classes that share one have a hub in
    common, which is also its own."""
    # equal weights are told apart by a hash, the same for all shingles
    order = F.least("weight", F.lit((1 << 42) - 1)) * (1 << 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    listed = classes.select("id", order.alias("order"), F.explode("prefix").alias("token"))
    groups = listed.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.max_by("id", "order").alias("hub")).where("size > 1")
    groups = stage(groups.select("token", "hub"), "token-hubs")
    members = listed.join(F.broadcast(groups) if _small(groups, 3 * BROADCAST) else groups, "token")
    return stage(members.select("id", "hub").distinct(), "hub-members")


def _needed(n: Column, m: Column) -> Column:
    """Least intersection of linked sets."""
    return F.ceil(F.lit(PERCENT) * (n + m) / (100 + PERCENT))


def _sizes_fit(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    return (100 * high >= PERCENT * other_low) & (100 * other_high >= PERCENT * low)


def _sets(df: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """Staged full sets of the classes in ``wanted`` (``id``, ``cls``, ``least`` key): ``w`` (the id) and ``shingles``.

    Sets are made again from the texts. If the wanted classes are few enough to be broadcast, only rows
    with one of their smallest keys are hashed, and a set occurs as often as such a key does; otherwise
    once. Texts are never shuffled for it.
    """

    def gathered(batches):
        for batch in batches:
            found = [s for s in (shingles(cell.as_py()) for cell in batch.column(0)) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest(s) for s in found], pa.binary()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))],
                ["cls", "shingles"],
            )

    few = _small(wanted)
    rows = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.col(text).alias("text"))
    if few:
        names = wanted.select(F.coalesce(F.col("least").cast("string"), F.lit("")).alias("name")).distinct()
        rows = rows.join(F.broadcast(names), "name", "left_semi")
    made = rows.select("text").mapInArrow(gathered, "cls binary, shingles array<bigint>")
    ids = wanted.select("cls", "id")
    kept = made.join(F.broadcast(ids) if few else ids, "cls").select(F.col("id").alias("w"), "shingles")
    return stage(kept if few else kept.groupBy("w").agg(F.first("shingles").alias("shingles")), "shingle-sets")


def _checked(pairs: DataFrame, df: DataFrame, key: str, text: str, classes: DataFrame, keyed: DataFrame) -> DataFrame:
    """Staged links among ``pairs`` (``a``, ``b``): those whose full sets meet the threshold.

    ``b`` may stand in very many pairs; its set is then repeated for lanes of them. Sets are shuffled at
    every size, so that small and large tables go the same way.
    """
    names = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = stage(classes.select("id", "cls").join(names, "id").join(keyed.select("cls", "least"), "cls"), "wanted-sets")
    sets = _sets(df, key, text, wanted)
    own = sets.select(F.col("w").alias("a"), F.col("shingles").alias("own"))
    few = _small(pairs)
    left = own.join(F.broadcast(pairs) if few else pairs, "a")
    named = pairs.select(F.col("b").alias("w")).distinct()
    partners = sets.join(F.broadcast(named) if few else named, "w", "left_semi")
    partners = partners.withColumnRenamed("shingles", "other")
    both = lookup_join(left, partners, {"w": F.col("b")}, size=1, broadcast_bytes=0, population=pairs, spread="a")
    common = F.size(F.array_intersect("own", "other"))
    linked = 100 * common >= PERCENT * (F.size("own") + F.size("other") - common)
    return stage(both.where(linked).select("a", "b").distinct(), "verified-links")


def components(links: DataFrame) -> DataFrame:
    """Staged: ``id`` and ``root`` (the smallest id of its component) of every class that has a link.

    In each round a class, and the one it points to, take the least that their neighbours point to, and
    then what that points to; a round is one job. Distances shrink by half or more a round. Only least values are aggregated, so a class with very many links is a row per task.
    """
    edges = links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = stage(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    found = edges.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("u")).alias("root"))
    before = None
    while True:
        found = stage(found, "components")
        now = tuple(found.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("id", "root"))).first())
        if now == before:
            return found
        before = now
        point = lambda name, value: found.select(F.col("id").alias(name), F.col("root").alias(value))
        met = edges.join(point("u", "own"), "u").join(point("v", "other"), "v").select("u", "own", "other")
        offers = met.select(F.col("u").alias("id"), F.col("other").alias("root")).unionByName(
            met.select(F.col("own").alias("id"), F.col("other").alias("root"))
        ).unionByName(found.select("id", "root"))
        least = offers.groupBy("id").agg(F.min("root").alias("root"))
        found = least.join(point("root", "beyond"), "root", "left").select("id", F.least("root", F.coalesce("beyond", "root")).alias("root"))


class Tree:
    """Levels of nodes over members ordered by component and size; level 0 holds the members.

    ``bits``: OR of the bitmaps; ``low``, ``high``: least and largest size; ``excess``: most shingles that a
    member has beyond its bits; ``first``, ``last``: least and largest component.
    """

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, roots: np.ndarray) -> None:
        excess = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, sizes, sizes, excess, roots, roots)]
        while len(self.levels[-1][1]) > FAN:
            starts = np.arange(0, len(self.levels[-1][1]), FAN)
            folds = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
            self.levels.append(tuple(fold.reduceat(part, starts, axis=0) for fold, part in zip(folds, self.levels[-1])))

    def at(self, level: int):
        """The nodes of a level; those of the top beyond it."""
        return self.levels[min(level, len(self.levels) - 1)]

    def below(self, nodes: np.ndarray, level: int) -> np.ndarray:
        """Per node its places at ``level``, the one below or still its own; -1 fills the rest up."""
        if level >= len(self.levels) - 1:
            return nodes[:, None]
        places = nodes[:, None] * FAN + np.arange(FAN)[None, :]
        return np.where(places < len(self.levels[level][1]), places, -1)


def possible(one, x: np.ndarray, two, y: np.ndarray) -> np.ndarray:
    """Room (largest possible overlap less the least needed) of node pairs; negative if they hold no link
    between components."""
    bits, low, high, excess, first, last = ([part[at] for part, at in ((a, x), (b, y))] for a, b in zip(one, two))
    overlap = np.bitwise_count(bits[0] & bits[1]).sum(axis=1, dtype=np.int64) + np.minimum(*excess)
    overlap = np.minimum(overlap, np.minimum(*high))
    room = overlap - -(-PERCENT * (low[0] + low[1]) // (100 + PERCENT))
    apart = (100 * high[0] < PERCENT * low[1]) | (100 * high[1] < PERCENT * low[0])
    one_component = (first[0] == last[0]) & (first[1] == last[1]) & (first[0] == first[1])
    return np.where(apart | one_component, -1, room)


def traverse(left: Tree, right: Tree | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Member pairs of different components that can link, and their room. Without ``right``, pairs within ``left``."""
    own = right is None
    right = left if own else right
    level = max(len(left.levels), len(right.levels)) - 1
    # a lower tree waits at its top until the other one has come down to it
    x, y = (places.ravel() for places in np.indices((len(left.at(level)[1]), len(right.at(level)[1]))))
    while True:
        if own:
            kept = x < y if level == 0 else x <= y
            x, y = x[kept], y[kept]
        parts = range(0, max(len(x), 1), AT_ONCE)
        room = np.concatenate([possible(left.at(level), x[s : s + AT_ONCE], right.at(level), y[s : s + AT_ONCE]) for s in parts])
        x, y, room = x[room >= 0], y[room >= 0], room[room >= 0]
        if level == 0:
            return x, y, room
        level -= 1
        one, two = left.below(x, level), right.below(y, level)
        x, y = np.repeat(one, two.shape[1], axis=1).ravel(), np.tile(two, (1, one.shape[1])).ravel()
        there = (x >= 0) & (y >= 0)
        x, y = x[there], y[there]


def _best(a: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Marks the pair with most room of every class."""
    order = np.lexsort((-room, a))
    new = np.ones(len(order), bool)
    new[1:] = a[order][1:] != a[order][:-1]
    marked = np.zeros(len(order), bool)
    marked[order[new]] = True
    return marked


def _tree_members(hubs: DataFrame, found: DataFrame, facts: DataFrame) -> DataFrame:
    """Staged members of hubs whose classes are not one component: ``hub``, ``id``, ``root``, ``n``, ``signature``,
    ``narrow`` and ``part``: the width of the signature and, for a hub of more than ``PART`` members, size class and
    hash."""
    rooted = hubs.join(found, "id", "left").select("hub", "id", F.coalesce("root", "id").alias("root"))
    rooted = stage(rooted, "rooted-members")
    counted = rooted.groupBy("hub").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("members"))
    # the pair of a hub and one other has been compared
    mixed = counted.where("low <> high AND members > 2").select("hub", F.ceil(F.col("members") / PART).alias("lanes"))
    described = rooted.join(mixed, "hub").join(facts, "id")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT)))
    # all signatures of a part have one width; it bounds the sizes that share a part
    place = F.size("signature") * 1000 + F.when(F.col("lanes") > 1, band).otherwise(0)
    part = place * F.col("lanes") + F.pmod(F.xxhash64("id"), F.col("lanes"))
    return stage(described.withColumn("part", part.cast("bigint")).drop("lanes"), "tree-members")


def _part_pairs(parted: DataFrame) -> DataFrame:
    """Pairs of parts (``hub``, ``p``, ``q``) whose roots can hold a link between components."""
    bits = [F.bit_or(F.get("narrow", F.lit(n))).alias(f"b{n}") for n in range(_LONGS)]
    ones = F.expr("aggregate(narrow, 0, (s, x) -> s + bit_count(x))")
    nodes = parted.withColumn("over", F.col("n") - ones).groupBy("hub", "part").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("over").alias("excess"), F.min("root").alias("first"), F.max("root").alias("last"), *bits
    )
    nodes = stage(nodes, "tree-parts")
    left = nodes.select(F.col("hub"), *[F.col(c).alias(f"l_{c}") for c in nodes.columns if c != "hub"])
    right = nodes.select(F.col("hub").alias("r_hub"), *[F.col(c).alias(f"r_{c}") for c in nodes.columns if c != "hub"])
    both = left.join(right, (F.col("hub") == F.col("r_hub")) & (F.col("l_part") <= F.col("r_part")))
    common = sum((F.bit_count(F.col(f"l_b{n}").bitwiseAND(F.col(f"r_b{n}"))) for n in range(_LONGS)), F.lit(0))
    overlap = F.least(common + F.least("l_excess", "r_excess"), "l_high", "r_high")
    mixed = F.least("l_first", "r_first") < F.greatest("l_last", "r_last")
    fits = _sizes_fit(F.col("l_low"), F.col("l_high"), F.col("r_low"), F.col("r_high"))
    met = both.where(mixed & fits & (overlap >= _needed(F.col("l_low"), F.col("r_low"))))
    return met.select("hub", F.col("l_part").alias("p"), F.col("r_part").alias("q"))


def _searched(parted: DataFrame) -> DataFrame:
    """Staged pairs (``a``, ``b``) of different components that signatures cannot keep apart; ``promising``
    marks the one with most room of each class and tree."""
    pairs = stage(_part_pairs(parted), "part-pairs")
    named = pairs.select("hub", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("part"))
    rows = parted.join(F.broadcast(named) if _small(pairs) else named, ["hub", "part"]).select("hub", "p", "q", "part", "id", "root", "n", "signature")

    def met(table: pa.Table) -> pa.Table:
        parts = table.column("part").to_numpy()
        roots, sizes, ids = (table.column(c).to_numpy() for c in ("root", "n", "id"))
        bitmaps = table.column("signature").combine_chunks()
        held, places = [], []
        for part in np.unique(parts):
            at = np.flatnonzero(parts == part)
            places.append(at[np.lexsort((ids[at], sizes[at], roots[at]))])
            longs = bitmaps.take(pa.array(places[-1])).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            held.append(longs.view(np.uint64).reshape(len(at), -1))
        narrowest = min(one.shape[1] for one in held)
        trees = [Tree(folded(one, narrowest), sizes[at], roots[at]) for one, at in zip(held, places)]
        x, y, room = traverse(*trees)
        x, y = places[0][x], places[-1][y]
        marked = _best(ids[x], room) | _best(ids[y], room)
        return pa.table({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y]), "promising": marked})

    found = rows.groupBy("hub", "p", "q").applyInArrow(met, "a bigint, b bigint, promising boolean")
    return stage(found.groupBy("a", "b").agg(F.max("promising").alias("promising")), "tree-pairs")


def _hub_pairs(hubs: DataFrame, facts: DataFrame) -> DataFrame:
    """Staged pairs (``a``, ``b``) of classes and their hubs that sizes and signatures cannot keep apart."""
    columns = {"n": "n", "signature": "s", "narrow": "t"}
    left, right = (facts.select(F.col("id").alias(c), *[F.col(name).alias(f"{short}_{c}") for name, short in columns.items()]) for c in "ab")
    pairs = hubs.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    fits = _sizes_fit(F.col("n_a"), F.col("n_a"), F.col("n_b"), F.col("n_b"))
    sized = pairs.join(left.select("a", "n_a"), "a").join(right.select("b", "n_b"), "b").where(fits)
    both = stage(sized, "sized-pairs").drop("n_a", "n_b").join(left, "a").join(right, "b")

    def overlap(s: str) -> Column:
        common = F.expr(f"aggregate(zip_with({s}_a, {s}_b, (x, y) -> bit_count(x & y)), 0, (s, x) -> s + x)")
        excess = [F.col(f"n_{c}") - F.expr(f"aggregate({s}_{c}, 0, (t, x) -> t + bit_count(x))") for c in "ab"]
        return common + F.least(*excess)

    most = F.when(F.size("s_a") == F.size("s_b"), overlap("s")).otherwise(overlap("t"))
    return stage(both.where(most >= _needed(F.col("n_a"), F.col("n_b"))).select("a", "b"), "likely-pairs")


def _stars(found: DataFrame) -> DataFrame:
    """Links that hold the same components together."""
    return found.select(F.col("id").alias("a"), F.col("root").alias("b"))


def _between(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Staged pairs whose classes are in different components."""
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("id").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    return stage(pairs.where(apart).select("a", "b"), "remaining-pairs")


def similar_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its key, ``n_shingles`` and ``component_id``.

    ``component_id`` is the smallest key of all rows that are linked directly or through others. A text
    without words, or a missing one, is linked with nothing and names itself. Rows without a key are
    linked like others but name no component; one that is linked with no keyed row has a missing
    ``component_id``. Rows that repeat a key are judged one by one. Only these two columns are read; an
    empty table gives none.
    """
    rows = _hashed_rows(df, key, text)
    keyed = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("copies"))
    keyed = stage(keyed, "class-keys")
    classes = _classes(df, text, _sketch(rows))
    facts = classes.select("id", "n", "signature", "narrow")
    hubs = _hubs(classes)
    found = components(_checked(_hub_pairs(hubs, facts), df, key, text, classes, keyed))
    pairs = _searched(_tree_members(hubs, found, facts))
    promising = pairs.where("promising").select("a", "b")
    if not promising.isEmpty():
        found = components(_stars(found).unionByName(_checked(promising, df, key, text, classes, keyed)))
        rest = _between(pairs.where("NOT promising").select("a", "b"), found)
        if not rest.isEmpty():
            found = components(_stars(found).unionByName(_checked(rest, df, key, text, classes, keyed)))
    return _named_rows(rows.where("counter IS NULL").select("key", "n", "cls"), classes, keyed, found, key)


def _named_rows(rows: DataFrame, classes: DataFrame, keyed: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Bring the components' smallest keys back to all rows."""
    linked = stage(classes.select("id", "cls").join(found, "id").join(keyed, "cls").select("cls", "root", "least"), "linked-classes")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = linked.join(smallest, "root").select("cls", "component")
    alone = keyed.where("copies > 1").join(linked.select("cls"), "cls", "left_anti")
    table = stage(named.unionByName(alone.select("cls", F.col("least").alias("component"))), "named-components")
    named = table.select(F.col("cls").alias("w"), "component", F.lit(True).alias("named"))
    both = lookup_join(rows, named, {"w": F.col("cls")}, broadcast_bytes=BROADCAST, population=rows)
    component = F.when(F.col("named"), F.col("component")).otherwise(F.col("key"))
    return both.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
