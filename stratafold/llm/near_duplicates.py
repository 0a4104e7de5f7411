"""Near duplicates by HyperMinHash, verified on full shingle sets.

1. Every text becomes its set of five-word shingles (64-bit hashes). Texts with equal sets are one
   class, so copies are one row from here on, however many there are.
2. A class has ``BUCKETS`` registers. A register keeps, of the smallest hash of its bucket, the number
   of leading zeros and ``MANTISSA`` bits after them. Every bucket has its own hash of the whole set:
   buckets that share the elements out would be empty for short texts.
3. Bands of registers give candidate groups. In each group the class that is most central (in most
   and largest groups) is compared with every other member: as many pairs as members. The number of
   equal registers, corrected for accidental collisions, estimates the similarity; pairs that can
   reach the threshold are verified on their sets, and links make components.
4. Groups that still hold several components may hide links between members that were not compared.
   In groups of up to ``FEW`` classes every pair of two components is estimated and verified like
   the pairs before, with a wider margin. The members of larger groups go through an exact similarity
   join: shingles ordered by frequency, prefix, length and positional filters, never two members of
   one component.

With 24 bands of 5 registers, a pair at the threshold of 0.85 shares no group with a probability of
1e-6; of estimates with the wider margin one in 1e8 is too low. Everything else is exact.
"""

from __future__ import annotations

import uuid
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratafold.llm.wordhash import NO_SPACE, joined, mix, word_hashes
from stratafold.operators.lookup import lookup_join, quoted, row_bytes
from stratafold.session import stage

WORDS = 5
BANDS, ROWS = 24, 5
BUCKETS = BANDS * ROWS
MANTISSA = 10
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Pairs are verified unless their estimate is this many standard deviations below the threshold.
DEVIATIONS = 5.0
#: Groups of up to this many classes are compared pair by pair; a class is in ``BANDS`` of them at most.
FEW = 16
FEW_DEVIATIONS = 6.5
BROADCAST = 24 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_FACTORS = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 63, BUCKETS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of a text's five-word shingles; fewer words are one shingle."""
    words = word_hashes(text.encode("utf-8", "replace").translate(_LOWER), NO_SPACE)
    if not len(words):
        return words
    if len(words) < WORDS:
        whole = np.array([len(words)], np.uint64)
        return joined(whole, *[words[n : n + 1] for n in range(len(words))])
    return np.unique(joined(*[words[n : len(words) - WORDS + 1 + n] for n in range(WORDS)]))


def registers(found: np.ndarray) -> np.ndarray:
    """The compressed minima of a set that is not empty, 16 bits each."""
    least = np.full(BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096]
        np.minimum(least, (_FACTORS[:, None] * part[None, :]).min(axis=1), out=least)
    return compress(least)


def compress(values: np.ndarray) -> np.ndarray:
    """Leading zeros above ``MANTISSA`` bits that follow the first one."""
    zeros = (53 - np.frexp((values >> np.uint64(11)).astype(np.float64))[1]).astype(np.uint64)  # exact: 53 bits
    rest = (values << zeros) << np.uint64(1)
    return ((zeros << np.uint64(MANTISSA)) | (rest >> np.uint64(64 - MANTISSA))).astype(np.uint16)


def accidental(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of two disjoint sets of ``n`` and ``m`` elements are equal."""
    total = np.zeros(len(n))
    size = (n + m - 1).astype(float)
    for zeros in range(40):
        low, high = 2.0 ** -(zeros + 1), 2.0**-zeros
        with np.errstate(divide="ignore"):
            total += 2.0 ** -(zeros + 1 + MANTISSA) * (np.exp(size * np.log1p(-low)) - np.exp(size * np.log1p(-min(high, 1.0))))
    return np.minimum(0.999, total * n * m / size)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates from register rows, corrected for accidental collisions."""
    chance = accidental(n.astype(float), m.astype(float))
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def _hashed_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Per row: key, ``mark`` (hash of the text), ``n``, ``cls`` and the registers (missing if no words)."""
    key_type = df.schema[key].dataType.simpleString()

    def hashed(batches):
        for batch in batches:
            sizes, classes, kept = [], [], []
            for cell in batch.column(2):
                found = shingles(cell.as_py() or "")
                sizes.append(len(found))
                classes.append(blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                kept.append(registers(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(kept, pa.binary())],
                ["key", "mark", "n", "cls", "registers"],
            )

    rows = df.select(F.col(key), F.xxhash64(F.col(text)).alias("mark"), F.col(text))
    return rows.mapInArrow(hashed, f"key {key_type}, mark bigint, n bigint, cls binary, registers binary")


def _side(table: DataFrame, name: str) -> DataFrame:
    """A staged join side, marked for broadcast if it measures at most ``BROADCAST`` bytes."""
    staged = stage(table, name)
    size = staged.agg(F.sum(row_bytes(staged))).first()[0] or 0
    return F.broadcast(staged) if size <= BROADCAST else staged


def _sets(df: DataFrame, key: str, text: str, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Full sets of the classes in ``wanted`` (``cls``, ``key`` of one of its rows), one row each.

    ``rows`` are the hashed rows. Only sets of keys that several rows have can stand there twice; the
    others are not shuffled.
    """
    name = F.coalesce(F.col("key").cast("string"), F.lit(""))
    held = rows.select(name.alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    asked = wanted.select("cls", name.alias("_k")).join(_side(held, "repeated-keys"), "_k", "left")
    asked = stage(asked.select("cls", "_k", F.col("_n").isNotNull().alias("repeated")), "wanted")
    names = asked.select("_k", F.lit(True).alias("_wanted"), F.col("repeated").alias("_repeated")).distinct()
    texts = df.select(F.col(key), F.col(text).alias("_text"))
    near = lookup_join(texts, stage(names, "wanted-keys"), {"_k": F.coalesce(F.col(key).cast("string"), F.lit(""))}, broadcast_bytes=BROADCAST, population=texts)

    def gathered(batches):
        for batch in batches:
            found = [shingles(cell.as_py() or "") for cell in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([blake2b(f.tobytes(), digest_size=16).digest() if len(f) else None for f in found], pa.binary()),
                    pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64())),
                    batch.column(1),
                ],
                ["cls", "shingles", "repeated"],
            )

    made = near.where("_wanted").select("_text", F.col("_repeated").alias("repeated")).mapInArrow(gathered, "cls binary, shingles array<bigint>, repeated boolean")
    exact = stage(made.join(_side(asked.select("cls", "repeated"), "wanted-classes"), ["cls", "repeated"], "left_semi"), "shingle-sets")
    again = exact.where("repeated").groupBy("cls").agg(F.first("shingles").alias("shingles"))
    return exact.where("NOT repeated").select("cls", "shingles").unionByName(stage(again, "repeated-sets"))


def _linked(common: Column, n: Column, m: Column) -> Column:
    return 100 * common >= PERCENT * (n + m - common)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (``a``, ``b``) whose full sets meet the threshold. ``b`` may stand in very many pairs."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("own")).join(_side(pairs, "pairs"), "a")
    named = _side(pairs.select(F.col("b").alias("cls")).distinct(), "hub-names")
    hubs = sets.join(named, "cls", "left_semi").withColumnRenamed("shingles", "other")
    both = lookup_join(left, stage(hubs, "hub-sets"), {"cls": F.col("b")}, broadcast_bytes=BROADCAST, population=pairs, spread="a")
    common = F.size(F.array_intersect("own", "other"))
    return both.where(_linked(common, F.size("own"), F.size("other"))).select("a", "b")


def _estimated(pairs: DataFrame, classes: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """Pairs whose sizes and registers can belong to a link."""
    facts = classes.select("cls", "n", "registers")
    left = facts.select(F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a")).join(_side(pairs, "pairs"), "a")
    hubs = facts.join(_side(pairs.select(F.col("b").alias("cls")).distinct(), "hub-names"), "cls", "left_semi").select(
        "cls", F.col("n").alias("n_b"), F.col("registers").alias("r_b")
    )
    both = lookup_join(left, stage(hubs, "hubs"), {"cls": F.col("b")}, broadcast_bytes=BROADCAST, population=pairs, spread="a")
    sized = both.where((100 * F.col("n_a") >= PERCENT * F.col("n_b")) & (100 * F.col("n_b") >= PERCENT * F.col("n_a")))
    least = PERCENT / 100 - deviations * (PERCENT / 100 * (1 - PERCENT / 100) / BUCKETS) ** 0.5

    def passed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [
                np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint16).reshape(-1, BUCKETS) for name in ("r_a", "r_b")
            ]
            sizes = [batch.column(name).to_numpy() for name in ("n_a", "n_b")]
            good = pa.array(estimate(*rows, *sizes) >= least)
            yield batch.select(["a", "b"]).filter(good)

    return sized.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(passed, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """``cls`` and ``root`` (its component's smallest class) of every class that has a link.

    Alternates between hanging larger neighbours and then all neighbours below the smallest one, until
    every class hangs on its root; the number of rounds grows with the logarithm of a component's
    width. Only minima are aggregated, so a class with very many links is one row per task.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        hung = lookup_join(both, least.withColumnRenamed("u", "w"), {"w": F.col("u")}, broadcast_bytes=BROADCAST, population=both)
        large = stage(hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large-star")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        joined_ = lookup_join(large, low.withColumnRenamed("u", "w"), {"w": F.col("u")}, broadcast_bytes=BROADCAST, population=large)
        small = joined_.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = stage(small.where("u <> v").distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = edges.select(F.col("v").alias("cls")).distinct()
    return stage(edges.select(F.col("u").alias("cls"), F.col("v").alias("root")).unionByName(roots.select("cls", F.col("cls").alias("root"))), "components")


def _rooted(members: DataFrame, found: DataFrame) -> DataFrame:
    """Add ``root``; a class without links is its own root."""
    named = lookup_join(members, found.withColumnRenamed("cls", "w"), {"w": F.col("cls")}, broadcast_bytes=BROADCAST, population=members)
    return named.withColumn("root", F.coalesce("root", "cls"))


def _candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (``key``, ``cls``, ``size``) of all groups of two or more classes, and pairs of each member with its
    group's most central one."""
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda band: F.xxhash64(band, F.substring(F.col("registers"), band * (2 * ROWS) + 1, F.lit(2 * ROWS))),
    )
    listed = classes.select("cls", F.explode(bands).alias("key"))
    sizes = listed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stage(listed.join(_side(sizes, "group-sizes"), "key"), "band-members")
    central = members.groupBy("cls").agg(F.sum("size").alias("weight"))
    weighed = stage(members.select("key", "cls").join(_side(central, "weights"), "cls"), "weighed-members")
    hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", "cls")).alias("hub")).select("key", F.col("hub.cls").alias("hub"))
    pairs = weighed.join(_side(hubs, "group-hubs"), "key").where(F.col("cls") != F.col("hub"))
    return members, stage(pairs.select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct(), "hub-pairs")


def _few_pairs(unsettled: DataFrame) -> DataFrame:
    """All pairs of members of a group (``key``) that belong to different components."""
    left = unsettled.select("key", F.col("cls").alias("a"), F.col("root").alias("root_a"))
    right = unsettled.select("key", F.col("cls").alias("b"), F.col("root").alias("root_b"))
    return left.join(right, "key").where("a < b AND root_a <> root_b").select("a", "b").distinct()


def _hidden_pairs(rooted: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs between different components of groups that hold several (``rooted``: ``cls``
    and the hash of the ``root`` of their members), by prefix, length and position."""
    own = stage(sets.join(_side(rooted, "unsettled-roots"), "cls").select("cls", "root", F.size("shingles").alias("n"), "shingles"), "unsettled-sets")
    tokens = own.select("root", F.explode("shingles").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("freq"), F.min("root").alias("low"), F.max("root").alias("high"))
    shared = counts.where("freq > 1").select("token", "freq", (F.col("low") != F.col("high")).alias("mixed"))
    held = own.select("cls", F.explode("shingles").alias("token")).join(shared, "token")
    ordered = held.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("freq", "token", "mixed"))).alias("order"))
    ordered = ordered.join(own.select("cls", "root", "n"), "cls")
    # shingles that no other class has come first in the order; they join nothing
    alone = F.col("n") - F.size("order")
    longest = F.col("n") - F.ceil(F.lit(PERCENT) * F.col("n") / 100) + 1
    prefix = ordered.select("cls", "root", "n", alone.alias("alone"), longest.alias("longest"), F.posexplode("order").alias("at", "x"))
    placed = prefix.withColumn("place", F.col("alone") + F.col("at")).where((F.col("place") < F.col("longest")) & F.col("x.mixed"))
    # the largest partner with which enough shingles can follow this one
    largest = F.floor((F.col("n") - F.col("place")) * (100 + PERCENT) / PERCENT) - F.col("n")
    rows = stage(placed.select("cls", "root", "n", "place", F.col("x.token").alias("token"), largest.alias("largest")), "prefixes")
    groups = rows.groupBy("token").agg(F.min("n").alias("smallest"), F.min("root").alias("low"), F.max("root").alias("high"))
    groups = groups.where(F.col("low") != F.col("high")).select("token", "smallest")
    useful = stage(rows.join(groups, "token").where(F.col("largest") >= F.col("smallest")), "useful-prefixes")
    # within a token, members of its largest component are never paired with each other
    parts = useful.groupBy("token", "root").agg(F.count(F.lit(1)).alias("k"))
    major = parts.groupBy("token").agg(F.max(F.struct("k", "root")).alias("major")).select("token", F.col("major.root").alias("major"))
    sided = useful.join(major, "token")
    left = sided.where(F.col("root") != F.col("major")).select("token", *[F.col(c).alias(f"l_{c}") for c in ("cls", "root", "n", "place")])
    right = sided.select("token", *[F.col(c).alias(f"r_{c}") for c in ("cls", "root", "n", "place")])
    needed = F.ceil(F.lit(PERCENT) * (F.col("l_n") + F.col("r_n")) / (100 + PERCENT))
    follow = F.least(F.col("l_n") - F.col("l_place"), F.col("r_n") - F.col("r_place"))
    sized = (100 * F.col("l_n") >= PERCENT * F.col("r_n")) & (100 * F.col("r_n") >= PERCENT * F.col("l_n"))
    met = left.join(right, (left.token == right.token) & (F.col("l_root") != F.col("r_root")) & sized & (follow >= needed))
    return met.select(F.least("l_cls", "r_cls").alias("a"), F.greatest("l_cls", "r_cls").alias("b")).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its key, ``mark`` (hash of its text), ``n_shingles``,
    ``component_id`` and ``kept``.

    ``component_id`` is the smallest key of all rows that are linked directly or through others. A text
    without words, or a missing one, is linked with nothing. Rows without a key are linked like others
    but name no component; one that is linked with no keyed row has a missing ``component_id`` and is
    kept. Rows that repeat a key with the same words are one document and are all kept or all not.
    Only these two columns are read; an empty table gives none.
    """
    rows = stage(_hashed_rows(df, key, text), "hashed-rows")
    filled = rows.where("cls IS NOT NULL")
    classes = stage(filled.groupBy("cls").agg(
        F.min("key").alias("key"), F.first("n").alias("n"), F.first("registers").alias("registers"), F.count(F.lit(1)).alias("rows")
    ), "classes")
    members, pairs = _candidates(classes)
    likely = stage(_estimated(pairs, classes), "likely-pairs")
    named = members.select("cls").distinct()
    wanted = stage(classes.join(named, "cls", "left_semi").select("cls", "key"), "members")
    sets = _sets(df, key, text, rows, wanted)
    links = stage(_verified(likely, sets), "verified-links")
    found = components(links)
    # the pair of a group of two has been compared; only larger groups can hold pairs that have not
    rooted = stage(_rooted(members.where("size > 2"), found).withColumn("root", F.xxhash64("root")), "rooted-members")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    unsettled = stage(rooted.join(mixed, "key", "left_semi"), "unsettled")
    few = stage(_few_pairs(unsettled.where(F.col("size") <= FEW)), "few-pairs")
    hidden = _hidden_pairs(unsettled.where(F.col("size") > FEW).select("cls", "root").distinct(), sets)
    both = stage(hidden.unionByName(_estimated(few, classes, FEW_DEVIATIONS)).distinct(), "hidden-pairs")
    more = _verified(both, sets)
    stars = found.select(F.col("cls").alias("a"), F.col("root").alias("b"))  # as good as the links they stand for
    found = components(stars.unionByName(more))
    return _named_rows(rows, classes, found, key)


def _named_rows(rows: DataFrame, classes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Bring the components' smallest keys back to all rows."""
    rooted = found.join(classes.select("cls", "key"), "cls")
    smallest = rooted.groupBy("root").agg(F.min("key").alias("component"))
    linked = found.join(smallest, "root").select("cls", "component")
    copies = classes.where("rows > 1").join(found, "cls", "left_anti").select("cls", F.col("key").alias("component"))
    table = stage(linked.unionByName(copies), "named-components").withColumnRenamed("cls", "w")
    joined_ = lookup_join(rows.drop("registers"), table.withColumn("_found", F.lit(True)), {"w": F.col("cls")}, broadcast_bytes=BROADCAST, population=rows)
    component = F.when(F.col("_found"), F.col("component")).otherwise(F.col("key"))
    return joined_.select(
        F.col("key").alias(key), "mark", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
    )


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all its columns; of repeated rows one stays.

    Rows without a key that are linked with no keyed row all stay, as do texts without words. Only the
    verdicts that change something return to the rows, by key and text hash: how many rows go, and
    which ones stand more than once. An empty table gives none. Columns may have any names.
    """
    found = near_duplicates(df.select(F.col(quoted(key)).alias("name"), F.col(quoted(text)).alias("text")), "name", "text")
    named = F.coalesce(F.col("name").cast("string"), F.lit("")).alias("k")
    counted = found.groupBy(named, "mark", F.col("name").isNull().alias("unnamed")).agg(
        F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("rows")
    )
    verdict = F.when(~F.col("kept"), "drop").when((F.col("rows") > 1) & ~F.col("unnamed"), "single")
    change = f"_change_{uuid.uuid4().hex}"
    table = stage(counted.select("k", "mark", "unnamed", verdict.alias(change)).where(F.col(change).isNotNull()), "changed-rows")
    keys = {
        "k": F.coalesce(F.col(quoted(key)).cast("string"), F.lit("")), "mark": F.xxhash64(F.col(quoted(text))), "unnamed": F.col(quoted(key)).isNull(),
    }
    joined_ = lookup_join(df, table, keys, broadcast_bytes=BROADCAST, population=df)
    columns = [quoted(c) for c in df.columns]
    kept = joined_.where(F.col(change).isNull()).select(*columns)
    repeated = joined_.where(F.col(change) == "single")
    return kept.unionByName(repeated.dropDuplicates([key, text]).select(*columns))
