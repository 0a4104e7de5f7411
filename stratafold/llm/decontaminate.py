"""Benchmark decontamination by token windows.

The benchmark's windows are a hash set that is broadcast, in blocks of a measured size; the scan of
the documents explodes window hashes and meets that set in the same stage. Verified hits and one
marker row per document are all that is shuffled. Only DataFrame expressions.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stratafold.llm.tokens import RAW_BREAKS, RAW_WORD, words
from stratafold.operators.lookup import lookup_join, quoted, row_bytes
from stratafold.session import stage

WIDTH = 13
#: Estimated bytes of benchmark windows in one broadcast; more windows mean more blocks.
BLOCK_BYTES = 16 << 20


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: ``h``, ``width``, ``gram`` (words joined by spaces) and the sorted ``items``
    that hold them. An item of fewer words than ``WIDTH`` is one window; without words it has none.
    An item without an id has windows but is not named."""
    tokens = benchmark.select(F.col(item).cast("string").alias("item"), words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    sized = tokens.where(F.size("w") > 0).withColumn("width", F.least(F.size("w"), F.lit(WIDTH)))
    starts = sized.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1)))
    grams = starts.select("item", "width", F.slice("w", F.col("i"), F.col("width")).alias("g"))
    keyed = grams.select("item", "width", F.xxhash64("g").alias("h"), F.array_join("g", " ").alias("gram"))
    return keyed.groupBy("h", "width", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))


def window_hits(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``key``, ``mark`` (hash of its text), ``n_words``, ``spans`` (merged
    ``start``/``past`` word positions that are hit) and ``items`` (sorted ids as strings).

    Missing texts have no words and no hits. Rows that share key and text share their result and are
    returned as often as they occur; a missing key is a key. Only these two columns are read.
    """
    windows = stage(benchmark_windows(benchmark), "benchmark-windows")
    facts = windows.agg(F.sum(row_bytes(windows)), F.sort_array(F.collect_set("width"))).first()
    size, widths = facts[0] or 0, facts[1] or [WIDTH]
    blocks = max(1, -(-size // BLOCK_BYTES))
    rows = df.select(F.col(key), F.col(text).alias("_text")).select(
        key, F.xxhash64("_text").alias("mark"), words(F.coalesce("_text", F.lit(""))).alias("w")
    )
    hashed = rows.withColumn("n_words", F.size("w").cast("bigint")).withColumn("hashes", _window_hashes(widths))
    found = []
    for block in range(blocks):
        part = windows.where(F.pmod("h", F.lit(blocks)) == block)
        # never empty; the outer form keeps the optimizer from testing the array's size below the scan,
        # which would compute it a second time
        scanned = hashed.select(key, "mark", "n_words", "w", F.posexplode_outer("hashes").alias("place", "hash"))
        met = scanned.join(F.broadcast(part), F.col("hash") == F.col("h"), "left")
        start = F.col("place") - _offset(widths)
        same = F.array_join(F.slice("w", start, F.col("width")), " ") == F.col("gram")
        marker = (F.col("place") == 0) if block == 0 else F.lit(False)
        met = met.where(marker | F.when(F.col("h").isNotNull(), same).otherwise(False))
        found.append(met.select(key, "mark", "n_words", "place", (start - 1).alias("start"), "width", "items"))
    hits = reduce(DataFrame.unionAll, found)
    hit = F.col("width").isNotNull()
    grouped = hits.groupBy(key, "mark").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(F.col("place") == 0, 1).otherwise(0)).alias("copies"),
        F.sort_array(F.collect_set(F.when(hit, F.struct("start", "width")))).alias("places"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items")))))).alias("items"),
    )
    once = grouped.select(key, "mark", "n_words", _merged().alias("spans"), "items", "copies")
    return once.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("copy", "copies")


def _window_hashes(widths: list[int]) -> Column:
    """A missing value as the document's marker, then the hashes of all windows, width by width."""
    arrays = ["array(CAST(NULL AS BIGINT))"]
    for width in widths:
        arrays.append(
            f"IF(size(w) >= {width}, transform(sequence(1, size(w) - {width - 1}), i -> xxhash64(slice(w, i, {width}))), array())"
        )
    return F.expr(f"concat({', '.join(arrays)})")


def _offset(widths: list[int]) -> Column:
    """How many array places come before the windows of the matched width, less the marker's."""
    before, column = F.lit(0), F.lit(0)
    for width in widths:
        column = F.when(F.col("width") == width, before).otherwise(column)
        before = before + F.greatest(F.col("n_words").cast("int") - (width - 1), F.lit(0))
    return column


def _merged() -> Column:
    """Overlapping and touching hits as spans, in order of their start."""
    return F.expr("""
    aggregate(places, CAST(array() AS array<struct<start: int, past: int>>), (a, p) ->
      IF(size(a) > 0 AND get(a, size(a) - 1).past >= p.start,
        concat(slice(a, 1, size(a) - 1), array(named_struct('start', get(a, size(a) - 1).start,
          'past', greatest(get(a, size(a) - 1).past, p.start + p.width)))),
        concat(a, array(named_struct('start', p.start, 'past', p.start + p.width)))))""")


def contamination(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: ``key``, ``mark``, ``n_words``, ``n_hit``, ``n_items``, ``items``,
    ``spans`` and ``contaminated`` (hit at all, and at least every twentieth word)."""
    hits = window_hits(df, benchmark, key, text)
    n_hit = F.aggregate("spans", F.lit(0), lambda total, span: total + span["past"] - span["start"])
    counted = hits.withColumn("n_hit", n_hit.cast("bigint")).withColumn("n_items", F.size("items").cast("bigint"))
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _found(df: DataFrame, benchmark: DataFrame, key: str, text: str) -> DataFrame:
    narrow = df.select(F.col(quoted(key)).alias("name"), F.col(quoted(text)).alias("text"))
    return contamination(narrow, benchmark, "name", "text")


def _judged(df: DataFrame, verdicts: DataFrame, key: str, text: str) -> DataFrame:
    """Join rows to what was found for their key and text; most rows need no look at it."""
    named = verdicts.withColumn("k", F.coalesce(F.col("name").cast("string"), F.lit(""))).drop("name")
    named = stage(named.dropDuplicates(["k", "mark"]), "contaminated")
    keys = {"k": F.coalesce(F.col(quoted(key)).cast("string"), F.lit("")), "mark": F.xxhash64(F.col(quoted(text)))}
    return lookup_join(df, named, keys, broadcast_bytes=32 << 20, population=df)


def remove_documents(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without its contaminated rows; all other rows are unchanged.

    Missing and empty texts hold no window and stay; repeated rows stay or go alike; an empty table or
    benchmark changes nothing. Columns may have any names.
    """
    bad = f"_bad_{uuid.uuid4().hex}"
    verdicts = _found(df, benchmark, key, text).where("contaminated").select("name", "mark", F.lit(True).alias(bad))
    return _judged(df, verdicts, key, text).where(F.col(bad).isNull()).select(*[quoted(c) for c in df.columns])


def remove_spans(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``df``; every hit word is cut from its text with what separates it from the word
    before.

    A missing text stays missing, an empty one empty; repeated rows are cut alike; an empty table gives
    none. Columns may have any names.
    """
    cuts = f"_cuts_{uuid.uuid4().hex}"
    found = _found(df, benchmark, key, text).where("n_hit > 0").select("name", "mark", F.col("spans").alias(cuts))
    judged = _judged(df, found, key, text)
    whole = F.col(quoted(text))
    raw = F.array_remove(F.split(whole, RAW_BREAKS), "")
    gaps = F.slice(F.split(whole, RAW_WORD), F.lit(1), F.size(raw))
    pieces = F.zip_with(gaps, raw, lambda gap, word: F.concat(gap, word))
    spared = lambda piece, i: ~F.exists(cuts, lambda s: (i >= s["start"]) & (i < s["past"]))
    cut = F.array_join(F.filter(pieces, spared), "")
    tail = F.regexp_extract(whole, r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)\z", 1)
    cleaned = F.when(F.col(cuts).isNull(), whole).otherwise(F.concat(cut, tail))
    return judged.select(*[cleaned.alias(c) if c == text else F.col(quoted(c)) for c in df.columns])
