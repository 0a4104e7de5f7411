"""Language identification by bit-sliced Bloom filters of character n-grams.

One filter per language, stored slot by slot: a slot is a bit mask over languages, so one look-up
returns all languages that hold an n-gram. A text's hits per language are the popcounts of those
masks, corrected for the filter's false positives; the language with most hits wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratafold.llm.wordhash import mix
from stratafold.session import stage

UNKNOWN = "und"
_SPACE = 32
_SLICE = 1 << 20
_SEEDS = [np.uint64(s) for s in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47, 0xD1B54A32D192ED03)]


@dataclass(frozen=True)
class FilterSettings:
    """``sample``: expected number of documents per language to learn from, chosen by hash; the rest
    of the corpus is not needed for frequent n-grams. ``least``: an n-gram belongs to a language if
    its share of the language's n-grams of that length reaches this, so a language has at most
    3 / ``least`` of them, and if it is at least ``near`` of its share in any other language.
    ``slots``: slots of the filters, a power of two."""

    sample: int = 3000
    least: float = 1e-4
    near: float = 0.3
    slots: int = 1 << 18


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_slices(text: str, letters: np.ndarray):
    """Codes of the text's n-grams of one to three letters, word ends as spaces; whole texts in slices.

    Runs of other characters are one space. An n-gram's code is its code points, 21 bits each.
    """
    tail = np.array([_SPACE], np.uint32)
    for at in range(0, len(text), _SLICE):
        codes = np.frombuffer(text[at : at + _SLICE].lower().encode("utf-32-le", "replace"), np.uint32)
        symbols = np.where(letters[codes], codes, _SPACE).astype(np.uint32)
        old = len(tail)
        joined = np.concatenate([tail, symbols, [_SPACE] if at + _SLICE >= len(text) else []]).astype(np.uint32)
        keep = np.ones(len(joined), bool)
        keep[1:] = (joined[1:] != _SPACE) | (joined[:-1] != _SPACE)
        keep[:old] = True
        line = joined[keep].astype(np.uint64)
        fresh = line[old:]
        single = fresh[fresh != _SPACE]
        pair_from = line[max(0, old - 1) :]
        double = (pair_from[:-1] << np.uint64(21)) | pair_from[1:]
        triple_from = line[max(0, old - 2) :]
        middle = triple_from[1:-1]
        triple = ((triple_from[:-2] << np.uint64(42)) | (middle << np.uint64(21)) | triple_from[2:])[middle != _SPACE]
        yield np.concatenate([single, double, triple])
        tail = line[-2:].astype(np.uint32)


def _order(code: Column) -> Column:
    return F.when(code >= 1 << 42, 3).when(code >= 1 << 21, 2).otherwise(1)


def _ngram_counts(df: DataFrame) -> DataFrame:
    """(lang, code, n) summed per Arrow batch, from ``lang`` and ``text``."""
    def counted(batches):
        letters = _letter_table()
        for batch in batches:
            gathered: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                gathered.setdefault(lang, []).extend(ngram_slices(text.as_py() or "", letters))
            for lang, codes in gathered.items():
                if codes:
                    found, counts = np.unique(np.concatenate(codes), return_counts=True)
                    names = pa.array([lang] * len(found), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [names, pa.array(found.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "code", "n"]
                    )

    return df.select("lang", "text").mapInArrow(counted, "lang string, code bigint, n bigint")


class LanguageFilters:
    """The filters: ``table[slot, plane]`` masks of 64 languages a plane, and what they need."""

    def __init__(self, languages: list[str], grams: list[tuple[int, int]], slots: int):
        self.languages, self.slots = languages, slots
        self.table = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
        codes = np.array([code for code, _ in grams], np.uint64)
        owner = np.array([number for _, number in grams], np.int64)
        for places in self.places(codes):
            for plane in range(self.table.shape[1]):
                own = owner // 64 == plane
                np.bitwise_or.at(self.table[:, plane], places[own], np.uint64(1) << (owner[own] % 64).astype(np.uint64))
        self.false_rate = np.array([
            float(((self.table[:, n // 64] >> np.uint64(n % 64)) & np.uint64(1)).mean()) ** len(_SEEDS) for n in range(len(languages))
        ])

    def places(self, codes: np.ndarray):
        """The slots of each n-gram, one array per hash."""
        for seed in _SEEDS:
            yield (mix(codes * seed + seed) & np.uint64(self.slots - 1)).astype(np.int64)

    def hits(self, codes: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language's filter holds."""
        masks = None
        for places in self.places(codes):
            masks = self.table[places] if masks is None else masks & self.table[places]
        return np.array([
            int(((masks[:, n // 64] >> np.uint64(n % 64)) & np.uint64(1)).sum()) for n in range(len(self.languages))
        ], float)

    def decide(self, text: str, letters: np.ndarray) -> tuple[str, float]:
        """Language and its share of all corrected hits; ties go to the language learned from more."""
        hits, total = np.zeros(len(self.languages)), 0
        for codes in ngram_slices(text, letters):
            hits, total = hits + self.hits(codes), total + len(codes)
        if not total or not len(hits) or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        true_hits = np.maximum(0.0, (hits - total * self.false_rate) / (1 - self.false_rate))
        best = int(np.argmax(true_hits))
        everything = true_hits.sum()
        return self.languages[best], float(true_hits[best] / everything) if everything > 0 else 0.0


def held_out(key: Column) -> Column:
    """Rows that nothing is learned from; a row without a key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", settings: FilterSettings = FilterSettings()) -> LanguageFilters:
    """Filters from the rows that are not held out and have a key, a text and a language.

    The number of languages is taken to be that of a fixed list of codes; what reaches the driver is
    their counts and at most ``3 / least`` n-grams for each.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    learned = rows.where(F.col("k").isNotNull() & ~held_out(F.col("k")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {row["lang"]: row["n"] for row in learned.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes, key=lambda name: (-sizes[name], name))
    if not languages:
        return LanguageFilters([], [], settings.slots)
    shares = {name: int(min(1.0, settings.sample / sizes[name]) * (1 << 30)) for name in languages}
    wanted = df.sparkSession.createDataFrame(list(shares.items()), "lang string, below long")
    sample = learned.join(F.broadcast(wanted), "lang").where(F.pmod(F.xxhash64("k", "text"), F.lit(1 << 30)) < F.col("below"))
    counts = _ngram_counts(sample).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = stage(counts.withColumn("width", _order(F.col("code"))), "ngram-counts")
    totals = counts.groupBy("lang", "width").agg(F.sum("n").alias("total"))
    common = counts.join(F.broadcast(totals), ["lang", "width"]).select("lang", "code", (F.col("n") / F.col("total")).alias("share"))
    common = common.where(F.col("share") >= settings.least)
    most = common.groupBy("code").agg(F.max("share").alias("most"))
    chosen = common.join(most, "code").where(F.col("share") >= settings.near * F.col("most")).select("lang", "code")
    number = {name: n for n, name in enumerate(languages)}
    return LanguageFilters(languages, [(row["code"], number[row["lang"]]) for row in chosen.collect()], settings.slots)


def predict(df: DataFrame, filters: LanguageFilters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its key, ``held_out``, ``lang_pred`` and ``score`` (0 to 1).

    A missing text, or one without a letter, is ``und`` with score 0; so is every text if nothing was
    learned. A text with letters but without any known n-gram gets the language learned from most, at
    score 0. Missing and repeated keys stay row by row; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(filters)
    key_type = df.schema[key].dataType.simpleString()

    def predicted(batches):
        letters, model = _letter_table(), shared.value
        for batch in batches:
            found = [model.decide(text.as_py() or "", letters) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [key, "held_out", "lang_pred", "score"],
            )

    rows = df.select(F.col(key), held_out(F.col(key)).alias("held_out"), F.col(text).alias("_text"))
    return rows.mapInArrow(predicted, f"`{key}` {key_type}, held_out boolean, lang_pred string, score double")
