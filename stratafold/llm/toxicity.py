"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every shard of the labelled sample runs FTRL-proximal from the shared state (per-coordinate rates, L1
sparsity); the shards' states are averaged by Spark after each round. The weights that are not zero
are few and are broadcast to score all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratafold.llm.language_id import held_out
from stratafold.llm.wordhash import LETTERS, joined, mix, word_and_start_hashes
from stratafold.session import stage

#: Bytes of the word beginnings that are features of longer words.
STARTS = (4, 5, 6, 7, 8)


@dataclass(frozen=True)
class FtrlSettings:
    """``sample``: expected number of labelled documents to learn from, chosen by hash. ``bits``: the
    hashed space has ``2 ** bits`` coordinates. ``shards``: models trained side by side on the sample,
    a fixed number, so results do not depend on the cluster. ``least``: a shard reports coordinates whose
    ``z`` is larger; smaller ones are far below the L1 bound and start anew."""

    sample: int = 8_000
    bits: int = 20
    shards: int = 6
    rounds: int = 4
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 2.0
    least: float = 0.25
    l2: float = 0.1


def features(text: str, bits: int) -> np.ndarray:
    """Coordinates of a text's words, word pairs and pairs with one word skipped, with repeats.

    A word also counts by its beginnings, so that forms of a word that were never seen share the
    evidence of the others.
    """
    words, *starts = word_and_start_hashes(text.lower().encode("utf-8", "replace"), LETTERS, STARTS)
    kinds = [words, *starts, joined(words[:-1], words[1:]) ^ np.uint64(1), joined(words[:-2], words[2:]) ^ np.uint64(2)]
    return (mix(np.concatenate(kinds)) >> np.uint64(64 - bits)).astype(np.int64)


def _sigmoid(value: float) -> float:
    return float(1 / (1 + np.exp(-min(35.0, max(-35.0, value)))))


class Ftrl:
    """State ``z`` and ``n`` per coordinate; the last coordinate is the bias, which has no L1."""

    def __init__(self, settings: FtrlSettings, coordinates=(), z=(), n=()):
        self.settings = settings
        self.z = np.zeros((1 << settings.bits) + 1)
        self.n = np.zeros((1 << settings.bits) + 1)
        self.z[list(coordinates)], self.n[list(coordinates)] = z, n

    def weights(self, at: np.ndarray) -> np.ndarray:
        s, z, n = self.settings, self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, s.l1)
        shrunk = np.sign(z) * np.maximum(0.0, np.abs(z) - l1)
        return -shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)

    def learn(self, at: np.ndarray, label: int) -> None:
        """One step; every coordinate of ``at`` is present once, with value 1."""
        weights = self.weights(at)
        gradient = _sigmoid(weights.sum()) - label
        rates = (np.sqrt(self.n[at] + gradient * gradient) - np.sqrt(self.n[at])) / self.settings.alpha
        self.z[at] += gradient - rates * weights
        self.n[at] += gradient * gradient


def _shard_learner(settings: FtrlSettings, shared, round_: int):
    """One round over one shard: its examples in an order drawn for the round, from the shared state."""
    def learn(frame):
        import pandas as pd

        model = Ftrl(settings, *shared.value)
        bias = len(model.z) - 1
        order = np.random.default_rng(round_).permutation(len(frame))
        ordered = frame.sort_values(["k", "label"], ignore_index=True).iloc[order]
        for at, label in zip(ordered["at"], ordered["label"]):
            model.learn(np.append(np.asarray(at, np.int64), bias), int(label))
        used = np.flatnonzero((np.abs(model.z) > settings.least) | (np.arange(len(model.z)) == bias))
        return pd.DataFrame({"c": used, "z": model.z[used], "n": model.n[used]})

    return learn


def train(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    settings: FtrlSettings = FtrlSettings(),
) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates and weights that are not zero, and the bias.

    Learned from rows that have a label of 0 or 1, a key and a text and are not held out. A repeated
    label row teaches repeatedly. Without such rows there are no weights and the bias is 0. Labels are
    sampled before the join, so the texts of a bounded number of documents are shuffled and staged.
    """
    spark = df.sparkSession
    spread = F.xxhash64("k")
    usable = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("label")).where(
        F.col("k").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("k"))
    )
    total = usable.count()
    below = int(min(1.0, settings.sample / max(1, total)) * (1 << 30))
    sample = usable.where(F.pmod(spread, F.lit(1 << 30)) < below)
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    joined_rows = rows.join(F.broadcast(sample), "k").select(
        F.pmod(F.xxhash64("k", "text"), F.lit(settings.shards)).cast("int").alias("shard"), "k", "label", "text"
    )
    bits = settings.bits

    def hashed(batches):
        for batch in batches:
            found = [np.unique(features(text.as_py(), bits)).astype(np.int32) for text in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.int32()))],
                ["shard", "k", "label", "at"],
            )

    examples = stage(
        joined_rows.mapInArrow(hashed, f"shard int, k {df.schema[key].dataType.simpleString()}, label int, at array<int>"), "toxicity-examples"
    )
    state = ([], [], [])
    for round_ in range(settings.rounds if total else 0):
        shared = spark.sparkContext.broadcast(state)

        learn = _shard_learner(settings, shared, round_)
        shards = examples.groupBy("shard").applyInPandas(learn, "c bigint, z double, n double")
        count = examples.select("shard").distinct().count()
        mean = shards.groupBy("c").agg((F.sum("z") / count).alias("z"), (F.sum("n") / count).alias("n"))
        frame = mean.where((F.abs("z") > settings.least) | (F.col("c") == 1 << bits)).toPandas()
        state = (frame["c"].to_numpy(), frame["z"].to_numpy(), frame["n"].to_numpy())
    model = Ftrl(settings, *state)
    everything = model.weights(np.arange(len(model.z)))
    used = np.flatnonzero(everything[:-1])
    return used, everything[used], float(everything[-1])


def score(
    df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], key: str = "doc_id", text: str = "text", bits: int = FtrlSettings.bits
) -> DataFrame:
    """One row per row of ``df``: its key, ``held_out``, ``score`` (0 to 1) and ``predicted``.

    A missing or empty text has no features: the bias alone decides. Missing and repeated keys stay
    row by row; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    key_type = df.schema[key].dataType.simpleString()

    def scored(batches):
        used, weights, bias = shared.value
        table = np.zeros(1 << bits, np.float64)
        table[used] = weights
        known = table != 0
        for batch in batches:
            values = []
            for cell in batch.column(2):
                at = features(cell.as_py() or "", bits)
                values.append(_sigmoid(table[np.unique(at[known[at]])].sum() + bias))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values, pa.float64()), pa.array([int(v >= 0.5) for v in values], pa.int32())],
                [key, "held_out", "score", "predicted"],
            )

    rows = df.select(F.col(key), held_out(F.col(key)).alias("held_out"), F.col(text).alias("_text"))
    return rows.mapInArrow(scored, f"`{key}` {key_type}, held_out boolean, score double, predicted int")
