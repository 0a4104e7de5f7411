"""Alignment of two tokenizers' tokens over the same bytes.

The texts of a batch lie one behind the other. Each side marks the bytes at which its tokens end: where
both mark one, a group ends; where either does, a link ends, as exactly one token of each side covers
the bytes between two marks. So alignment is a few operations on whole arrays.

Tokens with the same bytes in both vocabularies are known beforehand: an array leads from an id of the
first to the id of the second with the same bytes. Groups of one token each that this array foretells
are counted in a vector as long as the vocabulary, one per task; only links of all other groups are
shuffled as pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from stratafold.llm.bpe import WORDS, byte_letters
from stratafold.operators.lookup import lookup_join
from stratafold.session import stage

#: Pair tables up to this size are broadcast.
BROADCAST = 24 << 20
#: Code points of texts that are aligned at once.
SLICE = 1 << 19
#: Longer texts are encoded in pieces.
LONGEST = 1 << 16
#: No token crosses the place between the end of a word and a space.
_CUT = re.compile(r"(?<=\S)(?= )")
_SPACE = "▁"
_HEX_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
_LOW = (1 << 32) - 1


class ByteTokens:
    """Ids and bytes of a byte-level BPE vocabulary (JSON text); special strings are ordinary text.

    If the ids rise with the ranks of the merges, the vocabulary itself is the table of ranks that the
    faster of two libraries takes; any other file goes to the one that reads it as it is.
    """

    def __init__(self, model_json: str) -> None:
        parsed = json.loads(model_json)
        back = {letter: byte for byte, letter in byte_letters().items()}
        entries = parsed["model"]["vocab"]
        self.bytes: list[bytes] = [b""] * (max([*entries.values(), *[t["id"] for t in parsed["added_tokens"]]]) + 1)
        for token in parsed["added_tokens"]:
            self.bytes[token["id"]] = token["content"].encode()
        for token, number in entries.items():
            if all(letter in back for letter in token):
                self.bytes[number] = bytes(back[letter] for letter in token)
        merged = [entries["".join(m.split(" ") if isinstance(m, str) else m)] for m in parsed["model"]["merges"]]
        special = {t["id"] for t in parsed["added_tokens"]}
        if merged == sorted(set(merged)) and len(entries.keys() - {t["content"] for t in parsed["added_tokens"]}) == 256 + len(merged):
            import tiktoken

            ranks = {self.bytes[number]: number for number in entries.values() if number not in special}
            self._encode = tiktoken.Encoding("bytes", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(model_json)
            tokenizer.encode_special_tokens = True
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self._encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        return self._encode(text)


class PieceTokens:
    """Ids and bytes of a piece vocabulary (model bytes), which sets a space before every text."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self._model.id_to_piece(number) for number in range(self._model.get_piece_size())]
        self.bytes: list[bytes] = []
        self.plain: list[bool] = []
        for number, name in enumerate(names):
            byte = _HEX_PIECE.fullmatch(name) if self._model.is_byte(number) else None
            self.bytes.append(bytes([int(byte[1], 16)]) if byte else name.replace(_SPACE, " ").encode())
            self.plain.append(not byte and not self._model.is_control(number) and not self._model.is_unknown(number))
        # a piece that continues behind a word, or a model that rewrites texts, forbids cutting
        spanning = any(a != _SPACE and b == _SPACE for name in names for a, b in zip(name, name[1:]))
        probe = " a  é ﬁ　é "
        self.cuts = not spanning and b"".join(self.bytes[i] for i in self._model.encode(probe)) == f" {probe}".encode()
        self._lone = self._model.piece_to_id(_SPACE)

    def encode(self, text: str) -> list[int]:
        """Ids of a text that starts with a space, which the model sets itself."""
        return self._model.encode(text[1:], num_threads=1) if len(text) > 1 else [self._lone]


def identity_map(first: ByteTokens, second: PieceTokens) -> np.ndarray:
    """Per id of ``first`` the id of ``second`` with the same bytes, -1 if there is none; ordinary pieces win over
    byte tokens, then the smallest id."""
    of: dict[bytes, int] = {}
    for wanted in (True, False):
        for number, (token, plain) in enumerate(zip(second.bytes, second.plain)):
            if plain == wanted and token:
                of.setdefault(token, number)
    return np.array([of.get(token, -1) if token else -1 for token in first.bytes], np.int64)


@dataclass(frozen=True)
class Aligned:
    """Some texts aligned: per text its counts and groups, and all links in order with their text.

    ``groups`` are ``a1,a2|b1;a3|b2``, empty without tokens. ``regular`` marks links that are a group of
    their own which the identity map foretells.
    """

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    rows: np.ndarray
    a: np.ndarray
    b: np.ndarray
    regular: np.ndarray


class Aligner:
    """Aligns the texts of a task."""

    def __init__(self, model_json: str, model: bytes) -> None:
        self.first, self.second = ByteTokens(model_json), PieceTokens(model)
        self.same = identity_map(self.first, self.second)
        self._sizes = [np.array([len(token) for token in side.bytes], np.int64) for side in (self.first, self.second)]
        count = max(len(self.first.bytes), len(self.second.bytes))
        self._numerals = [f"{number}{mark}" for number in range(count) for mark in ",|;"]

    def _pieces(self, text: str) -> list[str]:
        """The text behind a space, cut where no token of either side can cross if it is long."""
        spaced = f" {text}"
        if len(spaced) <= LONGEST or not self.second.cuts:
            return [spaced]
        pieces, start = [], 0
        while start < len(spaced):
            cut = _CUT.search(spaced, start + LONGEST)
            pieces.append(spaced[start : cut.start() if cut else len(spaced)])
            start += len(pieces[-1])
        return pieces

    def tokens(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of both sides; None for an empty text and one that a side cannot give back."""
        if not text:
            return None
        pieces, found = self._pieces(text), []
        whole = f" {text}".encode()
        for side in (self.first, self.second):
            ids = side.encode(pieces[0]) if len(pieces) == 1 else [i for piece in pieces for i in side.encode(piece)]
            if b"".join(map(side.bytes.__getitem__, ids)) != whole:
                return None
            found.append(ids)
        return found[0], found[1]

    def align(self, texts: list[str]) -> Aligned:
        found = [self.tokens(text) or ([], []) for text in texts]
        counts = [np.array([len(pair[side]) for pair in found], np.int64) for side in (0, 1)]
        ids = [np.fromiter(chain.from_iterable(pair[side] for pair in found), np.int64, counts[side].sum()) for side in (0, 1)]
        ends = [np.cumsum(sizes[one]) - 1 for sizes, one in zip(self._sizes, ids)]  # last bytes
        total = int(ends[0][-1]) + 1 if len(ids[0]) else 0
        marks = np.zeros((2, total), bool)
        for mark, one in zip(marks, ends):
            mark[one] = True
        both = marks[0] & marks[1]
        group_of = np.cumsum(both) - both  # group that holds a byte
        of_group = [group_of[one] for one in ends]
        n_groups = int(both.sum())
        in_group = [np.bincount(of, minlength=n_groups) for of in of_group]
        links = np.flatnonzero(marks[0] | marks[1])
        at = [(np.cumsum(mark) - mark)[links] for mark in marks]
        a, b = ids[0][at[0]], ids[1][at[1]]
        alone = (in_group[0] == 1) & (in_group[1] == 1)
        regular = alone[group_of[links]] & (self.same[a] == b)
        text_of = np.repeat(np.arange(len(texts)), counts[0])
        rows = text_of[at[0]]
        last = text_of[np.cumsum(in_group[0]) - 1] if n_groups else np.empty(0, np.int64)
        return Aligned(*counts, np.bincount(last, minlength=len(texts)), self._written(ids, of_group, in_group, counts), rows, a, b, regular)

    def _written(self, ids, of_group, in_group, counts) -> list[str]:
        """The groups of every text as text: both sides' numerals, each with the mark that follows, in turn by group."""
        total = [np.cumsum(n) for n in in_group]
        places = [np.arange(len(ids[0])) + (total[1] - in_group[1])[of_group[0]], np.arange(len(ids[1])) + total[0][of_group[1]]]
        written = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for side, mark in ((0, 1), (1, 2)):
            closes = np.arange(len(ids[side])) == total[side][of_group[side]] - 1
            written[places[side]] = 3 * ids[side] + np.where(closes, mark, 0)
        parts = list(map(self._numerals.__getitem__, written.tolist()))
        ends = np.cumsum(counts[0] + counts[1]).tolist()
        return ["".join(parts[start:end])[:-1] for start, end in zip([0, *ends], ends)]


def _counted(rows: np.ndarray, values: np.ndarray, n_rows: int, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values (below ``bound``) of every row with their number, and where each row's begin."""
    keys, times = np.unique(rows * bound + values, return_counts=True)
    offsets = np.searchsorted(keys, np.arange(n_rows + 1) * bound).astype(np.int32)
    return offsets, keys % bound, times


_ROW = (
    "is_row boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "regular array<int>, regular_times array<bigint>, links array<bigint>, link_times array<bigint>"
)


def aligned_rows(df: DataFrame, first_path: str, second_path: str, key: str, text: str) -> DataFrame:
    """Staged: per row its counts, digest and distinct links; per task one more row with the vector of
    foretold groups (``is_row`` false, ids and numbers in ``regular``)."""
    with open(first_path, encoding="utf-8") as file:
        first = df.sparkSession.sparkContext.broadcast(file.read())
    with open(second_path, "rb") as file:
        second = df.sparkSession.sparkContext.broadcast(file.read())
    schema = pa.schema([
        ("is_row", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
        ("groups_sha256", pa.string()), ("regular", pa.list_(pa.int32())), ("regular_times", pa.list_(pa.int64())),
        ("links", pa.list_(pa.int64())), ("link_times", pa.list_(pa.int64())),
    ])

    def aligned(batches):
        aligner = Aligner(first.value, second.value)
        vector = np.zeros(len(aligner.same), np.int64)
        empty = None
        for batch in batches:
            empty = pa.nulls(1, batch.column(0).type)
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = int(sizes[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, before + SLICE)))
                part = batch.slice(at, end - at)
                at = end
                found = aligner.align([cell or "" for cell in part.column(1).to_pylist()])
                np.add.at(vector, found.a[found.regular], 1)
                yield pa.RecordBatch.from_arrays([part.column(0), *_made_rows(found, aligner, schema)], [key, *schema.names])
        held = np.flatnonzero(vector)
        if len(held):
            row = {name: [None] for name in schema.names} | {"is_row": [False], "regular": [held], "regular_times": [vector[held]]}
            yield pa.RecordBatch.from_arrays([empty, *[pa.array(row[f.name], f.type) for f in schema]], [key, *schema.names])

    rows = df.select(F.col(key), F.col(text)).mapInArrow(aligned, f"`{key}` {df.schema[key].dataType.simpleString()}, {_ROW}")
    return stage(rows.withColumn("_row", F.monotonically_increasing_id()), "aligned-rows")


def _made_rows(found: Aligned, aligner: Aligner, schema: pa.Schema) -> list[pa.Array]:
    n, width = len(found.groups), len(aligner.second.bytes)
    columns = {
        "is_row": pa.array(np.ones(n, bool)), "n_a": pa.array(found.n_a), "n_b": pa.array(found.n_b), "n_groups": pa.array(found.n_groups),
        "n_links": pa.array(found.n_a + found.n_b - found.n_groups),
        "groups_sha256": pa.array([hashlib.sha256(text.encode()).hexdigest() if text else "" for text in found.groups], pa.string()),
    }
    other = ~found.regular
    pairs = found.a[other] * width + found.b[other]
    parts = {
        ("regular", "regular_times"): _counted(found.rows[found.regular], found.a[found.regular], n, len(aligner.same)),
        ("links", "link_times"): _counted(found.rows[other], pairs, n, len(aligner.same) * width),
    }
    for (name, times), (offsets, values, numbers) in parts.items():
        values = values.astype(np.int32) if name == "regular" else (values // width << 32 | values % width)
        columns[name] = pa.ListArray.from_arrays(offsets, pa.array(values))
        columns[times] = pa.ListArray.from_arrays(offsets, pa.array(numbers))
    return [columns[name] for name in schema.names]


def _exploded(rows: DataFrame, values: str, times: str, name: str, *carried: str) -> DataFrame:
    zipped = F.arrays_zip(F.col(values).alias("v"), F.col(times).alias("t"))
    return rows.select(*carried, F.explode(zipped).alias("x")).select(*carried, F.col("x.v").alias(name), F.col("x.t").alias("times"))


def pair_counts(rows: DataFrame, same: np.ndarray) -> DataFrame:
    """Staged: ``a``, ``b``, ``n`` (links that hold them) and ``best`` (no pair of ``b`` has more), from ``aligned_rows``.

    The vectors of the tasks are summed per id and joined with the identity map; only the links of
    other groups are summed as pairs.
    """
    spark = rows.sparkSession
    mapped = spark.createDataFrame(
        pa.table({"a": pa.array(np.flatnonzero(same >= 0), pa.int64()), "b": pa.array(same[same >= 0], pa.int64())})
    )
    vector = _exploded(rows.where("NOT is_row"), "regular", "regular_times", "a").groupBy(F.col("a").cast("bigint").alias("a")).agg(F.sum("times").alias("n"))
    foretold = vector.join(F.broadcast(mapped), "a").select("a", "b", "n")  # the vocabulary bounds it
    links = _exploded(rows.where("is_row"), "links", "link_times", "pair").groupBy("pair").agg(F.sum("times").alias("n"))
    other = links.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(_LOW)).alias("b"), "n")
    summed = stage(foretold.unionByName(other).groupBy("a", "b").agg(F.sum("n").alias("n")), "pair-counts")
    highest = summed.groupBy("b").agg(F.max("n").alias("most"))  # one row per id of the second vocabulary
    return stage(summed.join(F.broadcast(highest), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def align(df: DataFrame, first_path: str, second_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its key, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum`` and ``groups_sha256``.

    Missing and empty texts, and texts that a vocabulary cannot give back, have no tokens: zeros and an
    empty digest. Missing and repeated keys are carried through row by row, and every row's links count;
    other columns are not read, so their names cannot clash. An empty table gives none.
    """
    rows = aligned_rows(df, first_path, second_path, key, text)
    with open(first_path, encoding="utf-8") as file, open(second_path, "rb") as other:
        same = identity_map(ByteTokens(file.read()), PieceTokens(other.read()))
    pairs = pair_counts(rows, same)
    texts = rows.where("is_row")
    weights = _weights(df, pairs, same)
    foretold = _exploded(texts, "regular", "regular_times", "id", "_row").join(F.broadcast(weights), "id")
    links = lookup_join(
        _exploded(texts, "links", "link_times", "pair", "_row"),
        pairs.select((F.shiftleft("a", 32).bitwiseOR(F.col("b"))).alias("pair"), "n", "best"),
        {"pair": F.col("pair")}, broadcast_bytes=BROADCAST, spread="_row",
    )
    both = foretold.select("_row", "times", "n", "best").unionByName(links.select("_row", "times", "n", "best"))
    sums = both.groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")]
    return texts.join(sums, "_row", "left").select(key, "n_a", "n_b", "n_groups", "n_links", *counts, "groups_sha256")


def _weights(df: DataFrame, pairs: DataFrame, same: np.ndarray) -> DataFrame:
    """``id``, ``n`` and ``best`` of the foretold pairs; at most one row per id of the first vocabulary."""
    mapped = df.sparkSession.createDataFrame(
        pa.table({"a": pa.array(np.flatnonzero(same >= 0), pa.int64()), "b": pa.array(same[same >= 0], pa.int64())})
    )
    return stage(pairs.join(F.broadcast(mapped), ["a", "b"]).select(F.col("a").cast("int").alias("id"), "n", "best"), "foretold-pairs")
