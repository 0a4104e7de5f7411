"""Byte-level BPE: encode whole texts to ids, decode ids by concatenating vocabulary strings.

A word's symbols form a doubly linked list. Every mergeable pair is an entry of a priority queue,
ordered by merge rank and then by place; an entry whose symbols have changed since is stale and
skipped when it is taken out. The work is per row: Spark splits the table, no shuffle is needed,
and a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import json
import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

# fixed values: the word pattern of this family of byte-level vocabularies
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# A text falls into pieces where the word pattern always ends a word: after letters and digits before ASCII
# punctuation or white space, after such punctuation (but an apostrophe, which may begin a word) before letters
# and digits, and at white space. Most pieces are one word and can be looked up whole.
# \s of the re module also takes U+001C to U+001F, which are no white space here.
_PIECES = re.compile(
    r" ?[^\W_]+(?=[!-/:-@\[-`{-~\s]|\Z)| ?[!-&(-/:-@\[-`{-~]+(?=[^\W_]|\s|\Z)"
    r"| ?[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]+"
)
#: Words that a Python worker remembers in each of two generations; when the younger is full, the
#: older is forgotten. This bounds its memory.
REMEMBERED = 200_000
#: Longer words are not remembered.
LONGEST_REMEMBERED = 64


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in such vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {byte: chr(byte) for byte in printable}
    others = [byte for byte in range(256) if byte not in letters]
    return letters | {byte: chr(256 + place) for place, byte in enumerate(others)}


class BytePairCoder:
    """Encoder and decoder of one vocabulary file (the JSON text of a byte-level BPE tokenizer)."""

    def __init__(self, model_json: str):
        parsed = json.loads(model_json)
        letters = byte_letters()
        vocabulary = parsed["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in parsed["model"]["merges"])
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged_ids: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self.ranks[vocabulary[a], vocabulary[b]] = rank
            self.merged_ids.append(vocabulary[a + b])
        self.byte_ids = [vocabulary[letters[byte]] for byte in range(256)]
        size = max([*vocabulary.values(), *self.specials.values()]) + 1
        back = {letter: byte for byte, letter in letters.items()}
        self.strings: list[bytes] = [b""] * size
        for token, number in vocabulary.items():
            self.strings[number] = bytes(back[letter] for letter in token)
        for token, number in self.specials.items():
            self.strings[number] = token.encode()
        self.words = regex.compile(WORDS)
        ordered = sorted(self.specials, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")") if ordered else None
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def word_ids(self, word: str) -> tuple[int, ...]:
        """Ids of one word by the merge queue.

        A queue entry is one integer, the rank above the place. It is stale if the pair that now
        starts at its place has another rank.
        """
        ids = list(map(self.byte_ids.__getitem__, word.encode("utf-8", "replace")))
        count = len(ids)
        rank_of, merged_ids = self.ranks.get, self.merged_ids
        ranks = list(map(rank_of, zip(ids, ids[1:])))  # of the pair that starts at a place
        bits = count.bit_length()  # short words have small entries
        places = (1 << bits) - 1
        queue = [rank << bits | place for place, rank in enumerate(ranks) if rank is not None]
        if not queue:
            return tuple(ids)
        heapify(queue)
        left, right = list(range(-1, count)), list(range(1, count + 1))
        ids.append(-1)  # stands behind the last symbol and merges with nothing
        ranks.append(None)  # of the last symbol, which starts no pair
        while queue:
            entry = heappop(queue)
            place, rank = entry & places, entry >> bits
            if ranks[place] != rank:
                continue  # stale: one of the symbols was merged meanwhile
            merged = ids[place] = merged_ids[rank]
            follower = right[place]
            ids[follower], ranks[follower] = -1, None
            after = right[place] = right[follower]
            left[after] = place
            rank = ranks[place] = rank_of((merged, ids[after]))
            if rank is not None:
                heappush(queue, rank << bits | place)
            before = left[place]
            if before >= 0:
                rank = ranks[before] = rank_of((ids[before], merged))
                if rank is not None:
                    heappush(queue, rank << bits | before)
        return tuple([number for number in ids if number >= 0])

    def learned(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece that is not among those met lately; remembered if short."""
        found = self.older.get(piece)
        if found is None:
            if (piece[1:] if piece[0] == " " else piece).isalpha():
                found = self.word_ids(piece)  # letters alone are one word
            else:
                found = self._joined(self.words.findall(piece))
        if len(piece) <= LONGEST_REMEMBERED and len(self.known) <= REMEMBERED:
            self.known[piece] = found
        return found

    def _joined(self, words: list[str]) -> tuple[int, ...]:
        ids: list[int] = []
        for word in words:
            part = self.known.get(word) or self.older.get(word)
            if part is None:
                part = self.word_ids(word)
                if len(word) <= LONGEST_REMEMBERED and len(self.known) <= REMEMBERED:
                    self.known[word] = part
            ids += part
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        ids: list[int] = []
        known = self.known
        for part in self.special.split(text) if self.special else [text]:
            if part in self.specials:
                ids.append(self.specials[part])
                continue
            for piece in _PIECES.findall(part):
                try:
                    ids += known[piece]
                except KeyError:
                    ids += self.learned(piece)
        return ids

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_TYPES = {
    "ids": ("array<int>", pa.list_(pa.int32())),
    "decoded": ("string", pa.string()),
    "n_tokens": ("bigint", pa.int64()),
    "ids_sha256": ("string", pa.string()),
    "decoded_sha256": ("string", pa.string()),
}


def encode_decode(
    df: DataFrame, model_path: str, outputs=("ids", "decoded"), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``df``: its key and the ``outputs`` (``ids``, ``decoded``, ``n_tokens``,
    ``ids_sha256``, ``decoded_sha256``).

    A missing text counts as empty: no ids, an empty decoded text. Missing and repeated keys are
    carried through row by row; other columns of ``df`` are not read, so their names cannot clash.
    An empty table gives an empty table. The vocabulary (a file of fixed size) is read by the driver
    and broadcast. Memory per worker: one Arrow batch, one text's ids and the remembered words.
    """
    with open(model_path, encoding="utf-8") as file:
        model = df.sparkSession.sparkContext.broadcast(file.read())
    key_type = df.schema[key].dataType
    digits = "ids_sha256" in outputs
    decodes = {"decoded", "decoded_sha256"} & set(outputs)

    def coded(batches):
        coder = BytePairCoder(model.value)
        numerals = [str(number) for number in range(len(coder.strings))] if digits else []
        for batch in batches:
            made: dict[str, list] = {name: [] for name in outputs}
            for value in batch.column(1):
                ids = coder.encode(value.as_py() or "")
                row = {"ids": ids, "n_tokens": len(ids)}
                if digits:
                    listed = ",".join(map(numerals.__getitem__, ids))
                    row["ids_sha256"] = hashlib.sha256(listed.encode()).hexdigest()
                if decodes:
                    row["decoded"] = coder.decode(ids)
                    row["decoded_sha256"] = hashlib.sha256(row["decoded"].encode()).hexdigest()
                for name in outputs:
                    made[name].append(row[name])
            columns = [pa.array(made[name], _TYPES[name][1]) for name in outputs]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, *outputs])

    schema = f"`{key}` {key_type.simpleString()}, " + ", ".join(f"{n} {_TYPES[n][0]}" for n in outputs)
    return df.select(F.col(key), F.col(text)).mapInArrow(coded, schema)
