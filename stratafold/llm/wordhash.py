"""64-bit hashes of a text's words, computed on whole arrays of bytes."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTERS = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes that are hashed at once; longer texts go in slices that end between words.
SLICE = 1 << 20

#: Byte is part of a word: all but ASCII white space.
NO_SPACE = np.ones(256, bool)
NO_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Byte is part of a word: ASCII letters and digits and everything beyond ASCII.
LETTERS = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])

_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers_to(count: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < count:
        size = max(count, 2 * len(_powers[0]))
        made = []
        for factor in (_BASE, _BASE_INVERSE):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _powers = tuple(made)
    return _powers


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; a one-to-one map."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def word_hashes(text: bytes, inside: np.ndarray) -> np.ndarray:
    """Hash of every word of a UTF-8 text in order; ``inside`` tells which bytes belong to words."""
    return word_and_start_hashes(text, inside, ())[0]


def word_and_start_hashes(text: bytes, inside: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the words, then for each length those of the words' first bytes, for longer words."""
    whole = np.frombuffer(text, np.uint8)
    if len(whole) <= SLICE:
        return _slice_hashes(whole, inside, lengths)
    parts, at = [], 0
    while at < len(whole):
        end = min(len(whole), at + SLICE)
        while end < len(whole) and inside[whole[end]] and inside[whole[end - 1]]:
            ahead = np.flatnonzero(~inside[whole[end : end + SLICE]])
            end = end + int(ahead[0]) if len(ahead) else min(len(whole), end + SLICE)
        parts.append(_slice_hashes(whole[at:end], inside, lengths))
        at = end
    return [np.concatenate(kind) for kind in zip(*parts)]


def _slice_hashes(data: np.ndarray, inside: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    flags = np.zeros(len(data) + 2, np.int8)
    flags[1:-1] = inside[data]
    steps = np.diff(flags)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    if not len(starts):
        return [np.empty(0, np.uint64) for _ in range(1 + len(lengths))]
    powers, inverses = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * powers[: len(data)], out=sums[1:])
    sizes = ends - starts
    made = [mix((sums[ends] - sums[starts]) * inverses[starts] + sizes.astype(np.uint64) * _BASE)]
    for length in lengths:
        at = starts[sizes > length]
        made.append(mix((sums[at + length] - sums[at]) * inverses[at] + np.uint64(3 * length + 1)))
    return made


def joined(first: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """Hash of tuples from the hashes of their members."""
    value = first
    for other in others:
        value = mix(value * np.uint64(0xD6E8FEB86659FD93) + other)
    return value
