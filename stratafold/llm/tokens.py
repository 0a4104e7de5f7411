"""Word expressions shared by the operators on words of ASCII letters, digits and all other letters."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: what separates such words once A-Z are lower case, and before
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters that lower() would change although they are not A-Z, and unassigned ones to be safe.
_OTHER_CAPITALS = r"[[^\x00-\x7F]&&[\p{javaUpperCase}\p{javaTitleCase}\p{Cn}]]"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; ``lower`` does it faster where it agrees."""
    return F.when(text.rlike(_OTHER_CAPITALS), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """Words of a text that is not missing."""
    return F.array_remove(F.split(ascii_lower(text), BREAKS), "")
