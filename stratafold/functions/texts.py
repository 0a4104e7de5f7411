"""Text column expressions: labels, keys and the clock format."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stratafold.functions.numbers import _BLANKS

# Label texts and their codes; the text of a missing key part.
LABEL_CODES = {"No": 0, "Yes": 1}
MISSING_TEXT = "nan"


def label_code(column: Column) -> Column:
    """0/1 code of a padded label text; null for any other text."""
    text = F.btrim(column.cast("string"), F.lit(_BLANKS))
    code = F.lit(None).cast("int")
    for label, number in LABEL_CODES.items():
        code = F.when(text == label, F.lit(number)).otherwise(code)
    return code


def says(column: Column, word: str) -> Column:
    """Null-safe test for one word: a missing value does not say it."""
    return column.eqNullSafe(F.lit(word))


def key_text(column: Column) -> Column:
    """Key part of a value; a missing value is a category of its own."""
    return F.coalesce(column.cast("string"), F.lit(MISSING_TEXT))


def clock_text(seconds: Column) -> Column:
    """``HH:MM:SS.ss`` of a duration in seconds."""
    minutes = F.floor(seconds / 60)
    return F.format_string(
        "%02d:%02d:%05.2f",
        F.floor(minutes / 60),
        F.pmod(minutes, F.lit(60)),
        seconds - minutes * 60,
    )
