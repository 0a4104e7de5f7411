"""Column expressions."""

from stratafold.functions.numbers import (
    as_feature, floor_div, floor_mod, half_even, parse_number, ratio,
)
from stratafold.functions.texts import clock_text, key_text, label_code, says

__all__ = [
    "as_feature", "clock_text", "floor_div", "floor_mod", "half_even", "key_text", "label_code",
    "parse_number", "ratio", "says",
]
