"""Features of a single row: ratios, flags, digits and composite keys."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from stratafold.functions import (
    as_feature, floor_div, floor_mod, half_even, key_text, ratio, says,
)
from stratafold.operators.clean import number
from stratafold.schema import NGRAM_SOURCES, NUMERIC, SERVICES, TRIGRAM_SOURCES


def ratio_features(df: DataFrame) -> DataFrame:
    """How total, monthly charge and tenure relate within the row."""
    tenure, monthly, total = (F.col(c) for c in NUMERIC)
    derived = {
        "charges_deviation": total - tenure * monthly,
        "monthly_to_total_ratio": ratio(monthly, total + 1),
        "avg_monthly_charges": ratio(total, tenure + 1),
    }
    return df.withColumns({name: as_feature(value) for name, value in derived.items()})


def service_features(df: DataFrame) -> DataFrame:
    """Number of services taken, and flags; a missing internet service counts as having one."""
    taken = sum((says(F.col(c), "Yes").cast("int") for c in SERVICES), F.lit(0))
    return df.withColumns(
        {
            "service_count": as_feature(taken),
            "has_internet": as_feature(~says(F.col("InternetService"), "No")),
            "has_phone": as_feature(says(F.col("PhoneService"), "Yes")),
        }
    )


@dataclass(frozen=True)
class DigitPlan:
    """Which digit features a numeric column gets. ``whole`` columns are integers by meaning."""

    prefix: str
    column: str
    moduli: tuple[int, ...]
    multiples: tuple[int, ...]
    unit: int
    years: int | None = None
    whole: bool = False


# The digit features of the three numeric columns.
TENURE_DIGITS = DigitPlan("tenure", "tenure", (12,), (10,), 10, years=12, whole=True)
MONTHLY_DIGITS = DigitPlan("monthly", "MonthlyCharges", (10, 100), (10, 50), 10)
TOTAL_DIGITS = DigitPlan("total", "TotalCharges", (10, 100), (10, 100), 100)


def digit_features(df: DataFrame, plan: DigitPlan) -> DataFrame:
    """Digits, multiples and rounding distances of one numeric column; missing counts as 0."""
    value = F.coalesce(number(df, plan.column), F.lit(0.0))
    floored = F.floor(value)
    base = floored.cast("double") if plan.whole else value
    derived: dict[str, Column] = {f"mod_{m}": floor_mod(floored, m) for m in plan.moduli}
    if plan.years:
        derived["years"] = floor_div(floored, plan.years)
    derived["last_digit"] = floor_mod(floored, 10)
    derived["tens_digit"] = F.floor(floor_mod(floored, 100) / 10)
    for m in plan.multiples:
        derived[f"is_multiple_{m}"] = floor_mod(floored, m) == 0
    rounded = as_feature(half_even(base, plan.unit))
    derived[f"rounded_{plan.unit}"] = rounded
    derived[f"dev_from_round{plan.unit}"] = F.abs(base - rounded.cast("double"))
    if not plan.whole:
        derived["fractional"] = value - floored
    derived["digit_count"] = F.length(floored.cast("string"))
    return df.withColumns({f"{plan.prefix}_{n}": as_feature(v) for n, v in derived.items()})


def per_tenure_features(df: DataFrame) -> DataFrame:
    """Monthly and total charge per month of tenure; missing counts as 0."""
    tenure, monthly, total = (F.coalesce(number(df, c), F.lit(0.0)) for c in NUMERIC)
    return df.withColumns(
        {
            "monthly_per_tenure": as_feature(ratio(monthly, tenure + 1)),
            "total_per_tenure": as_feature(ratio(total, tenure + 1)),
        }
    )


def numeric_keys(df: DataFrame) -> DataFrame:
    """Every distinct number as a category, a missing number as one more."""
    return df.withColumns({f"CAT_{c}": key_text(F.col(c)) for c in NUMERIC})


def ngram_groups(size: int, sources: list[str]) -> dict[str, tuple[str, ...]]:
    """Names and parts of all n-grams of ``size`` over ``sources``, in source order."""
    prefix = {2: "BG", 3: "TG"}[size]
    return {"_".join([prefix, *parts]): parts for parts in combinations(sources, size)}


def all_ngram_groups() -> dict[str, tuple[str, ...]]:
    return ngram_groups(2, NGRAM_SOURCES) | ngram_groups(3, NGRAM_SOURCES[:TRIGRAM_SOURCES])


def ngram_keys(df: DataFrame, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """Composite keys: the texts of the parts joined by an underscore."""
    return df.withColumns(
        {
            name: F.concat_ws("_", *[key_text(F.col(part)) for part in parts])
            for name, parts in groups.items()
        }
    )
