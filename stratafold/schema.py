"""Column names and types of the three input tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Input column names, their roles and their order.
CATEGORICAL = [
    "gender",
    "SeniorCitizen",
    "Partner",
    "Dependents",
    "PhoneService",
    "MultipleLines",
    "InternetService",
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
    "Contract",
    "PaperlessBilling",
    "PaymentMethod",
]
NUMERIC = ["tenure", "MonthlyCharges", "TotalCharges"]
NGRAM_SOURCES = [
    "Contract",
    "InternetService",
    "PaymentMethod",
    "OnlineSecurity",
    "TechSupport",
    "PaperlessBilling",
]
SERVICES = [
    "PhoneService",
    "MultipleLines",
    "OnlineSecurity",
    "OnlineBackup",
    "DeviceProtection",
    "TechSupport",
    "StreamingTV",
    "StreamingMovies",
]
ID = "id"
LABEL = "Churn"
TRIGRAM_SOURCES = 4
MISSING_FILL = -1.0
UNSEEN_RATE = 0.5
ENCODED_STATS = ["mean", "std", "min", "max"]

# Cell texts that a delimited file uses for "missing".
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def table_schema(labelled: bool = True, identified: bool = True) -> T.StructType:
    """Types of an input table; ``TotalCharges`` stays text until it is parsed. The reference table
    need not be ``identified``: its rows are only aggregated."""
    special = {
        ID: T.LongType(),
        "SeniorCitizen": T.IntegerType(),
        "tenure": T.IntegerType(),
        "MonthlyCharges": T.DoubleType(),
    }
    order = [
        ID, *CATEGORICAL[:4], "tenure", *CATEGORICAL[4:], "MonthlyCharges", "TotalCharges",
    ]
    if labelled:
        order.append(LABEL)
    if not identified:
        order.remove(ID)
    return T.StructType([T.StructField(c, special.get(c, T.StringType())) for c in order])


@dataclass(frozen=True)
class MatrixColumns:
    """Which columns of a feature matrix are keys to be target-encoded."""

    base_keys: list[str]
    ngram_keys: list[str]

    @property
    def keys(self) -> list[str]:
        return self.base_keys + self.ngram_keys
