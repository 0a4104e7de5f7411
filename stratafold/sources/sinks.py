"""Writing predictions, models and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, form: str = "csv") -> None:
    """Part files with a header (``csv``) or any other Spark format; an existing output is an error."""
    writer = df.write.mode("errorifexists").format(form)
    (writer.option("header", "true") if form == "csv" else writer).save(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_models(models: Sequence, folder: str, run: int) -> list[str]:
    """One saved model per fold under ``run=<run>/fold=<fold>``."""
    paths = [f"{folder}/run={run}/fold={fold}" for fold in range(len(models))]
    for model, path in zip(models, paths):
        model.write().save(path)
    return paths
