"""A fitted run as one Spark ML model: population tables, encodings and trees, stored and read together."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from stratafold.functions import as_feature
from stratafold.operators import population as pop
from stratafold.operators.clean import imputed, medians
from stratafold.operators.encode import TargetStats
from stratafold.operators.ensemble import ensemble_mean, union_all
from stratafold.operators.folds import nested_folds
from stratafold.operators.keyed import KeyedNumbers
from stratafold.operators.ranks import RankIndex
from stratafold.plans.fold_matrix import encode_rows
from stratafold.plans.matrix import Population, add_row_features, fit_population, matrix_columns, population_matrices
from stratafold.plans.training import CrossValidation, cross_validated_fit, predicted
from stratafold.schema import CATEGORICAL, ID, LABEL, NUMERIC
from stratafold.session import stage

_TOTAL = "TotalCharges"
# Names of the ranks and of the reference subsets they are taken in.
_RANKS = {"nonchurner": "pctrank_nonchurner_TC", "churner": "pctrank_churner_TC", "orig": "pctrank_orig_TC"}
_GROUP_RANKS = {"InternetService": "cond_pctrank_IS_TC", "Contract": "cond_pctrank_C_TC"}


class FoldEnsemble(Estimator):
    """Cross-validated training as an estimator: ``fit(train)`` gives a model that scores any rows.

    ``test`` and ``reference`` are the two other tables of a run (labels as 0/1 codes); their numbers
    belong to the population. All keyword arguments go to ``cross_validated_fit``.
    """

    def __init__(self, test: DataFrame, reference: DataFrame, label: str = LABEL, **settings) -> None:
        super().__init__()
        self._test, self._reference, self._label, self._settings = test, reference, label, settings

    def _fit(self, dataset: DataFrame) -> FoldEnsembleModel:
        label = self._label
        counts = {name: self._settings.get(name, 5) for name in ("folds", "inner_folds")}
        if not {"fold", "inner_fold"} <= set(dataset.columns):
            dataset = stage(nested_folds(dataset, label, ID, seed=self._settings.get("seed", 42), **counts), "train")
        tables = {"train": dataset, "test": self._test, "reference": self._reference}
        middle = medians(tables, _TOTAL)
        filled = {name: imputed(df, _TOTAL, middle[name]) for name, df in tables.items()}
        fitted = fit_population(filled["train"], filled["test"], filled["reference"], label)
        matrices = population_matrices(filled["train"], filled["test"], fitted)
        result = cross_validated_fit(*matrices, matrix_columns(), label=label, **self._settings)
        reference = filled["reference"]
        subsets = {"nonchurner": F.col(label) == 0, "churner": F.col(label) == 1, "orig": F.lit(True)}
        ranks = {"": RankIndex.fit(reference, _TOTAL, subsets)}
        ranks |= {group: RankIndex.fit(reference, _TOTAL, {"rank": F.lit(True)}, group) for group in _GROUP_RANKS}
        return FoldEnsembleModel(_Fitted.of(result, fitted, ranks, middle["test"]), result)


@dataclass(frozen=True)
class _Fitted:
    """What scoring needs. ``facts`` are the small numbers: median, scalars, totals, priors and names."""

    facts: dict
    categories: KeyedNumbers
    values: dict[str, DataFrame]
    ranks: dict[str, RankIndex]
    encodings: TargetStats
    models: list
    leaves: list[list[list[float]] | None]

    @classmethod
    def of(cls, result: CrossValidation, fitted: Population, ranks: dict[str, RankIndex], middle: float | None) -> _Fitted:
        facts = {
            "median": middle,
            "scalars": fitted.scalars,
            "means": fitted.categories.means,
            "totals": {c: fitted.values[c].totals for c in NUMERIC},
            "rows": {c: fitted.values[c].rows for c in NUMERIC},
            "features": result.features,
            "stats": result.encodings.stats,
            "priors": result.encodings.prior,
            "inner_folds": result.encodings.inner_folds,
            "models": [f"{type(m).__module__}.{type(m).__name__}" for m in result.models],
        }
        values = {c: fitted.values[c].table.select("value", "all", "labelled", "positive") for c in NUMERIC}
        return cls(facts, fitted.categories.numbers, values, ranks, result.encodings, result.models, result.leaves)

    def profile(self, column: str) -> pop.ValueProfile:
        return pop.ValueProfile(column, self.values[column], self.facts["totals"][column], self.facts["rows"][column])


class FoldEnsembleModel(Model, MLWritable, MLReadable):
    """Adds ``prediction``, the mean probability over the folds' models, to rows with the input columns and ``id``.

    Values, categories and groups that the training tables did not hold are scored like any others.
    ``result`` holds the cross-validation after a fit; a model that was read has none.
    """

    def __init__(self, fitted: _Fitted, result: CrossValidation | None = None) -> None:
        super().__init__()
        self._fitted, self.result = fitted, result

    def matrix(self, dataset: DataFrame) -> DataFrame:
        """The feature matrix of new rows."""
        fitted, facts = self._fitted, self._fitted.facts
        df = imputed(dataset, _TOTAL, facts["median"])
        for column in NUMERIC:
            df = pop.value_shares(df, fitted.profile(column))
            df = pop.value_rates(df, fitted.profile(column), "positive", "labelled")
        df = fitted.ranks[""].apply(df, _TOTAL).withColumnsRenamed(_RANKS)
        for group, name in _GROUP_RANKS.items():
            df = fitted.ranks[group].apply(df, _TOTAL).withColumnRenamed("rank", name)
        profile = pop.CategoryProfile(fitted.categories, facts["means"])
        df = pop.reference_rates(df, profile, CATEGORICAL)
        df = pop.group_residual(df, profile, "InternetService", "MonthlyCharges", "resid_IS_MC")
        df = df.withColumn("pctrank_churn_gap_TC", as_feature(F.col(_RANKS["churner"]) - F.col(_RANKS["nonchurner"])))
        df = pop.quantile_distances(pop.z_score_gap(df, _TOTAL, facts["scalars"]), _TOTAL, facts["scalars"])
        return add_row_features(df)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fitted, features = self._fitted, self._fitted.facts["features"]
        coded = encode_rows(self.matrix(dataset), fitted.encodings, matrix_columns(), [ID], {"spread": ID})
        vectors = VectorAssembler(inputCols=features, outputCol="features").transform(coded).select(ID, "held_out", "features")
        rows = stage(vectors, "scored-matrices", by="held_out")
        parts = [
            predicted(model, rows.where(F.col("held_out") == fold), leaves).select(ID, F.lit(fold).alias("fold"), "prediction")
            for fold, (model, leaves) in enumerate(zip(fitted.models, fitted.leaves))
        ]
        return ensemble_mean(union_all(parts), ID, "prediction", "prediction")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, instance: FoldEnsembleModel) -> None:
        super().__init__()
        self._instance = instance

    def saveImpl(self, path: str) -> None:
        fitted = self._instance._fitted
        for name, table in {"categories": fitted.categories.table, "encodings": fitted.encodings.numbers.table, **fitted.values}.items():
            table.write.parquet(f"{path}/tables/{name}")
        for group, index in fitted.ranks.items():
            index.save(f"{path}/ranks/{group or 'all'}")
        for fold, model in enumerate(fitted.models):
            model.write().save(f"{path}/models/{fold}")
        facts = fitted.facts | {"leaves": fitted.leaves}
        spark = fitted.categories.table.sparkSession
        # written last: a folder without facts is no model
        spark.createDataFrame([(json.dumps(facts),)], "facts string").coalesce(1).write.text(f"{path}/facts")


class _Reader(MLReader):
    def load(self, path: str) -> FoldEnsembleModel:
        spark = SparkSession.getActiveSession()
        facts = json.loads("".join(row["value"] for row in spark.read.text(f"{path}/facts").collect()))
        leaves = facts.pop("leaves")

        def table(name: str) -> DataFrame:
            return spark.read.parquet(f"{path}/tables/{name}")

        numbers = KeyedNumbers.of(table("encodings"), stored=True)
        encodings = TargetStats(numbers, facts["stats"], facts["priors"], facts["inner_folds"])
        ranks = {group: RankIndex.load(spark, f"{path}/ranks/{group or 'all'}") for group in ("", *_GROUP_RANKS)}
        models = [_named(kind).load(f"{path}/models/{fold}") for fold, kind in enumerate(facts["models"])]
        values = {c: table(c) for c in NUMERIC}
        return FoldEnsembleModel(_Fitted(facts, KeyedNumbers.of(table("categories"), stored=True), values, ranks, encodings, models, leaves))


def _named(kind: str):
    """A model class of Spark ML by its full name."""
    from importlib import import_module

    module, name = kind.rsplit(".", 1)
    if not module.startswith("pyspark.ml."):
        raise ValueError(f"not a model of Spark ML: {kind}")
    return getattr(import_module(module), name)
