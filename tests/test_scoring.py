"""A fitted run that is stored, read in another process and applied to rows old and new."""

import subprocess
import sys
from pathlib import Path

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from stratafold.operators.clean import map_label
from stratafold.plans.scoring import FoldEnsemble, FoldEnsembleModel
from stratafold.plans.training import boosted_trees
from stratafold.schema import ID, LABEL
from stratafold.session import stage
from stratafold.sources.subjects import subjects

FRESH = """
import sys
sys.path.insert(0, sys.argv[1])
from stratafold.plans.scoring import FoldEnsembleModel
from stratafold.session import local_session
spark = local_session(4, partitions=3, app="fresh")
FoldEnsembleModel.load(sys.argv[2]).transform(spark.read.parquet(sys.argv[3])).write.parquet(sys.argv[4])
"""


@pytest.fixture(scope="module")
def tables(spark):
    view = stage(map_label(subjects(spark, SF_DIR), LABEL).withColumn(LABEL, F.col("churn_planted")).drop("churn_planted"), "view")
    parts = {s: view.where(F.col("split") == s).drop("split") for s in ("train", "test", "orig")}
    return parts["train"], parts["test"].drop(LABEL), parts["orig"]


@pytest.fixture(scope="module")
def model(tables):
    train, test, reference = tables
    return FoldEnsemble(test, reference, folds=2, inner_folds=2, estimator=boosted_trees(3, 3, 0.4), patience=None).fit(train)


def numbers(df, column="prediction"):
    return {r[ID]: r[column] for r in df.collect()}


def test_a_fresh_process_gives_the_same_predictions(spark, tables, model, tmp_path):
    model.write().save(f"{tmp_path}/model")
    tables[1].write.parquet(f"{tmp_path}/test")
    root = str(Path(__file__).resolve().parents[1])
    subprocess.run([sys.executable, "-c", FRESH, root, f"{tmp_path}/model", f"{tmp_path}/test", f"{tmp_path}/scored"], check=True, timeout=600)
    found, wanted = numbers(spark.read.parquet(f"{tmp_path}/scored")), numbers(model.result.submission(), LABEL)
    assert found == pytest.approx(wanted, abs=1e-6) and len(found) == tables[1].count()
    read = FoldEnsembleModel.load(f"{tmp_path}/model")
    assert read.result is None and numbers(read.transform(tables[1])) == pytest.approx(wanted, abs=1e-6)


def test_the_matrix_of_known_rows_is_the_fitted_one(spark, tables, model):
    from stratafold.plans.matrix import build_feature_matrices

    _, test, _ = build_feature_matrices(*tables)
    names = [c for c in test.columns if c in model._fitted.facts["features"]]
    first, second = (df.select(ID, *names).orderBy(ID).toPandas() for df in (test, model.matrix(tables[1])))
    assert len(names) > 75 and first.equals(second)


def test_new_values_are_scored(spark, tables, model):
    rows = tables[1].limit(5).withColumns({
        "Contract": F.lit("never seen"), "PaymentMethod": F.lit(None).cast("string"), "TotalCharges": F.lit("123.456789"), "tenure": F.lit(-7),
    }).withColumn("further", F.lit(1))
    found = model.transform(rows).collect()
    assert len(found) == 5 and all(0 < r["prediction"] < 1 for r in found)
    assert model.transform(tables[1].where("false")).collect() == []
