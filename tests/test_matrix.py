"""Whole matrices: column counts, value ranges and the join paths."""

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from stratafold.operators import clean, folds
from stratafold.plans.fold_matrix import encode_fold_features
from stratafold.plans.matrix import build_feature_matrices
from stratafold.schema import ID, LABEL
from stratafold.session import stage
from stratafold.sources.subjects import subjects


@pytest.fixture(scope="module")
def tables(spark):
    view = stage(clean.map_label(subjects(spark, SF_DIR), LABEL).drop("churn_planted"))
    parts = {s: view.where(F.col("split") == s).drop("split") for s in ("train", "test", "orig")}
    return parts["train"], parts["test"].drop(LABEL), parts["orig"]


@pytest.fixture(scope="module")
def matrices(tables):
    train, test, columns = build_feature_matrices(*tables)
    return stage(train), stage(test), columns


def test_counts(tables, matrices):
    train, test, columns = matrices
    assert (len(train.columns), len(test.columns)) == (119, 118)
    assert (len(columns.base_keys), len(columns.ngram_keys)) == (19, 19)
    assert train.count() == tables[0].count() and test.count() == tables[1].count()
    assert LABEL not in test.columns


def test_ranks_lie_in_the_unit_interval(matrices):
    names = [c for c in matrices[0].columns if "pctrank" in c and "gap" not in c]
    assert len(names) == 5
    low = matrices[0].select(F.least(*[F.min(c) for c in names]), F.greatest(*[F.max(c) for c in names])).first()
    assert 0 <= low[0] and low[1] <= 1


def test_every_join_path_gives_the_same_matrix(tables, matrices):
    shuffled, _, _ = build_feature_matrices(*tables, options={"broadcast_bytes": 0})
    first, second = (df.orderBy(ID).toPandas() for df in (matrices[0], shuffled))
    assert first.equals(second[first.columns])


def test_grouped_ranks_without_shared_counters(tables, matrices, monkeypatch):
    monkeypatch.setattr("stratafold.operators.population.COUNTED_GROUPS", 1)
    other, _, _ = build_feature_matrices(*tables)
    names = [ID, "cond_pctrank_IS_TC", "cond_pctrank_C_TC"]
    first, second = (df.select(names).orderBy(ID).toPandas() for df in (matrices[0], other))
    assert first.equals(second)


def test_encoded_fold(matrices):
    train, test, columns = matrices
    rows = stage(folds.stratified_folds(train, LABEL, ID, 5))
    fitted, valid, coded, features = encode_fold_features(
        rows.where("fold <> 0").drop("fold"), rows.where("fold = 0").drop("fold"), test, columns, LABEL, ID,
    )
    assert len(features) == 174
    assert fitted.columns == [ID, LABEL, *features] and coded.columns == [ID, *features]
    assert fitted.count() + valid.count() == train.count()
    assert {t for n, t in fitted.dtypes if n in features} == {"float"}
    assert coded.select([F.count_if(F.col(c).isNull()).alias(c) for c in features]).first() == tuple([0] * 174)


def test_wide_projections_are_compiled_apart(spark):
    """One method of a whole stage cannot be compiled with dozens of columns; its rows would be interpreted."""
    from stratafold.catalog import registered

    spark.conf.set("spark.sql.debug.maxToStringFields", "500")
    try:
        plan = registered()["te_validation"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    wide = [line for line in plan.split("\n") if "Project [" in line and line.count(" AS ") > 30]
    assert wide and all("lambdafunction" in line for line in wide), [line[:80] for line in wide]
    assert not any("Generate" in line and line.count("TE_") > 30 for line in plan.split("\n"))
