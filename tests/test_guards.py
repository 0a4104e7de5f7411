"""Inputs that once gave silently wrong results: long groups, foreign folds, odd files."""

import pytest
from conftest import SF_DIR
from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F, types as T

from stratafold.operators import encode, keyed
from stratafold.operators.clean import map_label
from stratafold.operators.folds import nested_folds
from stratafold.plans.matrix import build_feature_matrices
from stratafold.plans.pipeline import run_pipeline
from stratafold.plans.runs import stored_names
from stratafold.plans.training import cross_validated_fit
from stratafold.schema import ID, LABEL, MatrixColumns, table_schema
from stratafold.sources.sinks import write_table
from stratafold.sources.subjects import subjects
from stratafold.sources.tables import read_table


def group_ranks(spark):
    view = map_label(subjects(spark, SF_DIR), LABEL).drop("churn_planted")
    parts = {s: view.where(F.col("split") == s).drop("split") for s in ("train", "test", "orig")}
    train, _, _ = build_feature_matrices(parts["train"], parts["test"].drop(LABEL), parts["orig"])
    return {r[0]: tuple(r[1:]) for r in train.select(ID, "cond_pctrank_IS_TC", "cond_pctrank_C_TC").collect()}


def test_group_ranks_do_not_depend_on_the_length_of_values(spark, monkeypatch):
    wanted = group_ranks(spark)
    monkeypatch.setattr(keyed, "DICTIONARY_BYTES", 1)
    assert group_ranks(spark) == wanted and any(any(v) for v in wanted.values())


@pytest.fixture(scope="module")
def folded(spark):
    view = subjects(spark, SF_DIR, [ID, "Contract", "tenure", "churn_planted", "split"]).withColumnRenamed("churn_planted", LABEL)
    train = nested_folds(view.where("split = 'train'").drop("split"), LABEL, ID, 5, 4)
    return train, view.where("split = 'test'").drop("split", LABEL)


@pytest.mark.parametrize("folds,inner", [(2, 4), (5, 2)])
def test_folds_beyond_the_count_are_an_error(folded, folds, inner):
    with pytest.raises(ValueError, match="rows have no"):
        cross_validated_fit(*folded, MatrixColumns(["Contract"], []), LogisticRegression(maxIter=1), folds, inner)


def test_missing_folds_are_an_error(folded):
    broken = folded[0].withColumn("fold", F.when(F.col("tenure") > 5, F.col("fold")))
    with pytest.raises(ValueError, match="fold from 0 to 4"):
        cross_validated_fit(broken, folded[1], MatrixColumns(["Contract"], []), LogisticRegression(maxIter=1), 5, 4)


def test_inner_folds_and_slots_beyond_the_count_are_an_error(folded):
    cells = encode.target_cells(folded[0], ["Contract"], LABEL, ["inner_fold"])
    with pytest.raises(Exception, match="inner folds must run from 0 to 1"):
        encode.out_of_fold_stats(cells, "inner_fold", 2, 0.5, ["mean"])
    stats = encode.out_of_fold_stats(cells, "inner_fold", 4, 0.5, ["mean", "std"])
    with pytest.raises(Exception, match="slots must run from 0 to 4"):
        encode.apply_target_stats(folded[0], stats, {"Contract": ["mean", "std"]}, F.lit(5)).collect()


def test_zero_and_minus_zero_are_one_key(spark):
    rows = spark.createDataFrame([(0.0, 1, 0), (-0.0, 0, 1)], "k double, y int, inner_fold int")
    cells = encode.target_cells(rows, ["k"], "y").collect()
    assert [(r["value"], r["n"], r["s"]) for r in cells] == [("0.0", 2, 1)]


def test_cells_keep_their_values(spark, tmp_path):
    lines = ["id,gender,tenure,code,note", '9007199254740993,"a ""b"", c",-3,1.5,x', "-9007199254740993,b,4.0,2,7", "12,c,4.5,NA,8"]
    (tmp_path / "cells.csv").write_text("\n".join(lines))
    schema = T.StructType([f for f in table_schema().fields if f.name in lines[0].split(",")])
    df = read_table(spark, str(tmp_path / "cells.csv"), schema, extra=True)
    assert dict(df.dtypes) == {"id": "bigint", "gender": "string", "tenure": "int", "code": "double", "note": "string"}
    assert [tuple(r) for r in df.collect()] == [
        (9007199254740993, 'a "b", c', -3, 1.5, "x"), (-9007199254740993, "b", 4, 2.0, "7"), (12, "c", None, None, "8")]
    with pytest.raises(ValueError, match="missing columns: .*Contract"):
        read_table(spark, str(tmp_path / "cells.csv"), table_schema().add("x", "string"))


def test_given_tables_survive_delimited_files(spark, tmp_path):
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang", "n_chars")
    given.write.options(header=True, escape='"').csv(str(tmp_path / "documents"))
    found = read_table(spark, str(tmp_path / "documents"), given.schema, multiline=True)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, given.collect()))


def test_outputs_are_never_replaced(spark, tmp_path):
    df = spark.range(1)
    write_table(df, f"{tmp_path}/out")
    with pytest.raises(AnalysisException):
        write_table(df, f"{tmp_path}/out")
    assert stored_names(spark, f"{tmp_path}/nothing").collect() == []
    with pytest.raises(Exception):
        stored_names(spark, "nosuchscheme://x/y").collect()


def test_run_with_a_foreign_reference_key_and_a_further_column(spark, tmp_path):
    view = subjects(spark, SF_DIR)
    for split in ("train", "test", "orig"):
        names = [c for c in table_schema(split != "test").names if c != ID]
        key = F.concat(F.lit("c-"), ID).alias("customerID") if split == "orig" else F.col(ID)
        write_table(view.where(F.col("split") == split).select(key, *names, (F.col("tenure") * 0.5).alias("half")), f"{tmp_path}/{split}")
    found = run_pipeline(spark, *[f"{tmp_path}/{s}" for s in ("train", "test", "orig")], f"{tmp_path}/out", folds=2, inner_folds=2, estimator=LogisticRegression(maxIter=1))
    assert "half" in found.features and "customerID" not in found.features and found.oof.count() == 900
    params = {r["param"]: r["value"] for r in spark.read.parquet(f"{tmp_path}/out/reports/runs").collect()}
    assert params["model_1"].endswith("run=1/fold=1") and "maxIter" in params["model_0_params"]
    write_table(view.where("split = 'train'").select(ID, "tenure"), f"{tmp_path}/short")
    with pytest.raises(ValueError, match="missing columns"):
        run_pipeline(spark, f"{tmp_path}/short", f"{tmp_path}/test", f"{tmp_path}/orig", f"{tmp_path}/out")


def test_no_exchange_is_on_the_group_alone(spark):
    """With every join shuffled, ranks within a group are exchanged by group and bucket or by value."""
    from stratafold.operators.population import ecdf_against
    from stratafold.operators.prefix import counts_below, value_cells

    view = subjects(spark, SF_DIR, [ID, "Contract", "MonthlyCharges"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = value_cells(view, "MonthlyCharges", {"n": F.lit(True)}, ["Contract"])
        plan = counts_below(cells, "MonthlyCharges", ["n"], ["Contract"])._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "SortMergeJoin" in line and "Contract" in line]
        assert joins and all("_bucket" in line for line in joins)
        assert ecdf_against(view, view, "MonthlyCharges", {"r": F.lit(True)}, group="Contract").count() == view.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
