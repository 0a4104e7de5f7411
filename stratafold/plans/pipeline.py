"""The whole run: read, clean, build, cross-validate, write."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from stratafold.operators.clean import map_label
from stratafold.operators.folds import nested_folds
from stratafold.plans.matrix import build_feature_matrices
from stratafold.plans.runs import RunReport, claim_run, next_run_number, stored_names
from stratafold.plans.training import CrossValidation, cross_validated_fit
from stratafold.schema import ID, LABEL, table_schema
from stratafold.session import stage
from stratafold.sources.sinks import write_json, write_models, write_table
from stratafold.sources.tables import read_table


def run_pipeline(
    spark: SparkSession,
    train_path: str,
    test_path: str,
    reference_path: str,
    output: str,
    form: str = "csv",
    folds: int = 5,
    inner_folds: int = 5,
    seed: int = 42,
    estimator=None,
) -> CrossValidation:
    """Train on the three stored tables and write predictions, models and the report."""
    raw = {
        name: read_table(spark, path, schema, form, extra)
        for name, path, schema, extra in (
            ("train", train_path, table_schema(), True),
            ("test", test_path, table_schema(labelled=False), True),
            ("reference", reference_path, table_schema(identified=False), False),
        )
    }
    first = next_run_number(
        stored_names(spark, f"{output}/submissions"), "name", "submission", ".csv"
    ).first()["next_run"]
    run = claim_run(spark, output, int(first))
    report = RunReport(spark, run)
    # parsed once: all later passes read the staged tables. A session that has observed a metric can send no
    # model with a training summary to its tasks any more, so the tables are counted from their files
    codes = {name: map_label(df, LABEL) if name != "test" else df for name, df in raw.items()}
    codes["train"] = nested_folds(codes["train"], LABEL, ID, folds, inner_folds, seed)
    tables = {name: stage(df, name) for name, df in codes.items()}
    seen = {
        name: df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(LABEL).isNull() if name != "test" else F.lit(False)).alias("unmapped")).first()
        for name, df in tables.items()
    }
    if seen["train"]["unmapped"]:
        raise ValueError(f"{seen['train']['unmapped']} rows have no valid {LABEL}")
    for name in raw:
        report.params({f"{name}_rows": seen[name]["rows"], f"{name}_columns": len(raw[name].columns)})
    report.params({"folds": folds, "inner_folds": inner_folds, "seed": seed})
    train, test, columns = build_feature_matrices(tables["train"], tables["test"], tables["reference"], LABEL)
    added = len({"fold", "inner_fold"})
    report.params({"train_features": len(train.columns) - added, "test_features": len(test.columns)})
    result = cross_validated_fit(train, test, columns, estimator, folds, inner_folds, seed)
    for place, model in enumerate(result.models):
        settings = {param.name: value for param, value in model.extractParamMap().items()}
        report.params({f"model_{place}": f"{output}/models/run={run}/fold={place}", f"model_{place}_params": settings})
        if result.rounds:
            report.metric("trees", len(model.treeWeights), place)
            report.metric("best_round", result.rounds[place], place)
    for row in result.scores().collect():
        fold = None if row["label"] == "Overall" else int(row["label"].split()[-1]) - 1
        report.metric("auc", row["auc"], fold)
    for fold, iteration, split, loss, auc in result.history_rows:
        report.metric(f"{split}_loss_{iteration}", loss, fold)
        if auc is not None:
            report.metric(f"{split}_auc_{iteration}", auc, fold)
    report.params(
        {
            "oof": f"{output}/oof/oof_predictions_{run}.csv",
            "submission": f"{output}/submissions/submission_{run}.csv",
            "models": f"{output}/models/run={run}",
        }
    )
    write_table(result.oof.select(ID, LABEL, "oof_pred"), f"{output}/oof/oof_predictions_{run}.csv")
    write_table(result.submission(), f"{output}/submissions/submission_{run}.csv")
    write_models(result.models, f"{output}/models", int(run))
    if result.history_rows:
        write_json(result.history(), f"{output}/history/eval_history_{run}.json")
    report.write(f"{output}/reports")
    return result
