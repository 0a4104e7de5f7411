"""Cross-validation, files and the whole run."""

from threading import Barrier

import pytest
from conftest import SF_DIR
from numpy import float32
from pyspark.ml.classification import GBTClassificationModel, LogisticRegression
from pyspark.ml.linalg import DenseVector
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from stratafold.operators.encode import apply_all_folds
from stratafold.operators.ensemble import coverage
from stratafold.operators.folds import nested_folds
from stratafold.plans.fold_matrix import encode_all_folds, key_cells, vectors_of_all_folds, wanted_stats
from stratafold.plans.pipeline import run_pipeline
from stratafold.plans.runs import stored_names
from stratafold.plans.training import _fits_at_once, boosted_trees, cross_validated_fit, predicted
from stratafold.schema import ID, LABEL, MatrixColumns, table_schema
from stratafold.session import computed, shared_dir, stage, stage_vectors, storage_bytes
from stratafold.sources.sinks import write_table
from stratafold.sources.subjects import subjects
from stratafold.sources.tables import read_table


@pytest.fixture(scope="module")
def rows(spark):
    view = subjects(spark, SF_DIR, [ID, "Contract", "tenure", "churn_planted", "split"])
    view = view.withColumnRenamed("churn_planted", LABEL)
    return view.where("split = 'train'").drop("split"), view.where("split = 'test'").drop("split", LABEL)


def test_every_row_is_stored_once_with_a_vector_per_fold(spark, rows):
    train = nested_folds(rows[0].withColumn("gap", F.when(F.col(ID) % 3 > 0, F.col("tenure") / 7)), LABEL, ID, 3, 3, 42)
    tested = rows[1].withColumn("gap", F.lit(None).cast("double"))
    given = [stage(train, "rows"), tested, MatrixColumns(["Contract"], []), 3, 3, LABEL, ID]
    wide = encode_all_folds(*given)
    found = vectors_of_all_folds(*given)
    assert found[2] == wide[2] and "gap" in found[2]
    for long, stored, source in ((wide[0], found[0], train), (wide[1], found[1], tested)):
        assert stored.count() == source.count()
        expected = {(r[ID], r["held_out"]): [float(r[c]) for c in wide[2]] for r in long.collect()}
        assert expected == {(r[ID], k): list(r[f"features_{k}"]) for r in stored.collect() for k in range(3)}


def test_any_estimator_learns_the_planted_label(rows):
    found = cross_validated_fit(*rows, MatrixColumns(["Contract"], []), LogisticRegression(maxIter=5), 3, 3)
    assert found.features == ["tenure"] + [f"TE_Contract_{s}" for s in ("mean", "std", "min", "max")]
    scores = {r["label"]: r["auc"] for r in found.scores().collect()}
    assert set(scores) == {"Fold 1", "Fold 2", "Fold 3", "Overall"} and scores["Overall"] > 0.7
    whole = coverage(found.oof, ID).first()
    assert whole["n_rows"] == whole["n_keys"] == rows[0].count() and whole["n_repeated"] == 0
    low, high = found.submission().agg(F.min(LABEL), F.max(LABEL)).first()
    assert 0 <= low <= high <= 1 and found.submission().count() == rows[1].count()


def test_vectors_are_stored_in_single_precision(spark):
    given = {k: [k / 7, -1.0, 0.0, k * 1e5] for k in range(50)}
    df = spark.createDataFrame(list(given.items()), "id int, v array<double>")
    stored = stage_vectors(df, ["v"], "vectors")
    folder = stored.inputFiles()[0].rsplit("/", 1)[0]
    assert spark.read.parquet(folder).schema["v"].dataType["values"].dataType.elementType == FloatType()
    for vectorized in ("true", "false"):
        spark.conf.set("spark.sql.parquet.enableVectorizedReader", vectorized)
        found = {r["id"]: r["v"] for r in stored.collect()}
        spark.conf.unset("spark.sql.parquet.enableVectorizedReader")
        assert found == {k: DenseVector([float32(x) for x in numbers]) for k, numbers in given.items()}


def test_no_more_folds_are_fitted_than_storage_holds(spark):
    assert [_fits_at_once(gb << 30, 4_320_000, 174, 3) for gb in (1, 6, 10, 20, 60)] == [1, 1, 2, 3, 3]
    assert _fits_at_once(0, 0, 0, 3) == 1 and storage_bytes(spark) > 1 << 30


def test_test_rows_are_predicted_in_one_pass_without_stored_vectors(spark, rows):
    train = stage(nested_folds(rows[0], LABEL, ID, 3, 3, 42), "rows")
    columns = MatrixColumns(["Contract"], [])
    before = {r["name"] for r in stored_names(spark, shared_dir(spark)).collect()}
    found = cross_validated_fit(train, rows[1], columns, LogisticRegression(maxIter=5), 3, 3)
    added = {r["name"].rsplit("-", 1)[0] for r in stored_names(spark, shared_dir(spark)).collect()} - before
    assert "matrices" in added and "test" in added and "test-matrices" not in added
    tested = vectors_of_all_folds(train, rows[1], columns, 3, 3, LABEL, ID)[1]
    expected = {}
    for k, model in enumerate(found.models):
        expected |= {(r[ID], k): r["prediction"] for r in predicted(model, tested.select(ID, F.col(f"features_{k}").alias("features"))).collect()}
    assert found.test_predictions.columns == [ID, "fold", "prediction"]
    assert expected == {(r[ID], r["fold"]): pytest.approx(r["prediction"], abs=1e-12) for r in found.test_predictions.collect()}


def test_counts_of_all_folds_are_those_of_every_fold_alone(spark):
    """Also where a cell has no label at all, and where a key is in one fold only."""
    rows = spark.range(300).selectExpr(
        "cast(id % 3 AS int) AS fold", "cast(id DIV 3 % 4 AS int) AS inner_fold", "concat('k', id * 7 % 11) AS Contract",
        "CASE WHEN id % 3 = 1 AND id DIV 3 % 4 = 2 AND id * 7 % 11 < 5 THEN NULL ELSE cast(id % 5 = 0 AS int) END AS Churn",
    ).unionByName(spark.createDataFrame([(0, 0, "once", 1), (1, 3, "blank", None)], "fold int, inner_fold int, Contract string, Churn int"))
    columns = MatrixColumns(["Contract"], [])
    cells = key_cells(stage(rows, "rows"), columns, LABEL, "inner_fold", 4, "fold")
    whole = cells.all_stats(rows, LABEL, 3)
    slots = whole.slots()
    for held_out in range(3):
        alone = {r["value"]: r["numbers"] for r in cells.stats(0.5, held_out).numbers.table.collect()}
        for row in whole.numbers.table.collect():
            for stat in range(4):
                found = row["numbers"][stat * slots + held_out * 5:stat * slots + held_out * 5 + 5]
                assert found == alone.get(row["value"], [None] * 20)[stat * 5:stat * 5 + 5], (row["value"], held_out, stat)


def test_what_is_computed_is_not_merged_into_what_follows(spark):
    df = spark.range(5).select("id", (F.col("id") * 7 + 1).alias("x"))
    apart = computed(df)
    assert apart.columns == df.columns and sorted(apart.collect()) == sorted(df.collect())
    plan = apart.select(F.transform(F.array("x"), lambda v: v + 1).alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "lambda" in line and "* 7" in line] and "* 7" in plan


def shuffled_columns(df):
    """What the left sides of a plan's joins hold."""
    def walk(node):
        children = [node.children().apply(at) for at in range(node.children().length())]
        own = [children[0].output().mkString(",")] if node.nodeName() == "Join" else []
        return own + [found for child in children for found in walk(child)]

    return walk(df._jdf.queryExecution().optimizedPlan())


def test_large_lookups_shuffle_packed_rows_with_their_own_slots(spark, rows):
    def keyed(df):
        return df.withColumn("gap", F.when(F.col(ID) % 3 > 0, F.col("tenure") / 7)).withColumn("who", F.concat(F.lit("w"), F.col(ID) % 301)).withColumn("whom", F.col(ID) % 283)

    train = stage(nested_folds(keyed(rows[0]), LABEL, ID, 3, 3, 42), "rows")
    given = [train, keyed(rows[1]), MatrixColumns(["who", "Contract", "whom"], []), 3, 3, LABEL, ID]
    found = [encode_all_folds(*given, options) for options in (None, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "dictionaries": False})]
    assert found[0][2] == found[1][2] == found[2][2] and len(found[0][2]) == 14
    for place in (0, 1):
        sides = [sorted(encoded[place].select(*found[0][place].columns).collect()) for encoded in found]
        assert sides[0] == sides[1] == sides[2] and len(sides[0]) == 3 * given[place].count()
    cells = key_cells(train, given[2], LABEL, "inner_fold", 3, "fold")
    wide = apply_all_folds(train, found[0][3], wanted_stats(cells.columns), "held_out", "fold", "inner_fold", broadcast_bytes=0)
    names = [c for c in found[0][2] if c.startswith("TE_")]
    assert sorted(wide.select(ID, "held_out", *names).collect()) == sorted(found[0][0].select(ID, "held_out", *names).collect())
    held = shuffled_columns(found[1][0])
    assert any("_found_" in columns for columns in held)  # a second lookup comes after the first
    assert not [columns for columns in held if "gap#" in columns or "Contract#" in columns]


class Meeting(LogisticRegression):
    """An estimator whose fits wait for each other."""

    barrier = None

    def _fit(self, dataset):
        Meeting.barrier.wait()
        return super()._fit(dataset)


def test_folds_are_fitted_at_once_as_one_by_one(rows):
    given = [*rows, MatrixColumns(["Contract"], [])]
    found = []
    for parallelism in (1, 3):
        Meeting.barrier = Barrier(parallelism, timeout=60)
        whole = cross_validated_fit(*given, Meeting(maxIter=5), 3, 3, parallelism=parallelism)
        places = [r["fold"] for r in whole.test_predictions.groupBy("fold").count().orderBy("fold").collect()]
        found.append((places, {r[ID]: (r["fold"], round(r["oof_pred"], 9)) for r in whole.oof.collect()}, [model.numFeatures for model in whole.models]))
    assert found[0] == found[1] and found[0][0] == [0, 1, 2]


def test_the_whole_run_from_files(spark, tmp_path):
    view = subjects(spark, SF_DIR)
    for split in ("train", "test", "orig"):
        part = view.where(F.col("split") == split).select(*table_schema(split != "test").names)
        write_table(part, f"{tmp_path}/{split}")
    places = [f"{tmp_path}/{s}" for s in ("train", "test", "orig")]
    out = f"{tmp_path}/out"
    found = run_pipeline(spark, *places, out, folds=2, inner_folds=2, estimator=boosted_trees(2, 2, 0.3))
    assert len(found.models) == 2
    assert {r["name"] for r in stored_names(spark, f"{out}/submissions").collect()} == {"submission_1.csv"}
    stored = spark.read.option("header", True).csv(f"{out}/submissions/submission_1.csv")
    assert stored.columns == [ID, LABEL] and stored.count() == 300
    oof = spark.read.option("header", True).csv(f"{out}/oof/oof_predictions_1.csv")
    assert oof.columns == [ID, LABEL, "oof_pred"] and oof.count() == 900
    assert GBTClassificationModel.load(f"{out}/models/run=1/fold=1").numFeatures == 174
    metrics = spark.read.parquet(f"{out}/reports/fold_metrics")
    assert metrics.where("metric = 'auc'").count() == 3
    assert metrics.where("metric = 'seconds'").first()["text"].count(":") == 2
    params = {r["param"]: r["value"] for r in spark.read.parquet(f"{out}/reports/runs").collect()}
    assert params["train_features"] == "119" and params["train_rows"] == "900"
    rounds = sum(model.getNumTrees for model in found.models)
    assert spark.read.json(f"{out}/history/eval_history_1.json").count() == 2 * rounds


def test_delimited_cells(spark, tmp_path):
    lines = ["id,gender,SeniorCitizen,tenure,MonthlyCharges,TotalCharges", "1,NA,1,3,1e1, ", "2,Male,,x,,NULL", "3,\"a,b\",0,4,nan,5"]
    (tmp_path / "cells.csv").write_text("\n".join(lines))
    wanted = [f for f in table_schema(False).fields if f.name in lines[0].split(",")]
    df = read_table(spark, str(tmp_path / "cells.csv"), type(table_schema())(wanted))
    got = {r["id"]: r.asDict() for r in df.collect()}
    assert got[1]["gender"] is None and got[1]["TotalCharges"] == " " and got[1]["MonthlyCharges"] == 10.0
    assert got[2]["SeniorCitizen"] is None and got[2]["tenure"] is None and got[2]["TotalCharges"] is None
    assert got[3]["gender"] == "a,b" and got[3]["MonthlyCharges"] is None and got[3]["tenure"] == 4


class Session:
    """As much of a session as the choice of the shared folder looks at."""

    def __init__(self, master, named=None):
        self.sparkContext, self.conf = self, self
        self.master, self._named, self._own = master, named, None

    def get(self, name, default):
        return self._named if name == "spark.checkpoint.dir" and self._named else default

    def getCheckpointDir(self):
        return self._own

    def setCheckpointDir(self, folder):
        self._own = folder


def test_shared_folder_follows_the_session():
    assert shared_dir(Session("spark://host:7077", "/some/where")) == "/some/where"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session("spark://host:7077"))
    local = Session("local[2]")
    assert shared_dir(local) == shared_dir(local) == local.getCheckpointDir()
