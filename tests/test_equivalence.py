"""Operators against direct computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from stratafold.operators import encode, folds, metrics
from stratafold.operators.keyed import KeyedNumbers
from stratafold.operators.lookup import lookup_join
from stratafold.operators.prefix import counts_below, value_cells
from stratafold.plans.fold_matrix import key_cells
from stratafold.schema import ENCODED_STATS, MatrixColumns
from stratafold.session import stage


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(7)
    n = 900
    hot = np.where(rng.random(n) < 0.35, "hot", rng.integers(0, 60, n).astype(str))
    frame = pd.DataFrame({
        "id": np.arange(n),
        "k": hot,
        "m": [None if v < 0.1 else f"v{int(v * 30)}" for v in rng.random(n)],
        "y": (rng.random(n) < 0.3).astype(int),
        "score": np.round(rng.random(n), 2),
    })
    return stage(spark.createDataFrame(frame, "id long, k string, m string, y int, score double")), frame


def test_nested_encoding_equals_direct_grouping(spark, people):
    rows, frame = people
    placed = stage(folds.nested_folds(rows, "y", "id", 4, 3))
    frame = frame.merge(placed.select("id", "fold", "inner_fold").toPandas(), on="id")
    cells = key_cells(placed, MatrixColumns(["k", "m"], []), "y", "inner_fold", 3, "fold")
    for held_out in range(4):
        train = frame[frame.fold != held_out]
        stats = cells.stats(float(train.y.mean()), held_out)
        slot = F.when(F.col("fold") == held_out, F.lit(3)).otherwise(F.col("inner_fold"))
        got = encode.apply_target_stats(placed, stats, cells.wanted(), slot).toPandas().set_index("id")
        for key in ("k", "m"):
            for inner in range(4):
                learn = train[train.inner_fold != inner]
                agg = learn.groupby(key).y.agg(ENCODED_STATS)
                ask = frame[frame.fold == held_out] if inner == 3 else train[train.inner_fold == inner]
                for stat in ENCODED_STATS:
                    fill = train.y.mean() if stat == "mean" else 0.0
                    wanted = ask[key].map(agg[stat]).fillna(fill).astype("float32").to_numpy()
                    found = got.loc[ask.id, f"TE_{key}_{stat}"].to_numpy()
                    assert np.allclose(wanted, found, atol=1e-6), (key, stat, held_out, inner)


def test_own_label_never_reaches_the_encoding(spark, people):
    rows, _ = people
    placed = stage(folds.nested_folds(rows, "y", "id", 4, 3))

    def encoded(df):
        cells = key_cells(df, MatrixColumns(["k"], []), "y", "inner_fold", 3, "fold")
        stats = cells.stats(0.3, 0)
        return encode.apply_target_stats(df.where("fold <> 0"), stats, {"k": ENCODED_STATS}, F.col("inner_fold"))

    probe = placed.where("fold <> 0").orderBy("id").first()["id"]
    flipped = placed.withColumn("y", F.when(F.col("id") == probe, 1 - F.col("y")).otherwise(F.col("y")))
    names = [f"TE_k_{s}" for s in ENCODED_STATS]
    before, after = (encoded(df).where(F.col("id") == probe).select(names).first() for df in (placed, flipped))
    assert before == after


def test_rolled_up_keys_equal_direct_keys(spark, people):
    rows, _ = people
    derive = lambda df: df.withColumn("km", F.concat_ws("_", F.coalesce("k", F.lit("nan")), F.coalesce("m", F.lit("nan"))))
    direct = encode.target_cells(derive(rows), ["km", "m"], "y")
    rolled = encode.rolled_up_cells(rows, ["k", "m"], derive, ["km", "m"], "y")
    assert sorted(direct.collect()) == sorted(rolled.collect())


def test_auc_equals_the_evaluator(spark, people):
    rows, _ = people
    got = metrics.roc_auc(rows, "score", "y").first()["auc"]
    judge = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="y", numBins=0)
    assert got == pytest.approx(judge.evaluate(rows.withColumn("y", F.col("y").cast("double"))), abs=1e-12)
    turned = metrics.roc_auc(rows.withColumn("score", -F.col("score")), "score", "y").first()["auc"]
    assert got + turned == pytest.approx(1.0)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_lookups_keep_every_row(spark, people, limit):
    rows, frame = people
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> '3'")
    table = table.unionByName(spark.createDataFrame([("unused", 5)], "k string, n long"))
    got = lookup_join(rows, table, {"k": F.col("k")}, broadcast_bytes=limit).toPandas()
    counts = frame.k.value_counts().drop("3", errors="ignore")
    assert sorted(got.id) == sorted(frame.id)
    wanted = frame.set_index("id").k.map(counts)
    assert got.set_index("id").n.sort_index().fillna(-1).tolist() == wanted.sort_index().fillna(-1).tolist()


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_missing_and_hot_missing_keys_survive(spark, limit):
    rows = spark.range(400).withColumn("k", F.when(F.col("id") % 3 > 0, F.lit("h")))
    table = spark.createDataFrame([("h", 1.0), ("x", 2.0)], "k string, v double")
    got = lookup_join(rows, table, {"k": F.col("k")}, broadcast_bytes=limit)
    assert got.count() == 400
    assert got.agg(F.count("v")).first()[0] == rows.agg(F.count("k")).first()[0]


def test_hot_key_is_fanned_over_partitions(spark, partitions):
    partitions(8)
    rows = spark.range(4000).withColumn("k", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = lookup_join(rows, table, {"k": F.col("k")}, broadcast_bytes=0)
    assert joined.count() == 4000 and joined.agg(F.max("n")).first()[0] == 1334
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_lane" in plan and "xxhash64" in plan


def test_dictionary_and_join_agree(spark, people):
    rows, _ = people
    table = rows.groupBy(F.lit("k").alias("column"), F.col("k").alias("value")).agg(
        F.array(F.avg("y"), F.lit(None).cast("double")).alias("numbers")
    )
    keyed = KeyedNumbers.of(table)
    ways = [keyed.find(rows, ["k"]), keyed.find(rows, ["k"], dictionaries=False), keyed.find(rows, ["k"], dictionaries=False, broadcast_bytes=0)]
    first, *others = [sorted((r["id"], r["_found_k"]) for r in df.collect()) for df in ways]
    assert all(first == other for other in others) and all(v[1] is None for _, v in first)


@pytest.mark.parametrize("width", [1, 4, 64])
def test_results_do_not_depend_on_partitions(spark, people, partitions, width):
    rows, frame = people
    partitions(width)
    placed = folds.nested_folds(rows, "y", "id", 5, 3).toPandas()
    order = frame.assign(h=[__import__("hashlib").md5(f"{i}#42".encode()).hexdigest() for i in frame.id])
    order = order.sort_values(["y", "h", "id"]).reset_index(drop=True)
    order["fold"] = order.index % 5
    second = order.sort_values(["y", "fold", "h", "id"]).reset_index(drop=True)
    second["inner_fold"] = second.index % 3
    wanted = second.set_index("id")[["fold", "inner_fold"]].sort_index()
    assert (placed.set_index("id")[["fold", "inner_fold"]].sort_index() == wanted).all().all()
    cells = stage(value_cells(rows, "score", {"n": F.lit(True)}))
    below = counts_below(cells, "score", ["n"]).toPandas().set_index("score").n_below
    direct = {v: int((frame.score < v).sum()) for v in frame.score.unique()}
    assert below.to_dict() == direct


def test_folds_are_even(spark, people):
    rows, _ = people
    placed = folds.nested_folds(rows, "y", "id", 7, 4).toPandas()
    sizes = placed.groupby("fold").size()
    assert sizes.max() - sizes.min() <= 1
    per_class = placed.groupby(["y", "fold"]).size().groupby("y")
    assert (per_class.max() - per_class.min() <= 1).all()
    for held_out in range(7):
        inner = placed[placed.fold != held_out].groupby(["y", "inner_fold"]).size().groupby("y")
        assert (inner.max() - inner.min() <= 3).all()
