"""Claimed run numbers and published reports."""

from concurrent.futures import ThreadPoolExecutor

from stratafold.plans.runs import RunReport, claim_run, published


def test_concurrent_claims_get_different_numbers(spark, tmp_path):
    with ThreadPoolExecutor(8) as pool:
        found = list(pool.map(lambda _: claim_run(spark, str(tmp_path)), range(16)))
    assert sorted(found) == list(range(1, 17))
    assert claim_run(spark, str(tmp_path), 5) == 17 and claim_run(spark, str(tmp_path), 40) == 40


def test_a_repeated_write_adds_no_row(spark, tmp_path):
    folder = str(tmp_path)
    for run in (1, 2):
        report = RunReport(spark, run)
        report.params({"seed": run})
        report.metric("auc", 0.5, 0)
        report.write(folder)
        report.write(folder)
    assert sorted((r["run"], r["param"], r["value"]) for r in published(spark, folder, "runs").collect()) == [(1, "seed", "1"), (2, "seed", "2")]
    assert published(spark, folder, "fold_metrics").count() == 4


def test_a_run_without_manifest_is_not_read(spark, tmp_path):
    folder = str(tmp_path)
    report = RunReport(spark, 1)
    report.params({"a": 1})
    report.write(folder)
    spark.createDataFrame([("b", "2")], "param string, value string").write.parquet(f"{folder}/runs/run=2")
    assert [r["run"] for r in published(spark, folder, "runs").collect()] == [1]
