"""The run registry: claimed run numbers and report tables that a repeated write does not change."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from time import perf_counter

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stratafold.functions import clock_text


def run_number(name: Column, prefix: str, suffix: str) -> Column:
    """N of a name ``prefix_N.suffix``; null for any other name."""
    pattern = f"^{re.escape(prefix)}_(\\d+){re.escape(suffix)}$"
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1).try_cast("bigint"))


def next_run_number(names: DataFrame, name: str, prefix: str, suffix: str) -> DataFrame:
    """One row: one more than the highest run number, 1 when there is none."""
    highest = F.max(run_number(F.col(name), prefix, suffix))
    return names.agg((F.coalesce(highest, F.lit(0)) + 1).alias("next_run"))


def stored_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the outputs in ``folder`` (files or directories of part files)."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise  # a folder that cannot be listed is not an empty one
        return spark.createDataFrame([], "name string")
    base = folder.rstrip("/").split(":")[-1]
    inside = F.regexp_extract("path", f"{re.escape(base)}/([^/]+)", 1)
    return files.select(inside.alias("name")).distinct()


class _Store:
    """Small files of a folder, through the file system that Spark writes it with."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._folder = folder.rstrip("/")
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/{name}" if name else self._folder)

    def make(self, name: str) -> None:
        self._files.mkdirs(self._path(name))

    def write(self, name: str, text: str) -> None:
        out = self._files.create(self._path(name), False)
        out.writeBytes(text)
        out.close()

    def read(self, name: str) -> str | None:
        path = self._path(name)
        if not self._files.exists(path):
            return None
        opened = self._files.open(path)
        try:
            return bytes(opened.readAllBytes()).decode()
        finally:
            opened.close()

    def move(self, name: str, to: str) -> None:
        """Rename; one that fails or ends inside an existing folder is told from a good one by the caller."""
        self._files.rename(self._path(name), self._path(to))


def claim_run(spark: SparkSession, folder: str, first: int = 1) -> int:
    """The smallest run number from ``first`` on that nobody has claimed in ``folder``; it is claimed now.

    A claim is a folder that holds its owner's token and is renamed into place. The rename is one step
    on a POSIX or Hadoop file system: of several claimants of a number one gets the folder, and the
    others read another token in it and go on to the next number.
    """
    store = _Store(spark, folder)
    store.make("claims")
    number = first
    while True:
        if store.read(f"claims/run={number}/owner") is None:
            token = uuid.uuid4().hex
            store.write(f"claims/.{token}/owner", token)
            store.move(f"claims/.{token}", f"claims/run={number}")
            if store.read(f"claims/run={number}/owner") == token:
                return number
        number += 1


class RunReport:
    """Collects parameters and fold metrics of a run and publishes them in two tables.

    Every table has one folder per run, which a repeated write replaces. A run's rows count once its
    manifest is there, which is written last; ``published`` reads only such runs.
    """

    def __init__(self, spark: SparkSession, run: int) -> None:
        self._spark = spark
        self._run = run
        self._started = perf_counter()
        self._params: list[tuple[int, str, str]] = []
        self._metrics: list[tuple[int, int | None, str, float]] = []

    def params(self, values: Mapping[str, object]) -> None:
        self._params += [(self._run, name, str(value)) for name, value in values.items()]

    def metric(self, name: str, value: float, fold: int | None = None) -> None:
        self._metrics.append((self._run, fold, name, float(value)))

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """Parameters and metrics, with the seconds since the report was opened."""
        timed = [*self._metrics, (self._run, None, "seconds", perf_counter() - self._started)]
        metrics = self._spark.createDataFrame(timed, "run int, fold int, metric string, value double")
        clock = F.when(F.col("metric") == "seconds", clock_text(F.col("value")))
        params = self._spark.createDataFrame(self._params, "run int, param string, value string")
        return params, metrics.withColumn("text", clock)

    def write(self, folder: str) -> None:
        for name, table in zip(("runs", "fold_metrics"), self.tables()):
            table.drop("run").write.mode("overwrite").parquet(f"{folder}/{name}/run={self._run}")
        rows = [(len(self._params), len(self._metrics) + 1)]
        manifest = self._spark.createDataFrame(rows, "params bigint, metrics bigint").coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{folder}/manifests/run={self._run}")


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of a report table (``runs`` or ``fold_metrics``) whose run has a manifest."""
    known = spark.read.parquet(f"{folder}/manifests").select("run").distinct()
    return spark.read.parquet(f"{folder}/{name}").join(F.broadcast(known), "run", "left_semi")
