"""Session settings the operators rely on, and staging in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# How the files of stored vectors are written.
_PLAIN_NUMBERS = {"compression": "zstd", "parquet.enable.dictionary": "false"}


def local_session(cpus: int | str = 8, partitions: int | None = None, app: str = "stratafold"):
    """A session for tests and the bench; a cluster brings its own."""
    width = partitions or (int(cpus) if str(cpus).isdigit() else 8)
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(width))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        # small local files: let every core have a scan split and a shuffle partition
        .config("spark.sql.files.minPartitionNum", str(width))
        .config("spark.sql.files.openCostInBytes", "131072")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128KB")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def apart(column: Column) -> Column:
    """The same value by a lambda, which keeps the projection that it is part of out of whole-stage code.

    A stage puts the row code of a projection into one method. With dozens of columns it passes the 8000 bytes
    up to which the JVM compiles a method, and every row is interpreted; outside of a stage the projection is
    generated as many short methods.
    """
    return F.get(F.transform(F.array(column), lambda value: value), F.lit(0))


def computed(df: DataFrame) -> DataFrame:
    """The same rows, whose columns are computed before anything that is made of them.

    A function with a lambda interprets all that stands below it, and projections that follow each other are merged:
    what was compiled by itself would be interpreted with the function. Rows are passed on as lists of one.
    """
    whole = df.select(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("_whole"))
    return whole.select(F.explode_outer("_whole").alias("_whole")).select("_whole.*")


def shuffle_width(spark: SparkSession) -> int:
    """How many shuffle partitions the session uses; bucket counts follow it."""
    initial = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(initial or 0))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="stratafold-"))
    return context.getCheckpointDir()


def stage(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write a table that several jobs read to the shared folder and read it back. With ``by`` the rows of
    every value of that column have files of their own, so a filter on it reads no others.

    This cuts the lineage: later plans start from files, hold no executor memory and survive the
    loss of executors. The folder's owner decides how long its tables are kept.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_vectors(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """``stage`` of arrays of single-precision numbers, which are read back as vectors.

    The parts that a vector is stored as are written by themselves: no function makes a vector of every row, and a
    number takes four bytes. Columns of different features share few values, so there is no dictionary.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    parts = {
        c: F.struct(
            F.lit(1).cast("tinyint").alias("type"), F.lit(None).cast("int").alias("size"),
            F.lit(None).cast("array<int>").alias("indices"), F.col(f"`{c}`").cast("array<float>").alias("values"),
        )
        for c in columns
    }
    df.withColumns(parts).write.options(**_PLAIN_NUMBERS).parquet(path)
    fields = [T.StructField(f.name, VectorUDT()) if f.name in parts else f for f in df.schema.fields]
    return df.sparkSession.read.schema(T.StructType(fields)).parquet(path)


def storage_bytes(spark: SparkSession) -> int:
    """Bytes of kept tables that the executors hold in memory, all of them together."""
    context = spark.sparkContext
    held = context._jsc.sc().getExecutorMemoryStatus()
    own = context._jvm.org.apache.spark.SparkEnv.get().blockManager().blockManagerId().hostPort()
    places = {}
    listed = held.iterator()
    while listed.hasNext():
        place = listed.next()
        places[place._1()] = place._2()._1()
    if not context.master.startswith("local[") and context.master != "local":
        places.pop(own, None)
    return sum(places.values())
