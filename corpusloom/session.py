"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


TEXTS = ("documents", "source_files", "chunks")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the data directory.

    A table of texts that comes in so few splits that more than half of the cores would stand idle (a small file) is spread over all of them.
    """
    table, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    if name in TEXTS and table.rdd.getNumPartitions() * 2 <= cores:
        return table.repartition(cores)
    return table


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: spark.checkpoint.dir where the session has it.

    A private temporary folder is set only in local mode without that setting, as in tests; a cluster without it is an error.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not given:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it is deleted when the application ends."""
    path = f"{shared_dir(spark)}/run-{spark.sparkContext.applicationId}"
    if path not in _runs:
        _runs.add(path)
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    return path


_runs: set[str] = set()


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df once to the shared folder and read it back: ends the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
