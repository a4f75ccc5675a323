"""Cutting lineage in iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes the shuffle files of a query at its end.
_CLEARS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share; one of our own only where it is unset, on one machine."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not configured and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="codeloom-checkpoint-"))
    return (configured or sc.getCheckpointDir()).rstrip("/")


def kept(df: DataFrame, clear: bool = False) -> DataFrame:
    """The rows, computed once and kept as Parquet in the shared folder.

    Other than a checkpoint, the files tell their size, so what follows broadcasts a small table and
    shuffles a large one, and reads only the columns it needs.  With ``clear`` the shuffle files behind
    the rows go as soon as these are kept.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    if clear:
        before = spark.conf.get(_CLEARS)
        spark.conf.set(_CLEARS, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(_CLEARS, before)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
