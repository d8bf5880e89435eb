"""Cutting lineage in the folder that the whole cluster shares.

``spark.checkpoint.dir`` is read from the session; a folder of our own is set
only where the setting is missing and Spark runs in one process, as in tests; on
a cluster the setting is required.  Nothing is ever kept on one
executor alone, so a lost executor costs at most a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; the session's setting goes before our own default."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="heliograph-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint of a small or iterated table."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks_for(spark: SparkSession, rows: int, most: int) -> int:
    """Tasks of which each gets ``most`` rows, about; of small tables so many that all cores have some.

    Rows whose values repeat fit a small shuffle but not a small sort, so where
    rows are wide or many their number decides, not the bytes of the shuffle.
    """
    return max(1, -(-rows // most), min(spark.sparkContext.defaultParallelism, -(-8 * rows // most)))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table as Parquet in the shared folder and read it again.

    For intermediate results that several later steps use: columns can be
    pruned and filters pushed when they are read back.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
