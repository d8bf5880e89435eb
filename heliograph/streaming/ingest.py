"""Packages as they arrive: parsed and rebuilt in micro-batches, with the same results as a full run.

A forest may change anywhere when a late parent comes, but never outside its
package.  So each micro-batch parses the packages that are new to it and
writes whole packages; nothing is kept in stream state, and a repeated batch
overwrites what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heliograph.operators.threads import build_forest
from heliograph.sources import packages


def package_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.zip").load(folder).select(F.col("path").alias("package"), "content")


def new_content(batch: DataFrame, done: DataFrame | None) -> DataFrame:
    """Packages whose bytes have not been taken yet, each once: the first path in order stands for its copies."""
    keyed = batch.withColumn("token", F.sha2("content", 256))
    first = keyed.groupBy("token").agg(F.min("package").alias("package"))
    out = keyed.join(first, ["token", "package"], "left_semi")
    return out if done is None else out.join(done.select("token"), "token", "left_anti")


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, limits: packages.Limits = packages.Limits()) -> StreamingQuery:
    """Take all packages that are there now, then stop; a later call goes on where this one ended.

    Writes ``forest`` (mails with their place), ``rejected`` (packages that
    broke a rule) and ``jobs`` (what was taken) under ``out``, one folder a
    micro-batch, so that a batch that is run again replaces itself.
    """

    def take(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        done = None
        try:
            done = session.read.parquet(f"{out}/jobs").where(F.col("epoch") != epoch)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh = new_content(batch, done)
        fresh.select("package", "token").write.mode("overwrite").parquet(f"{out}/jobs/epoch={epoch}")
        own = session.read.parquet(f"{out}/jobs/epoch={epoch}").select("package")
        packages.violations(packages.scan(own), limits).write.mode("overwrite").parquet(f"{out}/rejected/epoch={epoch}")
        mails = packages.read_mails(own, limits).withColumnRenamed("package", "scope")
        build_forest(mails).write.mode("overwrite").parquet(f"{out}/forest/epoch={epoch}")

    return package_stream(spark, folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
