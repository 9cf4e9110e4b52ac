"""Reliable checkpoints and working folders.

Both live in the shared folder named by ``spark.checkpoint.dir``, so that a lost
executor costs a retry and not the data.  A folder of our own is made only for
local masters where that setting is absent, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="offerloom-")


def working_folder(spark: SparkSession, purpose: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, rows_per_file: int = 0) -> DataFrame:
    """Write a table used several times to the shared folder and read it back.

    Unlike a checkpoint it is columnar, so later steps read only the columns
    they need and the optimizer knows its size.  With ``rows_per_file`` a task
    writes several files, which are read by as many tasks as there are cores.
    """
    path = working_folder(df.sparkSession, "table")
    writer = df.write.option("maxRecordsPerFile", rows_per_file) if rows_per_file else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
