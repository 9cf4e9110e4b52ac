"""Writers: result tables, cache rewrites and the CSV report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.operators.results import csv_rows, fit_to_store

JOB_BUCKETS = 256


def _bucket(job: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(job), F.lit(buckets)).cast("int")


def job_results(spark: SparkSession, path: str, job_id: str, buckets: int = JOB_BUCKETS) -> DataFrame:
    """The stored results of one job; only the folder of its bucket is read."""
    (number,) = spark.range(1).select(_bucket(F.lit(job_id), buckets)).first()
    stored = spark.read.parquet(path)
    return stored.filter((F.col("job_bucket") == number) & (F.col("job_id") == job_id)).drop("job_bucket")


def write_results(results: DataFrame, path: str, buckets: int = JOB_BUCKETS, mode: str = "append") -> None:
    """Append result rows, partitioned by a bucket of the job.

    Buckets keep the number of folders fixed.  Rows of a bucket are spread over
    several files by URL, so one huge job does not end in one task.  Texts are cut
    to the widths of the store, and rows that were cut are flagged.
    """
    spread = F.pmod(F.xxhash64("source_url"), F.lit(8))
    (
        fit_to_store(results)
        .withColumn("job_bucket", _bucket(F.col("job_id"), buckets))
        .repartition(F.col("job_bucket"), spread)
        .write.partitionBy("job_bucket")
        .mode(mode)
        .parquet(path)
    )


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def rewrite_table(df: DataFrame, path: str) -> None:
    """Write a new version of a cache table to a new path; never over its input."""
    df.write.mode("errorifexists").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """The CSV report of ``api_rows``: every cell quoted, quotes doubled, nulls empty."""
    (
        csv_rows(rows)
        .write.option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )
