"""Readers for batch and stream input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from offerloom.plans.checkpoints import materialize
from offerloom.plans.joins import BROADCAST_BYTES, bit_is_set

# Fixed by Spark: the size of one row of a bitmap.
BITMAP_BYTES = 4096


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A parquet table; with a schema nothing is read from the files to find one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_pages(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """A crawl snapshot: url and html, with whatever other columns it has.

    With the name of a ``version`` column only the newest row of each URL is
    read: of equal versions the last by file and place in it, a row without a
    version before all others.  Rows without a URL all stay.  The choice is made
    on URL, version and place; the source of a page is read where it is and
    never shuffled.
    """
    pages = read_table(spark, path)
    return pages if version is None else _newest(pages, version)


def _newest(pages: DataFrame, version: str) -> DataFrame:
    """Rows whose place is in a bitmap of the chosen ones.

    There is a row of 4 KB per file and 32,768 places.  They are broadcast within
    the bound of a broadcast; beyond it the files are read in as many shares as it takes.
    """
    file, place = F.col("_metadata.file_path"), F.col("_metadata.row_index") + 1
    keys = pages.filter(F.col("url").isNotNull()).select(
        "url", F.struct(F.col(version).alias("version"), file.alias("file"), place.alias("place")).alias("_at")
    )
    chosen = keys.groupBy("url").agg(F.max("_at").alias("_at")).select("_at.*")
    bits = materialize(
        chosen.groupBy(F.col("file").alias("_file"), F.bitmap_bucket_number("place").alias("_bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bits")
        )
    )
    shares = max(1, -(-bits.count() * BITMAP_BYTES // BROADCAST_BYTES))

    def share(of: Column, k: int) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(shares)) == k

    def part(k: int) -> DataFrame:
        rows = pages.filter(share(file, k)).select(
            F.struct("*").alias("_row"), file.alias("_file"), F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit")
        )
        marked = rows.join(F.broadcast(bits.filter(share(F.col("_file"), k))), ["_file", "_bucket"], "left")
        is_newest = F.coalesce(bit_is_set(F.col("_bits"), F.col("_bit")), F.lit(False))
        return marked.filter(F.col("_row.url").isNull() | is_newest).select("_row.*")

    return reduce(DataFrame.unionByName, [part(k) for k in range(shares)])


def stream_table(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None, pattern: str | None = None
) -> DataFrame:
    """A folder of parquet files as a stream of new files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a small input that arrives in fewer splits than there are cores.

    One row group is one task, which leaves all other cores idle in the costly
    projections that follow.  Inputs with enough splits are returned as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
