"""Caches as partitioned tables, of which a run reads and rewrites only the part it touches.

* The result cache has one partition and one file per bucket of its key, by the
  hash a shuffle uses as well.  A refresh rewrites the buckets of the incoming
  keys, each in one task that reads what it holds; a lookup joins bucket by
  bucket.  So only incoming rows and candidates move.
* The URL cache is partitioned by the hour its rows expire in.  Lookups skip
  the hours that are over, and purging drops them; only the hour at hand is rewritten.

Tables are managed ones of a database below a folder all executors share.
Partitions are replaced as a whole when a job commits, so a lost task is run
again; two writers of one cache must take turns.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.operators import caches

CACHE_BUCKETS = 256
# Up to this many incoming rows a bucket are held as a hash table; beyond it both sides are sorted.
HASHED_ROWS = 500_000
# Keys are hex digits, of which a code by frequency takes half the room.
STORED = "OPTIONS ('partitionOverwriteMode' 'dynamic', 'compression' 'zstd')"
HOUR_SECONDS = 3600


def create_database(spark: SparkSession, name: str, folder: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{folder}'")


def _columns(like: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema.fields)


# Result cache


def _bucket(key: Column, buckets: int) -> Column:
    """The bucket Spark puts a key into, both in bucketed tables and in shuffles."""
    return F.pmod(F.hash(key), F.lit(buckets))


def create_result_cache(table: str, rows: DataFrame, buckets: int = CACHE_BUCKETS) -> None:
    """A new result cache that holds ``rows``, unique by cache_key."""
    rows.sparkSession.sql(
        f"CREATE TABLE {table} ({_columns(rows)}, part INT) USING parquet "
        f"{STORED} PARTITIONED BY (part) "
        f"CLUSTERED BY (cache_key) INTO {buckets} BUCKETS TBLPROPERTIES ('cache.buckets' = '{buckets}')"
    )
    _replace_buckets(table, rows, buckets)


def _buckets(spark: SparkSession, table: str) -> int:
    return int(spark.sql(f"SHOW TBLPROPERTIES {table} ('cache.buckets')").first()["value"])


def _replace_buckets(table: str, rows: DataFrame, buckets: int) -> None:
    """Put rows in place of what is stored in their buckets."""
    _write_buckets(table, rows.repartition(buckets, "cache_key"), buckets)


def _write_buckets(table: str, rows: DataFrame, buckets: int) -> None:
    """``_replace_buckets`` for rows of which each partition holds one bucket, whole."""
    numbered = rows.withColumn("part", _bucket(F.col("cache_key"), buckets))
    with _unsorted(rows.sparkSession):
        numbered.write.insertInto(table, overwrite=True)


@contextmanager
def _unsorted(spark: SparkSession) -> Iterator[None]:
    """Have tasks that write to one partition not sort their rows by it; one with more than two sorts the rest."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "2")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def result_cache(spark: SparkSession, table: str) -> DataFrame:
    """The rows of a result cache, clustered by cache_key without a shuffle."""
    return spark.table(table).drop("part")


def _stored_in(spark: SparkSession, table: str, parts: DataFrame) -> DataFrame:
    """Rows of the buckets listed in parts(part), of which there are at most as many as buckets."""
    touched = [row.part for row in parts.distinct().collect()]
    return spark.table(table).filter(F.col("part").isin(touched))


def upsert_result_cache(
    table: str, incoming: DataFrame, order: list[str], now: Column, ttl_hours: int = caches.TTL_HOURS
) -> None:
    """``upsert_results`` in place; buckets without an incoming key keep their files.

    The incoming rows are brought to the buckets, whose rows stay where they are.
    """
    spark = incoming.sparkSession
    buckets, last = _buckets(spark, table), caches.last_results(incoming, order)
    old = _stored_in(spark, table, last.select(_bucket(F.col("cache_key"), buckets).alias("part"))).drop("part")
    placed = last.repartition(buckets, "cache_key")
    if last.count() <= buckets * HASHED_ROWS:
        placed = placed.hint("shuffle_hash")
    merged = caches.refreshed(caches.as_old(old).join(placed, "cache_key", "full_outer"), now, ttl_hours)
    _write_buckets(table, merged.select(*old.columns), buckets)


def purge_result_cache(spark: SparkSession, table: str, now: Column) -> None:
    """Remove expired rows; buckets without one keep their files, and those without another row are dropped."""
    rows = spark.table(table)
    live = F.coalesce(F.col("expires_at") >= now, F.lit(False))
    counts = rows.groupBy("part").agg(F.count_if(live).alias("live"), F.count("*").alias("all"))
    found = counts.filter("live < all").collect()
    _drop(spark, table, "part", [row.part for row in found if row.live == 0])
    rewritten = [row.part for row in found if row.live]
    if rewritten:
        kept = caches.purge_expired(rows.filter(F.col("part").isin(rewritten)).drop("part"), now)
        _replace_buckets(table, kept, _buckets(spark, table))


def _drop(spark: SparkSession, table: str, column: str, values: list[int]) -> None:
    if values:
        listed = ", ".join(f"PARTITION ({column} = {value})" for value in values)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {listed}")


# URL cache


def _hour(at: Column) -> Column:
    return F.floor(F.unix_seconds(at) / HOUR_SECONDS)


def _hour_of(spark: SparkSession, now: Column) -> int:
    return spark.sql("SELECT 1").select(_hour(now)).first()[0]


def create_url_cache(table: str, like: DataFrame) -> None:
    """A new and empty URL cache with the columns of ``like``."""
    like.sparkSession.sql(
        f"CREATE TABLE {table} ({_columns(like)}, expires_hour BIGINT) USING parquet "
        f"{STORED} PARTITIONED BY (expires_hour)"
    )


def append_url_rows(table: str, rows: DataFrame) -> None:
    """Add rows where they are; those that never expire in time, for they have no time, are never live and left out."""
    timed = rows.filter(F.col("expires_at").isNotNull())
    timed.withColumn("expires_hour", _hour(F.col("expires_at"))).write.insertInto(table)


def live_urls(spark: SparkSession, table: str, now: Column) -> DataFrame:
    """Rows that have not expired; hours that are over are not read."""
    held = spark.table(table).filter(F.col("expires_hour") >= F.lit(_hour_of(spark, now)))
    return caches.purge_expired(held, now).drop("expires_hour")


def purge_url_cache(spark: SparkSession, table: str, now: Column) -> None:
    """Drop the hours that are over and rewrite the one at hand if rows of it have expired."""
    current = _hour_of(spark, now)
    hours = [int(row.partition.split("=")[1]) for row in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    _drop(spark, table, "expires_hour", [hour for hour in hours if hour < current])
    at_hand = spark.table(table).filter(F.col("expires_hour") == current)
    expired = F.col("expires_at") < now
    if current not in hours or at_hand.filter(expired).isEmpty():
        return
    if at_hand.filter(~expired).isEmpty():
        _drop(spark, table, "expires_hour", [current])
    else:
        at_hand.filter(~expired).write.insertInto(table, overwrite=True)
