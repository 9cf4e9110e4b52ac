"""Sorted results on disk, of which any page is read without the pages before it.

The rows of a sort are written by range partition, each row with its place in
it, and beside them the number of rows of each partition.  A page is a range of
places in one or, at a border, a few partitions: no other one is opened, and
within it the places tell which row groups to read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.operators.results import check_page

PART, PLACE = "page_part", "page_place"
# Fixed by Spark: the lower bits of a growing number are the place of a row in its partition.
PLACE_BITS = 33


def write_sorted(ordered: DataFrame, path: str) -> None:
    """Store sorted rows below a new path; a sort leaves few enough partitions to count them one by one."""
    number = F.monotonically_increasing_id()
    part = F.shiftright(number, PLACE_BITS).cast("int")
    numbered = ordered.withColumns({PART: part, PLACE: number.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))})
    numbered.write.partitionBy(PART).parquet(f"{path}/rows")
    # Of a table without rows no partition is written, but its columns are.
    numbered.limit(0).write.parquet(f"{path}/columns")
    stored = ordered.sparkSession.read.schema(numbered.schema).parquet(f"{path}/rows")
    stored.groupBy(PART).agg(F.count("*").alias("rows")).coalesce(1).write.parquet(f"{path}/counts")


def _ranges(spark: SparkSession, path: str, first: int, size: int) -> list[tuple[int, int, int]]:
    """(partition, from, to) of the rows ``first`` to ``first + size``; one small row per partition is read."""
    found, before = [], 0
    for row in spark.read.parquet(f"{path}/counts").orderBy(PART).collect():
        start, end = max(first - before, 0), min(first + size - before, row.rows)
        if start < end:
            found.append((row[PART], start, end))
        before += row.rows
    return found


def read_page(spark: SparkSession, path: str, page: int = 1, page_size: int = 25) -> DataFrame:
    """One page of the rows stored by ``write_sorted``, in their order; a page beyond the last is empty."""
    check_page(page, page_size)
    rows = spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")
    inside = [
        (F.col(PART) == part) & (F.col(PLACE) >= start) & (F.col(PLACE) < end)
        for part, start, end in _ranges(spark, path, (page - 1) * page_size, page_size)
    ]
    wanted = rows.filter(reduce(lambda a, b: a | b, inside, F.lit(False)))
    return wanted.orderBy(PART, PLACE).drop(PART, PLACE)
