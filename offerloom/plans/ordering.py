"""Places in a total order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.plans.checkpoints import materialize


def with_places(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """The rows with their place from 1 in a total order.

    Rows are range partitioned, numbered inside their partition, and moved on by
    the sizes of the partitions before, of which the driver sees one number each.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}
    before, starts = 0, []
    for part in range(max(sizes, default=-1) + 1):
        starts.append(before)
        before += sizes.get(part, 0)
    start = F.get(F.array(*[F.lit(s).cast("bigint") for s in starts]), F.col("_part")) if starts else F.lit(0)
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn(out, start + inside).drop("_part")
