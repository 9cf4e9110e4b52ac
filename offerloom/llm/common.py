"""What the operators share: session settings, scratch tables, positions, batches of texts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.plans.checkpoints import working_folder

# Python workers see at most this much at a time, whatever the length of a text.
ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD = r"[^\x20\x09-\x0D]+"


def prepare(df: DataFrame) -> SparkSession:
    """The session of a table, with bounded Arrow batches."""
    spark = df.sparkSession
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


class Stored:
    """A table written to the shared folder; its shuffle files go as soon as it is written."""

    def __init__(self, df: DataFrame, purpose: str):
        self.spark = df.sparkSession
        self.path = working_folder(self.spark, purpose)
        with setting(self.spark, FREE_SHUFFLES, "true"):
            df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def empty(self) -> None:
        """Give the space back; for tables that no later step reads."""
        self.spark.range(0).write.mode("overwrite").parquet(self.path)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    return Stored(df, purpose).df


def numbered(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """Add the position, from 0, in the total order of ``keys``.

    A range shuffle and a sort within partitions; only the row counts of the
    partitions, at most one row each, are added up apart and broadcast.
    """
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = stored(ordered.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    table = table.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1))
    counts = table.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect()
    offsets, total = [], 0
    for row in counts:
        offsets.append((row["_p"], total))
        total += row["n"]
    starts = df.sparkSession.createDataFrame(offsets, "_p long, _start long")
    joined = table.join(F.broadcast(starts), "_p")
    return joined.withColumn(name, F.col("_start") + F.col("_i")).drop("_m", "_p", "_i", "_start")


def free_name(columns: list[str], name: str) -> str:
    """A column name that is not taken, whatever the letter case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(column: pa.Array) -> list[bytes]:
    """The texts of a batch as UTF-8; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def slices(texts: list[bytes], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``limit`` bytes; a longer text is a range of its own."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def forest(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the nodes of all pairs (i, j) in ``parent``, where every node names its smallest member."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


class Groups:
    """Cut a stream of Arrow batches, sorted by key columns, into batches of whole groups."""

    def __init__(self, keys: list[str]):
        self.keys = keys

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
        """Yields tables and the first row of each group in them."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            first, last = held[0], batch
            if all(first.column(k)[0] == last.column(k)[-1] for k in self.keys):
                continue
            table = pa.Table.from_batches(held)
            starts = self.starts(table)
            yield table.slice(0, starts[-1]), starts[:-1]
            rest = table.slice(starts[-1]).combine_chunks()
            held = rest.to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield table, self.starts(table)

    def starts(self, table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for key in self.keys:
            values = table.column(key).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)
