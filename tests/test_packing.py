"""Packed rows: all of them, of every type, and few values per key and task."""

import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from offerloom.streaming import packing


def test_rows_are_packed_by_key_and_task(spark):
    at = datetime.datetime(2024, 3, 31, 2, 30)
    rows = [
        (None if i % 5 == 4 else f"k{i % 5}", i, None if i % 3 else at, Decimal(i) / 4, [i, None], None if i % 7 else float(i))
        for i in range(2000)
    ]
    schema = "key STRING, i BIGINT, at TIMESTAMP, price DECIMAL(12,2), list ARRAY<INT>, x DOUBLE"
    df = spark.createDataFrame(rows, schema).repartition(3)
    packed = packing.pack(df, "key").cache()
    assert packed.groupBy("key").count().count() == 5 and packed.count() <= 5 * 3
    back = packing.unpack(packed.filter("key IS NULL OR key <> 'k0'"), df.schema)
    assert back.schema == df.schema
    expected = df.filter("key IS NULL OR key <> 'k0'")
    assert sorted(map(str, back.collect())) == sorted(map(str, expected.collect()))
    none = packing.pack(df.filter(F.lit(False)), "key")
    assert packing.unpack(none, df.schema).count() == 0
