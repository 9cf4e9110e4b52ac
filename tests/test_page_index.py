"""Pages of stored sorted rows against slices of a list."""

import re

import pytest
from pyspark.sql import functions as F

from offerloom.operators.results import sort_results
from offerloom.sources import page_index


def offers(spark, n):
    rows = [(f"o{i:04}", None if i % 23 == 0 else f"s{i % 5}", None if i % 11 == 0 else float(i * 7 % 100)) for i in range(n)]
    return spark.createDataFrame(rows, "id STRING, domain STRING, price DOUBLE")


def test_pages_are_slices(spark, tmp_path):
    ordered = sort_results(offers(spark, 1000).repartition(8), "price", "desc")
    path = str(tmp_path / "sorted")
    threshold = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        page_index.write_sorted(ordered, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", threshold)
    assert spark.read.parquet(f"{path}/counts").count() > 4
    all_rows = ordered.collect()
    for page, size in [(1, 30), (7, 30), (34, 30), (35, 30), (2, 200), (5, 200)]:
        got = page_index.read_page(spark, path, page, size)
        assert got.columns == ["id", "domain", "price"]
        assert got.collect() == all_rows[(page - 1) * size : page * size]


def test_a_deep_page_reads_no_more_than_the_first(spark, tmp_path, capsys):
    path = str(tmp_path / "sorted")
    rows = spark.range(400_000).select(F.col("id").cast("string").alias("id"), F.lit("s").alias("domain"), F.col("id").cast("double").alias("price"))
    page_index.write_sorted(sort_results(rows, "price"), path)
    parts = spark.read.parquet(f"{path}/counts").count()
    for page in (1, 10_000):
        assert len(page_index._ranges(spark, path, (page - 1) * 25, 25)) <= 2 <= parts
        got = page_index.read_page(spark, path, page)
        assert [r.id for r in got.collect()] == [str(25 * (page - 1) + i) for i in range(25)]
        capsys.readouterr()
        got.explain()
        plan = capsys.readouterr().out
        assert re.search(r"PartitionFilters: \[[^\]]*page_part", plan) and re.search(r"PushedFilters: \[[^\]]*page_place", plan)


def test_empty_and_wrong_pages(spark, tmp_path):
    path = str(tmp_path / "sorted")
    page_index.write_sorted(sort_results(offers(spark, 3).filter("false"), "site"), path)
    assert page_index.read_page(spark, path).columns == ["id", "domain", "price"]
    assert page_index.read_page(spark, path, 4).collect() == []
    with pytest.raises(ValueError):
        page_index.read_page(spark, path, 0)
