"""The shared joins give the same rows whichever way they take."""

import pytest
from pyspark.sql import functions as F

from offerloom.plans import joins


def tables(spark):
    # A third of the rows share one key; some keys are null or unknown.
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 50}") for i in range(600)]
    large = spark.createDataFrame(rows, "i INT, k STRING")
    keyed = spark.createDataFrame([(f"k{j}", j) for j in range(0, 40)] + [("hot", -1), (None, -2)], "k STRING, v INT")
    return large, keyed


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot", [0, 3])
def test_lookup_join_beyond_the_broadcast_bound(spark, monkeypatch, how, hot):
    large, keyed = tables(spark)
    if how in ("left_semi", "left_anti"):
        keyed = keyed.select("k")
    expected = large.join(keyed, "k", how).collect()
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(joins, "HOT_KEYS", hot)
    got = joins.lookup_join(large, keyed, ["k"], how, costly=hot == 0)
    assert got.columns == large.join(keyed, "k", how).columns
    assert sorted(map(str, got.collect())) == sorted(map(str, expected))


def test_match_join_beyond_the_broadcast_bound(spark, monkeypatch):
    large, _ = tables(spark)
    other = spark.createDataFrame([(k, n) for k in ("hot", "k1", "k2") for n in range(4)], "k STRING, n INT")
    expected = sorted(map(str, large.join(other, "k").collect()))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    got = joins.match_join(large, other, ["k"])
    assert sorted(map(str, got.collect())) == expected


def test_small_tables_are_broadcast(spark):
    large, keyed = tables(spark)
    plan = joins.lookup_join(large, keyed, ["k"], "left")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_wide_rows_are_not_small(spark, monkeypatch):
    rows = spark.createDataFrame([("a", ["x" * 50])] * 10, "k STRING, v ARRAY<STRING>")
    assert joins.is_small(rows)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 500)
    assert not joins.is_small(rows)
    assert joins.is_small(rows.select("k"))


@pytest.mark.parametrize("bits", [1 << 27, 64])
def test_likely_in_keeps_every_wanted_row(spark, monkeypatch, bits):
    monkeypatch.setattr(joins, "FILTER_BITS", bits)
    large = spark.range(2000).select(F.concat(F.lit("u"), "id").alias("url"), "id")
    large = large.unionByName(spark.createDataFrame([(None, 1)], "url STRING, id BIGINT"))
    wanted = spark.range(20).select(F.concat(F.lit("u"), F.col("id") * 100).alias("url"))
    found = joins.likely_in(large, wanted, "url")
    assert found.columns == large.columns
    ids = {r.id for r in found.collect() if r.url}
    assert {i * 100 for i in range(20)} <= ids
    assert len(ids) == 20 if bits > 64 else len(ids) < 1000
    assert joins.likely_in(large, wanted.limit(0), "url").count() == 0


def test_mark_likely_keeps_all_rows_and_marks_the_wanted(spark):
    large = spark.range(5000).select("id", F.lit("taken").alias("_bucket"), F.lit(None).cast("int").alias("_bits"))
    wanted = spark.range(0, 5000, 7).select(F.xxhash64("id").alias("h"))
    marked = joins.mark_likely(large, wanted, F.xxhash64("id"), "maybe")
    rows = marked.collect()
    assert marked.columns == [*large.columns, "maybe"] and len(rows) == 5000
    assert all(r.maybe for r in rows if r.id % 7 == 0) and sum(r.maybe for r in rows) < 5000 / 7 + 50
    assert not any(r.maybe for r in joins.mark_likely(large, wanted.limit(0), F.xxhash64("id"), "maybe").collect())


def test_only_keys_with_a_large_share_are_hot(spark, monkeypatch):
    large = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    for classes in (joins.HOT_CLASSES, 5):
        monkeypatch.setattr(joins, "HOT_CLASSES", classes)
        assert [r.k for r in joins.hot_keys(large, ["k"]).collect()] == [-1]
        assert joins.hot_keys(large.filter("k >= 0"), ["k"]).isEmpty()


def test_rows_that_match_nothing_are_not_shuffled(spark, monkeypatch, tmp_path):
    spark.range(4000).select("id", F.concat(F.lit("k"), "id").alias("k")).write.parquet(f"{tmp_path}/large")
    large = spark.read.parquet(f"{tmp_path}/large")
    keyed = spark.range(0, 4000, 10).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    marked = []
    real = joins.mark_by
    monkeypatch.setattr(joins, "mark_by", lambda *args: marked.append(real(*args)) or marked[-1])
    assert joins.lookup_join(large, keyed, ["k"], "left_anti").count() == 3600
    assert joins.lookup_join(large, keyed, ["k"], "left").filter("v IS NOT NULL").count() == 400
    assert len(marked) == 2 and all(400 <= m.filter("_likely").count() < 450 for m in marked)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_keys_of_two_types_still_match(spark, monkeypatch, how):
    large = spark.range(100).select(F.col("id").cast("int").alias("k"))
    keyed = spark.range(0, 100, 7).select(F.col("id").alias("k"))
    expected = sorted(r.k for r in large.join(keyed, "k", how).collect())
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 5)
    assert sorted(r.k for r in joins.lookup_join(large, keyed, ["k"], how).collect()) == expected
