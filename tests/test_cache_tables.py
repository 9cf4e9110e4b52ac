"""Caches as tables: the same rows as the batch operators, and no file touched without need."""

import datetime
import os
import uuid

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from offerloom.operators import caches
from offerloom.plans import joins
from offerloom.sources import cache_tables

START = datetime.datetime(2024, 1, 2)
RESULT = (
    "query_normalized STRING, domain STRING, source_url STRING, product_name STRING, price DECIMAL(12,2), currency STRING, "
    "size_text STRING, location_city STRING, location_address STRING, location_lat DOUBLE, location_lon DOUBLE"
)


def now(hours=0):
    return F.lit(START + datetime.timedelta(hours=hours, minutes=30))


@pytest.fixture
def database(spark, tmp_path):
    name = f"cache_{uuid.uuid4().hex}"
    cache_tables.create_database(spark, name, str(tmp_path / name))
    yield name, tmp_path / name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def results(spark, numbers, name):
    rows = [(f"q{i}", "a.ro", f"https://a.ro/{i}", f"{name} {i}", None, "RON", None, None, None, None, None) for i in numbers]
    return spark.createDataFrame(rows, RESULT)


def cached(spark, n, hours):
    rows = results(spark, range(n), "old")
    i = F.regexp_extract("query_normalized", r"\d+", 0).cast("int")
    expires = F.lit(START) + F.make_dt_interval(hours=hours(i))
    key = F.sha1(F.concat_ws("|", "query_normalized", "source_url").cast("binary"))
    return rows.select(key.alias("cache_key"), "*", F.lit(START).alias("created_at"), expires.alias("expires_at"))


def files(folder):
    return {os.path.join(at, f) for at, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_upsert_rewrites_only_touched_buckets(spark, database):
    name, folder = database
    old = cached(spark, 300, lambda i: F.lit(5))
    cache_tables.create_result_cache(f"{name}.results", old, 32)
    same(cache_tables.result_cache(spark, f"{name}.results"), old)
    before = files(folder)
    assert len(before) == 32
    incoming = results(spark, [7, 7, 400], "new").withColumn("seq", F.monotonically_increasing_id())
    expected = caches.upsert_results(old, incoming, ["seq"], now())
    cache_tables.upsert_result_cache(f"{name}.results", incoming, ["seq"], now())
    same(cache_tables.result_cache(spark, f"{name}.results"), expected)
    after = files(folder)
    assert 1 <= len(before - after) <= 2 and len(after) == 32
    # Nothing incoming: nothing is written.
    cache_tables.upsert_result_cache(f"{name}.results", incoming.limit(0), ["seq"], now())
    assert files(folder) == after


def test_purge_of_results_keeps_live_buckets(spark, database):
    name, folder = database
    old = cached(spark, 40, lambda i: F.when(i == 3, 0).otherwise(5))
    cache_tables.create_result_cache(f"{name}.results", old, 32)
    before = files(folder)
    cache_tables.purge_result_cache(spark, f"{name}.results", now())
    same(cache_tables.result_cache(spark, f"{name}.results"), caches.purge_expired(old, now()))
    assert len(before - files(folder)) == 1
    cache_tables.purge_result_cache(spark, f"{name}.results", now(24))
    assert cache_tables.result_cache(spark, f"{name}.results").count() == 0 and not files(folder)


def _shuffled_scans(plan, table):
    """Scans of a table that stand below an exchange by cache_key."""
    above, found, scans = [], [], 0
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, text) for d, text in above if d < depth]
        if "FileScan" in line and table in line:
            scans += 1
            found += [text for _, text in above if "Exchange hashpartitioning" in text]
        above.append((depth, line))
    return scans, found


def test_lookup_moves_only_candidates(spark, database, monkeypatch, capsys):
    name, _ = database
    old = cached(spark, 300, lambda i: i % 2)
    cache_tables.create_result_cache(f"{name}.results", old, 32)
    wanted = spark.createDataFrame(
        [(f"q{i % 350}", f"https://a.ro/{i % 350}", "any", True) for i in range(0, 800, 3)] + [("q1", "https://a.ro/1", "any", True)] * 300,
        "query_normalized STRING, url STRING, radius_option STRING, include_unknown BOOLEAN",
    )
    expected = caches.cache_hits(wanted, old, now())
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(joins, "HOT_KEYS", 3)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = caches.cache_hits(wanted, cache_tables.result_cache(spark, f"{name}.results"), now())
        same(got, expected)
        capsys.readouterr()
        got.explain()
        scans, shuffled = _shuffled_scans(capsys.readouterr().out, f"{name}.results")
        assert scans >= 1 and shuffled == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_hours_of_the_url_cache(spark, database, capsys):
    name, folder = database
    rows = [("q", "manual", f"https://a.ro/{i}", 1.0, START, START + datetime.timedelta(minutes=20 * i - 200)) for i in range(30)]
    df = spark.createDataFrame([*rows, ("q", "manual", "https://a.ro/never", 1.0, START, None)], "query_normalized STRING, provider STRING, url STRING, score DOUBLE, created_at TIMESTAMP, expires_at TIMESTAMP")
    cache_tables.create_url_cache(f"{name}.urls", df)
    cache_tables.append_url_rows(f"{name}.urls", df)
    live = cache_tables.live_urls(spark, f"{name}.urls", now())
    expected = caches.purge_expired(df, now())
    same(live, expected)
    live.explain()
    assert "PartitionFilters: [isnotnull(expires_hour" in capsys.readouterr().out
    hour = int(START.replace(tzinfo=datetime.UTC).timestamp()) // 3600
    before = files(folder)
    cache_tables.purge_url_cache(spark, f"{name}.urls", now())
    after = files(folder)
    same(cache_tables.live_urls(spark, f"{name}.urls", now()), expected)
    same(spark.table(f"{name}.urls").drop("expires_hour"), expected)
    # Hours that are over are gone, the one at hand is rewritten, later ones keep their files.
    assert {f for f in before if f"expires_hour={hour}/" not in f and int(f.split("expires_hour=")[1].split("/")[0]) > hour} <= after
    assert not [f for f in after if int(f.split("expires_hour=")[1].split("/")[0]) < hour]
    cache_tables.purge_url_cache(spark, f"{name}.urls", now())
    assert files(folder) == after
    cache_tables.purge_url_cache(spark, f"{name}.urls", now(24))
    assert spark.table(f"{name}.urls").count() == 0


def test_upsert_groups_by_the_text_of_a_key_and_leaves_other_rows(spark):
    now = F.expr("TIMESTAMP '2024-01-02 00:00:00'")
    values = ", ".join(f"CAST(NULL AS {'DOUBLE' if c.startswith('location_l') else 'STRING'}) AS {c}" for c in caches.CACHED_VALUES)

    def rows(given, columns):
        df = spark.createDataFrame(given, columns)
        return df.selectExpr("*", *[v for v in values.split(", ") if v.split(" AS ")[-1] not in df.columns])

    old = rows([("q|a", "q", "d", "a", "old"), ("q|b", "q", "d", "b", "old"), (None, "q", "d", "c", "old")], "text STRING, query_normalized STRING, domain STRING, source_url STRING, product_name STRING")
    old = old.withColumn("cache_key", F.sha1("text")).withColumn("created_at", now).withColumn("expires_at", now).drop("text")
    # The first two are one key, though not one pair.
    given = [("q", "d", "a", "first", 1), (None, "d", "q|a", "last", 2), ("q", "d", "z", "new", 1)]
    new = rows(given, "query_normalized STRING, domain STRING, source_url STRING, product_name STRING, n INT")
    assert caches.last_results(new, ["n"]).count() == 2
    found = {(r.source_url, r.product_name) for r in caches.upsert_results(old, new, ["n"], now).collect()}
    assert found == {("a", "last"), ("b", "old"), ("c", "old"), ("z", "new")}


def test_a_refresh_moves_incoming_rows_only(spark, database, monkeypatch):
    name, _ = database
    old = cached(spark, 300, lambda i: F.lit(5))
    cache_tables.create_result_cache(f"{name}.results", old, 32)
    incoming = results(spark, range(290, 320), "new").withColumn("seq", F.monotonically_increasing_id())
    expected = caches.upsert_results(old, incoming, ["seq"], now())
    plans, insert = [], DataFrameWriter.insertInto

    def recorded(writer, *args, **options):
        plans.append(writer._df._jdf.queryExecution().executedPlan().toString())
        insert(writer, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "insertInto", recorded)
    cache_tables.upsert_result_cache(f"{name}.results", incoming, ["seq"], now())
    (plan,) = plans
    # The only shuffle is that of the incoming rows, and the cache is not sorted either.
    assert plan.count("Exchange ") == 1 and "Sort" not in plan
    same(cache_tables.result_cache(spark, f"{name}.results"), expected)
