"""Caches, result views, sinks."""

import csv
import datetime
import decimal
import glob

import pytest
from pyspark.sql import functions as F

from offerloom import schemas
from offerloom.operators import caches, results
from offerloom.sources import sinks

NOW = datetime.datetime(2024, 1, 2)
HOUR = datetime.timedelta(hours=1)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def cached(spark, rows):
    full = [
        (key, "q", "a.ro", url, name, decimal.Decimal("49.90"), "RON", None, city, None, lat, lon, NOW - HOUR, expires)
        for key, url, name, city, lat, lon, expires in rows
    ]
    return spark.createDataFrame(full, schemas.CACHED_RESULTS)


def key_of(url):
    import hashlib

    return hashlib.sha1(f"q|{url}".encode()).hexdigest()


def test_hits_and_misses(spark):
    cache = cached(
        spark,
        [
            (key_of("u1"), "u1", "Ghiveci Ă", "Cluj", 46.7712, 23.6236, NOW),
            (key_of("u2"), "u2", "B", None, None, None, NOW - HOUR),
            (key_of("u3"), "u3", "C", None, None, None, NOW + HOUR),
        ],
    )
    candidates = spark.createDataFrame(
        [("j", "q", u, o, f) for u in ("u1", "u2", "u3") for o, f in (("50", False), ("All Romania", False), ("50", True))],
        "job_id STRING, query_normalized STRING, url STRING, radius_option STRING, include_unknown BOOLEAN",
    )
    hits = caches.cache_hits(candidates, cache, now()).collect()
    assert sorted((r.url, r.radius_option, r.include_unknown, r.accepted) for r in hits) == [
        ("u1", "50", False, False), ("u1", "50", True, False), ("u1", "All Romania", False, True),
        ("u3", "50", False, False), ("u3", "50", True, True), ("u3", "All Romania", False, True),
    ]
    first = next(r for r in hits if r.url == "u1")
    assert (first.price_token, first.normalized_name, first.canonical_url) == ("49.90", "ghiveci a", "u1")
    assert first.distance_km > 300 and first.extraction_method == "cache" and first.location_unknown is False
    assert {r.url for r in caches.cache_misses(candidates, cache, now()).collect()} == {"u2"}
    assert {r.source_url for r in caches.purge_expired(cache, now()).collect()} == {"u1", "u3"}


def test_upsert(spark):
    cache = cached(spark, [(key_of("u1"), "u1", "vechi", None, None, None, NOW - HOUR), (key_of("u9"), "u9", "alt", None, None, None, NOW)])
    columns = ["query_normalized", "domain", "source_url", *caches.CACHED_VALUES, "n"]
    rows = [("q", "b.ro", u, name, decimal.Decimal("1.00"), "EUR", "1 l", None, None, None, None, n) for u, name, n in [("u1", "nou1", 1), ("u1", "nou2", 2), ("u2", "x", 1)]]
    incoming = spark.createDataFrame(
        rows,
        "query_normalized STRING, domain STRING, source_url STRING, product_name STRING, price DECIMAL(12,2), currency STRING, "
        "size_text STRING, location_city STRING, location_address STRING, location_lat DOUBLE, location_lon DOUBLE, n INT",
    )
    assert incoming.columns == columns
    merged = caches.upsert_results(cache, incoming, ["n"], now())
    assert merged.schema.names == schemas.CACHED_RESULTS.names
    got = {r.source_url: (r.product_name, r.domain, r.created_at, r.expires_at) for r in merged.collect()}
    later = NOW + datetime.timedelta(hours=24)
    assert got == {
        "u1": ("nou2", "a.ro", NOW - HOUR, later),
        "u9": ("alt", "a.ro", NOW - HOUR, NOW),
        "u2": ("x", "b.ro", NOW, later),
    }


def test_url_cache(spark):
    requests = spark.createDataFrame([("a", "q1", 10), ("b", "q2", 30), ("c", "q3", 30)], "job_id STRING, query_normalized STRING, max_urls INT")
    rows = [("q1", 9), ("q2", 10)]
    urls = spark.createDataFrame([(q, f"u{i}", 1.0) for q, n in rows for i in range(n)], "query_normalized STRING, url STRING, score DOUBLE")
    appended = caches.append_url_cache(urls, now())
    assert appended.schema.names == schemas.CACHED_URLS.names
    gate = {r.job_id: (r.cached_urls, r.use_cache) for r in caches.url_cache_gate(requests, appended, now()).collect()}
    assert gate == {"a": (9, False), "b": (10, True), "c": (0, False)}


def test_the_gate_counts_cached_urls_once(spark, tmp_path):
    rows = [("q", f"u{i}", 1.0) for i in range(10)]
    urls = caches.append_url_cache(spark.createDataFrame(rows, "query_normalized STRING, url STRING, score DOUBLE"), now())
    urls.write.parquet(str(tmp_path / "urls"))
    stored = spark.read.parquet(str(tmp_path / "urls"))
    requests = spark.createDataFrame([("a", "q", 30), ("b", "r", 30)], "job_id STRING, query_normalized STRING, max_urls INT")
    gated = caches.url_cache_gate(requests, stored, now())
    assert {r.job_id: (r.cached_urls, r.use_cache) for r in gated.collect()} == {"a": (10, True), "b": (0, False)}
    assert set(stored.inputFiles()).isdisjoint(gated.inputFiles())


def result_rows(spark):
    rows = [
        ("1", 'Ghiveci "mic", rotund', "ghiveci mic rotund", "B.ro", "https://b.ro/1", decimal.Decimal("49.90"), "RON", "30 cm", None, None, 0.0, False),
        ("2", "Pamant", "pamant", "a.ro", "https://a.ro/2", None, None, "50 l", "Cluj", "Cluj, Romania", 325.5, False),
        ("3", "Set", "set", "a.ro", "https://a.ro/3", decimal.Decimal("100.00"), "EUR", None, None, None, None, True),
        ("4", "Trandafir", "trandafir", "c.ro", "https://c.ro/4", decimal.Decimal("7.00"), "RON", "1_5 L", "Iasi", None, 12.25, False),
    ]
    return spark.createDataFrame(
        rows,
        "id STRING, product_name STRING, normalized_name STRING, domain STRING, source_url STRING, price DECIMAL(12,2), currency STRING, "
        "size_text STRING, location_city STRING, location_address STRING, distance_km DOUBLE, location_unknown BOOLEAN",
    )


def ids(df):
    return [r.id for r in df.collect()]


def test_filter_sort_page(spark):
    df = result_rows(spark)
    assert set(ids(results.filter_results(df, product_contains="GHIVECI,  mic"))) == {"1"}
    assert set(ids(results.filter_results(df, product_contains="--"))) == {"1", "2", "3", "4"}
    assert set(ids(results.filter_results(df, size_contains="_0"))) == {"1", "2"}
    assert set(ids(results.filter_results(df, price_min=7, price_max=49.9))) == {"1", "4"}
    assert ids(results.sort_results(df)) == ["4", "1", "3", "2"]
    assert ids(results.sort_results(df, "anything", "DOWN")) == ["2", "3", "1", "4"]
    assert ids(results.sort_results(df, "site", "ASC")) == ["1", "2", "3", "4"]
    ordered = results.sort_results(df, "price", "asc")
    assert [ids(results.page_results(ordered, p, 3)) for p in (1, 2, 3)] == [["4", "1", "3"], ["2"], []]
    assert results.result_total(results.filter_results(df, price_min=8)).first().total == 2
    for page, size in ((0, 25), (1, 0), (1, 501)):
        with pytest.raises(ValueError, match="page"):
            results.page_results(ordered, page, size)


def test_a_page_is_a_top_k_not_a_full_sort(spark):
    plan = results.page_results(results.sort_results(result_rows(spark)), 2, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=20" in plan


def test_table_view(spark):
    rows = results.api_rows(result_rows(spark))
    assert ids(results.table_view(rows)) == ["4", "1", "3", "2"]
    assert ids(results.table_view(rows, sort_dir="desc")) == ["2", "3", "1", "4"]
    assert ids(results.table_view(rows, sort_by="site")) == ["2", "3", "1", "4"]
    assert ids(results.table_view(rows, price_min=0)) == ["4", "1", "3"]
    assert ids(results.table_view(rows, name_contains='"MIC"')) == ["1"]
    assert ids(results.table_view(rows, size_contains="_")) == ["4"]


def test_display_rows(spark):
    shown = results.display_rows(results.api_rows(result_rows(spark))).orderBy("id").collect()
    assert [r.priceLabel for r in shown] == ["49.9 RON", "-", "100 EUR", "7 RON"]
    assert [r.locationLabel for r in shown] == ["Romania", "Cluj (325.5 km)", "Necunoscut", "Iasi (12.25 km)"]
    assert [r.sizeLabel for r in shown] == ["30 cm", "50 l", "-", "1_5 L"]


def test_csv_file(spark, tmp_path):
    path = str(tmp_path / "csv")
    sinks.write_csv(results.api_rows(result_rows(spark)).coalesce(1).orderBy("id"), path)
    lines, written = [], ""
    for name in sorted(glob.glob(f"{path}/*.csv")):
        with open(name, newline="") as f:
            text = f.read()
            written += text
            lines += list(csv.reader(text.splitlines()))
    header = list(results.CSV_HEADERS.values())
    rows = [line for line in lines if line != header]
    assert rows[0] == ['Ghiveci "mic", rotund', "B.ro", "49.9", "RON", "30 cm", "", "", "0", "https://b.ro/1"]
    assert rows[2] == ["Set", "a.ro", "100", "EUR", "", "", "", "", "https://a.ro/3"]
    assert '"Ghiveci ""mic"", rotund"' in written


def test_job_status(spark):
    jobs = spark.createDataFrame([("a", "running"), ("b", "done"), ("c", "queued")], "job_id STRING, status STRING")
    items = spark.createDataFrame(
        [("a", True, True, False), ("a", True, False, True), ("a", False, None, None)],
        "job_id STRING, processed BOOLEAN, found BOOLEAN, error BOOLEAN",
    )
    got = {r.job_id: tuple(r)[2:] for r in results.job_status(jobs, items).collect()}
    assert got == {"a": (3, 2, 1, 1, 66.67), "b": (0, 0, 0, 0, 100.0), "c": (0, 0, 0, 0, 0.0)}


def test_union_cached_fresh_order(spark):
    cached_rows = spark.createDataFrame([("j", 2), ("j", 4)], "job_id STRING, rank INT")
    fresh_rows = spark.createDataFrame([("j", 1), ("j", 3), ("j", 5)], "job_id STRING, rank INT")
    merged = results.union_cached_fresh(cached_rows, fresh_rows, batch_size=3).orderBy("ord").collect()
    assert [(r.batch_no, r.rank) for r in merged] == [(0, 2), (0, 1), (0, 3), (1, 4), (1, 5)]


def test_results_are_cut_to_width_and_flagged(spark):
    df = spark.createDataFrame([("n" * 600, "5", decimal.Decimal(5)), ("n", "9" * 15, None)], "product_name STRING, price_token STRING, price DECIMAL(12,2)")
    got = results.fit_to_store(df).collect()
    assert [len(r.product_name) for r in got] == [500, 1] and [r.truncated for r in got] == [True, True]


def test_write_results_appends_by_job_bucket(spark, tmp_path):
    path = str(tmp_path / "results")
    df = spark.range(20).selectExpr("concat('j', id % 4) AS job_id", "concat('u', id) AS source_url")
    sinks.write_results(df, path, buckets=4)
    sinks.write_results(df, path, buckets=4)
    assert spark.read.parquet(path).count() == 40


def test_cache_rewrites_never_overwrite(spark, tmp_path):
    path = str(tmp_path / "cache")
    sinks.rewrite_table(spark.range(3), path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.rewrite_table(spark.range(3), path)


def test_results_of_one_job_are_read_from_its_bucket(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = [(f"j{i % 20}", "x" * 600, f"https://a.ro/{i}") for i in range(100)]
    sinks.write_results(spark.createDataFrame(rows, "job_id STRING, product_name STRING, source_url STRING"), path, buckets=8)
    found = sinks.job_results(spark, path, "j3", buckets=8)
    assert sorted(r.source_url for r in found.collect()) == sorted(r[2] for r in rows if r[0] == "j3")
    assert all(r.truncated and len(r.product_name) == 500 for r in found.collect())
    assert "PartitionFilters: [isnotnull(job_bucket" in found._jdf.queryExecution().executedPlan().toString()
    assert sinks.job_results(spark, path, "none", buckets=8).count() == 0
