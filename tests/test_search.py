"""The whole search on a small web."""

import dataclasses
import datetime
import decimal
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from offerloom import schemas
from offerloom.operators import extract
from offerloom.operators.extract import DEFAULT_SITE_RULES
from offerloom.operators.requests import validate_requests
from offerloom.plans import joins
from offerloom.plans import search as search_plan
from offerloom.plans.checkpoints import materialize
from offerloom.plans.search import SearchInput, search

NOW = datetime.datetime(2024, 5, 1)
LATER = NOW + datetime.timedelta(hours=24)


def page(name, text):
    return f"<html><h1>{name}</h1><p>{text}</p>{'<p>umplutura</p>' * 40}</html>"


PAGES = [
    ("https://a.ro/produs/rosu", page("Trandafir rosu", "49,90 lei in Bucuresti"), "httpx"),
    ("https://a.ro/produs/alb", page("Trandafir alb", "10 lei in Cluj"), "httpx"),
    ("https://b.ro/p/rosu", page("Trandafir  roșu", "49,90 lei in Bucuresti") + '<link rel="canonical" href="https://a.ro/produs/rosu">', "httpx"),
    ("https://b.ro/p/js", "<h1>enable javascript</h1>", "httpx"),
    ("https://b.ro/p/browser", "<h1>Scurt</h1><p>5 lei Bucuresti</p>", "playwright-reused"),
    ("https://b.ro/p/gol", "<p>fara nume</p>" * 40, "httpx"),
]
LINKS = [
    ("a.ro", 0, "https://a.ro/produs/rosu", "Trandafir"),
    ("a.ro", 1, "https://a.ro/produs/alb", ""),
    ("a.ro", 2, "https://a.ro/contact", ""),
    ("a.ro", 3, "https://a.ro/blog", "forum"),
    ("b.ro", 0, "https://b.ro/p/rosu", "Trandafir"),
    ("b.ro", 1, "https://b.ro/p/js", "trandafir"),
    ("b.ro", 2, "https://b.ro/p/browser", ""),
    ("b.ro", 3, "https://b.ro/p/gol", "trandafir"),
]


def small_web(spark):
    requests = [
        ("near", "Trandafir", "Bucuresti", False, 10, 60),
        ("all", "trandafir", "All Romania", False, 200, 60),
        ("cached", "cache", "All Romania", False, 10, 60),
        ("bad", "x", "All Romania", False, 10, 60),
    ]
    cached_urls = [("cache", "manual", f"https://c.ro/p/{i}", float(i), NOW, LATER) for i in range(11)]
    cached_urls += [("cache", "manual", "https://c.ro/p/old", 99.0, NOW, NOW - datetime.timedelta(seconds=1))]
    key = hashlib.sha1(b"cache|https://c.ro/p/9").hexdigest()
    cached_results = [
        (key, "cache", "c.ro", "https://c.ro/p/9", "Din cache", decimal.Decimal("1.00"), "RON", None, None, None, None, None, NOW, LATER)
    ]
    given = SearchInput(
        requests=spark.createDataFrame(requests, schemas.REQUESTS),
        allowed=spark.createDataFrame([("a.ro",), ("b.ro",)], "domain STRING"),
        links=spark.createDataFrame(LINKS, schemas.LINKS),
        pages=spark.createDataFrame(PAGES, schemas.PAGES),
        gazetteer=spark.createDataFrame(
            [("Bucuresti", "Bucuresti", "Bucuresti, RO", 44.43, 26.1, "Romania"), ("Cluj", None, "Cluj, RO", 46.77, 23.62, "Romania")],
            schemas.GAZETTEER,
        ),
        rules=spark.createDataFrame([tuple(r.values()) for r in DEFAULT_SITE_RULES], schemas.SITE_RULES),
        robots=spark.createDataFrame([("a.ro", "*", 1, False, "/contact")], schemas.ROBOTS_RULES),
        cached_urls=spark.createDataFrame(cached_urls, schemas.CACHED_URLS),
        cached_results=spark.createDataFrame(cached_results, schemas.CACHED_RESULTS),
    )
    return given


def run(given):
    return search(given, F.lit(NOW).cast("timestamp_ntz"), "OfferBot/1.0")


@pytest.fixture(scope="module")
def found(spark):
    return run(small_web(spark))


def test_candidates_are_spread_evenly(spark):
    given = small_web(spark)
    wanted = spark.range(600).selectExpr("concat('j', id) AS job_id", "element_at(array('trandafir', 'rosu', 'alb'), int(id % 3) + 1) AS query")
    requests = wanted.coalesce(1).selectExpr("*", "'All Romania' AS radius_option", "false AS include_unknown", "30 AS max_urls", "60 AS time_budget_seconds")
    candidates, _ = search_plan.find_candidates(given, validate_requests(requests), F.lit(NOW))
    sizes = [r["count"] for r in candidates.groupBy(F.col("_metadata.file_path")).count().collect()]
    # They came from requests in one partition.
    assert len(sizes) > 8 and max(sizes) <= 3 * sum(sizes) / len(sizes)


def test_source_of_pages_is_not_shuffled(spark, monkeypatch, tmp_path):
    given = small_web(spark)
    given.pages.write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    urls = spark.createDataFrame([(p[0],) for p in PAGES] + [("https://none.ro/p",)], "url STRING")
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(search_plan, "materialize", lambda df: written.append(df) or materialize(df))
    written = []
    given = dataclasses.replace(given, pages=pages, extract=extract.extract_products)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        got = search_plan.extract_needed(given, urls, "OfferBot/1.0")
        execution = written[-1]._jdf.queryExecution()
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(execution, "formatted")
    finally:
        spark.conf.set(threshold, before)
    assert {r.url for r in got.collect()} == {p[0] for p in PAGES if "/p/js" not in p[0] and "/p/gol" not in p[0]}
    assert len(re.findall(r"ReadSchema: \S*html", plan)) == 1
    shuffled = re.findall(r"\n\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: (.*)", plan)
    assert len(shuffled) >= 3 and not any("html#" in columns for columns in shuffled)


def test_settings(spark):
    given = dataclasses.replace(small_web(spark), top_per_domain=1, ttl_hours=1, batch_size=2)
    out = run(given)
    assert {r.url for r in out.new_cached_urls.collect()} == {"https://a.ro/produs/rosu", "https://b.ro/p/rosu"}
    assert {r.expires_at for r in out.new_cached_urls.collect()} == {NOW + datetime.timedelta(hours=1)}


def test_results(found):
    rows = {(r.job_id, r.source_url): r for r in found.results.collect()}
    # b.ro/p/rosu has the canonical URL of a.ro/produs/rosu and is dropped.
    assert set(rows) == {
        ("near", "https://a.ro/produs/rosu"),
        ("all", "https://a.ro/produs/rosu"),
        ("all", "https://a.ro/produs/alb"),
        ("cached", "https://c.ro/p/9"),
    }
    near = rows["near", "https://a.ro/produs/rosu"]
    assert (near.product_name, near.normalized_name, near.price_token, near.domain) == ("Trandafir rosu", "trandafir rosu", "49.90", "a.ro")
    assert (near.location_city, near.extraction_method, near.extractor) == ("Bucuresti", "httpx", "heuristic")
    assert rows["all", "https://a.ro/produs/alb"].location_city == "Cluj"
    assert rows["cached", "https://c.ro/p/9"].extraction_method == "cache"


def test_counters(found):
    status = {r.job_id: (r.total_candidate_urls, r.processed_urls, r.found_products, r.errors, r.progress) for r in found.status.collect()}
    # Three links per domain; a.ro/contact may not be read, b.ro/p/js needs a browser.
    assert status == {"near": (6, 6, 1, 2, 100.0), "all": (6, 6, 2, 2, 100.0), "cached": (10, 10, 1, 9, 100.0)}


def test_caches(found):
    urls = {(r.query_normalized, r.url) for r in found.new_cached_urls.collect()}
    assert urls == {("trandafir", l[2]) for l in LINKS if l[2] not in ("https://a.ro/blog", "https://b.ro/p/browser")}
    refreshed = {(r.query_normalized, r.source_url): r.expires_at for r in found.cached_results.collect()}
    assert refreshed == {
        ("cache", "https://c.ro/p/9"): LATER,
        ("trandafir", "https://a.ro/produs/rosu"): LATER,
        ("trandafir", "https://a.ro/produs/alb"): LATER,
        ("trandafir", "https://b.ro/p/rosu"): LATER,
    }


def test_only_cached_rows_of_candidates_are_looked_up(spark, monkeypatch):
    given, seen, real = small_web(spark), [], search_plan.caches.cache_lookup
    other = given.cached_results.withColumn("cache_key", F.sha1(F.concat(F.lit("other"), "cache_key")))
    given = dataclasses.replace(given, cached_results=given.cached_results.unionByName(other))

    def spied(candidates, cached_results, now):
        seen.append(cached_results.count())
        return real(candidates, cached_results, now)

    monkeypatch.setattr(search_plan.caches, "cache_lookup", spied)
    output = run(given)
    assert seen and seen[0] <= given.cached_results.count() // 2
    assert {r.cache_key for r in other.collect()} <= {r.cache_key for r in output.cached_results.collect()}
