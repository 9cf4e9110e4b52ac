"""Every registered query: the operator on whole given or derived tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions import text as T
from offerloom.functions import urls as U
from offerloom.functions.geo import distance_from_center
from offerloom.operators import caches, discovery, extract, location, requests, results, robots
from offerloom.operators.dedupe import dedupe_results
from offerloom.operators.ratelimit import rate_limit
from offerloom.plans.checkpoints import materialize, working_folder
from offerloom.plans.search import SearchInput, find_candidates, refresh_tables, search
from offerloom.sources import cache_tables, page_index, tables
from offerloom.sources.sinks import job_results as stored_job_results
from offerloom.sources.sinks import write_csv, write_results
from offerloom.streaming import jobs as streams
from workload.fixtures import derive, stream_of, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ROBOT = "OfferBot/1.0"
DAY_SECONDS = 24 * 3600
CANDIDATE_ORDER = ["ord", "l_partkey", "l_suppkey"]


def now():
    return F.expr("TIMESTAMP '2024-01-02 00:00:00'")


def query(run: Query) -> Query:
    QUERIES[run.__name__.removesuffix("_query")] = run
    return run


def _double_price(df: DataFrame) -> DataFrame:
    return df.withColumn("price", F.col("price").cast("double"))


# Sources and requests


@query
def read_pages(spark, sf):
    folder, given = working_folder(spark, "crawls"), table(spark, sf, "pages")
    given.withColumn("crawl", F.lit(1).cast("bigint")).write.parquet(folder)
    again = given.filter(F.col("page_id") % 3 == 0).withColumn("html", F.concat(F.lit("<!-- 2 -->"), "html"))
    again.withColumn("crawl", F.lit(2).cast("bigint")).write.mode("append").parquet(folder)
    newest = tables.read_pages(spark, folder, version="crawl")
    return newest.select("page_id", "url", "crawl", F.md5(F.col("html").cast("binary")).alias("html_md5"))


@query
def allowed_domains(spark, sf):
    return requests.allowed_domains(table(spark, sf, "fx_domain_entries"))


@query
def validate_requests(spark, sf):
    given = table(spark, sf, "fx_requests")
    rejected = requests.rejected_requests(given).withColumn("errors", F.array_join("errors", ","))
    return requests.validate_requests(given).withColumn("errors", F.lit("")).unionByName(rejected)


# Text, prices, sizes, cities


@query
def normalize_text(spark, sf):
    normalized = T.normalize_text(F.col("text")).alias("normalized")
    return table(spark, sf, "documents").select("doc_id", normalized)


@query
def parse_price(spark, sf):
    parsed = T.add_price(table(spark, sf, "fx_offers").select("id", "price_text"), "price_text")
    return _double_price(parsed).select("id", "price", "price_token", "currency")


@query
def extract_size(spark, sf):
    return table(spark, sf, "fx_offers").select(
        "id",
        T.extract_size(F.col("size_text")).alias("size"),
        T.extract_size(F.col("price_text")).alias("size_in_price"),
    )


@query
def city_hint(spark, sf):
    return table(spark, sf, "fx_places").select(
        "id", T.city_hint(F.col("place")).alias("hint"), T.city_mention(F.col("place")).alias("mention")
    )


# URLs


@query
def registered_domain(spark, sf):
    given = derive(spark, sf, "SELECT url FROM fx_urls UNION ALL SELECT url FROM pages UNION ALL SELECT url FROM fx_hosts")
    return U.add_domain(given, suffixes=U.suffix_list(table(spark, sf, "fx_suffixes")))


@query
def score_url(spark, sf):
    given = U.add_domain(table(spark, sf, "fx_urls"))
    return U.add_score(given, texts=["title", "snippet"]).select("url", "title", "snippet", "score")


# Pages


@query
def usable_pages(spark, sf):
    return extract.usable_pages(table(spark, sf, "fx_all_pages")).select("page", "usable")


@query
def extract_links(spark, sf):
    return discovery.extract_links(table(spark, sf, "fx_all_pages"), table(spark, sf, "fx_page_domains")).select(
        "page", "pos", "link_url", "link_domain", "text"
    )


def _products(df: DataFrame) -> DataFrame:
    return _double_price(df).drop("url")


@query
def extract_jsonld(spark, sf):
    return _products(extract.extract_jsonld(table(spark, sf, "fx_all_pages")))


@query
def extract_microdata(spark, sf):
    return _products(extract.extract_microdata(table(spark, sf, "fx_all_pages")))


@query
def extract_opengraph(spark, sf):
    return _products(extract.extract_opengraph(table(spark, sf, "fx_all_pages")))


@query
def extract_heuristic(spark, sf):
    return _products(extract.extract_heuristic(table(spark, sf, "fx_all_pages")))


@query
def extract_products(spark, sf):
    return _products(extract.extract_products(table(spark, sf, "fx_all_pages")))


@query
def site_rules(spark, sf):
    return _products(extract.site_rules(table(spark, sf, "fx_all_pages"), table(spark, sf, "fx_site_rules")))


# Places


@query
def distance_from_center_query(spark, sf):
    return table(spark, sf, "fx_places").select(
        "id", distance_from_center(F.col("lat"), F.col("lon")).alias("distance_km")
    )


@query
def radius_filter(spark, sf):
    given = location.with_distance(table(spark, sf, "fx_places")).withColumn("location_city", T.city_hint(F.col("place")))
    return location.radius_filter(given).select("id", "radius_option", "distance_km", "location_city")


@query
def geocode_join(spark, sf):
    given = table(spark, sf, "fx_places").select("id", "place")
    return location.geocode_join(given, table(spark, sf, "fx_gazetteer"), "place")


@query
def geocode_misses(spark, sf):
    return location.geocode_misses(table(spark, sf, "fx_places"), table(spark, sf, "fx_gazetteer"), "place")


# Caches


@query
def cache_hits(spark, sf):
    hits = caches.cache_hits(table(spark, sf, "fx_lookups"), table(spark, sf, "fx_cached_results"), now())
    return _double_price(hits).select(
        "job_id", "ord", "cache_key", "product_name", "normalized_name", "domain", "canonical_url", "price",
        "price_token", "size_text", "location_city", "distance_km", "location_unknown", "extraction_method", "accepted",
    )


@query
def cache_misses(spark, sf):
    misses = caches.cache_misses(table(spark, sf, "fx_lookups"), table(spark, sf, "fx_cached_results"), now())
    return misses.select("job_id", "ord", "query_normalized", "url")


@query
def url_cache_gate(spark, sf):
    valid = requests.validate_requests(table(spark, sf, "fx_requests"))
    return caches.url_cache_gate(valid, table(spark, sf, "fx_cached_urls"), now()).select(
        "job_id", "query_normalized", "max_urls", "cached_urls", "use_cache"
    )


@query
def purge_expired(spark, sf):
    return caches.purge_expired(table(spark, sf, "fx_cached_urls"), now())


@query
def append_url_cache(spark, sf):
    given = table(spark, sf, "fx_cached_urls").select("query_normalized", "url", "score")
    return caches.append_url_cache(given, now())


@query
def upsert_results(spark, sf):
    merged = caches.upsert_results(
        table(spark, sf, "fx_cached_results"), table(spark, sf, "fx_incoming"), ["batch", "seq", "l_suppkey"], now()
    )
    return _double_price(merged)


def _cache_table(spark, name) -> str:
    """Name of a table in a database of its own below the shared folder."""
    folder = working_folder(spark, "cache")
    database = folder.rpartition("/")[2].replace("-", "_")
    cache_tables.create_database(spark, database, folder)
    return f"{database}.{name}"


@query
def upsert_buckets(spark, sf):
    stored = _cache_table(spark, "results")
    cache_tables.create_result_cache(stored, table(spark, sf, "fx_cached_results"), buckets=32)
    cache_tables.upsert_result_cache(stored, table(spark, sf, "fx_incoming"), ["batch", "seq", "l_suppkey"], now())
    return _double_price(cache_tables.result_cache(spark, stored))


@query
def lookup_buckets(spark, sf):
    stored = _cache_table(spark, "results")
    cache_tables.create_result_cache(stored, table(spark, sf, "fx_cached_results"), buckets=32)
    misses = caches.cache_misses(table(spark, sf, "fx_lookups"), cache_tables.result_cache(spark, stored), now())
    return misses.select("job_id", "ord", "query_normalized", "url")


@query
def purge_hours(spark, sf):
    stored, given = _cache_table(spark, "urls"), table(spark, sf, "fx_cached_urls")
    cache_tables.create_url_cache(stored, given)
    cache_tables.append_url_rows(stored, given)
    cache_tables.purge_url_cache(spark, stored, now())
    return spark.table(stored).drop("expires_hour")


# Discovery


def _valid(spark, sf) -> DataFrame:
    return requests.validate_requests(table(spark, sf, "fx_requests"))


@query
def allowed_semi(spark, sf):
    return robots.allowed_semi(table(spark, sf, "fx_urls"), table(spark, sf, "fx_allowed_urls")).select(
        "ord", "l_partkey", "l_suppkey", "url"
    )


@query
def robots_filter(spark, sf):
    return robots.robots_filter(table(spark, sf, "fx_links"), table(spark, sf, "fx_robots"), ROBOT)


@query
def request_link_match(spark, sf):
    return discovery.request_link_match(_valid(spark, sf), table(spark, sf, "fx_links"))


@query
def first_links(spark, sf):
    return discovery.first_links(table(spark, sf, "fx_links"))


@query
def top_links_per_domain(spark, sf):
    return discovery.top_links_per_domain(_valid(spark, sf), table(spark, sf, "fx_links"))


@query
def top_links(spark, sf):
    valid = _valid(spark, sf)
    return discovery.top_links(valid, discovery.top_links_per_domain(valid, table(spark, sf, "fx_links")))


@query
def rank_candidates(spark, sf):
    valid = _valid(spark, sf)
    best = discovery.top_links(valid, discovery.top_links_per_domain(valid, table(spark, sf, "fx_links")))
    wanted = valid.select("query_normalized", "max_urls").distinct()
    cut = best.join(wanted, "query_normalized").filter(F.col("position") <= F.col("max_urls"))
    ranked = discovery.rank_candidates(cut, table(spark, sf, "fx_allowed"), ["query_normalized", "max_urls"])
    return ranked.withColumn("batch_no", discovery.batch_no(F.col("rank")))


# Results


@query
def build_results(spark, sf):
    products = extract.extract_products(
        derive(
            spark,
            sf,
            "SELECT 'job' || CAST(page_id % 50 AS STRING) AS job_id, url, html, 'httpx' AS fetch_method, "
            "CASE page_id % 7 WHEN 0 THEN 'Bucuresti' WHEN 1 THEN '50' WHEN 2 THEN '200' ELSE 'All Romania' END AS radius_option, "
            "page_id % 2 = 0 AS include_unknown FROM fx_product_pages",
        )
    )
    built = results.build_results(products, table(spark, sf, "fx_gazetteer"))
    return _double_price(built).select(
        "job_id", "product_name", "normalized_name", "domain", "source_url", "canonical_url", "price", "currency",
        "size_text", "location_city", "location_address", "location_lat", "location_lon", "distance_km",
        "location_unknown", "extraction_method", "extractor",
    )


@query
def union_cached_fresh(spark, sf):
    ranked = table(spark, sf, "fx_ranked")
    cached = ranked.filter("is_cached").drop("is_cached")
    return results.union_cached_fresh(cached, ranked.filter("NOT is_cached").drop("is_cached"))


@query
def dedupe_results_query(spark, sf):
    return dedupe_results(
        table(spark, sf, "fx_candidates"), CANDIDATE_ORDER, ["normalized_name", "domain", "price_token"], ["url"]
    )


@query
def job_status(spark, sf):
    return results.job_status(table(spark, sf, "fx_jobs"), table(spark, sf, "fx_items"))


FILTERS = {"product_contains": "Red  WIDGET!", "size_contains": "1_ c", "price_min": 100.0, "price_max": 60000.0}


@query
def filter_results(spark, sf):
    return _double_price(results.filter_results(table(spark, sf, "fx_results"), **FILTERS))


@query
def job_results(spark, sf):
    folder = working_folder(spark, "results")
    write_results(table(spark, sf, "fx_results"), folder)
    return _double_price(stored_job_results(spark, folder, "job7"))


@query
def result_total(spark, sf):
    return results.result_total(results.filter_results(table(spark, sf, "fx_results"), price_min=1000.0))


@query
def sort_results(spark, sf):
    given = table(spark, sf, "fx_results").select("id", "domain", "price")
    return _double_price(results.sort_results(given, "price", "desc"))


@query
def page_results(spark, sf):
    by_site = results.sort_results(_double_price(table(spark, sf, "fx_results")), "site", "asc")
    return results.page_results(by_site, page=3, page_size=500).select("id", "domain", "price")


@query
def page_of_index(spark, sf):
    stored = working_folder(spark, "sorted")
    page_index.write_sorted(results.sort_results(_double_price(table(spark, sf, "fx_results")), "site", "asc"), stored)
    return page_index.read_page(spark, stored, page=3, page_size=500).select("id", "domain", "price")


@query
def table_view(spark, sf):
    rows = results.api_rows(table(spark, sf, "fx_results"))
    return results.table_view(rows, name_contains="red-W", size_contains=" l", price_max=70000.0, sort_by="site")


@query
def api_rows(spark, sf):
    return results.api_rows(table(spark, sf, "fx_results"))


@query
def csv_export(spark, sf):
    """Written and read again."""
    folder = working_folder(spark, "csv")
    write_csv(results.api_rows(table(spark, sf, "fx_results")), folder)
    names = ", ".join(f"`{header}` STRING" for header in results.CSV_HEADERS.values())
    reader = spark.read.schema(names).option("header", True).option("escape", '"')
    return reader.option("emptyValue", "").option("nullValue", "\0").csv(folder)


@query
def display_rows(spark, sf):
    return results.display_rows(results.api_rows(table(spark, sf, "fx_results")))


def _search_input(spark, sf, from_pages: bool) -> SearchInput:
    # Start pages are gathered from sorted links, and read several times: they are built once.
    pages = table(spark, sf, "fx_link_pages")
    return SearchInput(
        requests=table(spark, sf, "fx_requests"),
        allowed=table(spark, sf, "fx_allowed"),
        links=None if from_pages else table(spark, sf, "fx_links"),
        pages=pages.unionByName(materialize(table(spark, sf, "fx_start_pages"))) if from_pages else pages,
        gazetteer=table(spark, sf, "fx_gazetteer"),
        rules=table(spark, sf, "fx_site_rules"),
        robots=table(spark, sf, "fx_robots"),
        cached_urls=table(spark, sf, "fx_cached_urls"),
        cached_results=table(spark, sf, "fx_search_cache"),
    )


OFFER_COLUMNS = [
    "job_id", "rank", "source_url", "product_name", "domain", "price", "price_token", "size_text", "location_city",
    "distance_km", "extraction_method", "extractor",
]


@query
def search_requests(spark, sf):
    """All valid requests from ranking to stored offers."""
    offers = search(_search_input(spark, sf, from_pages=False), now(), ROBOT).results
    return _double_price(offers).select(*OFFER_COLUMNS)


@query
def search_from_pages(spark, sf):
    """The same from nothing but pages, the start pages among them."""
    offers = search(_search_input(spark, sf, from_pages=True), now(), ROBOT).results
    return _double_price(offers).select(*OFFER_COLUMNS)


@query
def search_status(spark, sf):
    return search(_search_input(spark, sf, from_pages=True), now(), ROBOT).status


@query
def search_new_urls(spark, sf):
    _, discovered = find_candidates(_search_input(spark, sf, from_pages=True), _valid(spark, sf), now())
    return caches.append_url_cache(discovered, now())


SEARCH_CACHE_COLUMNS = [
    "cache_key", "query_normalized", "domain", "source_url", "product_name", "price", "location_city", "created_at", "expires_at",
]


@query
def search_cache(spark, sf):
    cached = search(_search_input(spark, sf, from_pages=False), now(), ROBOT).cached_results
    return _double_price(cached).select(*SEARCH_CACHE_COLUMNS)


@query
def search_refresh(spark, sf):
    """A search over cache tables, which are then refreshed in place."""
    given, stored, urls = _search_input(spark, sf, from_pages=False), _cache_table(spark, "results"), _cache_table(spark, "urls")
    cache_tables.create_result_cache(stored, given.cached_results, buckets=32)
    cache_tables.create_url_cache(urls, given.cached_urls)
    cache_tables.append_url_rows(urls, given.cached_urls)
    held = replace(
        given,
        cached_results=cache_tables.result_cache(spark, stored),
        cached_urls=cache_tables.live_urls(spark, urls, now()),
    )
    refresh_tables(search(held, now(), ROBOT), stored, urls, now())
    return _double_price(cache_tables.result_cache(spark, stored)).select(*SEARCH_CACHE_COLUMNS)


# Time-driven and incremental


@query
def rate_limit_query(spark, sf):
    hits = table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), "ts")
    return rate_limit(hits, 3, DAY_SECONDS)


@query
def stream_rate_limit(spark, sf):
    folder = working_folder(spark, "rate-limit")
    hits = stream_of(spark, sf, "SELECT event_id, user_id AS key, ts FROM events")
    streams.stream_rate_limit(hits, folder, 3, DAY_SECONDS).awaitTermination()
    return streams.read_batches(spark, folder, "decided").drop("batch")


@query
def stream_rate_limit_keyed(spark, sf):
    folder = working_folder(spark, "rate-limit-keyed")
    hits = stream_of(spark, sf, "SELECT event_id, user_id AS key, ts FROM events")
    streams.stream_rate_limit_keyed(hits, folder, 3, DAY_SECONDS).awaitTermination()
    return streams.read_batches(spark, folder, "hits").filter(~F.col("late")).drop("late")


@query
def stream_extract(spark, sf):
    folder = working_folder(spark, "extract")
    streams.stream_extract(stream_of(spark, sf, "SELECT * FROM fx_product_pages"), folder).awaitTermination()
    return _products(spark.read.parquet(f"{folder}/products"))


@query
def stream_dedupe(spark, sf):
    folder = working_folder(spark, "dedupe")
    rows = stream_of(spark, sf, "SELECT * FROM fx_candidates")
    streams.stream_dedupe(
        rows, folder, CANDIDATE_ORDER, ["normalized_name", "domain", "price_token"], ["url"]
    ).awaitTermination()
    return streams.read_batches(spark, folder, "kept").drop("batch")


@query
def stream_progress(spark, sf):
    folder = working_folder(spark, "progress")
    streams.stream_progress(stream_of(spark, sf, "SELECT * FROM fx_items"), folder).awaitTermination()
    return streams.latest_progress(spark, folder)
