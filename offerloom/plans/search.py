"""The whole search as one run over many requests.

    validate -> cached URLs or discovery -> cached results or extraction
    -> locate and filter -> merge -> drop duplicates -> counters and caches

Every step is one DataFrame plan for all requests.  Work that does not depend
on the request is done once: ranking per distinct query, extraction per
distinct page.  Tables used by several later steps are materialized.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.functions.urls import DEFAULT_SUFFIXES
from offerloom.operators import caches, discovery
from offerloom.operators.dedupe import dedupe_results, with_offer_keys
from offerloom.operators.extract import site_rules, usable_pages
from offerloom.operators.requests import validate_requests
from offerloom.operators.results import build_results, job_status, union_cached_fresh
from offerloom.operators.robots import robots_filter
from offerloom.plans.checkpoints import materialize
from offerloom.plans.joins import is_small, likely_in, lookup_join, match_join, unique_join
from offerloom.sources import cache_tables

# Of several fresh rows with one cache key the last in this order counts.
FRESH_ORDER = ["job_id", "rank"]

# Fixed value: pages a browser has rendered are used whatever they contain.
BROWSER_METHOD = "playwright-reused"


@dataclass
class SearchInput:
    """Tables a search reads; see ``offerloom.schemas``."""

    requests: DataFrame
    allowed: DataFrame
    # Links of start pages; without them they are read from the start pages among ``pages``.
    links: DataFrame | None
    pages: DataFrame
    gazetteer: DataFrame
    rules: DataFrame
    robots: DataFrame
    cached_urls: DataFrame
    cached_results: DataFrame
    # Replaces the extraction by rules and markup: pages(url, html, fetch_method) to
    # products with the same columns, a null name where a page has none.
    extract: Callable[[DataFrame], DataFrame] | None = None
    # Public-suffix rules, as ``suffix_list`` reads them from a table.
    suffixes: Sequence[str] = DEFAULT_SUFFIXES
    links_per_seed: int = discovery.LINKS_PER_SEED
    top_per_domain: int = discovery.TOP_PER_DOMAIN
    batch_size: int = discovery.BATCH_SIZE
    ttl_hours: int = caches.TTL_HOURS


@dataclass
class SearchOutput:
    """What a search gives back."""

    results: DataFrame
    status: DataFrame
    new_cached_urls: DataFrame
    cached_results: DataFrame
    # What a run has read afresh, by which cache tables are refreshed in place.
    fresh_results: DataFrame


def _from_url_cache(queries: DataFrame, cached_urls: DataFrame, now: Column) -> DataFrame:
    """Live cached URLs of the given queries by score, at most as many as a request may take."""
    live = lookup_join(caches.purge_expired(cached_urls, now), queries, ["query_normalized"], "left_semi")
    order = Window.partitionBy("query_normalized").orderBy(F.desc("score"), "created_at", "url")
    return (
        live.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= discovery.MOST_URLS)
        .select("query_normalized", "rank", "url", "score")
    )


def find_candidates(given: SearchInput, requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Ranked URLs per request, and the newly discovered ones per query for the URL cache."""
    gated = materialize(caches.url_cache_gate(requests, given.cached_urls, now))
    from_cache, to_discover = gated.filter("use_cache"), gated.filter("NOT use_cache")
    cached = materialize(_from_url_cache(from_cache.select("query_normalized").distinct(), given.cached_urls, now))
    cached_rows = match_join(from_cache, cached, ["query_normalized"]).filter(F.col("rank") <= F.col("max_urls"))

    links = given.links
    if links is None:
        links = discovery.discover_links(given.pages, given.allowed, given.suffixes, given.links_per_seed)
    lists = discovery.top_links_per_domain(
        to_discover, links, given.top_per_domain, given.suffixes, given.links_per_seed
    )
    best = discovery.top_links(to_discover, lists)
    wanted = to_discover.select("query_normalized", "max_urls").distinct()
    cut = match_join(best, wanted, ["query_normalized"]).filter(F.col("position") <= F.col("max_urls"))
    ranked = materialize(discovery.rank_candidates(
        cut, given.allowed, ["query_normalized", "max_urls"], suffixes=given.suffixes
    ))
    fresh_rows = match_join(to_discover, ranked.drop("domain"), ["query_normalized", "max_urls"])

    columns = ["job_id", "query_normalized", "radius_option", "include_unknown", "rank", "url"]
    discovered = ranked.groupBy("query_normalized", "url").agg(F.max("score").alias("score"))
    candidates = cached_rows.select(*columns).unionByName(fresh_rows.select(*columns))
    # They lie where their requests were, and take little space: without this a few tasks would do what follows.
    tasks = 2 * candidates.sparkSession.sparkContext.defaultParallelism
    return materialize(candidates.repartition(tasks, "job_id", "rank")), discovered


def extract_needed(given: SearchInput, urls: DataFrame, agent: str) -> DataFrame:
    """One row per page that could be read among distinct URLs; without a product its name is null.

    Pages are unique per URL, and their source is never shuffled: where the URLs
    are too many to broadcast, a bitmap of them drops most other pages, and the
    products of those it lets through are dropped by an exact join.
    """
    permitted = materialize(robots_filter(urls, given.robots, agent))
    few = is_small(permitted)
    pages = given.pages.join(F.broadcast(permitted), ["url"], "left_semi") if few else likely_in(given.pages, permitted, "url")
    readable = usable_pages(pages).filter(F.col("usable") | (F.col("fetch_method") == BROWSER_METHOD))
    readable = readable.drop("usable")
    if given.extract is not None:
        extracted = given.extract(readable)
    else:
        extracted = site_rules(readable, given.rules, keep_nameless=True)
    return materialize(extracted if few else unique_join(extracted, permitted, ["url"], "left_semi"))


def search(given: SearchInput, now: Column, agent: str) -> SearchOutput:
    """Run all requests; ``now`` decides what is expired.

    ``pages`` hold one row per URL.  All requests see the result cache as it
    was at the start of the run.
    """
    requests = materialize(validate_requests(given.requests))
    candidates, discovered = find_candidates(given, requests, now)

    # Only cached rows that may belong to a candidate are looked up; the cache is read once and not shuffled.
    held = materialize(likely_in(given.cached_results, caches.keyed(candidates).select("cache_key"), "cache_key"))
    looked_up = materialize(caches.cache_lookup(candidates, held, now))
    hits, misses = caches.judged_hits(looked_up), caches.unmatched(looked_up)
    extracted = extract_needed(given, misses.select("url").distinct(), agent)
    products = extracted.filter(F.col("product_name").isNotNull())
    fresh = materialize(build_results(lookup_join(misses, products, ["url"], "inner"), given.gazetteer, given.suffixes))

    accepted = hits.filter("accepted").drop("accepted", "cache_key", "url").withColumn("extractor", F.lit("cache"))
    merged = materialize(with_offer_keys(union_cached_fresh(accepted, fresh, given.batch_size)))
    kept = dedupe_results(merged, ["ord"])
    results = materialize(
        kept.withColumn("id", F.sha1(F.concat_ws("|", "job_id", "source_url"))).drop(
            "price_key", "url_key", "is_fetched", "radius_option", "include_unknown", "location_text"
        )
    )

    # A rank names one candidate of a job, so these joins are one to one.
    failed = lookup_join(misses, extracted.select("url"), ["url"], "left_anti").select("job_id", "rank")
    items = (
        candidates.select("job_id", "rank", F.lit(True).alias("processed"))
        .join(results.select("job_id", "rank", F.lit(True).alias("found")), ["job_id", "rank"], "left")
        .join(failed.withColumn("error", F.lit(True)), ["job_id", "rank"], "left")
    )
    return SearchOutput(
        results=results,
        status=job_status(requests.select("job_id", F.lit("done").alias("status")), items),
        new_cached_urls=caches.append_url_cache(discovered, now, given.ttl_hours),
        cached_results=caches.upsert_results(given.cached_results, fresh, FRESH_ORDER, now, given.ttl_hours),
        fresh_results=fresh,
    )


def refresh_tables(
    output: SearchOutput, results_table: str, urls_table: str, now: Column, ttl_hours: int = caches.TTL_HOURS
) -> None:
    """Refresh the cache tables a search has read, in place of writing ``cached_results`` as a whole.

    Tables that ``output`` reads change with this, so ``cached_results`` is of no use afterwards.
    """
    cache_tables.append_url_rows(urls_table, output.new_cached_urls)
    cache_tables.upsert_result_cache(results_table, output.fresh_results, FRESH_ORDER, now, ttl_hours)
