"""Result cache and URL cache: lookups, refresh, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions import text as T
from offerloom.functions import urls as U
from offerloom.functions.geo import distance_from_center, within_radius
from offerloom.plans.checkpoints import materialize
from offerloom.plans.joins import bitmap_of, lookup_join, mark_by

CACHED_VALUES = [
    "product_name", "price", "currency", "size_text", "location_city", "location_address",
    "location_lat", "location_lon",
]
TTL_HOURS = 24


def _live(cache: DataFrame, now: Column) -> DataFrame:
    return cache.filter(F.col("expires_at") >= now)


def keyed(candidates: DataFrame) -> DataFrame:
    """The candidates with the key of their result."""
    return candidates.withColumn("cache_key", U.cache_key(F.col("query_normalized"), F.col("url")))


def cache_lookup(candidates: DataFrame, cached_results: DataFrame, now: Column) -> DataFrame:
    """All candidates with their live cached result as ``cached``, null where there is none."""
    row = F.struct("domain", "source_url", *CACHED_VALUES).alias("cached")
    return lookup_join(keyed(candidates), _live(cached_results, now).select("cache_key", row), ["cache_key"], "left")


def cache_hits(candidates: DataFrame, cached_results: DataFrame, now: Column) -> DataFrame:
    """Candidates with a live cached result, re-judged for their own request.

    ``candidates`` carry query_normalized, url, radius_option and
    include_unknown.  All hits are returned; ``accepted`` tells which lie
    inside the radius, since a rejected hit still counts as processed.
    """
    return judged_hits(cache_lookup(candidates, cached_results, now))


def judged_hits(looked_up: DataFrame) -> DataFrame:
    """The hits of ``cache_lookup``, re-judged."""
    hits = looked_up.filter(F.col("cached").isNotNull()).select("*", "cached.*").drop("cached")
    distance = distance_from_center(F.col("location_lat"), F.col("location_lon"))
    return (
        hits.withColumn("distance_km", distance)
        .withColumn("normalized_name", T.normalize_product_name(F.col("product_name")))
        .withColumn("canonical_url", F.col("source_url"))
        .withColumn("price_token", F.col("price").cast("string"))
        .withColumn("location_unknown", F.col("location_lat").isNull())
        .withColumn("extraction_method", F.lit("cache"))
        .withColumn(
            "accepted",
            within_radius(
                F.col("radius_option"), F.col("include_unknown"), F.col("distance_km"), F.col("location_city")
            ),
        )
    )


def cache_misses(candidates: DataFrame, cached_results: DataFrame, now: Column) -> DataFrame:
    """Candidates without a live cached result, which need extraction."""
    live = _live(cached_results, now).select("cache_key")
    return lookup_join(keyed(candidates), live, ["cache_key"], "left_anti").select(*candidates.columns)


def unmatched(looked_up: DataFrame) -> DataFrame:
    """The candidates of ``cache_lookup`` without a result."""
    return looked_up.filter(F.col("cached").isNull()).drop("cache_key", "cached")


IDENTITY = ["query_normalized", "domain", "source_url"]


def last_results(incoming: DataFrame, order: list[str]) -> DataFrame:
    """Per cache_key the incoming row that is last in ``order``, as ``_new``.

    Rows are grouped by the text a key is the hash of, which is hashed once per key.
    """
    text = U.cache_key_text(F.col("query_normalized"), F.col("source_url"))
    row = F.struct(*IDENTITY, *CACHED_VALUES)
    last = incoming.groupBy(text.alias("_text")).agg(F.max_by(row, F.struct(*order)).alias("_new"))
    return materialize(last.select(F.sha1("_text").alias("cache_key"), "_new"))


def upsert_results(
    cached_results: DataFrame, incoming: DataFrame, order: list[str], now: Column, ttl_hours: int = TTL_HOURS
) -> DataFrame:
    """The cache after inserting or refreshing the incoming results.

    Of several incoming rows with one key the last in ``order`` counts.  A
    refreshed row keeps its key, query, domain, URL and creation time.
    """
    return merged_results(cached_results, last_results(incoming, order), now, ttl_hours)


def merged_results(cached_results: DataFrame, last: DataFrame, now: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """The cache after inserting or refreshing what ``last_results`` gives.

    Both sides of the join are unique per key, so no key can be hot.  Cached rows
    that surely are not refreshed stay where they are.
    """
    old = as_old(cached_results)
    hashed, mark = F.xxhash64("cache_key"), "_likely"
    marked = mark_by(old, materialize(bitmap_of(last.select(hashed.alias("_hash")))), hashed, mark)
    untouched = marked.filter(~F.col(mark)).drop(mark)
    joined = marked.filter(F.col(mark)).drop(mark).join(last, "cache_key", "full_outer").unionByName(untouched, allowMissingColumns=True)
    return refreshed(joined, now, ttl_hours)


def as_old(cached_results: DataFrame) -> DataFrame:
    """Cached rows as ``cache_key`` and ``_old``."""
    rest = [c for c in cached_results.columns if c != "cache_key"]
    return cached_results.select("cache_key", F.struct(*rest).alias("_old"))


def refreshed(joined: DataFrame, now: Column, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """Rows of the cache from ``_old`` and ``_new`` of their key, either of which may be null."""
    is_new, is_fresh = F.col("_old").isNull(), F.col("_new").isNotNull()
    kept = [F.coalesce(F.col("_old")[c], F.col("_new")[c]).alias(c) for c in IDENTITY]
    values = [F.when(is_fresh, F.col("_new")[c]).otherwise(F.col("_old")[c]).alias(c) for c in CACHED_VALUES]
    return joined.select(
        "cache_key",
        *kept,
        *values,
        F.when(is_new, now).otherwise(F.col("_old")["created_at"]).alias("created_at"),
        F.when(is_fresh, ttl_expiry(now, ttl_hours)).otherwise(F.col("_old")["expires_at"]).alias("expires_at"),
    )


def ttl_expiry(now: Column, hours: int = TTL_HOURS) -> Column:
    return now + F.make_dt_interval(hours=F.lit(hours))


def purge_expired(cache: DataFrame, now: Column) -> DataFrame:
    """Rows of a cache that have not expired; one expiring right now stays."""
    return _live(cache, now)


def append_url_cache(
    ranked: DataFrame, now: Column, ttl_hours: int = TTL_HOURS, provider: str = "manual"
) -> DataFrame:
    """Rows to append to the URL cache for ranked (query_normalized, url, score)."""
    return ranked.select(
        "query_normalized",
        F.lit(provider).alias("provider"),
        "url",
        "score",
        now.alias("created_at"),
        ttl_expiry(now, ttl_hours).alias("expires_at"),
    )


def url_cache_gate(requests: DataFrame, cached_urls: DataFrame, now: Column) -> DataFrame:
    """Requests with the live cached URLs of their query and whether those suffice."""
    queries = requests.select("query_normalized").distinct()
    live = lookup_join(_live(cached_urls, now), queries, ["query_normalized"], "left_semi")
    # One row per query, asked for several times by the join.
    counts = materialize(live.groupBy("query_normalized").agg(F.count("*").alias("cached_urls")))
    counted = lookup_join(requests, counts, ["query_normalized"], "left").withColumn(
        "cached_urls", F.coalesce("cached_urls", F.lit(0))
    )
    enough = (F.col("cached_urls") > 0) & (F.col("cached_urls") >= F.least(F.lit(10), F.col("max_urls")))
    return counted.withColumn("use_cache", enough)
