"""Result rows: assembly, job counters, filtering, sorting, paging and report views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions import text as T
from offerloom.functions.geo import distance_from_center
from offerloom.functions.urls import DEFAULT_SUFFIXES, add_domain
from offerloom.operators.discovery import BATCH_SIZE, batch_no
from offerloom.operators.location import geocode_join, radius_filter
from offerloom.schemas import RESULT_WIDTHS

MOST_ROWS_PER_PAGE = 500

# Headers of the CSV report and labels of the table.
CSV_HEADERS = {
    "productName": "Produs", "website": "Site", "price": "Pret", "currency": "Moneda", "size": "Marime",
    "locationCity": "Oras locatie", "locationAddress": "Adresa locatie", "distanceKm": "Distanta km",
    "sourceUrl": "URL",
}
UNKNOWN_PLACE = "Necunoscut"
COUNTRY = "Romania"


def build_results(
    products: DataFrame, gazetteer: DataFrame, suffixes: Sequence[str] = DEFAULT_SUFFIXES
) -> DataFrame:
    """Result rows of extracted products that lie inside the radius of their job.

    ``products`` carry the product columns, url, fetch_method and the job's
    radius_option and include_unknown.
    """
    located = geocode_join(products, gazetteer)
    rows = (
        located.withColumn(
            "location_city", F.coalesce(T.city_hint(F.col("location_text")), T.non_empty(F.col("city")))
        )
        .withColumn("location_address", F.col("address"))
        .withColumn("location_lat", F.col("lat"))
        .withColumn("location_lon", F.col("lon"))
        .withColumn("distance_km", distance_from_center(F.col("lat"), F.col("lon")))
        .drop("city", "address", "lat", "lon", "country")
    )
    kept = radius_filter(rows)
    return (
        add_domain(kept, "url", "domain", suffixes)
        .withColumn("normalized_name", T.normalize_product_name(F.col("product_name")))
        .withColumn("location_unknown", F.col("location_lat").isNull())
        .withColumnRenamed("url", "source_url")
        .withColumnRenamed("fetch_method", "extraction_method")
    )


def fit_to_store(results: DataFrame) -> DataFrame:
    """Cut texts to the widths of the stored table and flag the rows that were cut."""
    cut = [F.length(c) > width for c, width in RESULT_WIDTHS.items() if c in results.columns]
    too_long = F.lit(False)
    for is_long in cut:
        too_long = too_long | F.coalesce(is_long, F.lit(False))
    if "price_token" in results.columns:
        too_long = too_long | (F.col("price_token").isNotNull() & F.col("price").isNull())
    flagged = results.withColumn("truncated", too_long)
    fitted = {c: F.left(c, F.lit(width)) for c, width in RESULT_WIDTHS.items() if c in results.columns}
    return flagged.withColumns(fitted)


def union_cached_fresh(cached: DataFrame, fresh: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Cached and fresh rows of a job in processing order, as column ``ord``.

    Batches follow the rank of the URLs; inside a batch the cached rows come
    first, then the fetched ones, each by rank.
    """
    both = cached.withColumn("is_fetched", F.lit(False)).unionByName(
        fresh.withColumn("is_fetched", F.lit(True)), allowMissingColumns=True
    )
    batch = batch_no(F.col("rank"), batch_size)
    inside = F.col("is_fetched").cast("int") * batch_size + (F.col("rank") - 1) % batch_size
    return both.withColumn("batch_no", batch).withColumn("ord", (batch * 2 * batch_size + inside).cast("bigint"))


def job_status(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """Counters and progress per job from items(job_id, processed, found, error)."""

    def number(flag: str) -> Column:
        return F.count_if(F.coalesce(F.col(flag), F.lit(False))).alias(f"_{flag}")

    counts = items.groupBy("job_id").agg(
        F.count("*").alias("_total"), number("processed"), number("found"), number("error")
    )

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    share = F.round(F.least(F.lit(100.0), filled("_processed") / filled("_total") * 100), 2)
    progress = (
        F.when(filled("_total") > 0, share).when(F.col("status") == "done", 100.0).otherwise(0.0)
    )
    return jobs.join(counts, "job_id", "left").select(
        "job_id",
        "status",
        filled("_total").alias("total_candidate_urls"),
        filled("_processed").alias("processed_urls"),
        filled("_found").alias("found_products"),
        filled("_error").alias("errors"),
        progress.alias("progress"),
    )


def filter_results(
    results: DataFrame,
    product_contains: str | None = None,
    size_contains: str | None = None,
    price_min: float | None = None,
    price_max: float | None = None,
) -> DataFrame:
    """Results fitting all given conditions; absent ones are ignored."""
    if product_contains:
        # Normalised once here: inside the filter it would be worked out for every row.
        wanted = results.sparkSession.range(1).select(T.normalize_text(F.lit(product_contains))).first()[0]
        results = results.filter(F.col("normalized_name").contains(wanted))
    if size_contains:
        results = results.filter(F.col("size_text").ilike(f"%{size_contains}%"))
    if price_min is not None:
        results = results.filter(F.col("price") >= price_min)
    if price_max is not None:
        results = results.filter(F.col("price") <= price_max)
    return results


def _ordered(column: Column, ascending: bool) -> Column:
    return column.asc_nulls_last() if ascending else column.desc_nulls_first()


def sort_results(results: DataFrame, sort_by: str = "price", sort_dir: str = "asc", tie_break: list[str] | None = None) -> DataFrame:
    """Results by site or (anything else) price; ties by ``tie_break``."""
    column = F.col("domain" if sort_by == "site" else "price")
    return results.orderBy(_ordered(column, sort_dir.lower() == "asc"), *(tie_break or ["id"]))


def check_page(page: int, page_size: int) -> None:
    if page < 1 or not 1 <= page_size <= MOST_ROWS_PER_PAGE:
        raise ValueError(f"page must be at least 1 and page_size 1 to {MOST_ROWS_PER_PAGE}")


def page_results(ordered: DataFrame, page: int = 1, page_size: int = 25) -> DataFrame:
    """One page of sorted results."""
    check_page(page, page_size)
    return ordered.offset((page - 1) * page_size).limit(page_size)


def result_total(filtered: DataFrame) -> DataFrame:
    """Number of filtered results before paging, as one row."""
    return filtered.agg(F.count("*").alias("total"))


def api_rows(results: DataFrame) -> DataFrame:
    """Results under the names of the service's answers; price as a double."""
    return results.select(
        "id",
        F.col("product_name").alias("productName"),
        F.col("domain").alias("website"),
        F.col("source_url").alias("sourceUrl"),
        F.col("price").cast("double").alias("price"),
        "currency",
        F.col("size_text").alias("size"),
        F.col("location_city").alias("locationCity"),
        F.col("location_address").alias("locationAddress"),
        F.col("distance_km").alias("distanceKm"),
        F.col("location_unknown").alias("locationUnknown"),
    )


def table_view(
    rows: DataFrame,
    name_contains: str = "",
    size_contains: str = "",
    price_min: float | None = None,
    price_max: float | None = None,
    sort_by: str = "price",
    sort_dir: str = "asc",
) -> DataFrame:
    """The table's own filters over ``api_rows``: literal text, no rows without a price under a bound."""
    if name_contains:
        rows = rows.filter(F.lower("productName").contains(name_contains.lower()))
    if size_contains:
        rows = rows.filter(F.lower(F.coalesce("size", F.lit(""))).contains(size_contains.lower()))
    if price_min is not None:
        rows = rows.filter(F.col("price") >= price_min)
    if price_max is not None:
        rows = rows.filter(F.col("price") <= price_max)
    key = F.lower("website") if sort_by == "site" else F.coalesce("price", F.lit(float("inf")))
    return rows.orderBy(key.asc() if sort_dir == "asc" else key.desc(), "id")


def _number_text(c: Column) -> Column:
    """A number with at most two decimals as written in a script: no trailing zeros."""
    return F.regexp_replace(c.cast("decimal(20,2)").cast("string"), r"\.?0+\z", "")


def display_rows(rows: DataFrame) -> DataFrame:
    """``api_rows`` with the price and place labels of the table."""
    price = F.when(F.col("price").isNull(), "-").otherwise(
        F.concat_ws(" ", _number_text(F.col("price")), F.coalesce("currency", F.lit(T.DEFAULT_CURRENCY)))
    )
    near = F.when(
        F.coalesce("distanceKm", F.lit(0.0)) != 0, F.concat(F.lit(" ("), _number_text(F.col("distanceKm")), F.lit(" km)"))
    ).otherwise("")
    place = F.when(F.col("locationUnknown"), UNKNOWN_PLACE).otherwise(
        F.concat(F.coalesce("locationCity", F.lit(COUNTRY)), near)
    )
    return rows.select(
        "id",
        "productName",
        "website",
        price.alias("priceLabel"),
        F.coalesce("size", F.lit("-")).alias("sizeLabel"),
        place.alias("locationLabel"),
        "sourceUrl",
    )


def csv_rows(rows: DataFrame) -> DataFrame:
    """``api_rows`` as the nine text cells of the CSV report; nulls are empty."""
    numbers = {"price", "distanceKm"}
    cells = [
        F.coalesce(_number_text(F.col(c)) if c in numbers else F.col(c), F.lit("")).alias(header)
        for c, header in CSV_HEADERS.items()
    ]
    return rows.select(*cells)
