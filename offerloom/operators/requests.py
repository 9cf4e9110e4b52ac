"""Search requests and the allow-list of domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions import text as T
from offerloom.functions.geo import RADIUS_OPTIONS

# Bounds and defaults of a request.
QUERY_LENGTH = (2, 180)
MAX_URLS = (10, 200)
MAX_URLS_DEFAULT = 30
TIME_BUDGET = (60, 180)
TIME_BUDGET_DEFAULT = 60


def allowed_domains(entries: DataFrame, column: str = "entries") -> DataFrame:
    """The distinct domains of comma-separated, loosely written entries."""
    entry = F.lower(T.strip(F.col("_entry")))
    without_scheme = F.replace(F.replace(entry, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))
    host = F.regexp_replace(F.split_part(without_scheme, F.lit("/"), F.lit(1)), r"\Awww\.", "")
    return (
        entries.select(F.explode(F.split(column, ",")).alias("_entry"))
        .select(host.alias("domain"))
        .filter(F.col("domain") != "")
        .distinct()
    )


def check_requests(requests: DataFrame) -> DataFrame:
    """Requests with defaults filled in, cleaned and normalised query, and a list of errors."""
    length = F.length("query")
    filled = requests.select(
        "job_id",
        T.collapse_spaces(F.col("query")).alias("_clean"),
        F.coalesce(length.between(*QUERY_LENGTH), F.lit(False)).alias("_length_ok"),
        "radius_option",
        F.coalesce("include_unknown", F.lit(False)).alias("include_unknown"),
        F.coalesce("max_urls", F.lit(MAX_URLS_DEFAULT)).alias("max_urls"),
        F.coalesce("time_budget_seconds", F.lit(TIME_BUDGET_DEFAULT)).alias("time_budget_seconds"),
    )

    def error(holds: Column, name: str) -> Column:
        return F.when(holds, F.lit(name))

    radius_ok = F.coalesce(F.col("radius_option").isin(RADIUS_OPTIONS), F.lit(False))
    errors = F.array_compact(
        F.array(
            error(~F.col("_length_ok"), "query_length"),
            error(F.col("_length_ok") & (F.col("_clean") == ""), "query_blank"),
            error(~radius_ok, "radius_option"),
            error(~F.col("max_urls").between(*MAX_URLS), "max_urls"),
            error(~F.col("time_budget_seconds").between(*TIME_BUDGET), "time_budget_seconds"),
        )
    )
    return filled.select(
        "job_id",
        F.col("_clean").alias("query"),
        T.normalize_text(F.col("_clean")).alias("query_normalized"),
        "radius_option",
        "include_unknown",
        "max_urls",
        "time_budget_seconds",
        errors.alias("errors"),
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """The requests a search may run."""
    return check_requests(requests).filter(F.size("errors") == 0).drop("errors")


def rejected_requests(requests: DataFrame) -> DataFrame:
    return check_requests(requests).filter(F.size("errors") > 0)
