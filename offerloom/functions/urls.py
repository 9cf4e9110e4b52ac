"""URL columns: host, registered domain, resolution against a base, relevance score."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.text import compute_once, let, non_empty, strip

# Public suffixes known without a list of the caller's own.
DEFAULT_SUFFIXES = (
    "ro", "com.ro", "org.ro", "info.ro", "nom.ro", "store.ro", "shop.ro", "firm.ro",
    "com", "net", "org", "info", "biz", "eu", "shop", "store", "online", "io", "co",
    "de", "fr", "it", "es", "at", "hu", "bg", "pl", "nl", "be", "ch",
    "uk", "co.uk", "org.uk", "md", "com.md",
)

# What a table of suffix rules may hold at most, as it becomes constants of the plan.
MOST_SUFFIXES = 50_000

# The words and weights that make up the relevance score.
PREFERRED_WORDS = [
    "gradina", "garden", "flori", "horti", "plante", "construct", "diy",
    "magazin", "shop", "market",
]
EXCLUDED_WORDS = ["forum", "pdf", "blog", "wikipedia", "manual"]
PRODUCT_PATH_WORDS = ["produs", "product", "p", "item", "catalog"]
RELEVANCE_THRESHOLD = 1.0


def host_of(url: Column) -> Column:
    """Host with port, lower case, every ``www.`` removed; empty without a host."""
    authority = F.regexp_extract(url, r"\A[\x00-\x20]*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)", 1)
    tidy = F.translate(F.lower(authority), "\t\r\n", "")
    return F.replace(tidy, F.lit("www."), F.lit(""))


def suffix_list(rules: DataFrame, column: str = "suffix") -> list[str]:
    """The rules of a public-suffix table as constants: ``com.ro``, ``*.ck``, ``!www.ck``.

    The public list has some 10,000 rules; more than ``MOST_SUFFIXES`` are refused.
    """
    found = [r[0] for r in rules.select(F.lower(F.trim(column))).distinct().limit(MOST_SUFFIXES + 1).collect() if r[0]]
    if len(found) > MOST_SUFFIXES:
        raise ValueError(f"more than {MOST_SUFFIXES} suffix rules")
    return sorted(found)


def _registered(name: Column, suffixes: Sequence[str]) -> Column:
    """Last label in front of the public suffix, with the suffix; null if no rule fits.

    An exception decides first, then the rule with most labels; a star stands for one label.
    """
    rules: dict[tuple[bool, bool], dict[int, list[str]]] = {}
    for suffix in suffixes:
        kind = (suffix.startswith("!"), suffix.startswith("*."))
        rules.setdefault(kind, {}).setdefault(suffix.count(".") + 1, []).append(suffix.removeprefix("!").removeprefix("*."))
    excepted, plain, starred = (rules.get(k, {}) for k in ((True, False), (False, False), (False, True)))
    choices = [F.when(F.substring_index(name, ".", -n).isin(excepted[n]), F.substring_index(name, ".", -n)) for n in sorted(excepted, reverse=True)]
    for labels in sorted({*plain, *starred}, reverse=True):
        tail = F.substring_index(name, ".", -labels)
        domain = F.when(name == tail, F.concat(F.lit("."), name)).otherwise(
            F.substring_index(name, ".", -(labels + 1))
        )
        fits = tail.isin(plain.get(labels, []))
        if labels in starred:
            rest = F.substring_index(name, ".", -(labels - 1))
            fits = fits | (rest.isin(starred[labels]) & (rest != name))
        choices.append(F.when(fits, domain))
    return F.coalesce(*choices) if choices else F.lit(None).cast("string")


def add_domain(
    df: DataFrame,
    url: str = "url",
    out: str = "domain",
    suffixes: Sequence[str] = DEFAULT_SUFFIXES,
) -> DataFrame:
    """The table with the registered domain of its URL column.

    That is the domain with the longest public suffix, or the host if no suffix
    fits; ``suffix_list`` reads the rules of a table.  The suffixes are compared as
    constants per label count, so this is a projection: no join and no shuffle on
    hosts, whatever their frequency.
    """
    host = F.col("_host")
    bare = F.when(host.rlike("[@:]"), F.regexp_replace(host, r"\A.*@|:\d*\z", "")).otherwise(host)
    named = compute_once(compute_once(df, _host=host_of(F.col(url))), _name=bare)
    return named.withColumn(out, F.coalesce(_registered(F.col("_name"), suffixes), host)).drop("_host", "_name")


def _drop_dot_segments(path: Column) -> Column:
    kept = F.split(path, "/")

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(segment == ".", done)
            .otherwise(F.concat(done, F.array(segment)))
        )

    walked = F.aggregate(kept, F.array().cast("array<string>"), step)
    tail = F.when(F.element_at(kept, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.array_join(walked, "/"), tail)
    return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))


def join_url(base: Column, href: Column) -> Column:
    """``href`` made absolute against ``base``: absolute, //host, /path, ?query or relative."""
    parts = F.struct(
        base.alias("base"),
        F.lower(F.regexp_extract(base, r"\A([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)).alias("scheme"),
        href.alias("href"),
        F.lower(F.regexp_extract(href, r"\A([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)).alias("href_scheme"),
    )

    def relative(p: Column, local: Column) -> Column:
        """Path, query and fragment of a target on the site of the base, which is taken apart only for these."""
        site = F.regexp_extract(p["base"], r"\A([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
        base_path = F.regexp_extract(p["base"], r"\A[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
        query = F.regexp_extract(local, r"\A[^?#]*(\?[^#]+)", 1)
        fragment = F.regexp_extract(local, r"(#.+)\z", 1)

        def on_path(path: Column) -> Column:
            below = F.concat(F.lit("/"), F.regexp_replace(base_path, r"[^/]*\z", ""), path)
            # Empty segments vanish from a relative path only.
            full = F.when(path.startswith("/"), path).otherwise(F.regexp_replace(below, "/{2,}", "/"))
            return let(
                full, lambda f: F.when(f.rlike(r"/\.{1,2}(?:/|\z)"), _drop_dot_segments(f)).otherwise(f)
            )

        base_query = F.regexp_extract(p["base"], r"\A[^?#]*(\?[^#]+)", 1)
        same_page = F.concat(base_path, F.when(query == "", base_query).otherwise(query))
        path = F.regexp_extract(local, r"\A([^?#]*)", 1)
        return F.concat(
            site,
            let(path, lambda x: F.when(x == "", same_page).otherwise(F.concat(on_path(x), query))),
            fragment,
        )

    def target(p: Column) -> Column:
        other_scheme = (p["href_scheme"] != "") & (p["href_scheme"] != p["scheme"])
        local = F.when(p["href_scheme"] != "", F.regexp_replace(p["href"], r"\A[^:]*:", "")).otherwise(p["href"])
        return (
            F.when(p["href"] == "", p["base"])
            .when(other_scheme, p["href"])
            .otherwise(
                let(
                    local,
                    lambda h: F.when(h.startswith("//"), F.concat(p["scheme"], F.lit(":"), h)).otherwise(
                        relative(p, h)
                    ),
                )
            )
        )

    return let(parts, target)


def resolve_url(base: Column, href: Column) -> Column:
    """An anchor's target, or null for empty, mail, phone, script and in-page ones."""
    def target(h: Column) -> Column:
        skipped = (
            h.startswith("mailto:") | h.startswith("tel:") | h.startswith("javascript:") | h.startswith("#")
        )
        return F.when(~skipped, join_url(base, h))

    return F.when(href != "", let(strip(href), target))


def add_score(
    df: DataFrame, url: str = "url", domain: str = "domain", texts: Sequence[str] = (), out: str = "score"
) -> DataFrame:
    """The table with the relevance of a URL, given its registered domain and texts like title and snippet."""
    blob = F.col("_blob")

    def any_of(words: list[str]) -> Column:
        return reduce(Column.__or__, [blob.contains(word) for word in words])

    address = F.col(url)
    score = (
        F.when(F.col(domain).endswith(".ro"), 3.0).otherwise(0.0)
        + F.when(any_of(PREFERRED_WORDS), 2.0).otherwise(0.0)
        + F.when(any_of([f"/{word}" for word in PRODUCT_PATH_WORDS]), 1.5).otherwise(0.0)
        - F.when(any_of(EXCLUDED_WORDS), 3.0).otherwise(0.0)
        - F.when(address.contains("?") & address.contains("sort"), 1.0).otherwise(0.0)
    )
    staged = compute_once(df, _blob=F.lower(F.concat_ws(" ", address, *texts)))
    return staged.withColumn(out, score).drop("_blob")


def cache_key_text(query_normalized: Column, url: Column) -> Column:
    """What a cache key is the hash of."""
    return F.concat_ws("|", query_normalized, url)


def cache_key(query_normalized: Column, url: Column) -> Column:
    return F.sha1(cache_key_text(query_normalized, url))


def url_key(canonical_url: Column, source_url: Column) -> Column:
    return F.coalesce(non_empty(canonical_url), non_empty(source_url), F.lit(""))
