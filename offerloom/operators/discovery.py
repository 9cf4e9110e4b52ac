"""From pages to ranked candidate URLs for every search request.

A request looks at the links of every allowed domain's start page.  Its ranking
depends only on its query, and a link matching none of the query's words keeps
a score that is the same for all queries.  So the work is done once per domain
(the base lists), once per distinct word (the matches) and, per distinct query,
only for the domains in which one of its words matches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerloom.functions import html as H
from offerloom.functions import text as T
from offerloom.functions import urls as U
from offerloom.operators.robots import allowed_semi
from offerloom.plans.checkpoints import materialize
from offerloom.plans.joins import likely_in, lookup_join, match_join, unique_join
from offerloom.plans.ordering import with_places

# Fixed values of the ranking.
LINKS_PER_SEED = 120
TOP_PER_DOMAIN = 3
MOST_URLS = 200
MATCH_BONUS = 2.0
BATCH_SIZE = 25

# Up to this many distinct words are tried on every link; more go through trigrams.
TOKENS_IN_PLACE = 200

# For the first n links of a start page, so many times n of its anchors are read before the others.
FIRST_ANCHORS = 1.5

# Start pages per file where their source is kept, so that reading their links is spread evenly.
PAGES_PER_FILE = 500

# Up to the end tag or the next anchor: only a "<" may be where one starts.
_ANCHOR = rf"(?is)<a\b{H.ATTRS}>[^<]*+(?:<(?!/a\s*>|a\b)[^<]*+)*+"


def extract_links(
    pages: DataFrame, allowed: DataFrame, base: str = "url", suffixes: Sequence[str] = U.DEFAULT_SUFFIXES
) -> DataFrame:
    """Links of pages(base, html) to allowed domains, with anchor text and position."""
    return _links_at(_anchors(pages), allowed, base, suffixes)


def _anchors(pages: DataFrame) -> DataFrame:
    """The anchors of pages(html) in document order, with their position from 0."""
    anchors = F.regexp_extract_all(H.visible_source(F.col("html")), F.lit(_ANCHOR), F.lit(0))
    keep = [c for c in pages.columns if c != "html"]
    return pages.select(*keep, F.posexplode(anchors).alias("pos", "_anchor"))


def _links_at(anchors: DataFrame, allowed: DataFrame, base: str, suffixes: Sequence[str]) -> DataFrame:
    """The links to allowed domains among ``_anchors``."""
    keep = [c for c in anchors.columns if c not in ("pos", "_anchor")]
    # What a link leads to is asked for several times, its attribute is looked for once.
    with_href = T.compute_once(anchors, _href=H.attribute(H.opening_tag(F.col("_anchor")), "href"))
    links = T.compute_once(
        with_href,
        link_url=U.resolve_url(F.col(base), F.col("_href")),
        text=H.inner_text(F.col("_anchor"), " "),
    ).filter(F.col("link_url").isNotNull()).drop("_href")
    with_domain = U.add_domain(links, "link_url", "link_domain", suffixes).drop("_anchor")
    return allowed_semi(with_domain, allowed, domain="link_domain", costly=True).select(
        *keep, "pos", "link_url", "link_domain", "text"
    )


def first_links(links: DataFrame, limit: int = LINKS_PER_SEED) -> DataFrame:
    """The first links of each seed page in document order, numbered from 1."""
    order = Window.partitionBy("seed_domain").orderBy("pos", "url", "text")
    return links.withColumn("link_no", F.row_number().over(order)).filter(F.col("link_no") <= limit)


def start_pages(pages: DataFrame, allowed: DataFrame) -> DataFrame:
    """Start page (seed_domain, base_url, page_url) of each allowed domain, https before http.

    A page without source counts as not fetched; a domain without a start page is left out.
    """
    return _start_pages(_roots(pages), allowed)


def _seed_addresses(allowed: DataFrame) -> DataFrame:
    """The two addresses (seed_domain, base_url) a start page of an allowed domain may have."""
    schemes = F.array(F.lit("https://"), F.lit("http://"))
    return allowed.select(F.col("domain").alias("seed_domain")).distinct().select(
        "seed_domain", F.explode(F.transform(schemes, lambda s: F.concat(s, "seed_domain"))).alias("base_url")
    )


def _start_pages(roots: DataFrame, allowed: DataFrame) -> DataFrame:
    """``start_pages`` among ``_roots``."""
    found = lookup_join(roots.drop("html"), _seed_addresses(allowed), ["base_url"], "inner")
    # Of the two addresses the one with https sorts last; of two spellings the shorter counts.
    best = F.max_by(F.struct("base_url", "page_url"), F.struct("base_url", -F.length("page_url")))
    return found.groupBy("seed_domain").agg(best.alias("_best")).select("seed_domain", "_best.*")


def _roots(pages: DataFrame) -> DataFrame:
    """Fetched pages at the root of a host, with the address links are resolved against."""
    base = F.lower(F.regexp_extract(F.col("url"), r"(?i)\A(https?://[^/?#]+)/?\z", 1))
    roots = pages.select(F.col("url").alias("page_url"), base.alias("base_url"), "html")
    return roots.filter((F.col("base_url") != "") & F.col("html").isNotNull())


def discover_links(
    pages: DataFrame, allowed: DataFrame, suffixes: Sequence[str] = U.DEFAULT_SUFFIXES, limit: int = LINKS_PER_SEED
) -> DataFrame:
    """Links of the start pages of all allowed domains; a start page without any stands for itself.

    ``pages(url, html)`` hold one row per URL.  They are read once: what may be a start page is kept where it is
    found, in small files.  Links are read where the page is; only they are joined.
    Anchors far down a page are read only for seeds whose first anchors hold fewer links than ``limit``.
    """
    roots = materialize(likely_in(_roots(pages), _seed_addresses(allowed), "base_url"), PAGES_PER_FILE)
    seeds = materialize(_start_pages(roots, allowed))
    first = F.col("pos") < math.ceil(limit * FIRST_ANCHORS)

    def links_of(among: DataFrame, read: Column) -> DataFrame:
        anchors = _anchors(likely_in(roots, among, "page_url")).filter(read)
        links = _links_at(anchors, allowed, "base_url", suffixes)
        seeded = lookup_join(links, among.select("page_url", "seed_domain"), ["page_url"], "inner", costly=True)
        return seeded.select("seed_domain", F.col("pos").cast("bigint").alias("pos"), F.col("link_url").alias("url"), "text")

    links = materialize(first_links(links_of(seeds, first), limit))
    complete = links.filter(F.col("link_no") == limit).select("seed_domain")
    open_seeds = materialize(unique_join(seeds, complete, ["seed_domain"], "left_anti"))
    if not open_seeds.isEmpty():
        both = links.drop("link_no").unionByName(links_of(open_seeds, ~first))
        links = materialize(first_links(both, limit))
    return seed_links(seeds.select("seed_domain", "base_url"), links)


def seed_links(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """Links per seed, the seed's own URL standing in where there are none."""
    bare = seeds.join(links.select("seed_domain").distinct(), "seed_domain", "left_anti")
    stand_in = bare.select(
        "seed_domain", F.lit(0).cast("bigint").alias("pos"), F.col("base_url").alias("url"), F.lit("").alias("text")
    )
    return links.select("seed_domain", "pos", "url", "text").unionByName(stand_in)


def scored_links(
    links: DataFrame, suffixes: Sequence[str] = U.DEFAULT_SUFFIXES, per_seed: int = LINKS_PER_SEED
) -> DataFrame:
    """First links, one row per seed and URL (the first counts), with their score."""
    once = (
        first_links(links, per_seed)
        .groupBy("seed_domain", "url")
        .agg(F.min(F.struct("link_no", "text")).alias("_first"))
        .select("seed_domain", "url", "_first.link_no", "_first.text")
    )
    return U.add_score(U.add_domain(once, "url", "_domain", suffixes), "url", "_domain", ["text"]).drop("_domain")


def query_words(requests: DataFrame) -> DataFrame:
    """Distinct (query_normalized, token) pairs of the requests."""
    queries = requests.select("query_normalized").distinct()
    return queries.select("query_normalized", F.explode(T.query_tokens(F.col("query_normalized"))).alias("token"))


def _with_trigrams(df: DataFrame, column: str) -> DataFrame:
    """One row per position of ``column``, with the trigram starting there."""
    at = F.explode(F.sequence(F.lit(1), F.length(column) - 2))
    return (
        df.filter(F.length(column) >= 3)
        .withColumn("_at", at)
        .withColumn("_gram", F.substring(F.col(column), F.col("_at"), F.lit(3)))
        .drop("_at")
    )


def token_matches(tokens: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose URL or text contains a token, once per token; the links given must be distinct.

    A few tokens (the count is checked) are tried on each link in place.  Many
    are looked up by the trigrams of the links.
    """
    searched = links.withColumn("_hay", F.lower(F.concat_ws("\n", "url", "text")))
    vocabulary = tokens.select("token").distinct()
    few = [row.token for row in vocabulary.limit(TOKENS_IN_PLACE + 1).collect()]
    if len(few) <= TOKENS_IN_PLACE:
        words = F.array(*[F.lit(t) for t in few]) if few else F.array().cast("array<string>")
        contained = F.filter(words, lambda t: F.col("_hay").contains(t))
        return searched.withColumn("token", F.explode(contained)).drop("_hay")
    return _trigram_matches(vocabulary, searched)


def _trigram_matches(vocabulary: DataFrame, searched: DataFrame) -> DataFrame:
    """Matches found through shared trigrams, then verified.

    Each token is looked up by its rarest trigram among the links, which keeps
    the candidates close to the true matches.  Tokens are lower-case ASCII
    words, so there are at most 36**3 trigrams and the trigram tables are
    broadcast.
    """
    token_grams = _with_trigrams(vocabulary, "token").distinct()
    needed = token_grams.select("_gram").distinct()
    link_grams = _with_trigrams(searched, "_hay").join(F.broadcast(needed), "_gram", "left_semi")
    frequency = link_grams.groupBy("_gram").agg(F.count("*").alias("_n"))
    rarest = materialize(
        token_grams.join(F.broadcast(frequency), "_gram", "left")
        .groupBy("token")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_gram")).alias("_rarest"))
        .filter(F.col("_rarest._n") > 0)
        .select("token", "_rarest._gram")
    )
    candidates = match_join(link_grams, rarest, ["_gram"]).filter(F.col("_hay").contains(F.col("token")))
    return candidates.drop("_hay", "_gram").distinct()


def request_link_match(requests: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (query, seed, URL) where a word of the query is in the link's URL or text."""
    words = query_words(requests)
    matched = token_matches(words, links.select("seed_domain", "url", "text").distinct()).select("seed_domain", "url", "token")
    return match_join(matched, words, ["token"]).select("query_normalized", "seed_domain", "url").distinct()


def _top(df: DataFrame, keys: list[str], limit: int, out: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "link_no")
    return df.withColumn(out, F.row_number().over(order)).filter(F.col(out) <= limit)


def top_links_per_domain(
    requests: DataFrame,
    links: DataFrame,
    limit: int = TOP_PER_DOMAIN,
    suffixes: Sequence[str] = U.DEFAULT_SUFFIXES,
    per_seed: int = LINKS_PER_SEED,
) -> DataFrame:
    """Best links per query and seed domain; a matching word adds a bonus once.

    Rows with a null query are the list of a domain for every query that has no
    rows of its own there (no word of it matches any link of the domain).
    """
    limit = max(1, limit)
    scored = materialize(scored_links(links, suffixes, per_seed))
    base = _top(scored, ["seed_domain"], limit, "rank")
    words = query_words(requests)
    # Of the links a word matches in a domain only the best can be listed.
    matched = _top(token_matches(words, scored), ["token", "seed_domain"], limit, "_rank")
    bonus = match_join(matched.drop("_rank"), words, ["token"]).select(
        "query_normalized", "seed_domain", "url", "link_no", (F.col("score") + MATCH_BONUS).alias("score")
    )
    touched = bonus.select("query_normalized", "seed_domain").distinct()
    unmatched = match_join(touched, base.select("seed_domain", "url", "link_no", "score"), ["seed_domain"])
    merged = (
        bonus.unionByName(unmatched)
        .groupBy("query_normalized", "seed_domain", "url")
        .agg(F.max("score").alias("score"), F.min("link_no").alias("link_no"))
    )
    own = _top(merged, ["query_normalized", "seed_domain"], limit, "rank")
    columns = ["query_normalized", "seed_domain", "rank", "url", "score"]
    return own.select(*columns).unionByName(
        base.withColumn("query_normalized", F.lit(None).cast("string")).select(*columns)
    )


def top_links(requests: DataFrame, lists: DataFrame, limit: int = MOST_URLS) -> DataFrame:
    """Best links per query over all domains, from ``top_links_per_domain``.

    Of equal URLs the one of the first domain in order counts, with its score.
    The full lists of a query are never built: URLs in a domain where the query
    matches something are settled one by one, all others follow the common
    order, of which a query needs ``limit`` places plus one for every URL of
    its own that may stand in front.
    """
    queries = requests.select("query_normalized").distinct()
    place = F.struct("seed_domain", "rank", "score")
    lists = materialize(lists)
    base = lists.filter(F.col("query_normalized").isNull()).drop("query_normalized")
    own = lists.filter(F.col("query_normalized").isNotNull())
    replaced = own.select("query_normalized", "seed_domain").distinct()

    common = base.groupBy("url").agg(F.min(place).alias("_place"), F.count("*").alias("_places"))
    touched = (
        own.select("query_normalized", "url")
        .unionByName(match_join(replaced, base.select("seed_domain", "url"), ["seed_domain"]).select("query_normalized", "url"))
        .distinct()
    )

    # Where a touched URL stands: in a list of the query itself, ...
    in_own = own.select("query_normalized", "url", place.alias("_place"))
    # ... in its first domain if that one is not replaced, ...
    firsts = lookup_join(touched, common, ["url"], "inner").withColumn("seed_domain", F.col("_place.seed_domain"))
    in_first = firsts.join(replaced, ["query_normalized", "seed_domain"], "left_anti")
    # ... or in a later one.
    displaced = firsts.filter(F.col("_places") > 1).join(replaced, ["query_normalized", "seed_domain"], "left_semi")
    later = match_join(
        displaced.select("query_normalized", "url"), base.select("url", "seed_domain", place.alias("_place")), ["url"]
    ).join(replaced, ["query_normalized", "seed_domain"], "left_anti")
    columns = ["query_normalized", "url", "_place"]
    settled = (
        in_own.unionByName(in_first.select(*columns))
        .unionByName(later.select(*columns))
        .groupBy("query_normalized", "url")
        .agg(F.min("_place").alias("_place"))
    )

    counts = touched.groupBy("query_normalized").agg(F.count("*").alias("_n"))
    needed = queries.join(counts, "query_normalized", "left").select(
        "query_normalized", (F.coalesce("_n", F.lit(0)) + limit).alias("_needed")
    )
    longest = needed.agg(F.max("_needed")).first()[0] or 0
    best_first = [F.desc("_place.score"), F.asc("_place.seed_domain"), F.asc("_place.rank")]
    prefix = with_places(common.select("url", "_place"), best_first, "_at").filter(F.col("_at") <= longest)
    places = needed.select("query_normalized", F.explode(F.sequence(F.lit(1), "_needed")).alias("_at"))
    untouched = lookup_join(places, prefix, ["_at"], "inner").join(
        touched, ["query_normalized", "url"], "left_anti"
    )

    order = Window.partitionBy("query_normalized").orderBy(*best_first)
    return (
        settled.unionByName(untouched.select(*columns))
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= limit)
        .select("query_normalized", "position", "url", F.col("_place.score").alias("score"))
    )


def rank_candidates(
    links: DataFrame,
    allowed: DataFrame,
    keys: list[str],
    limit: int = MOST_URLS,
    suffixes: Sequence[str] = U.DEFAULT_SUFFIXES,
) -> DataFrame:
    """Final ranking of links(keys, url, position): allowed, relevant, by the score of the URL alone."""
    scored = U.add_score(U.add_domain(links.select(*keys, "url", "position"), suffixes=suffixes))
    kept = allowed_semi(scored, allowed, domain="domain").filter(F.col("score") >= U.RELEVANCE_THRESHOLD)
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "position")
    return (
        kept.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select(*keys, "rank", "url", "domain", "score")
    )


def batch_no(rank: Column, size: int = BATCH_SIZE) -> Column:
    """Number of the batch a rank falls into, from 0."""
    return F.floor((rank - 1) / size).cast("int")


def relevant_urls(df: DataFrame, score: str = "score") -> DataFrame:
    return df.filter(F.col(score) >= U.RELEVANCE_THRESHOLD)
