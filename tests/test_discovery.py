"""Ranking of known links, and the parts it is made of."""

import random

import pytest
from pyspark.sql import functions as F

from offerloom import schemas
from offerloom.operators import discovery
from offerloom.plans import joins
from offerloom.plans.ordering import with_places

LINKS = [
    ("alfa.ro", 0, "https://alfa.ro/despre", ""),
    ("alfa.ro", 1, "https://alfa.ro/item/1", "Red ring"),
    ("alfa.ro", 2, "https://alfa.ro/blog/ring", ""),
    ("alfa.ro", 3, "https://beta.com/item/2", ""),
    ("alfa.ro", 4, "https://alfa.ro/despre", "Shop"),  # seen before
    ("beta.com", 0, "https://beta.com/item/2", "Garden set"),
    ("beta.com", 1, "https://alfa.ro/item/1", "x"),
    ("beta.com", 2, "https://beta.com/c?sort=a", ""),
]
A1, A0, B2 = "https://alfa.ro/item/1", "https://alfa.ro/despre", "https://beta.com/item/2"
# The two best of each start page; without a query where no word of it matches there.
LISTS = {
    (None, "alfa.ro"): [(A1, 4.5), (A0, 3.0)],
    (None, "beta.com"): [(A1, 4.5), (B2, 3.5)],
    ("red", "alfa.ro"): [(A1, 6.5), (A0, 3.0)],
    ("ring blog", "alfa.ro"): [(A1, 6.5), (A0, 3.0)],
    ("garden", "beta.com"): [(B2, 5.5), (A1, 4.5)],
    ("https", "alfa.ro"): [(A1, 6.5), (A0, 5.0)],
    ("https", "beta.com"): [(A1, 6.5), (B2, 5.5)],
}
BEST = {
    "red": [(A1, 6.5), (B2, 3.5), (A0, 3.0)],
    "ring blog": [(A1, 6.5), (B2, 3.5), (A0, 3.0)],
    "garden": [(B2, 5.5), (A1, 4.5), (A0, 3.0)],
    "ab": [(A1, 4.5), (B2, 3.5), (A0, 3.0)],
    "https": [(A1, 6.5), (B2, 5.5), (A0, 5.0)],
}


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_ranking_of_known_links(spark, monkeypatch, broadcast):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(discovery, "TOKENS_IN_PLACE", 200 if broadcast else 0)
    requests = spark.createDataFrame([(q,) for q in [*BEST, *BEST]], "query_normalized STRING")
    lists = discovery.top_links_per_domain(requests, spark.createDataFrame(LINKS, schemas.LINKS), 2)
    found = {}
    for r in sorted(lists.collect(), key=lambda r: r.rank):
        found.setdefault((r.query_normalized, r.seed_domain), []).append((r.url, r.score))
    assert found == LISTS
    best = {}
    for r in sorted(discovery.top_links(requests, lists, limit=4).collect(), key=lambda r: r.position):
        best.setdefault(r.query_normalized, []).append((r.url, r.score))
    assert best == BEST
    cut = discovery.top_links(requests, lists, limit=1).collect()
    assert {r.query_normalized: r.url for r in cut} == {q: rows[0][0] for q, rows in BEST.items()}


def test_only_the_first_links_count(spark):
    requests = spark.createDataFrame([("red",)], "query_normalized STRING")
    lists = discovery.top_links_per_domain(requests, spark.createDataFrame(LINKS, schemas.LINKS), 2, per_seed=1).collect()
    assert {(r.query_normalized, r.seed_domain, r.url, r.score) for r in lists} == {
        (None, "alfa.ro", A0, 3.0), (None, "beta.com", B2, 3.5),
    }


@pytest.mark.parametrize("in_place", [200, 2])
def test_token_matches(spark, monkeypatch, in_place):
    monkeypatch.setattr(discovery, "TOKENS_IN_PLACE", in_place)
    rng = random.Random(2)
    tokens = ["abc", "bca", "cab", "abca", "zzz", "produs", "aaaa"]
    links = [("d", i, "https://x/" + "".join(rng.choice("abc/") for _ in range(8)), rng.choice(["", "ABCA", "Produse"])) for i in range(300)]
    table = spark.createDataFrame(links, schemas.LINKS)
    got = discovery.token_matches(spark.createDataFrame([(t,) for t in tokens], "token STRING"), table).collect()
    expected = {(t, l[1]) for t in tokens for l in links if t in l[2].lower() or t in l[3].lower()}
    assert {(r.token, r.pos) for r in got} == expected and len(got) == len(expected)


def test_start_pages_are_read_where_they_are(spark):
    web = [
        ("https://a.ro", '<a href="/x">X</a><a href="https://no.ro/y">no</a><a href="//b.ro/z">Z</a>'),
        ("http://a.ro/", '<a href="/never">never</a>'),
        ("https://b.ro/", None),  # not fetched
        ("http://b.ro/", '<a href="p/1">P</a>'),
        ("https://c.ro/", "<p>no links</p>"),
        ("https://no.ro", '<a href="https://a.ro/x">X</a>'),
        ("https://a.ro/deep", '<a href="https://a.ro/deeper">D</a>'),
    ]
    pages = spark.createDataFrame(web, "url STRING, html STRING")
    allowed = spark.createDataFrame([("a.ro",), ("b.ro",), ("c.ro",), ("d.ro",)], "domain STRING")
    links = discovery.discover_links(pages, allowed)
    assert sorted((r.seed_domain, r.url, r.text) for r in links.collect()) == [
        ("a.ro", "https://a.ro/x", "X"), ("a.ro", "https://b.ro/z", "Z"), ("b.ro", "http://b.ro/p/1", "P"), ("c.ro", "https://c.ro", ""),
    ]
    assert [r.seed_domain for r in discovery.discover_links(pages, allowed, limit=1).orderBy("seed_domain").collect()] == ["a.ro", "b.ro", "c.ro"]
    assert discovery.discover_links(pages.limit(0), allowed).count() == 0


def test_links_far_down_a_page_are_read_only_where_needed(spark, monkeypatch):
    def page(domain, hosts):
        return f"https://{domain}", "".join(f'<a href="https://{h}/{i}">{i}</a>' for i, h in enumerate(hosts))

    web = [page("a.ro", ["a.ro"] * 50), page("b.ro", ["no.ro"] * 20 + ["b.ro"] * 9), page("c.ro", ["c.ro", "no.ro"] * 3), page("d.ro", ["no.ro"] * 9)]
    pages = spark.createDataFrame([*web, page("e.ro", ["e.ro"] * 3), page("e.ro", ["no.ro"] * 6 + ["e.ro"])], "url STRING, html STRING")
    allowed = spark.createDataFrame([(f"{d}.ro",) for d in "abcde"], "domain STRING")
    numbered, number = [], discovery.first_links

    def counted(links, limit):
        numbered.append(links.filter("seed_domain = 'a.ro'").count())
        return number(links, limit)

    monkeypatch.setattr(discovery, "first_links", counted)
    found = discovery.discover_links(pages, allowed, limit=4).collect()
    assert sorted((r.seed_domain, r.pos) for r in found) == sorted(
        [("a.ro", i) for i in range(4)] + [("b.ro", i) for i in range(20, 24)] + [("c.ro", i) for i in (0, 2, 4)] + [("d.ro", 0)]
        + [("e.ro", i) for i in (0, 1, 2, 6)]
    )
    assert 0 < max(numbered) <= 6


def test_pages_are_read_once_for_their_links(spark, monkeypatch):
    web = [(f"https://{d}.ro", f'<a href="/{i}">{i}</a>') for i, d in enumerate("abcdefgh")] + [("https://no.ro", "<a href='https://a.ro/x'>x</a>")]
    pages = spark.createDataFrame(web, "url STRING, html STRING").coalesce(1)
    allowed = spark.createDataFrame([(f"{d}.ro",) for d in "abcdefgh"], "domain STRING")
    read, kept = [], []
    roots, write = discovery._roots, discovery.materialize

    def counted(pages):
        read.append(pages)
        return roots(pages)

    def noted(df, *rows_per_file):
        stored = write(df, *rows_per_file)
        if "html" in df.columns:
            kept.append((stored.count(), len(stored.inputFiles())))
        return stored

    monkeypatch.setattr(discovery, "_roots", counted)
    monkeypatch.setattr(discovery, "materialize", noted)
    monkeypatch.setattr(discovery, "PAGES_PER_FILE", 3, raising=False)
    found = discovery.discover_links(pages, allowed).collect()
    assert sorted((r.seed_domain, r.url) for r in found) == [(f"{d}.ro", f"https://{d}.ro/{i}") for i, d in enumerate("abcdefgh")]
    # One task found the eight start pages, three to a file.
    assert len(read) == 1 and kept == [(8, 3)]


def test_places_in_a_total_order(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("score"), "id")
    order = [F.desc("score"), F.asc("id")]
    placed = with_places(df, order, "at")
    assert [r["at"] for r in placed.orderBy(*order).collect()] == list(range(1, 1001))
    assert with_places(df.limit(0), order, "at").count() == 0
    # A window without keys would sort everything in one task.
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_seeds_without_links_stand_for_themselves(spark):
    seeds = spark.createDataFrame([("a.ro", "https://a.ro"), ("b.ro", "https://b.ro")], "seed_domain STRING, base_url STRING")
    links = spark.createDataFrame([("a.ro", 0, "https://a.ro/x", "t")], schemas.LINKS)
    got = {(r.seed_domain, r.url, r.text) for r in discovery.seed_links(seeds, links).collect()}
    assert got == {("a.ro", "https://a.ro/x", "t"), ("b.ro", "https://b.ro", "")}


def test_rank_candidates(spark):
    urls = ["https://a.ro/c", "https://a.ro/produs/1", "https://b.com/produs", "https://a.ro/blog", "https://no.ro/p"]
    links = spark.createDataFrame([("j", u, i + 1) for i, u in enumerate(urls)], "job_id STRING, url STRING, position INT")
    allowed = spark.createDataFrame([("a.ro",), ("b.com",)], "domain STRING")
    got = discovery.rank_candidates(links, allowed, ["job_id"]).orderBy("rank").collect()
    assert [(r.rank, r.url, r.score) for r in got] == [
        (1, "https://a.ro/produs/1", 4.5), (2, "https://a.ro/c", 3.0), (3, "https://b.com/produs", 1.5),
    ]


def test_query_words(spark):
    df = spark.createDataFrame([("red de ring",), ("red de ring",)], "query_normalized STRING")
    assert sorted(r.token for r in discovery.query_words(df).collect()) == ["red", "ring"]
