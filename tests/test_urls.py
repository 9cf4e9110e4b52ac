"""URL columns against Python's own URL functions and literal cases."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from offerloom.functions import urls as U

BASES = ["https://a.ro", "https://www.a.ro/x/y/z?q=1#f", "http://b.com/dir/", "https://c.ro:8080/p;v=1/q"]
HREFS = [
    "/produs/1", "produs/2", "../up", "../../../up", "./same", "x/./y/../z", "a//b", "/a/../b//c", "//cdn.ro/x",
    "https://other.ro/y?z#f", "HTTP://UP.ro/x", "?page=2", "?page=2#t", "x?y=/../z", "für x", "the,", "..", ".", "x/..",
    "x/.", "ftp://h/x", "https:rel", "#only", "x#frag", "data:text/plain,1",
]


def test_join_url_equals_urljoin(spark):
    rows = spark.createDataFrame([(b, h) for b in BASES for h in HREFS], "b STRING, h STRING")
    got = rows.select("b", "h", U.join_url(F.col("b"), F.col("h")).alias("u")).collect()
    wrong = [(r.b, r.h, r.u, urljoin(r.b, r.h)) for r in got if r.u != urljoin(r.b, r.h)]
    assert wrong == []


def test_resolve_url_drops_what_is_no_page(spark):
    hrefs = ["mailto:x@y", "tel:1", "javascript:void(0)", "#top", "", None, "  ", " /p ", "MAILTO:x"]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(hrefs)], "i INT, h STRING")
    got = rows.select("i", U.resolve_url(F.lit("https://a.ro"), F.col("h")).alias("u")).orderBy("i").collect()
    assert [r.u for r in got] == [None] * 6 + ["https://a.ro", "https://a.ro/p", "MAILTO:x"]


def test_registered_domain(spark):
    cases = {
        "https://www.example.ro/x": "example.ro",
        "https://shop.test.ro": "test.ro",
        "http://a.b.com.ro/": "b.com.ro",
        "https://x.co.uk:8080/p": "x.co.uk",
        "https://user:pw@y.ro/": "y.ro",
        "https://WWW.UP.RO": "up.ro",
        "https://host.unknown/x": "host.unknown",
        "https://127.0.0.1:80/": "127.0.0.1:80",
        "https://com.ro/": ".com.ro",
        "https://wwww.ro": "wro",
        "/relative": "",
        "//z.ro/x": "z.ro",
        "https://für x.ro/y": "für x.ro",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url STRING")
    got = {r.url: r.domain for r in U.add_domain(rows).collect()}
    assert got == cases


def test_suffix_rules_of_a_table(spark):
    rules = spark.createDataFrame([("hu",), (" CO.HU ",), ("*.ck",), ("!www.ck",), (None,)], "suffix STRING")
    cases = {
        "https://www.flori.co.hu/": "flori.co.hu",
        "https://a.flori.hu/": "flori.hu",
        "https://co.hu/": ".co.hu",
        "https://x.y.any.ck/": "y.any.ck",
        "https://any.ck/": ".any.ck",
        "https://m.www.ck/": ".m.ck",  # every www. is dropped from the host
        "https://m.ww.www.ck/": "m.ww.ck",
        "https://shop.example.cz/": "shop.example.cz",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url STRING")
    found = {r.url: r.domain for r in U.add_domain(rows, suffixes=U.suffix_list(rules)).collect()}
    assert found == cases
    assert [r.domain for r in U.add_domain(rows.limit(1), suffixes=[]).collect()] == ["flori.co.hu"]


def test_score_url(spark):
    cases = [
        ("https://gradina.ro/produs/1", "", 6.5),
        ("https://x.com/", "", 0.0),
        ("https://x.com/", "Garden shop", 2.0),
        ("https://x.ro/blog/p", "", 1.5),
        ("https://x.com/?sort=a", "", -1.0),
        ("https://x.com/?SORT=a", "", 0.0),
        ("https://product.com/", "", 1.5),
        ("https://x.com/", "FORUM pdf", -3.0),
    ]
    rows = U.add_domain(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i INT, url STRING, t STRING, s DOUBLE"))
    got = U.add_score(rows, texts=["t"]).orderBy("i").collect()
    assert [r.score for r in got] == [c[2] for c in cases]


def test_keys(spark):
    import hashlib

    row = spark.range(1).select(
        U.cache_key(F.lit("red widget"), F.lit("https://a.ro/ü")).alias("k"),
        U.url_key(F.lit(""), F.lit("s")).alias("a"),
        U.url_key(F.lit("c"), F.lit("s")).alias("b"),
        U.url_key(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("c"),
    ).first()
    assert row.k == hashlib.sha1("red widget|https://a.ro/ü".encode()).hexdigest()
    assert (row.a, row.b, row.c) == ("s", "c", "")
