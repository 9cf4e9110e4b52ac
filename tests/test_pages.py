"""Page extraction: the markup cases the rules were written for."""

import decimal

from pyspark.sql import functions as F

from offerloom import schemas
from offerloom.functions import html as H
from offerloom.operators import discovery, extract

JSONLD_PAGE = """<html lang="ro"><body><p>Bine ati venit</p>
<script type='application/ld+json'>{"name": "Masa de stejar", "@type": "product", "url": "/mese/17",
"size": "blat de 140 cm", "offers": {"priceCurrency": "EUR", "price": "812.5"}}</script>
<h1>Mese si scaune</h1></body></html>"""
OPENGRAPH_PAGE = """<html><head><link rel="nofollow canonical" href="/scaune/9">
<meta name="description" content="nimic"><meta property="og:title" content="Scaun pliant 2 kg">
<meta property='og:description' content='Ridicare din Cluj, acum 74,50 lei &lt;redus&gt;'></head><body><h1>Alt titlu</h1></body></html>"""


def products(spark, pages, run=extract.extract_products):
    rows = [(f"https://shop.ro/dir/{i}", html) for i, html in enumerate(pages)]
    df = run(spark.createDataFrame(rows, "url STRING, html STRING"))
    found = {r.url: r for r in df.collect()}
    return [found.get(f"https://shop.ro/dir/{i}") for i in range(len(pages))]


def ld(text):
    return f'<script type="application/ld+json">{text}</script>'


def test_jsonld_page(spark):
    (row,) = products(spark, [JSONLD_PAGE])
    assert row.product_name == "Masa de stejar" and row.extractor == "jsonld"
    assert (row.price, row.price_token, row.currency) == (decimal.Decimal("812.50"), "812.5", "EUR")
    assert row.size_text == "140 cm" and row.canonical_url == "/mese/17"


def test_opengraph_page(spark):
    (row,) = products(spark, [OPENGRAPH_PAGE])
    assert row.product_name == "Scaun pliant 2 kg" and row.extractor == "opengraph"
    assert row.location_text == "Ridicare din Cluj, acum 74,50 lei <redus>"
    assert row.currency == "RON" and row.price_token == "74.50" and row.size_text == "74.50 l"
    assert row.canonical_url == "/scaune/9"


def test_strict_json(spark):
    rows = products(
        spark,
        [
            # Text behind the value, or a second value, is an error; the next block counts.
            ld('{"@type":"Product","name":"no"};') + ld('{"@type":"Product","name":"A"}'),
            ld('{"@type":"Product","name":"no"}{"a":1}') + "<h1>B</h1>",
            ld('{"@type":"Product","name":"no"},{"@type":"Product","name":"no"}') + "<h1>C</h1>",
            # Of a repeated key the last value counts.
            ld('{"@type":"Thing","@type":"Product","name":"no","name":"D"}'),
        ],
    )
    assert [r.product_name for r in rows] == ["A", "B", "C", "D"]


def test_jsonld_numbers_that_are_none(spark):
    long = ",".join(['"a NaN, b"', "NaN", "-Infinity"] * 20_000)
    rows = products(
        spark,
        [
            ld('{"@type":"Product","name":"A NaN, Infinity \\" NaN","rating":NaN,"offers":{"price":7.50,"x":[-Infinity, Infinity]}}'),
            ld('{"@type":"Product","name":"B","offers":{"price":NaN,"priceCurrency":"EUR"}}'),
            ld('{"@type":"Product","name":"C","list":[' + long + "]}"),
            ld('{"@type":"Product","name":"no","x":NaNa}') + "<h1>D</h1>",
        ],
    )
    assert [r.product_name for r in rows] == ['A NaN, Infinity " NaN', "B", "C", "D"]
    assert (rows[0].price_token, rows[1].price_token) == ("7.5", None)


def test_jsonld_oddities(spark):
    rows = products(
        spark,
        [
            # A broken block is skipped, the next one counts; a list is searched for its first product.
            ld("{broken") + ld('[1, {"@type": "Thing"}, {"@type": ["X", "Product"], "name": "A"}, {"@type":"Product","name":"B"}]'),
            # Numbers print as Python does; a list of offers has no price.
            ld('{"@type":"Product","name":"C","offers":{"price":49.90,"priceCurrency":"RON"}}'),
            ld('{"@type":"Product","name":"D","offers":{"price":1500.0,"priceCurrency":"EUR"}}'),
            ld('{"@type":"Product","name":"E","offers":{"price":1500,"priceCurrency":null}}'),
            ld('{"@type":"Product","name":"F","offers":[{"price":1}]}'),
            # No name, raw size kept, location from the brand.
            ld('{"@type":"IndividualProduct","name":"","sku":" X-9 ","brand":{"name":"Cluj"}}'),
            # A commented block and one of another type do not count; a graph is not searched.
            "<!-- " + ld('{"@type":"Product","name":"no"}') + " --><h1>G</h1>",
            '<script type="text/x">{"@type":"Product","name":"no"}</script><h1>H</h1>',
            ld('{"@graph":[{"@type":"Product","name":"no"}]}') + "<h1>I</h1>",
            "<SCRIPT data-a='>' type='application/ld+json'>" + '{"@type":"product","name":"</b>J"}' + "</SCRIPT >",
        ],
    )
    assert [r and r.product_name for r in rows] == ["A", "C", "D", "E", "F", "Unknown product", "G", "H", "I", "</b>J"]
    assert [r.price_token for r in rows[1:5]] == ["49.9", "1500.0", "1500", None]
    assert [r.currency for r in rows[1:5]] == ["RON", "EUR", "RON", "RON"]
    assert (rows[5].size_text, rows[5].location_text) == ("X-9", "Cluj")
    assert [r.extractor for r in rows[6:9]] == ["heuristic"] * 3


def test_microdata(spark):
    rows = products(
        spark,
        [
            """<h1>T</h1><div itemscope itemtype="http://schema.org/Product"><span itemprop="name">A <b>B</b></span>
               <span itemprop="price" content="12,50">ignored</span><meta itemprop="priceCurrency" content=" EUR ">
               <div><span itemprop="size">3 kg</span></div></div><p>9 cm</p>""",
            # No name inside: the headline; size from the text of the node only.
            """<h1>Head <i>line</i></h1><div itemtype='x/Product'><div>a</div><p>nimic</p></div><p>9 cm</p>""",
            # The node's own tag is no property; without currency RON.
            """<title>T</title><div itemtype="Product" itemprop="name">x<span itemprop=price>7 lei</span></div>""",
            """<!-- <div itemtype="Product"> --><h1>plain</h1>""",
        ],
    )
    assert [r.product_name for r in rows] == ["AB", "Headline", "T", "plain"]
    assert [r.extractor for r in rows] == ["microdata"] * 3 + ["heuristic"]
    assert (rows[0].price_token, rows[0].currency, rows[0].size_text) == ("12.50", "EUR", "3 kg")
    assert (rows[1].price_token, rows[1].currency, rows[1].size_text) == (None, "RON", "a nimic")
    assert (rows[2].price_token, rows[2].size_text) == ("7", "7 l")


def test_heuristic(spark):
    rows = products(
        spark,
        [
            "<title>Titlu</title><h1> Nume &lt;mare&gt; <b>10</b></h1><style>1 lei</style><p>Pret 25 lei, 5 kg la Iași</p>",
            "<title>Doar titlu</title><p>x</p>",
            "<p>fara nume</p>",
            '<h1>Cu link</h1><link rel="canonical" href="../c"><script>var t="</p> 3 lei";</script>',
            "<h1>&#351;&#x219;&nbsp;</h1><p>  a\n b  </p><template><p>4 lei</p></template>",
        ],
    )
    assert rows[2] is None
    assert rows[0].product_name == "Nume <mare> 10" and rows[0].price_token == "25"
    assert (rows[0].size_text, rows[0].location_text, rows[0].canonical_url) == ("25 l", "Iași", "https://shop.ro/dir/0")
    assert rows[1].product_name == "Doar titlu"
    assert rows[3].canonical_url == "https://shop.ro/c" and rows[3].price_token is None
    assert rows[4].product_name == "şș" and rows[4].price_token is None


def test_page_text_keeps_inner_spaces(spark):
    page = "<p>  a  b\n c </p>x<!-- y --> z<br/><a title='>'>q</a><script>w</script>"
    df = spark.createDataFrame([(page,)], "html STRING")
    text = df.select(H.page_text(H.visible_source(F.col("html"))).alias("t")).first().t
    assert text == "a  b\n c x z q"


def test_text_between_many_spaces_and_tags(spark):
    wide = " \u00a0" * 100_000
    pages = [f"{wide}<b>{wide}a{wide}b{wide}<i></i>{wide}<", "<p>", "x<y <z>", " <p> a <b>\x1c</b> b", None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i INT, html STRING").orderBy("i")
    rows = df.select(H.inner_text(F.col("html"), " ").alias("t"), H.inner_text(F.col("html"), "").alias("s")).collect()
    assert [r.t for r in rows] == [f"a{wide}b <", "", "x", "a b", None]
    assert [r.s for r in rows] == [f"a{wide}b<", "", "x", "ab", None]


def test_odd_attributes(spark):
    rows = products(
        spark,
        [
            # Text like an attribute inside a value is none; the first of two counts.
            """<meta data-x=' property="og:title" content="no" ' property="og:title" content="A" content="B">""",
            """<META PROPERTY=og:title CONTENT=C><meta name="og:title" content="no">""",
            """<meta x="1"property="og:title"content='D "d"'/>""",
            """<meta property="og:titles" content="no"><metadata property="og:title" content="no"><h1 class='>'>E</h1>""",
            """<my-item itemtype="x:Product"><h1>F</h1></my-item>""",
        ],
    )
    assert [r.product_name for r in rows] == ["A", "C", 'D "d"', "E", "F"]
    assert rows[4].extractor == "microdata"


def test_very_long_tags_and_pages(spark):
    many = " ".join(f'a{i}="x>{i}"' for i in range(100_000))
    deep = "<div>" * 50_000
    rows = products(
        spark,
        [
            f'<meta {many} property="og:title" content="A">',
            f'<h1 {many}>B</h1><p {many}>5 lei</p>',
            f'<div itemtype="Product"><span itemprop="name" {many}>C</span>{deep}</div>',
            f'<script {many} type="application/ld+json">{{"@type":"Product","name":"D"}}</script>',
            "<p title='" + "<b>" * 100_000 + "<h1>E</h1>",
        ],
    )
    assert [r and r.product_name for r in rows[:4]] == ["A", "B", "C", "D"]
    assert rows[1].price_token == "5"


def test_empty_name_in_opengraph(spark):
    rows = products(spark, ['<meta property="og:title">', '<meta property="og:title" content="">'])
    assert [r.product_name for r in rows] == ["Unknown product"] * 2


def test_site_rules_override_and_reject(spark):
    rules = spark.createDataFrame([tuple(r.values()) for r in extract.DEFAULT_SITE_RULES], schemas.SITE_RULES)
    host = extract.DEFAULT_SITE_RULES[0]["host"]
    ruled = '<h1 class="x product-name">Usa <b>alba</b></h1><span class="product-price big">1.299,00 lei</span>'
    pages = spark.createDataFrame(
        [
            (f"https://www.{host}/p/1", ruled),
            (f"https://{host}/p/2", "<h1>fara clasa</h1>"),
            (f"https://sub.{host}/p/3", "<h1>alt host</h1>"),
            (f"https://{host}/p/4", JSONLD_PAGE),
        ],
        "url STRING, html STRING",
    )
    rows = {r.url.rsplit("/", 1)[1]: r for r in extract.site_rules(pages, rules).collect()}
    assert set(rows) == {"1", "3"}
    assert rows["1"].product_name == "Usa alba" and rows["1"].price_token == "1299.00"
    assert rows["1"].extractor == "adapter:dedeman" and rows["1"].location_text == "Romania"
    assert rows["3"].extractor == "heuristic"


def test_usable_pages(spark):
    pages = ["x" * 400, "x" * 399, "Please ENABLE JavaScript" + "x" * 400]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i INT, html STRING")
    assert [r.usable for r in extract.usable_pages(df).orderBy("i").collect()] == [True, False, False]


def test_extract_links(spark):
    html = """<a href="/a?x=1&amp;y=2"> A <b>b</b></a><a name=x>no</a><a href='https://www.b.ro/p'>B</a>
      <!-- <a href="/hidden">h</a> --><a href="https://c.com/">C</a><a href="mailto:m@x">m</a>
      <a class="q" href=rel>unquoted<a href="">empty</a><a href="#x">in page</a>"""
    pages = spark.createDataFrame([("https://a.ro", html)], "url STRING, html STRING")
    allowed = spark.createDataFrame([("a.ro",), ("b.ro",)], "domain STRING")
    links = discovery.extract_links(pages, allowed).orderBy("pos").collect()
    assert [(r.link_url, r.text) for r in links] == [
        ("https://a.ro/a?x=1&y=2", "A b"),
        ("https://www.b.ro/p", "B"),
        ("https://a.ro/rel", "unquoted"),
    ]
