"""Pages to products.

Each extractor reads one kind of markup into the same raw fields; prices and
sizes are then parsed once for all of them.  Everything is a projection over
the page row: no join, no shuffle, and the page source is dropped at the end.
Expensive steps go through ``compute_once``, so that the cascade scans a page
once per step and later steps only where the earlier ones found nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions import html as H
from offerloom.functions import text as T
from offerloom.functions.urls import host_of, join_url
from offerloom.plans.joins import lookup_join

# Names and tags of the reports.
UNKNOWN_PRODUCT = "Unknown product"
JSONLD_TYPE = "application/ld+json"
JS_NOTICE = "enable javascript"
SHORTEST_PAGE = 400

PRODUCT_COLUMNS = [
    "product_name", "price", "price_token", "currency", "size_text",
    "location_text", "canonical_url", "extractor",
]

# Up to a NaN or an infinity that stands outside of texts.
_NO_NUMBER = r'''\G((?:"(?:[^"\\]|\\.)*+"|(?!-?(?:NaN|Infinity)\b)[^"])*+)-?(?:NaN|Infinity)\b'''
_COMMENT_OR_SCRIPT = rf"(?is)<!--.*?(?:-->|\z)|<script\b{H.ATTRS}>.*?(?:</script\s*>|\z)"
def usable_pages(pages: DataFrame) -> DataFrame:
    """Flag the pages whose content needs a browser: a script notice or too little source."""
    needs_browser = F.lower("html").contains(JS_NOTICE) | (F.length("html") < SHORTEST_PAGE)
    return pages.withColumn("usable", ~needs_browser)


def _raw(
    names: list[Column],
    prices: list[Column],
    currency: Column | None = None,
    sizes: list[Column] | None = None,
    keep_size: bool = False,
    location: Column | None = None,
    canonical: Column | None = None,
) -> Column:
    """What an extractor read; of several texts the first non-blank one counts."""
    missing = F.lit("")

    def text(c: Column | None) -> Column:
        return missing if c is None else F.coalesce(c, missing)

    return F.struct(
        F.array(*names).alias("_names"),
        F.array(*prices).alias("_prices"),
        text(currency).alias("_currency"),
        F.array(*(sizes or [missing])).alias("_sizes"),
        F.lit(keep_size).alias("_keep_size"),
        text(location).alias("_location"),
        text(canonical).alias("_canonical"),
    )


def _finish(
    found: DataFrame, raw: Column, extractor: Column, keep: list[str], keep_nameless: bool = False
) -> DataFrame:
    """Parse the raw fields into product columns; rows without a name are dropped unless asked for."""
    rows = found.select(*keep, extractor.alias("extractor"), F.inline(F.array(raw)))
    picked = T.compute_once(
        rows,
        _name=F.get(F.filter("_names", lambda n: n != ""), F.lit(0)),
        _price_raw=F.get(F.filter("_prices", lambda p: p != ""), F.lit(0)),
        _size_raw=T.first_filled(F.col("_sizes")),
    )
    if not keep_nameless:
        picked = picked.filter(F.col("_name").isNotNull())
    named = T.add_price(picked, "_price_raw", currency="_parsed")
    return named.select(
        *keep,
        F.col("_name").alias("product_name"),
        "price",
        "price_token",
        F.coalesce(T.non_empty(F.col("_currency")), "_parsed", F.lit(T.DEFAULT_CURRENCY)).alias("currency"),
        F.coalesce(
            T.extract_size(F.col("_size_raw")), F.when(F.col("_keep_size"), F.col("_size_raw"))
        ).alias("size_text"),
        T.non_empty(F.col("_location")).alias("location_text"),
        T.non_empty(F.col("_canonical")).alias("canonical_url"),
        "extractor",
    )


def jsonld_item(html: Column) -> Column:
    """The first Product object of the JSON-LD blocks, or null."""
    scripts = F.regexp_extract_all(html, F.lit(_COMMENT_OR_SCRIPT), F.lit(0))

    def is_block(script: Column) -> Column:
        return ~script.startswith("<!--") & (H.attribute(H.opening_tag(script), "type") == JSONLD_TYPE)

    def items(block: Column) -> Column:
        body = F.regexp_replace(block, rf"(?is)\A<script\b{H.ATTRS}>|</script\s*>\z", "")
        # Numbers that are none, which lenient parsers take, are read as null.
        body = F.when(body.rlike("NaN|Infinity"), F.regexp_replace(body, _NO_NUMBER, "$1null")).otherwise(body)
        # Inside brackets, so that text behind the value is an error as it is in a strict parser.
        wrapped = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", "array<variant>")
        return T.let(
            F.when(F.size(wrapped) == 1, F.get(wrapped, F.lit(0))),
            lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)),
        )

    def is_product(item: Column) -> Column:
        return F.lower(F.try_variant_get(item, "$['@type']", "string")).contains("product")

    all_items = F.flatten(F.transform(F.filter(scripts, is_block), items))
    return F.when(html.contains(JSONLD_TYPE), F.get(F.filter(all_items, is_product), F.lit(0)))


def _jsonld_raw(item: Column) -> Column:
    def text(path: str) -> Column:
        return F.try_variant_get(item, path, "string")

    amount_type = F.schema_of_variant(F.try_variant_get(item, "$.offers.price", "variant"))
    # A JSON number with a zero fraction keeps one decimal, as in 1500.0.
    space = F.when(amount_type.rlike(r"\ADECIMAL\(\d+,\s*0\)"), ".0 ").otherwise(" ")
    code = F.coalesce(text("$.offers.priceCurrency"), F.lit(""))
    return _raw(
        [text("$.name"), F.lit(UNKNOWN_PRODUCT)],
        [F.concat(text("$.offers.price"), F.coalesce(space, F.lit(" ")), code)],
        currency=code,
        sizes=[text("$.size"), text("$.description"), text("$.sku")],
        keep_size=True,
        location=text("$.brand.name"),
        canonical=text("$.url"),
    )


def _last_of_repeated_keys(pages: DataFrame) -> None:
    """Of a repeated key in JSON the last value counts, instead of failing the block."""
    pages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def extract_jsonld(pages: DataFrame) -> DataFrame:
    """Products of pages(url, html) with a JSON-LD Product."""
    _last_of_repeated_keys(pages)
    found = T.compute_once(pages, _item=jsonld_item(F.col("html"))).filter(F.col("_item").isNotNull())
    return _finish(found, _jsonld_raw(F.col("_item")), F.lit("jsonld"), _kept(pages))


def _with_microdata(pages: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Add the first element typed as Product and its properties; empty if none."""
    visible = F.col("_visible")
    typed = H.tag_where(H.ANY_ELEMENT, "itemtype", r"""[^"'>]*Product[^"'>]*""")
    may_have = visible.contains("Product") if wanted is None else wanted & visible.contains("Product")
    found = T.compute_once(pages, _rest=F.when(may_have, H.source_from(visible, typed)).otherwise(""))
    found = T.compute_once(found, _node=H.leading_element("_rest")).drop("_rest")
    # Properties are looked up below the node, not on its own tag.
    below = F.regexp_replace("_node", rf"\A<{H.ATTRS}>", "")

    def prop(name: str) -> Column:
        return H.source_from(below, H.tag_where(H.ANY_ELEMENT, "itemprop", name))

    found = T.compute_once(found, _at_name=prop("name"), _at_price=prop("price"), _at_size=prop("size"))
    return T.compute_once(
        found,
        _currency_tag=H.first_tag(below, H.tag_where(H.ANY_ELEMENT, "itemprop", "priceCurrency")),
        _item_name=H.leading_element("_at_name"),
        _item_price=H.leading_element("_at_price"),
        _item_size=H.leading_element("_at_size"),
    ).drop("_at_name", "_at_size")


def _microdata_raw(visible: Column) -> Column:
    return _raw(
        [
            H.inner_text(F.col("_item_name"), ""),
            H.inner_text(H.heading(visible, "h1"), ""),
            H.inner_text(H.heading(visible, "title"), ""),
            F.lit(UNKNOWN_PRODUCT),
        ],
        [
            T.strip(H.attribute(H.opening_tag(F.col("_at_price")), "content")),
            H.inner_text(F.col("_item_price"), ""),
        ],
        currency=T.strip(H.attribute(F.col("_currency_tag"), "content")),
        sizes=[H.inner_text(F.col("_item_size"), ""), H.inner_text(F.col("_node"), " ")],
        keep_size=True,
    )


def _with_visible(pages: DataFrame) -> DataFrame:
    return T.compute_once(pages, _visible=H.visible_source(F.col("html")))


def extract_microdata(pages: DataFrame) -> DataFrame:
    """Products of pages(url, html) with an element typed as Product."""
    found = _with_microdata(_with_visible(pages)).filter(F.col("_node") != "")
    return _finish(found, _microdata_raw(F.col("_visible")), F.lit("microdata"), _kept(pages))


def opengraph_tag(visible: Column) -> Column:
    """The first ``og:title`` tag; empty if there is none."""
    return H.first_tag(visible, H.tag_where("meta", "property", "og:title"))


def canonical_href(visible: Column) -> Column:
    """Target of the first canonical link; empty without such a link or target."""
    tag = H.first_tag(visible, H.tag_where("link", "rel", r"""(?:[^"'>]*\s)?canonical(?:\s[^"'>]*)?"""))
    return F.when(visible.contains("canonical"), H.attribute(tag, "href")).otherwise("")


def _opengraph_raw(title_tag: Column, visible: Column) -> Column:
    described = H.first_tag(visible, H.tag_where("meta", "property", "og:description"))
    return T.let(
        H.attribute(described, "content"),
        lambda description: _raw(
            [H.attribute(title_tag, "content"), F.lit(UNKNOWN_PRODUCT)],
            [description],
            sizes=[description],
            location=description,
            canonical=canonical_href(visible),
        ),
    )


def extract_opengraph(pages: DataFrame) -> DataFrame:
    """Products of pages(url, html) with an ``og:title``."""
    found = T.compute_once(_with_visible(pages), _title=opengraph_tag(F.col("_visible")))
    raw = _opengraph_raw(F.col("_title"), F.col("_visible"))
    return _finish(found.filter(F.col("_title") != ""), raw, F.lit("opengraph"), _kept(pages))


def _heuristic_raw(visible: Column, url: Column) -> Column:
    return T.let(
        H.page_text(visible),
        lambda blob: _raw(
            [H.inner_text(H.heading(visible, "h1"), " "), H.inner_text(H.heading(visible, "title"), " ")],
            [T.first_match(blob, T.PRICE_MENTION_PATTERN)],
            sizes=[blob],
            location=T.first_match(blob, T.CITY_MENTION_PATTERN),
            canonical=T.let(
                canonical_href(visible), lambda href: F.when(href != "", join_url(url, href)).otherwise(url)
            ),
        ),
    )


def extract_heuristic(pages: DataFrame) -> DataFrame:
    """Products read from the headline and text of pages(url, html)."""
    raw = _heuristic_raw(F.col("_visible"), F.col("url"))
    return _finish(_with_visible(pages), raw, F.lit("heuristic"), _kept(pages))


def _kept(pages: DataFrame) -> list[str]:
    return [c for c in pages.columns if c != "html"]


def _cascade(
    pages: DataFrame, keep: list[str], rule: Column | None = None, keep_nameless: bool = False
) -> DataFrame:
    """Products by the first kind of markup found; ``rule`` (a struct) overrides it."""
    _last_of_repeated_keys(pages)
    item, node, title, visible = F.col("_item"), F.col("_node"), F.col("_title"), F.col("_visible")
    free = F.lit(True) if rule is None else rule.isNull()
    marked = T.compute_once(pages, _item=F.when(free, jsonld_item(F.col("html"))))
    marked = T.compute_once(
        marked, _visible=F.when(item.isNull(), H.visible_source(F.col("html"))).otherwise("")
    )
    marked = _with_microdata(marked, free)
    marked = T.compute_once(marked, _title=F.when(free & (node == ""), opengraph_tag(visible)).otherwise(""))
    extractor = (
        F.when(item.isNotNull(), "jsonld")
        .when(node != "", "microdata")
        .when(title != "", "opengraph")
        .otherwise("heuristic")
    )
    raw = (
        F.when(item.isNotNull(), _jsonld_raw(item))
        .when(node != "", _microdata_raw(visible))
        .when(title != "", _opengraph_raw(title, visible))
        .otherwise(_heuristic_raw(visible, F.col("url")))
    )
    if rule is not None:
        by_rule = _raw(
            [H.inner_text(F.expr("regexp_extract(_visible, _rule.name_pattern, 1)"), " ")],
            [H.inner_text(F.expr("regexp_extract(_visible, _rule.price_pattern, 1)"), " ")],
            location=rule["location"],
            canonical=F.col("url"),
        )
        raw = F.when(rule.isNotNull(), by_rule).otherwise(raw)
        extractor = F.when(rule.isNotNull(), F.concat(F.lit("adapter:"), rule["rule"])).otherwise(extractor)
    return _finish(marked, raw, extractor, keep, keep_nameless)


def extract_products(pages: DataFrame) -> DataFrame:
    """One product per page(url, html): the first kind of markup that gives one."""
    return _cascade(pages, _kept(pages))


# The one site with rules of its own, as a row of the rules table.
DEFAULT_SITE_RULES = [
    {
        "host": "dedeman.ro",
        "rule": "dedeman",
        "name_pattern": r"""(?is)<h1\b[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?product-name(?:\s[^"']*)?["'][^>]*>(.*?)</h1""",
        "price_pattern": r"""(?is)<[a-z][^>]*\bclass\s*=\s*["'](?:[^"']*\s)?product-price(?:\s[^"']*)?["'][^>]*>(.*?)</""",
        "location": "Romania",
    }
]


def site_rules(pages: DataFrame, rules: DataFrame, keep_nameless: bool = False) -> DataFrame:
    """``extract_products`` with per-site rules taking precedence.

    ``rules(host, rule, name_pattern, price_pattern, location)`` has one row per
    host; the first group of a pattern is the source of the name or price.  A
    page of such a host without the name is rejected, with no second attempt.
    ``keep_nameless`` keeps rejected pages as rows with a null name.
    """
    by_host = rules.select(
        F.col("host").alias("_host"),
        F.struct("rule", "name_pattern", "price_pattern", "location").alias("_rule"),
    )
    ruled = lookup_join(pages.withColumn("_host", host_of(F.col("url"))), by_host, ["_host"], "left")
    return _cascade(ruled, _kept(pages), F.col("_rule"), keep_nameless)
