"""Literal cases for text, price, size and city columns."""

import decimal
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from offerloom.functions import text as T


def column(spark, values, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r.x for r in rows.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalized_text_has_only_words(spark):
    rng = random.Random(5)
    pool = [chr(c) for c in range(0x20, 0x17F)] + list("ﬁ½™…ⅷ㎏ＡＢ１𝐀𝟗🅐  ́șțăâî\t\n\x1c")
    values = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(400)]
    got = column(spark, values, T.normalize_text)
    assert all(re.fullmatch("(?:[a-z0-9]+(?: [a-z0-9]+)*)?", g) for g in got)
    assert column(spark, got, T.normalize_text) == got
    assert column(spark, [v.upper() for v in got], T.normalize_text) == got


def test_normalized_text_of_known_cases(spark):
    cases = {
        "Lămâi și piersici": "lamai si piersici",
        "": "",
        "  X--y  ": "x y",
        "ﬁ½": "fi12",
        "ß": "",
        "ＡＢ１": "ab1",
        "𝐀𝟗": "a9",
        "㎏ ™": "kg tm",
        "e\u0301te\u0301": "ete",
        "Ø12Łx": "12x",
        "a_b.c": "a b c",
    }
    assert column(spark, list(cases), T.normalize_text) == list(cases.values())


def test_every_character_folds_by_its_decomposition(spark):
    values = [f"a{chr(c)}b" for c in range(1, 0x20000) if not 0xD800 <= c <= 0xDFFF]
    for v, g in zip(values, column(spark, values, T.normalize_text), strict=True):
        kept = [c for c in unicodedata.normalize("NFKD", v[1:-1]) if c.isascii()]
        assert g.replace(" ", "") == "a" + "".join(c.lower() for c in kept if c.isalnum()) + "b"
        assert (" " in g) == any(not c.isalnum() for c in kept)


def test_product_name_is_cut(spark):
    assert column(spark, ["x" * 600], T.normalize_product_name) == ["x" * 500]


def test_query_tokens(spark):
    assert column(spark, ["la dulap cu 3 usi alb dulap"], T.query_tokens) == [["dulap", "usi", "alb"]]


PRICES = [
    ("2.475,30 lei", "2475.30", "RON"),
    ("1299 lei", "299", "RON"),
    ("1299.00 RON", "299.00", "RON"),
    ("1 299 lei", "1299", "RON"),
    ("1.299 lei", "1.299", "RON"),
    ("1,299.99 lei", "1.29999", "RON"),
    ("12,345,678 lei", "12345678", "RON"),
    ("Livrare 24h", "24", None),
    ("29lei", "29", None),
    ("007,50 lei", "7.50", "RON"),
    ("0,50 lei", "0.50", "RON"),
    ("1 299 lei", "1299", "RON"),
    ("1\n299 lei", None, "RON"),
    ("19 EUR", "19", None),
    ("la cerere", None, None),
    ("lei", None, "RON"),
    ("", None, None),
    (None, None, None),
    ("12 R.O.N.", "12", None),
]


def test_parse_price(spark):
    rows = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PRICES)], "i INT, raw STRING")
    got = T.add_price(rows, "raw").orderBy("i").collect()
    assert [(r.raw, r.price_token, r.currency) for r in got] == PRICES
    assert got[0].price == decimal.Decimal("2475.30")
    assert got[5].price == decimal.Decimal("1.30")
    assert "_text" not in got[0].asDict()


def test_price_beyond_the_stored_width_is_null(spark):
    rows = spark.createDataFrame([("123.456.789.012.345 lei",)], "raw STRING")
    row = T.add_price(rows, "raw").first()
    assert row.price_token == "123456789012345" and row.price is None


@pytest.mark.parametrize(
    ("text", "size"),
    [
        ("Dulap lat de 45 cm", "45 cm"),
        ("5 ml", "5 m"),
        ("3 m2", "3 m"),
        ("20 lei", "20 l"),
        ("2 grame", "2 g"),
        ("50L", "50 l"),
        ("2,5 KG", "2.5 kg"),
        ("fara", None),
        ("", None),
        (None, None),
    ],
)
def test_extract_size(spark, text, size):
    assert column(spark, [text], T.extract_size) == [size]


def test_mentions_and_hints(spark):
    values = ["in CLUJ si Bucuresti", "București", "iașiul", "Iasi", "Sibiu", "pret 10,5 Lei azi", None, "BRAȘOV"]
    assert column(spark, values, T.city_mention) == ["CLUJ", "București", "iași", "Iasi", None, None, None, "BRAȘOV"]
    assert column(spark, values, T.city_hint) == ["Bucuresti", None, None, "Iasi", "Sibiu", None, None, None]
    assert column(spark, values, T.price_mention)[5] == "10,5 Lei"


def test_strip_and_first_non_empty(spark):
    assert column(spark, [" \t a b  \x1c"], T.strip) == ["a b"]
    assert column(spark, ["   "], lambda c: T.first_non_empty(c, F.lit(" x "))) == ["x"]
    assert column(spark, ["a\n  b "], T.collapse_spaces) == ["a b"]
