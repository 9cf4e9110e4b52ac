"""Text, price, size and city columns.

Everything here is a native Column expression.  Whitespace means Unicode
whitespace throughout, hence the ``(?U)`` flags.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a price, a size and a place in free text.
PRICE_PATTERN = r"(?iU)(\d{1,3}(?:[.,\s]\d{3})*(?:[.,]\d{1,2})?)\s*(?:lei|ron|r\.?o\.?n)"
NUMBER_PATTERN = r"(?U)\d+(?:[.,]\d{1,2})?"
CURRENCY_PATTERN = r"(?iU)\b(?:ron|lei)\b"
PRICE_MENTION_PATTERN = (
    r"(?iU)(?:\d{1,3}(?:[.\s]\d{3})*(?:,\d{1,2})?|\d+(?:[.,]\d{1,2})?)\s*(?:lei|ron)"
)
SIZE_PATTERN = r"(?iU)\d+(?:[.,]\d+)?\s*(?:cm|mm|m|l|ml|kg|g|buc|set|m2|m\^2)"
CITY_SPELLINGS = [
    "Bucuresti", "București", "Cluj", "Timisoara", "Timișoara", "Iasi", "Iași",
    "Constanta", "Constanța", "Brasov", "Brașov",
]
CITY_HINTS = [
    "Bucuresti", "Cluj", "Timisoara", "Iasi", "Constanta", "Brasov",
    "Craiova", "Oradea", "Sibiu",
]
DEFAULT_CURRENCY = "RON"

# All characters Python's str.strip and str.split treat as whitespace.
WHITESPACE = "".join(chr(code) for code in range(0x10000) if chr(code).isspace())
SPACE = (
    r"[ \t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Drop whitespace at both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def collapse_spaces(c: Column) -> Column:
    """Runs of whitespace become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def non_empty(c: Column) -> Column:
    """Null instead of the empty string."""
    return F.nullif(c, F.lit(""))


def first_filled(values: Column) -> Column:
    """The first non-blank string of an array, stripped."""
    return F.get(F.filter(F.transform(values, strip), lambda v: v != ""), F.lit(0))


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind an ``inline`` so that each is evaluated once per row.

    The optimizer copies the expression of a plain projected column into every
    filter and projection above it, which repeats expensive patterns; it does
    not look through a generator.
    """
    struct = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(struct)))


def first_non_empty(*values: Column) -> Column:
    """The first argument that is not blank, stripped."""
    return F.coalesce(*[non_empty(strip(v)) for v in values])


@lru_cache(maxsize=1)
def _ascii_folds() -> tuple[str, str, dict[str, str]]:
    """ASCII forms of all non-ASCII characters, derived from Unicode NFKD.

    Returns the two sides of a one-to-one ``translate`` and a dictionary for
    the characters that become several (ligatures, fractions, units).
    """
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    # The compatibility forms of ASCII all lie in the first two planes.
    for code in range(0x80, 0x20000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        folded = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            single[chr(code)] = folded
        elif folded:
            several[chr(code)] = folded
    return "".join(single), "".join(single.values()), several


def map_literal(entries: dict[str, str]) -> Column:
    """A constant map, built by the optimizer from a single string literal."""
    packed = "\x02".join(f"{k}\x01{v}" for k, v in entries.items())
    return F.str_to_map(F.lit(packed), F.lit("\x02"), F.lit("\x01"))


def normalize_text(c: Column) -> Column:
    """Lower-case ASCII words and numbers separated by single spaces.

    Accents go, compatibility forms are spelled out, other non-ASCII characters
    vanish and ASCII symbols become spaces: one pass over the text, as
    ``translate`` covers all but the characters that become several.
    """
    source, target, several = _ascii_folds()
    symbols = "".join(ch for ch in map(chr, range(0x80)) if not ch.isalnum())
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    target = "".join(ch.lower() if ch.isalnum() else " " for ch in target)
    ligatures = map_literal(several)

    def spell(s: Column) -> Column:
        letters = F.transform(F.split(s, ""), lambda ch: F.coalesce(F.try_element_at(ligatures, ch), ch))
        foreign = F.regexp_replace(s, r"[\x00-\x7F]+", "")
        has_any = let(foreign, lambda f: F.length(F.translate(f, "".join(several), "")) < F.length(f))
        return F.when(has_any, F.array_join(letters, "")).otherwise(s)

    def fold(s: Column) -> Column:
        plain = F.translate(
            spell(s), source + symbols + capitals, target + " " * len(symbols) + capitals.lower()
        )
        return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\x00-\x7F]+", ""), " {2,}", " "))

    return let(c, fold)


def normalize_product_name(c: Column) -> Column:
    return F.left(normalize_text(c), F.lit(500))


def query_tokens(query_normalized: Column) -> Column:
    """Distinct words of at least three characters of a normalised query."""
    words = F.split(query_normalized, " ")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))


def add_price(
    df: DataFrame,
    source: str,
    price: str = "price",
    token: str = "price_token",
    currency: str = "currency",
) -> DataFrame:
    """Parse a price text into its exact digits, DECIMAL(12,2) and currency.

    Staged as three projections so that each pattern scans the text once.
    The digits are kept as text because the duplicate test compares them as
    text (``49.9`` and ``49.90`` differ).
    """
    text = F.translate(strip(F.col(source)), "\u00a0", " ")
    staged = df.withColumn("_text", F.when(F.col(source) != "", text))
    found = F.coalesce(
        non_empty(F.regexp_extract("_text", PRICE_PATTERN, 1)),
        non_empty(F.regexp_extract("_text", NUMBER_PATTERN, 0)),
    )
    staged = compute_once(
        staged,
        _digits=F.replace(found, F.lit(" "), F.lit("")),
        _code=F.when(F.col("_text").rlike(CURRENCY_PATTERN), F.lit(DEFAULT_CURRENCY)),
    )
    d = F.col("_digits")
    commas = F.length(d) - F.length(F.replace(d, F.lit(","), F.lit("")))
    dots = F.length(d) - F.length(F.replace(d, F.lit("."), F.lit("")))
    plain = (
        F.when((commas == 1) & (dots == 0), F.translate(d, ",", "."))
        .when((dots > 1) & (commas == 0), F.translate(d, ".", ""))
        .when((dots >= 1) & (commas == 1), F.translate(d, ",.", "."))
        .otherwise(F.translate(d, ",", ""))
    )
    staged = staged.withColumn("_plain", plain)
    valid = F.when(F.col("_plain").rlike(r"\A\d+(?:\.\d+)?\z"), F.col("_plain"))
    return (
        staged.withColumn(token, F.regexp_replace(valid, r"\A0+(?=\d)", ""))
        .withColumn(price, F.expr("try_cast(_plain AS DECIMAL(12,2))"))
        .withColumn(currency, F.col("_code"))
        .drop("_text", "_digits", "_code", "_plain")
    )


def extract_size(c: Column) -> Column:
    """The first "number unit" of a text, as ``<number> <unit>``."""
    found = F.translate(F.regexp_extract(c, SIZE_PATTERN, 0), ",", ".")
    return non_empty(F.lower(F.regexp_replace(found, r"(?U)\A(\d+(?:\.\d+)?)\s*", "$1 ")))


# Looking at the first letter alone skips most positions of a long text.
CITY_MENTION_PATTERN = (
    f"(?iU)(?=[{''.join(sorted({city[0] for city in CITY_SPELLINGS}))}])(?:" + "|".join(CITY_SPELLINGS) + ")"
)


def first_match(c: Column, pattern: str) -> Column:
    """The first match of a pattern as written; empty if there is none."""
    return F.regexp_extract(c, pattern, 0)


def price_mention(c: Column) -> Column:
    """The first lei/ron amount of a text, as written."""
    return non_empty(first_match(c, PRICE_MENTION_PATTERN))


def city_mention(c: Column) -> Column:
    """The first known city spelling of a text, as written."""
    return non_empty(first_match(c, CITY_MENTION_PATTERN))


def city_hint(c: Column) -> Column:
    """The first city, in the order of the list, that stands in the text as a word."""
    return F.coalesce(*[F.when(c.rlike(rf"(?iU)\b{city}\b"), F.lit(city)) for city in CITY_HINTS])
