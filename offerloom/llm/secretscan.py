"""Secrets in texts: three fixed kinds, and a battery of randomness tests for the rest.

Base kinds: an assignment to a password-like name, an access key, a long run of hex
digits.  Beyond them every unbroken token of ``TOKEN_LENGTH`` characters that holds
both a letter and a digit is a candidate; ``=`` belongs to it only as padding at its
end, so a value is apart from its name.  So is every part of it between ``+`` and ``/``,
or between ``-`` and ``_``, that is as long, since paths and names join words to a
secret; of spans within each other the outermost counts.  Its encoding is inferred from the
characters it uses (hex, hex in groups like a UUID's, tested without the dashes, base 32,
base 36 in either case, the same with ``+``, ``/``, ``-`` or ``_``, base 62, and base 64
for the rest, so that none goes untested), and three tests measure how
random it looks as a string over that alphabet:

* chi-squared: how evenly the symbols of the alphabet are used;
* runs: how often the class of the symbol changes (lower, upper, digit, other);
* serial correlation: how little a symbol tells about the next one.

Each test tells how many standard deviations a token is from an ordinary one of its length
and encoding (``ENCODINGS`` has its unevenness and its share of the changes of class, as
measured on identifiers and paths of the Python library; its correlation is 0.25).  The
weighted sum of the three, normal for an ordinary token, gives one p-value: what a short
token shows in each adds up, and a test that it fails counts against it.  On ordinary
tokens the tests were uncorrelated or negatively correlated, so that p is rather too large.
The serial test tells least and weighs least.  Among the candidates of an
encoding and a class of length (doubling every two classes) Benjamini-Hochberg keeps
the share of false discoveries at ``FALSE_SHARE``: the p-values are counted in bins
of one eighth of a power of e, a table of bounded size, and the threshold of each
class, rounded to the strict side, is part of the second pass over the texts.

Null and empty texts hold no secrets; repeated rows are counted as often as they
occur; an empty table gives an empty result.  Only the id and the text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import free_name

KINDS = ["assign", "access", "hex", "random"]
# The base patterns, and the least length of group 2 or of the match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

TOKEN_LENGTH = 20


def unbroken(inside: str, cut: str = "") -> str:
    """Pattern of a run of letters, digits and ``inside``, with its padding; given ``cut``,
    only of runs that such a symbol parts from their neighbours."""
    body = "[A-Za-z0-9%s]" % inside
    beside = "(?:(?<=[%s])|(?=%s++[%s]))" % (cut, body, cut) if cut else ""
    both = "(?=[A-Za-z%s]*[0-9])(?=[0-9%s]*[A-Za-z])" % (inside, inside)
    return "(?<!%s)%s%s%s{%d,}(?:=++(?![A-Za-z0-9+/_-]))?" % (body, beside, both, body, TOKEN_LENGTH)


TOKEN = unbroken("+/_-")
# A token, and its parts between the symbols that also join words to a secret.
CANDIDATES = [TOKEN, unbroken("_-", "+/"), unbroken("", "_-")]
FALSE_SHARE = 0.01
CORRELATION = 0.25
WEIGHTS = (1.0, 1.0, 0.4)
BINS_PER_E = 8
BINS = 400
CHUNK = 512
STRETCH = 1024
# Encoding: pattern, symbols, and the chance that neighbours are of different classes; then, of
# ordinary tokens, the excess of the chi-squared statistic a symbol and the share of that chance.
# Every token with a letter and a digit has one: the last takes whatever is left.
ENCODINGS = {
    "hex": (r"^([0-9a-f]+|[0-9A-F]+)=*$", 16, 1 - (10 / 16) ** 2 - (6 / 16) ** 2, 2.0, 0.5),
    "uuid": (r"^([0-9a-f]++([_-][0-9a-f]++)++|[0-9A-F]++([_-][0-9A-F]++)++)=*$", 16, 1 - (10 / 16) ** 2 - (6 / 16) ** 2, 2.0, 0.5),
    "base32": (r"^[A-Z2-7]+=*$", 32, 1 - (26 / 32) ** 2 - (6 / 32) ** 2, 0.7, 0.4),
    "base36": (r"^([a-z0-9]+|[A-Z0-9]+)=*$", 36, 1 - (26 / 36) ** 2 - (10 / 36) ** 2, 0.75, 0.4),
    "base38": (r"^([a-z0-9+/_-]+|[A-Z0-9+/_-]+)=*$", 38, 1 - (26 / 38) ** 2 - (10 / 38) ** 2 - (2 / 38) ** 2, 0.9, 0.6),
    "base62": (r"^[A-Za-z0-9]+=*$", 62, 1 - 2 * (26 / 62) ** 2 - (10 / 62) ** 2, 1.4, 0.52),
    "base64": (r"^[A-Za-z0-9+/_-]+=*$", 64, 1 - 2 * (26 / 64) ** 2 - (10 / 64) ** 2 - (2 / 64) ** 2, 1.4, 0.57),
}


def running(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step(carried, item)`` finds at each item; it gives ``(carried on, found)``.

    Items are taken in chunks of ``CHUNK``: a list that grows by one is copied each time,
    so a text with very many items would otherwise cost the square of their number.
    """

    def one(state: Column, item: Column) -> Column:
        carried, found = step(state["at"], item)
        return F.struct(carried.alias("at"), F.concat(state["found"], F.array(found)).alias("found"))

    def none(item: Column) -> Column:
        return F.slice(F.array(step(start, item)[1]), 2, 1)

    def over(every: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(1), F.size(every), F.lit(CHUNK)), lambda i: F.slice(every, i, CHUNK))
        nothing = none(F.get(every, F.lit(0)))

        def many(state: Column, chunk: Column) -> Column:
            after = F.aggregate(chunk, F.struct(state["at"].alias("at"), nothing.alias("found")), one)
            return F.get(
                F.transform(F.array(after), lambda s: F.struct(s["at"].alias("at"), F.concat(state["found"], F.array(s["found"])).alias("found"))),
                F.lit(0),
            )

        begin = F.struct(start.alias("at"), F.array(nothing).alias("found"))
        found = F.flatten(F.aggregate(chunks, begin, many, lambda s: s["found"]))
        return F.when(F.size(every) > 0, found).otherwise(nothing)

    return _bound(items, over)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def located(text: Column, pattern: str) -> Column:
    """Matches with their places: array of ``(start, end, match)`` in code points, end exclusive.

    What the pattern splits off and what it matches alternate, so the lengths of
    both add up to the places.
    """
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match")
    )

    def step(at: Column, pair: Column) -> tuple[Column, Column]:
        start = at + F.length(pair["between"])
        end = start + F.coalesce(F.length(pair["match"]), F.lit(0))
        return end, F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"))

    return F.filter(running(pairs, F.lit(0), step), lambda s: s["match"].isNotNull())


def _only_if(text: Column, pattern: str, spans: Column) -> Column:
    """Spans where the cheap pattern is met at all."""
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(text.rlike(pattern), spans).otherwise(none)


def assignments(text: Column) -> Column:
    value = lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= ASSIGN_VALUE
    some = ASSIGN.removesuffix("+)") + "{%d})" % ASSIGN_VALUE
    return _only_if(text, some, F.filter(located(text, ASSIGN), value))


def normal_tail(z: Column) -> Column:
    """The upper tail of the normal distribution, within one percent."""

    def of(z: Column) -> Column:
        size = F.abs(z)
        beyond = F.exp(-z * z / 2) / (F.lit(1.64) * size + F.sqrt(F.lit(0.76) * z * z + 4))
        return F.when(z < 0, 1 - beyond).otherwise(beyond)

    return _bound(z, of)


def _encoding(token: Column) -> Column:
    *known, last = ENCODINGS
    chosen = F.lit(last)
    for name in reversed(known):
        chosen = F.when(token.rlike(ENCODINGS[name][0]), name).otherwise(chosen)
    return chosen


def _constant(encoding: Column, position: int) -> Column:
    values = [F.lit(x) for name, row in ENCODINGS.items() for x in (name, float(row[position]))]
    return F.element_at(F.create_map(*values), encoding)


def _chi_squared(body: Column, symbols: Column, unevenness: Column) -> Column:
    n = F.length(body)
    used = F.array_distinct(F.filter(F.split(body, ""), lambda c: c != ""))
    squares = F.aggregate(used, F.lit(0.0), lambda s, c: s + F.pow((n - F.length(F.replace(body, c, F.lit("")))).cast("double"), 2.0))
    statistic = squares * symbols / n - n
    mean = symbols - 1 + unevenness * n
    return (mean - statistic) / F.sqrt(2 * (symbols - 1) + 4 * unevenness * n)


def _runs(body: Column, rate: Column) -> Column:
    n = F.length(body) - 1
    changes = F.regexp_count(body, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) - 1
    return (changes - n * rate) / F.sqrt(n * rate * (1 - rate))


def _serial(body: Column) -> Column:
    """Correlation of each symbol's code with the next one, the last followed by the first."""
    n = F.length(body).cast("double")
    codes = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("double"))
    following = F.concat(F.slice(codes, 2, F.size(codes)), F.slice(codes, 1, 1))
    add = lambda s, x: s + x
    total = F.aggregate(codes, F.lit(0.0), add)
    squares = F.aggregate(codes, F.lit(0.0), lambda s, x: s + x * x)
    products = F.aggregate(F.zip_with(codes, following, lambda x, y: x * y), F.lit(0.0), add)
    spread = n * squares - total * total
    r = F.when(spread > 0, F.abs((n * products - total * total) / spread)).otherwise(1.0)
    return (F.atanh(F.lit(CORRELATION)) - F.atanh(F.least(r, F.lit(0.999)))) * F.sqrt(n - 3)


def candidates(text: Column) -> Column:
    """Array of ``(start, end, stratum, bin)``: the class of each candidate and its p-value,
    as whole eighths of -ln p."""
    found = F.concat(*[_only_if(text, pattern, located(text, pattern)) for pattern in CANDIDATES])
    known = F.transform(found, lambda s: F.struct(s["start"], s["end"], s["match"].alias("match"), _encoding(s["match"]).alias("encoding")))

    def judged(s: Column) -> Column:
        body = F.rtrim(s["match"], F.lit("="))
        body = F.when(s["encoding"] == "uuid", F.translate(body, "_-", "")).otherwise(body)
        symbols, rate, unevenness, share = (_constant(s["encoding"], position) for position in range(1, 5))
        tests = (_chi_squared(body, symbols, unevenness), _runs(body, rate * share), _serial(body))
        total = sum((weight * z for weight, z in zip(WEIGHTS, tests)), F.lit(0.0))
        p = normal_tail(total / math.sqrt(sum(weight**2 for weight in WEIGHTS)))
        level = F.least(F.floor(-BINS_PER_E * F.ln(F.greatest(p, F.lit(1e-300)))), F.lit(BINS)).cast("int")
        size = F.floor(2 * F.log2(F.length(body) / F.lit(float(TOKEN_LENGTH)))).cast("string")
        stratum = F.concat_ws(":", s["encoding"], size)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), stratum.alias("stratum"), level.alias("bin"))

    return F.transform(known, judged)


def discovery_bins(docs: DataFrame, text_col: str, false_share: float = FALSE_SHARE) -> dict[str, int]:
    """For each encoding and class of length the least bin that counts as found.

    At most ``BINS`` counts per class; classes are a few per encoding, so what the
    driver reads does not grow with the table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = docs.select(F.inline(candidates(text))).groupBy("stratum", "bin").count()
    counts: dict[str, dict[int, int]] = {}
    for row in tokens.collect():
        counts.setdefault(row["stratum"], {})[row["bin"]] = row["count"]
    least = {}
    for stratum, by_bin in counts.items():
        total, reached = sum(by_bin.values()), 0
        for level in sorted(by_bin, reverse=True):
            reached += by_bin[level]
            if 2.718281828459045 ** (-level / BINS_PER_E) * total <= false_share * reached:
                least[stratum] = level
    return least


def with_spans(docs: DataFrame, text: Column, least: dict[str, int], name: str) -> DataFrame:
    """Add an array of ``(start, kind, end)`` in order; ``kind`` counts in ``KINDS``."""
    fixed = [(assignments(text), 0), (_only_if(text, ACCESS, located(text, ACCESS)), 1), (_only_if(text, HEX, located(text, HEX)), 2)]

    def kind(number: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"))

    docs = docs.withColumn(name, F.array_sort(F.concat(*[F.transform(spans, kind(k)) for spans, k in fixed])))
    if not least:
        return docs
    values = [F.lit(x) for pair in sorted(least.items()) for x in pair]
    threshold = lambda c: F.element_at(F.create_map(*values), c["stratum"])
    found = F.filter(candidates(text), lambda c: c["bin"] >= F.coalesce(threshold(c), F.lit(BINS + 1)))
    return docs.withColumn(name, _outermost(_apart(F.array_sort(F.concat(F.col(name), F.transform(found, kind(3)))))))


def _apart(spans: Column) -> Column:
    """Ordered spans without those of the last kind that overlap one of another kind.

    What begins before such a span overlaps it if it ends behind its start, what begins
    after it if it starts before its end: one pass from either side.
    """
    fixed = lambda s: s["kind"] < 3

    def forth(reach: Column, s: Column) -> tuple[Column, Column]:
        free = (fixed(s) | (reach <= s["start"])).alias("free")
        return F.when(fixed(s), F.greatest(reach, s["end"])).otherwise(reach), F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), free)

    def back(reach: Column, s: Column) -> tuple[Column, Column]:
        free = (s["free"] & (fixed(s) | (reach >= s["end"]))).alias("free")
        return F.when(fixed(s), F.least(reach, s["start"])).otherwise(reach), F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), free)

    ahead = running(spans, F.lit(0), forth)
    found = F.reverse(running(F.reverse(ahead), F.lit((1 << 31) - 1), back))
    return F.transform(F.filter(found, lambda s: s["free"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def _outermost(spans: Column) -> Column:
    """Ordered spans without those of the last kind that lie in another one of it."""
    wide = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def step(reach: Column, s: Column) -> tuple[Column, Column]:
        last, end = s["kind"] == 3, -s["back"]
        found = F.struct(s["start"].alias("start"), s["kind"].alias("kind"), end.alias("end"), (last & (end <= reach)).alias("inner"))
        return F.when(last, F.greatest(reach, end)).otherwise(reach), found

    kept = F.filter(running(wide, F.lit(0), step), lambda s: ~s["inner"])
    return F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def written(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    texts = F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(texts, ",")


def find_secrets(docs: DataFrame, id_col: str, text_col: str, false_share: float = FALSE_SHARE) -> DataFrame:
    """``(id, spans)`` of every row, spans as ``with_spans`` gives them."""
    least = discovery_bins(docs, text_col, false_share)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_spans(rows, F.col("text"), least, "spans").select("id", "spans")


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark in place of its spans, at least one; spans that touch or overlap share one.

    The text is cut into stretches of ``STRETCH`` code points first, as finding a place in a
    text means counting from its start.
    """

    def step(reach: Column, s: Column) -> tuple[Column, Column]:
        kept = F.struct(F.greatest(reach, F.lit(0)).alias("start"), s["start"].alias("end"), (s["start"] > reach).alias("apart"))
        return F.greatest(reach, s["end"]), kept

    def built(stretches: Column) -> Column:
        def part(start: Column, end: Column) -> Column:
            def within(i: Column) -> Column:
                begin = F.greatest(start, i * STRETCH)
                return F.substr(F.get(stretches, i), begin - i * STRETCH + 1, end - begin)

            touched = F.sequence(F.floor(start / STRETCH).cast("int"), F.floor((end - 1) / STRETCH).cast("int"))
            return F.when(start < end, F.array_join(F.transform(touched, within), "")).otherwise(F.lit(""))

        kept = F.filter(running(spans, F.lit(-1), step), lambda s: s["apart"])
        before = F.array_join(F.transform(kept, lambda s: F.concat(part(s["start"], s["end"]), F.lit(mark))), "")
        return F.concat(before, part(F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    return _bound(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % STRETCH), F.lit(0)), built)


def redact(docs: DataFrame, text_col: str, mark: str = "[SECRET]", false_share: float = FALSE_SHARE) -> DataFrame:
    """All documents, with the secrets in their texts replaced; texts without any stay as they are."""
    least = discovery_bins(docs, text_col, false_share)
    whole, spans = free_name(docs.columns, "doc"), free_name(docs.columns, "spans")
    text = F.col(whole)[text_col]
    rows = docs.select(F.struct(*docs.columns).alias(whole))
    rows = with_spans(rows, F.coalesce(text, F.lit("")), least, spans)
    changed = F.when(F.size(spans) > 0, redacted(text, F.col(spans), mark)).otherwise(text)
    columns = [changed.alias(c) if c == text_col else F.col(whole)[c].alias(c) for c in docs.columns]
    return rows.select(*columns)
