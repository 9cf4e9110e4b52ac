"""Phrase collocations by the stripes pattern.

A stripe belongs to a language and a prefix of k words: a counter of the words that follow it.
Tasks build stripes for some two million words at a time and Spark merges those of a prefix
elementwise.  The merged stripes of k = 0, 1, 2, 3 are one structure that gives all: a phrase's frequency, that is
the total of its own prefix one level on, is its entry in the stripe one word shorter; the stripe's entries are
its extensions; the largest of them is what subsumption asks for.

There is one pass for each k.  A phrase is frequent only if its first and its last k
words are, so pass k counts extensions only where both may be frequent: a bitmap of
``FILTER_BITS`` bits, of a fixed size, says so.  What it lets through in error is counted exactly and falls
to ``least`` later.  Counts are exact.

A prefix with over 1 / ``SHARES`` of all words, of which there are at most ``SHARES``, has its stripe
cut into segments by a hash of the next word, in proportion to its weight, so no merge holds a large
share of the words.  The stripe of the empty prefix has ``4 * spark.sql.shuffle.partitions``
segments.

Only one more word has to be looked at for subsumption: if a phrase lies in a frequent one two words
longer, it lies in one between them, which occurs at least as often as the longer one.

A null text counts as empty and a null language as ``und``; the words of a text are read once from
end to end whatever its length.  Repeated rows count as often as they occur.  Equal scores go by frequency,
then by phrase.  An empty table, or one without a frequent phrase, gives an empty one.  Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerloom.llm.common import prepare, stored, texts_of
from offerloom.plans.joins import lookup_join

LONGEST, LEAST, SCALE, COVERED = 4, 30, 2_000_000, 80
ROUND_BYTES = 16 << 20
FILTER_BITS = 1 << 27
SHARES = 20_000
MOST_SEGMENTS = 1024
SALTS = 64
UNKNOWN = "und"

_PIECE_END = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
ENDS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\n" * 10)
_FACTOR, _SPAN = np.uint64(0x9E3779B97F4A7C15), 1 << 62

STRIPES = "lang string, prefix string, segment int, nexts string, counts array<int>"
Round = tuple[pa.Array, list[str], np.ndarray, np.ndarray, np.ndarray]


class Words:
    """Texts of about a round, and their words as numbers."""

    def __init__(self):
        self.langs: dict[str, int] = {}
        self.texts: list[bytes] = []
        self.owners: list[int] = []
        self.size = 0

    def add(self, text: bytes, lang: str) -> None:
        self.texts.append(text)
        self.owners.append(self.langs.setdefault(lang, len(self.langs)))
        self.size += len(text) + 1

    def take(self) -> Round:
        sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts)) + 1
        raw = np.frombuffer(b"\n".join(self.texts).lower().translate(ENDS), np.uint8)
        inside = np.zeros(len(raw) + 2, bool)
        inside[1:-1] = (raw != 0x20) & (raw != 0x09) & (raw != 0x0A)
        border = np.flatnonzero(inside[1:] != inside[:-1])
        start, size = border[::2], border[1::2] - border[::2]
        n = len(start)
        offsets = np.append(0, np.cumsum(size)).astype(np.int32)
        letters = np.ascontiguousarray(raw[inside[1:-1]])
        parts = [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
        listed = pa.Array.from_buffers(pa.binary(), n, parts).dictionary_encode()
        # A line end before a word begins a piece.
        breaks = np.append(np.searchsorted(start, np.flatnonzero(raw == 0x0A)), n)
        breaks = np.append(0, breaks[np.append(breaks[:1] > 0, breaks[1:] > breaks[:-1])])
        left = np.repeat(breaks[1:], np.diff(breaks)) - np.arange(n)
        firsts = np.searchsorted(start, np.cumsum(sizes) - sizes)
        lang = np.repeat(np.array(self.owners, np.int32), np.diff(np.append(firsts, n)))
        found = (listed.dictionary, list(self.langs), listed.indices.to_numpy(), left.astype(np.int32), lang)
        self.__init__()
        return found


def chunks(text: bytes, limit: int) -> Iterator[bytes]:
    """A text, cut behind ends of pieces if it is much longer than a round."""
    begin = 0
    while len(text) - begin > 2 * limit:
        end = _PIECE_END.search(text, begin + limit)
        if not end:
            break
        yield text[begin : end.end()]
        begin = end.end()
    yield text[begin:]


class Bits:
    """A fixed-size bitmap of phrase hashes."""

    def __init__(self, data: np.ndarray):
        self.data = data

    def has(self, hashes: np.ndarray) -> np.ndarray:
        spot = spots(hashes)
        return (self.data[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)


def spots(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ hashes >> np.uint64(29)) % np.uint64(FILTER_BITS)).astype(np.int64)


def hashed(names: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in names), np.uint64, len(names))


def phrase_hashes(langs: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from those of their language and words."""
    return reduce(lambda a, b: a * _FACTOR + b, words, langs)


def _sorted_runs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    code = np.sort(code)
    heads = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
    return code[heads], np.diff(np.append(heads, len(code)))


def counted_phrases(langs: int, words: int, lang: np.ndarray, columns: list[np.ndarray]):
    """Distinct phrases as columns (language, words) in order, and how often each occurs."""
    code, span, tables = lang.astype(np.int64), langs, []
    for column in columns:
        if span * words >= _SPAN:  # number what was found so far anew, in the same order
            known, code = np.unique(code, return_inverse=True)
            tables.append(known)
            span = len(known)
        else:
            tables.append(None)
        code, span = code * words + column, span * words
    code, times = _sorted_runs(code)
    found = []
    for known in reversed(tables):
        found.append(code % words)
        code = code // words
        if known is not None:
            code = known[code]
    return [code, *reversed(found)], times


class Cuts:
    """Into how many segments the stripe of a prefix is cut, by the hash of the prefix."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray, other: int = 1):
        order = np.argsort(hashes)
        self.hashes, self.numbers, self.other = hashes[order], numbers[order], other

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        found = np.full(len(hashes), self.other, np.uint64)
        if len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            same = self.hashes[place] == hashes
            found[same] = self.numbers[place[same]]
        return found


def stripes_of(found: Round, k: int, bits: Bits | None, cuts: Cuts) -> pa.RecordBatch:
    """The stripes of the prefixes of k words in a round of words."""
    words, langs, ids, left, lang = found
    hashes, lang_hashes = hashed(words.to_pylist()), hashed([x.encode() for x in langs])
    at = np.flatnonzero(left > k)
    if k:
        heads = phrase_hashes(lang_hashes[lang[at]], [hashes[ids[at + t]] for t in range(k)])
        at = at[bits.has(heads)]
        tails = phrase_hashes(lang_hashes[lang[at]], [hashes[ids[at + t]] for t in range(1, k + 1)])
        at = at[bits.has(tails)]
    columns, n = counted_phrases(len(langs), max(1, len(words)), lang[at], [ids[at + t] for t in range(k + 1)])
    following = columns.pop()

    new = np.append(True, reduce(np.logical_or, (c[1:] != c[:-1] for c in columns)))[: len(n)]
    stripe = np.cumsum(new) - 1
    heads = [c[new] for c in columns]
    cut = cuts(phrase_hashes(lang_hashes[heads[0]], [hashes[c] for c in heads[1:]]))
    if (cut > 1).any():
        segment = (hashes[following] % cut[stripe]).astype(np.int32)
        order = np.lexsort((segment, stripe))
        stripe, segment, following, n = stripe[order], segment[order], following[order], n[order]
    else:
        segment = np.zeros(len(n), np.int32)

    begin = np.append(True, (stripe[1:] != stripe[:-1]) | (segment[1:] != segment[:-1]))[: len(stripe)]
    ends = pa.array(np.append(np.flatnonzero(begin), len(begin)).astype(np.int32))
    owners = stripe[begin]
    text = words.cast(pa.string())
    prefix = [text.take(pa.array(c[owners])) for c in heads[1:]]
    arrays = [
        pa.array(langs, pa.string()).take(pa.array(heads[0][owners])),
        pc.binary_join_element_wise(*prefix, " ") if prefix else pa.array([""] * len(owners), pa.string()),
        pa.array(segment[begin]),
        # One string per stripe is half as long in a shuffle as an array of them.
        pc.binary_join(pa.ListArray.from_arrays(ends, text.take(pa.array(following))), " "),
        pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32))),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["lang", "prefix", "segment", "nexts", "counts"])


def merged(partial: DataFrame, least: int) -> DataFrame:
    """Stripes of one key merged elementwise: entries of at least ``least``, and the total of all.

    One shuffle, by the stripe's key; the entries are added up where the stripe is.
    """
    keys = ["lang", "prefix", "segment"]
    dealt = partial.repartition(*keys).select(*keys, F.inline(F.arrays_zip(F.split("nexts", " ").alias("next"), "counts")))
    entries = dealt.groupBy(*keys, "next").agg(F.sum("counts").alias("n"))
    kept = F.when(F.col("n") >= least, F.struct("next", "n"))
    return entries.groupBy(*keys).agg(F.sum("n").alias("total"), F.collect_list(kept).alias("entries"))


def hashes_of(langs: list[str], phrases: list[str]) -> np.ndarray:
    """Hashes of phrases of one length."""
    split = zip(*(p.encode().split(b" ") for p in phrases), strict=True)
    return phrase_hashes(hashed([x.encode() for x in langs]), [hashed(list(column)) for column in split])


def _bits(phrases: DataFrame) -> Bits:
    """The bitmap of the phrases of a table: at most ``FILTER_BITS`` bits come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = hashes_of(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(spots(found))], ["spot"])

    spot = phrases.select("lang", "phrase").mapInArrow(run, "spot long").select((F.col("spot") + 1).alias("spot"))
    bucket, bit = F.bitmap_bucket_number("spot"), F.bitmap_bit_position("spot")
    rows = spot.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits")).collect()
    data = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, part in rows:
        data[(bucket - 1) * len(part) : bucket * len(part)] = np.frombuffer(part, np.uint8)
    return Bits(data)


def _count(
    docs: DataFrame, k: int, frequent: DataFrame | None, least: int, words: int, shares: int, round_bytes: int
) -> DataFrame:
    """Merged stripes of prefixes of k words."""
    spark = docs.sparkSession
    none = np.zeros(0, np.uint64)
    shared = spark.sparkContext.broadcast((None, Cuts(none, none, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    if k:
        heavy = frequent.filter(F.col("n") * shares >= words).select("lang", "phrase", "n").collect()
        numbers = np.array([min(MOST_SEGMENTS, 1 + r["n"] * shares // words) for r in heavy], np.uint64)
        hashes = hashes_of([r["lang"] for r in heavy], [r["phrase"] for r in heavy])
        shared = spark.sparkContext.broadcast((_bits(frequent), Cuts(hashes, numbers)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, cuts = shared.value
        held = Words()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                for part in chunks(text, round_bytes):
                    held.add(part, lang)
                    if held.size >= round_bytes:
                        yield stripes_of(held.take(), k, bits, cuts)
        if held.size:
            yield stripes_of(held.take(), k, bits, cuts)

    return stored(merged(docs.mapInArrow(run, STRIPES), least), f"stripes{k}")


def stripes(
    docs: DataFrame,
    text_col: str,
    lang_col: str,
    least: int = LEAST,
    longest: int = LONGEST,
    shares: int = SHARES,
    round_bytes: int = ROUND_BYTES,
) -> list[DataFrame]:
    """Merged stripes of prefixes of 0, 1, ... ``longest`` - 1 words, those of the empty one first."""
    prepare(docs)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    rows = docs.select(lang.alias("lang"), F.col(text_col).cast("binary").alias("text")).filter("length(text) > 0")
    found: list[DataFrame] = []
    words = 0
    for k in range(longest):
        frequent = extensions(found[-1], k - 1) if k else None
        found.append(_count(rows, k, frequent, least, words, shares, round_bytes))
        words = words or found[0].agg(F.sum("total")).first()[0] or 1
    return found


def extensions(table: DataFrame, k: int) -> DataFrame:
    """The frequent phrases of k + 1 words: ``lang, prefix, rest, phrase, n``."""
    pairs = table.select("lang", "prefix", F.inline("entries"))
    phrase = F.concat_ws(" ", "prefix", "next") if k else F.col("next")
    rows = pairs.select("lang", "prefix", phrase.alias("phrase"), "n")
    return rows.withColumn("rest", F.expr("substring(phrase, locate(' ', phrase) + 1)"))


def candidates(tables: list[DataFrame]) -> DataFrame:
    """Frequent phrases of two and more words that no longer one covers, with the frequencies
    of all their first words (``lefts``) and last words (``rights``): ``lang, phrase, a, lefts, rights``."""
    listed = [extensions(t, k) for k, t in enumerate(tables)]
    one = F.array("n")
    known = listed[0].select("lang", "phrase", one.alias("lefts"), one.alias("rights"))
    out = []
    for k in range(1, len(tables)):
        rows = listed[k].select("lang", "phrase", "prefix", "rest", F.col("n").alias("a"))
        lefts = known.select("lang", F.col("phrase").alias("prefix"), "lefts")
        rights = known.select("lang", F.col("phrase").alias("rest"), "rights")
        rows = lookup_join(lookup_join(rows, lefts, ["lang", "prefix"], "inner"), rights, ["lang", "rest"], "inner")
        rows = rows.withColumns({"lefts": F.concat("lefts", F.array("a")), "rights": F.concat("rights", F.array("a"))})
        known = stored(rows.select("lang", "phrase", "a", "lefts", "rights"), f"phrases{k}")
        out.append(known if k + 1 == len(tables) else _uncovered(known, tables[k + 1], listed[k + 1]))
    return reduce(DataFrame.unionByName, out)


def _uncovered(known: DataFrame, table: DataFrame, longer: DataFrame) -> DataFrame:
    right = table.select("lang", F.col("prefix").alias("phrase"), F.array_max("entries.n").alias("n"))
    left = longer.select("lang", F.col("rest").alias("phrase"), "n")
    widest = right.filter("n is not null").unionByName(left).groupBy("lang", "phrase").agg(F.max("n").alias("n"))
    joined = lookup_join(known, widest, ["lang", "phrase"], "left")
    covered = F.col("n").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * COVERED
    return joined.filter(~F.coalesce(covered, F.lit(False))).drop("n")


def scored(rows: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Adds ``l``, ``r`` and ``score`` of the cut that scores lowest; products are exact."""

    def cut(words: int, k: int):
        left, right = F.element_at("lefts", k), F.element_at("rights", words - k)
        both = left.cast("decimal(20,0)") + right.cast("decimal(20,0)")
        share = F.call_function("div", F.col("a").cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(8,0)"), both)
        return F.struct(share.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))

    size = F.size("lefts")
    lowest = F.coalesce(
        *[F.when(size == m, F.array_min(F.array(*[cut(m, k) for k in range(1, m)]))) for m in range(2, longest + 1)]
    )
    return rows.withColumn("cut", lowest).select("*", "cut.l", "cut.r", "cut.score").drop("cut")


def collocations(
    docs: DataFrame,
    text_col: str,
    lang_col: str,
    first: int = 2000,
    least: int = LEAST,
    longest: int = LONGEST,
    shares: int = SHARES,
    round_bytes: int = ROUND_BYTES,
) -> DataFrame:
    """The ``first`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    tables = stripes(docs, text_col, lang_col, least, longest, shares, round_bytes)
    rows = scored(candidates(tables), longest).select("lang", "phrase", "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    spread = F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))
    rows = rows.withColumn("rank", spread).filter(F.col("rank") <= first)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    rows = rows.withColumn("rank", place.cast("long")).filter(F.col("rank") <= first)
    # A row per language, which the result has too.
    words = tables[0].groupBy("lang").agg(F.sum("total").alias("n"))
    found = lookup_join(rows, words, ["lang"], "inner")
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
