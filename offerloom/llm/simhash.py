"""Near duplicates by SimHash fingerprints, compared bit plane by bit plane.

Copies share a fingerprint, so only distinct fingerprints are compared.  Two of
them that differ in at most ``radius`` bits agree on some ``agree`` of
``radius + agree`` bands; each combination of bands is a table of buckets, so
no pair is missed.  ``agree`` follows the count of fingerprints, so that a bucket
holds about ``BLOCK_ROWS`` of them at most; a fuller one is cut into pieces, and
every pair of pieces is a cell of its own.

In a cell the fingerprints are stored by bit: plane b is the b-th bit of 64
candidates in one word.  A query is compared with 64 candidates at once: the
planes where it differs are added up in carry-save counters (ones, twos, fours,
with an overflow that sticks), and a block of 64 is abandoned as soon as all its
counters exceed the radius.  A cell hands on a spanning forest of its links, never
all pairs.

Null texts and texts without words have fingerprint zero and are linked like any
other; repeated rows are copies; an empty table gives an empty result.  Only the
id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from offerloom.llm.common import Groups, forest, free_name, prepare, stored, texts_of
from offerloom.llm.components import components
from offerloom.plans.joins import lookup_join, mark_likely

BLOCK_ROWS = 2048
HASHES_AT_ONCE = 1 << 17
JOBS_AT_ONCE = 1 << 18
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, words: int, seed: int) -> list[int]:
    """XXH64 of each run of ``words`` words, joined by single spaces; A-Z in lower case."""
    found = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    joined = b" ".join(found)
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(joined, seed)] if found else []
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]


def _majorities(texts: list[bytes], words: int, seed: int) -> np.ndarray:
    counts, sizes = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[int] = []
    owners: list[int] = []
    amounts: list[int] = []

    def add() -> None:
        if not held:
            return
        bits = np.unpackbits(np.array(held, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        begins = np.cumsum([0, *amounts[:-1]])
        counts[owners] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
        held.clear(), owners.clear(), amounts.clear()

    for i, text in enumerate(texts):
        hashes = shingle_hashes(text, words, seed)
        sizes[i] = len(hashes)
        if hashes:
            held.extend(hashes)
            owners.append(i)
            amounts.append(len(hashes))
            if len(held) >= HASHES_AT_ONCE:
                add()
    add()
    return np.packbits(counts * 2 > sizes[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 4, seed: int = 42) -> DataFrame:
    """``(id, fingerprint)`` of every row; the 64 bits as a signed long."""
    prepare(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = StructType([StructField("id", rows.schema["id"].dataType), StructField("fingerprint", LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = _majorities(texts_of(batch.column(1)), words, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["id", "fingerprint"])

    return rows.mapInArrow(work, schema)


def band_masks(radius: int, agree: int) -> list[int]:
    """Masks of every ``agree`` of ``radius + agree`` bands of near equal width."""
    cuts = [64 * i // (radius + agree) for i in range(radius + agree + 1)]
    bands = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(bands, agree)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class Counters:
    """Carry-save counters of differing bits, one per bit of each word."""

    def __init__(self, n: int, radius: int):
        self.radius = radius
        self.planes = [np.zeros(n, np.uint64) for _ in range((radius + 1).bit_length())]
        self.over = np.zeros(n, np.uint64)

    def add_two(self, x: np.ndarray, y: np.ndarray) -> None:
        """A full adder takes two differences at once; its carry ripples up."""
        low = self.planes[0]
        half = low ^ x
        carry = (low & x) | (half & y)
        self.planes[0] = half ^ y
        for k in range(1, len(self.planes)):
            plane = self.planes[k]
            self.planes[k] = plane ^ carry
            carry = plane & carry
        self.over |= carry

    def exceeding(self) -> np.ndarray:
        """A bit for each counter above the radius."""
        above, equal = self.over.copy(), ~self.over
        for k in range(len(self.planes) - 1, -1, -1):
            if self.radius >> k & 1:
                equal = equal & self.planes[k]
            else:
                above |= equal & self.planes[k]
                equal = equal & ~self.planes[k]
        return above

    def keep(self, which: np.ndarray) -> None:
        self.planes = [p[which] for p in self.planes]
        self.over = self.over[which]


def close_pairs(prints: np.ndarray, groups: np.ndarray, sides: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs at most ``radius`` bits apart within each group, as two arrays.

    ``groups``: first row of each group; ``sides``: 0, or 0 and 1 where only pairs
    across the two sides are asked for (rows of side 0 come first).
    """
    n = len(prints)
    sizes = np.diff(np.append(groups, n))
    group_of = np.repeat(np.arange(len(groups)), sizes)
    blocks = -(-sizes // 64)
    first_block = np.cumsum(blocks) - blocks
    within = np.arange(n) - groups[group_of]
    block_of = first_block[group_of] + within // 64
    lane_bit = np.uint64(1) << (within % 64).astype(np.uint64)
    total = int(blocks.sum())
    alive = np.zeros(total, np.uint64)
    np.bitwise_or.at(alive, block_of, lane_bit)
    planes = np.zeros((64, total), np.uint64)
    asked = np.zeros((64, n), np.uint64)
    for bit in range(64):
        on = (prints >> np.uint64(bit)) & np.uint64(1) != 0
        np.bitwise_or.at(planes[bit], block_of[on], lane_bit[on])
        asked[bit][on] = ALL
    # Each row against the blocks of its group from its own on, so each pair is met once or twice.
    later = first_block[group_of] + blocks[group_of] - block_of
    left, right = [], []
    begin = 0
    reach = np.cumsum(later)
    while begin < n:
        stop = max(begin + 1, int(np.searchsorted(reach, (reach[begin - 1] if begin else 0) + JOBS_AT_ONCE, "right")))
        amount = later[begin:stop]
        query = np.repeat(np.arange(begin, stop), amount)
        offset = np.arange(len(query)) - np.repeat(np.cumsum(amount) - amount, amount)
        block = block_of[query] + offset
        counters = Counters(len(query), radius)
        for bit in range(0, 64, 2):
            x = planes[bit][block] ^ asked[bit][query]
            y = planes[bit + 1][block] ^ asked[bit + 1][query]
            counters.add_two(x, y)
            if bit % 8 == 6:
                going = np.flatnonzero(~counters.exceeding() & alive[block])
                if len(going) < len(query):
                    query, block = query[going], block[going]
                    counters.keep(going)
                if not len(query):
                    break
        if len(query):
            hits = ~counters.exceeding() & alive[block]
            lanes = np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            job, lane = np.nonzero(lanes)
            a = query[job]
            g = group_of[a]
            b = groups[g] + (block[job] - first_block[g]) * 64 + lane
            # Rows of one side only are compared in the cell of that piece alone.
            wanted = (a < b) & ((sides[a] != sides[b]) | (sides[groups[g] + sizes[g] - 1] == sides[groups[g]]))
            left.append(a[wanted])
            right.append(b[wanted])
        begin = stop
    none = np.zeros(0, np.int64)
    return (np.concatenate(left) if left else none), (np.concatenate(right) if right else none)


def links(prints: DataFrame, radius: int, agree: int | None = None) -> DataFrame:
    """Links ``(a, b)`` that join all distinct ``fingerprint`` values within ``radius`` bits."""
    spark = prepare(prints)
    if agree is None:
        total, agree = prints.count(), 1
        while total >> (64 * agree // (radius + agree)) > BLOCK_ROWS and agree < 4:
            agree += 1
    tables = [
        F.struct(F.lit(i).alias("t"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for i, m in enumerate(band_masks(radius, agree))
    ]
    placed = prints.select("fingerprint", F.inline(F.array(*tables)))
    full = placed.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * BLOCK_ROWS)
    full = stored(full.select("t", "key", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("pieces")), "buckets")
    pieces = F.coalesce("pieces", F.lit(1))
    cut = lookup_join(placed, full, ["t", "key"]).withColumn("pieces", pieces)
    cut = cut.withColumn("own", F.pmod(F.xxhash64("fingerprint"), F.col("pieces")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    cells = cut.withColumn("other", other).select(
        "t",
        "key",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
        "fingerprint",
    )
    keys = ["t", "key", "low", "high"]
    cells = cells.repartition(*keys).sortWithinPartitions(*keys, "side")
    whole = Groups(keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole(batches):
            prints = table.column("fingerprint").to_numpy().view(np.uint64)
            sides = table.column("side").to_numpy()
            a, b = close_pairs(prints, starts, sides, radius)
            parent = np.arange(len(prints))
            forest(parent, a, b)
            linked = np.flatnonzero(parent != np.arange(len(prints)))
            ends = [prints.view(np.int64)[linked], prints.view(np.int64)[parent[linked]]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

    return cells.mapInArrow(work, "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str, text_col: str, words: int = 4, radius: int = 4, seed: int = 42
) -> DataFrame:
    """``(id, fingerprint, component_id)``: the smallest id that links reach, itself included."""
    rows = stored(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    distinct = stored(rows.groupBy("fingerprint").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(distinct.select("fingerprint"), radius)).withColumnRenamed("node", "fingerprint")
    named = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("fingerprint", "root").join(least, "root").select("fingerprint", "component_id")
    return rows.join(named, "fingerprint").select("id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, id_col: str, text_col: str, words: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """One row of each group: the one with the smallest id, then the smallest digest of its text.

    Rows are told apart by id and text, so rows that share an id with another text are compared and
    kept on their own.  Of rows with the same id and text one stays, any of them if other columns differ.  Rows
    without an id cannot be named by a group: they all stay.

    Whole texts are not shuffled but for rows that may have to go, which a bitmap of a fixed size marks.
    """
    names = [free_name(docs.columns, n) for n in ("_row", "_maybe")]
    named_docs = docs.filter(F.col(id_col).isNotNull())
    keyed = named_docs.withColumn(names[0], F.struct(id_col, F.md5(F.coalesce(text_col, F.lit("")))))
    rows = stored(fingerprints(keyed, names[0], text_col, words, seed), "fingerprints")
    roots = components(links(rows.select("fingerprint").distinct(), radius)).withColumnRenamed("node", "fingerprint")
    # A fingerprint many rows share is one row here, so no key is frequent.
    distinct = rows.groupBy("fingerprint").agg(F.min("id").alias("least"))
    named = distinct.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    first = named.groupBy("root").agg(F.min("least").alias("id"))
    counted = rows.groupBy("id").agg(F.count("*").alias("n"))
    kept = stored(counted.join(first.select("id", F.lit(True).alias("stays")), "id", "left"), "decided")
    spot = F.xxhash64("id")
    going = kept.filter(F.col("stays").isNull() | (F.col("n") > 1))
    marked = mark_likely(keyed, going.select(spot.alias("spot")), F.xxhash64(names[0]), names[1])
    sure = marked.filter(~F.col(names[1])).select(*docs.columns)
    doubtful = marked.filter(names[1]).drop(names[1])
    staying = doubtful.join(kept.filter("stays").select(F.col("id").alias(names[0])), names[0], "left_semi")
    kept_rows = sure.unionByName(staying.dropDuplicates([names[0]]).select(*docs.columns))
    return kept_rows.unionByName(docs.filter(F.col(id_col).isNull()))


def hexadecimal(fingerprint: str):
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")
