"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if some string of 100 bytes that covers it also starts earlier.  The
strings are told apart as a suffix array does it by doubling: Spark sorts pairs of
ranks of ever longer prefixes, and what is unique after a round is dropped.

* 32 bytes.  Each string of 100 bytes is led by one of its 69 strings of 32 bytes,
  the one with the smallest hash, leftmost of equals; equal strings are led alike.
  Neighbours mostly share their leader, so a run of starts with one leader is one
  row: the rank of the leader (its hash) and that of all the bytes the run covers.
  A range sort by this pair puts equal leaders side by side.  A leader met once
  drops out with its run; runs that equal an earlier one as a whole are removed.
* 64 bytes.  Runs that share their leader only with other runs go on, each as up to
  two parts: starts whose string reaches 32 bytes behind the leader, and the
  others, which reach 32 bytes before it.  The range sort is by the pair of ranks
  (leader, next 32 bytes) or (32 bytes before, leader).
* 100 bytes, past the threshold.  Every start left is a row, ranked by the pair of
  its first and second 50 bytes; in each rank all but the first start are repeats.

Ranks are hashes of 64 bits, compared in pairs.  Rows that are equal within a batch
are settled before the shuffle, so that a passage in a third of all documents is
one row per batch; range sorts by the full key split whatever is left of it.
Groups of the second round are settled where they lie; those that touch the edge of
a partition or exceed ``GROUP_ROWS`` rows go through the sort of the third round.

Null texts are empty; texts below 100 bytes keep all their bytes.  Rows that repeat
an id with the same text are one document and share its result; with other texts
they are documents of their own, in the order of their texts' hashes; a null id
comes last.  Other columns are not read, so they may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, ByteType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from offerloom.llm.common import Stored, numbered, prepare, slices, texts_of

LENGTH = 100
GRAM = 32
HALF = LENGTH // 2
LEADERS = LENGTH - GRAM + 1
SLICE_BYTES = 2 << 20
GROUP_ROWS = 50_000
_U = np.uint64
_INDEX = _U((1 << 28) - 1)
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
_ODD = [_U(int(x) | 3) for x in _RANDOM.integers(1 << 62, 1 << 63, 8)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(29))
    x *= _ODD[6]
    x ^= x >> _U(32)
    return x


def gram_ranks(data: np.ndarray) -> np.ndarray:
    """The rank of the 32 bytes from each position: doubled from 1, 2, 4, 8 and 16 bytes."""
    ranks, length, step = _BYTE[data], 1, 0
    while length < GRAM:
        ranks = ranks[:-length] * _ODD[step] + ranks[length:]
        length, step = 2 * length, step + 1
    return _mix(ranks)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of ``width`` keys from each position."""
    length = 1
    while 2 * length <= width:
        keys = np.minimum(keys[:-length], keys[length:])
        length *= 2
    rest = width - length
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys


def _leaders(ranks: np.ndarray) -> np.ndarray:
    """The position of the leader of the string from each position."""
    places = np.arange(len(ranks), dtype=_U)
    return (_least((ranks & ~_INDEX) | places, LEADERS) & _INDEX).astype(np.int64)


def leader_runs(texts: list[bytes]):
    """Runs of starts with one leader: text, first start, starts, ranks of leader and of the run."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        return None
    ranks = gram_ranks(data)
    leader = _leaders(ranks)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(leader)]
    inside = np.flatnonzero(np.arange(LENGTH, LENGTH + len(leader)) <= ends[text])
    if not len(inside):
        return None
    new = np.ones(len(inside), bool)
    new[1:] = (leader[inside[1:]] != leader[inside[:-1]]) | (text[inside[1:]] != text[inside[:-1]])
    begins = np.flatnonzero(new)
    starts = np.diff(np.append(begins, len(inside)))
    first = inside[begins]
    at = leader[first]
    last = first + starts - 1 + LENGTH - GRAM
    whole = _mix((at - first).astype(_U) * _ODD[5] + starts.astype(_U))
    for k in range(-(-(LENGTH + LEADERS) // GRAM)):
        whole = _mix(whole * _ODD[4] + ranks[np.minimum(first + k * GRAM, last)])
    owner = text[first]
    return owner, first - (ends - sizes)[owner], starts, ranks[at], whole


def packed(first: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A run of starts in one number."""
    return (first.astype(np.int64) << 8) | starts


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 1, before the sort: runs, and those of them that repeat an earlier one of the batch."""
    for batch in batches:
        docs = batch.column(0).to_numpy()
        texts = texts_of(batch.column(1))
        parts = []
        for a, b in slices(texts, SLICE_BYTES):
            found = leader_runs(texts[a:b])
            if found is not None:
                owner, first, starts, lead, whole = found
                parts.append((lead.view(np.int64), whole.view(np.int64), docs[a + owner], packed(first, starts)))
        if not parts:
            continue
        lead, whole, doc, run = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((run, doc, whole, lead))
        lead, whole, doc, run = lead[order], whole[order], doc[order], run[order]
        repeat = np.zeros(len(order), bool)
        repeat[1:] = (lead[1:] == lead[:-1]) & (whole[1:] == whole[:-1])
        first = np.maximum.accumulate(np.where(repeat, 0, np.arange(len(order))))
        keep = ~repeat | (doc != doc[first]) | (run != run[first])  # a repeated row is no repeat of itself
        columns = [x[keep] for x in (lead, whole, doc, run, repeat.astype(np.int8))]
        yield _batch(columns, ["lead", "whole", "doc", "run", "repeat"])


def _settle_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 1, sorted: runs that equal an earlier one (open 0), runs that share only their
    leader (open 1); those at the edge of a partition count as such, as its neighbours
    are not seen here."""
    held, edge = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        lead, whole, doc, run = (batch.column(k).to_numpy() for k in ("lead", "whole", "doc", "run"))
        shared = False
        if held is not None:
            shared = held[4]
            lead, whole, doc, run = (np.append(h, x) for h, x in zip(held[:4], (lead, whole, doc, run), strict=True))
        else:
            edge = lead[0]
        new_lead = np.append(not shared, lead[1:] != lead[:-1])
        new = np.append(True, (lead[1:] != lead[:-1]) | (whole[1:] != whole[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        repeat = ~new & ((doc != doc[first]) | (run != run[first]))
        heads = np.flatnonzero(new)
        others = ~new_lead[heads]
        others[:-1] |= ~new_lead[heads[1:]]
        others |= lead[heads] == edge
        done, last = heads[:-1], heads[-1]
        open_ = done[others[:-1]]
        held = (lead[last], whole[last], doc[last], run[last], bool(~new_lead[last]))
        chosen = np.concatenate([np.flatnonzero(repeat), open_])
        marks = np.repeat([0, 1], [int(repeat.sum()), len(open_)]).astype(np.int8)
        yield _batch([doc[chosen], run[chosen], marks], ["doc", "run", "open"])
    if held is not None:
        yield _batch([np.array([held[2]]), np.array([held[3]]), np.ones(1, np.int8)], ["doc", "run", "open"])


_PARTS = StructType(
    [
        StructField("k1", LongType()),
        StructField("k2", LongType()),
        StructField("doc", LongType()),
        StructField("first", IntegerType()),
        StructField("starts", ShortType()),
        StructField("bytes", BinaryType()),
    ]
)


def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 2, before the sort: open runs as parts with pairs of ranks, and their bytes."""
    names = ["k1", "k2", "doc", "first", "starts", "bytes"]
    for batch in batches:
        docs = batch.column(0).to_numpy()
        texts, runs = texts_of(batch.column(1)), batch.column(2)
        sizes = np.diff(runs.offsets.to_numpy())
        flat = runs.flatten().to_numpy()
        for a in range(0, len(flat), 20_000):
            owner = np.repeat(np.arange(len(texts)), sizes)[a : a + 20_000]
            run = flat[a : a + 20_000]
            first, starts = run >> 8, run & 255
            regions = [
                texts[o][f : f + n + LENGTH - 1]
                for o, f, n in zip(owner.tolist(), first.tolist(), starts.tolist(), strict=True)
            ]
            ends = np.cumsum(starts + LENGTH - 1)
            begin = ends - (starts + LENGTH - 1)
            data = b"".join(regions)
            ranks = gram_ranks(np.frombuffer(data, np.uint8))
            at = _leaders(ranks)[begin] - begin
            behind = np.maximum(0, at - (LENGTH - 2 * GRAM))
            rows = []
            for low, high, left, mark in (
                (behind, starts, at, 0),  # starts that reach 64 bytes from the leader on
                (np.zeros_like(behind), np.minimum(behind, starts), at - GRAM, 1),
            ):
                some = np.flatnonzero(high > low)
                k1 = ranks[(begin + left)[some]] ^ _U(mark)
                k2 = ranks[(begin + left)[some] + GRAM]
                content = [
                    data[x:y]
                    for x, y in zip(
                        (begin + low)[some].tolist(), (begin + high)[some] + LENGTH - 1, strict=True
                    )
                ]
                rows.append((k1, k2, docs[owner[some]], (first + low)[some], (high - low)[some], content))
            k1, k2, doc, low, count = (np.concatenate([r[i] for r in rows]) for i in range(5))
            yield _batch(
                [
                    k1.view(np.int64),
                    k2.view(np.int64),
                    doc,
                    low.astype(np.int32),
                    count.astype(np.int16),
                    pa.array([c for r in rows for c in r[5]], pa.binary()),
                ],
                names,
            )


_STARTS = StructType([StructField(n, LongType()) for n in ("x", "y", "doc", "run")] + [StructField("repeat", ByteType())])


def _start_ranks(table: pa.Table):
    """Every start of the parts: row of its part, ranks of its two halves, document, position."""
    column = table.column("bytes").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    texts = column.to_pylist()
    begin = np.cumsum([0, *map(len, texts[:-1])])
    ranks = gram_ranks(np.frombuffer(b"".join(texts), np.uint8))
    counts = table.column("starts").to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begin[owner] + within
    overlap = HALF - GRAM
    x = _mix(ranks[at] * _ODD[0] + ranks[at + overlap])
    y = _mix(ranks[at + HALF] * _ODD[0] + ranks[at + HALF + overlap])
    doc = table.column("doc").to_numpy()[owner]
    return owner, x, y, doc, table.column("first").to_numpy().astype(np.int64)[owner] + within


def _repeats(group: np.ndarray, x, y, doc, place):
    """Order of the starts, and which of them repeat one before them."""
    order = np.lexsort((place, doc, y, x, group))
    group, x, y, doc, place = group[order], x[order], y[order], doc[order], place[order]
    same = np.zeros(len(order), bool)
    same[1:] = (group[1:] == group[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    itself = same & (doc == doc[first]) & (place == place[first])
    return order, same & ~itself, itself


def _as_runs(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single starts as runs of up to 128."""
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
    index = np.arange(len(doc))
    since = index - np.maximum.accumulate(np.where(new, index, 0))
    new |= since % 128 == 0
    begins = np.flatnonzero(new)
    return doc[begins], packed(place[begins], np.diff(np.append(begins, len(doc))))


def _settle_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 2, sorted: repeats within groups of equal rank pairs that lie here as a whole
    (repeat 1), and the starts of other groups, to be sorted by their own ranks (repeat 0)."""
    names = _STARTS.names

    def rows(table: pa.Table, alone: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """``alone``: the group of each row, or None if the group goes on elsewhere."""
        for a in range(0, table.num_rows, GROUP_ROWS) if alone is None else [0]:
            part = table.slice(a, GROUP_ROWS) if alone is None else table
            owner, x, y, doc, place = _start_ranks(part)
            group = np.zeros(len(owner), np.int64) if alone is None else alone[owner]
            order, repeat, itself = _repeats(group, x, y, doc, place)
            docs, runs = _as_runs(doc[order][repeat], place[order][repeat])
            zero = np.zeros(len(docs), np.int64)
            yield _batch([zero, zero, docs, runs, np.ones(len(docs), np.int8)], names)
            if alone is None:
                rest = order[~repeat & ~itself]
                columns = [x[rest].view(np.int64), y[rest].view(np.int64), doc[rest], packed(place[rest], 1)]
                yield _batch([*columns, np.zeros(len(rest), np.int8)], names)

    held: list[pa.RecordBatch] = []
    amount, opening = 0, True  # opening: the first group may go on in the partition before
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        amount += batch.num_rows
        table = pa.Table.from_batches(held)
        k1, k2 = table.column("k1").to_numpy(), table.column("k2").to_numpy()
        new = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
        last = int(new[-1])
        if opening and len(new) > 1:
            yield from rows(table.slice(0, new[1]), None)
            opening = False
            new = new[1:]
        if not opening and last > new[0]:
            begin = int(new[0])
            group = np.repeat(np.arange(len(new) - 1), np.diff(new))
            several = np.flatnonzero(np.bincount(group)[group] > 1)  # a group of one part repeats nothing
            if len(several):
                yield from rows(table.slice(begin, last - begin).take(pa.array(several)), group[several])
        rest = table.slice(last)
        if rest.num_rows > GROUP_ROWS:
            yield from rows(rest, None)
            held, amount, opening = [], 0, True
        else:
            held, amount = rest.combine_chunks().to_batches(), rest.num_rows
    if held:
        yield from rows(pa.Table.from_batches(held), None)


def _settle_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Round 3, sorted: all but the first start of each rank pair."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in ("x", "y", "doc", "run")]
        if held is not None:
            columns = [np.append(h, c) for h, c in zip(held, columns, strict=True)]
        x, y, doc, run = columns
        same = np.append(False, (x[1:] == x[:-1]) & (y[1:] == y[:-1]))
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(x))))
        repeat = same & ((doc != doc[first]) | (run != run[first]))
        held = [c[first[-1]] for c in columns]
        yield _batch([doc[repeat], run[repeat]], ["doc", "run"])


def _with_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, id, text)``: documents under a long key in the order of their ids."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    total, known, distinct = rows.agg(F.count("*"), F.count("id"), F.count_distinct("id")).first()
    if dict(rows.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint") and total == known == distinct:
        return rows.withColumn("doc", F.col("id").cast("long"))
    hashed = rows.withColumn("_hash", F.xxhash64("text"))
    keys = numbered(hashed.select("id", "_hash").distinct(), [F.col("id").asc_nulls_last(), F.col("_hash")], "doc")
    keys = keys.select(F.col("id").alias("_id"), F.col("_hash").alias("_key_hash"), "doc")
    match = F.col("id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_key_hash"))
    return hashed.join(keys, match).select("doc", "id", "text")


def repeated_runs(rows: DataFrame) -> DataFrame:
    """``(doc, run)``: starts, packed as runs, of strings that also start earlier; rows ``(doc, text)``."""
    first = Stored(rows.select("doc", "text").mapInArrow(_run_rows, "lead long, whole long, doc long, run long, repeat byte"), "runs")
    order = ["lead", "whole", "doc", "run"]
    ranked = first.df.filter("repeat = 0").repartitionByRange("lead", "whole").sortWithinPartitions(*order)
    settled = Stored(ranked.mapInArrow(_settle_runs, "doc long, run long, open byte"), "settled")
    found = [Stored(first.df.filter("repeat = 1").select("doc", "run"), "repeats").df]
    found.append(settled.df.filter("open = 0").select("doc", "run"))
    first.empty()

    open_runs = settled.df.filter("open = 1").groupBy("doc").agg(F.collect_list("run").alias("runs"))
    joined = rows.select("doc", "text").join(open_runs, "doc").dropDuplicates(["doc"])  # of repeated rows one
    parts = Stored(joined.select("doc", "text", "runs").mapInArrow(_part_rows, _PARTS), "parts")
    order = ["k1", "k2", "doc", "first"]
    ranked = parts.df.repartitionByRange(*order).sortWithinPartitions(*order)
    starts = Stored(ranked.mapInArrow(_settle_parts, _STARTS), "starts")
    parts.empty()
    found.append(starts.df.filter("repeat = 1").select("doc", "run"))

    order = ["x", "y", "doc", "run"]
    ranked = starts.df.filter("repeat = 0").repartition("x", "y").sortWithinPartitions(*order)
    found.append(ranked.mapInArrow(_settle_starts, "doc long, run long"))
    result = found[0]
    for more in found[1:]:
        result = result.union(more)
    return result


def merged_spans(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal removed stretches of one document."""
    if not len(runs):
        return runs, runs
    runs = np.sort(runs)
    begin, end = runs >> 8, (runs >> 8) + (runs & 255) + LENGTH - 1
    reach = np.maximum.accumulate(end)
    new = np.append(True, begin[1:] > reach[:-1])
    heads = np.flatnonzero(new)
    return begin[heads], reach[np.append(heads[1:], len(runs)) - 1]


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = batch.column(2)
        counts: list[tuple] = []
        for text, own in zip(texts_of(batch.column(1)), runs, strict=True):
            begin, end = merged_spans(own.values.to_numpy() if own.is_valid else np.zeros(0, np.int64))
            digest, at = hashlib.sha256(), 0
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            counts.append((len(text), int((end - begin).sum()), len(begin), digest.hexdigest()))
        columns = list(zip(*counts, strict=True)) or [[]] * 4
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row."""
    prepare(docs)
    rows = _with_keys(docs, id_col, text_col)
    runs = Stored(repeated_runs(rows).groupBy("doc").agg(F.collect_list("run").alias("runs")), "repeated").df
    fields = [StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    schema = StructType([StructField("id", rows.schema["id"].dataType), *fields, StructField("kept_sha256", StringType())])
    joined = rows.join(runs, "doc", "left").select("id", "text", "runs")
    return joined.mapInArrow(_results, schema)
