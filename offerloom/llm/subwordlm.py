"""Language model scores by subword lattice likelihood, beside a word model with add-one smoothing.

The pieces of a fixed public vocabulary weigh all segmentations of a text; its score is the log
probability with the segmentations summed out.  No piece goes over a space, so a text's
lattice is that of its words one after another, each with a space before it, and an end; the
forward recursion runs once per distinct word of a task, in log space, over whole words of any length.

The vocabulary's own scores, minus a piece's rank, weigh the first round: a piece of rank k
weighs 1 / (k + 2.7), single bytes come last.  Each of ``rounds`` rounds then takes the expected use of
every piece over all distinct words of all training rows, counted by Spark, and gives back at most
one row per piece.  The probability of the end is its share among pieces and ends.

Words are counted over all rows, in training rows and in all, so the counts grow with the input.  Words with
over 1 / ``SHARES`` of all tokens, of which there are at most ``SHARES``, and of at most ``WORD_BYTES``
bytes are looked up where the text is read; all others by a join, in which no word can be frequent but
for long ones, which are joined apart.

Rows are scored one by one: repeated rows give repeated rows; a null text counts as empty and has the
end alone; a row with a null id is held out.  Without training rows the vocabulary's own weights
score, and every text ends with probability 1 / 2.  An empty table gives an empty one.  Columns besides id and
text are not read, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.llm import lattice
from offerloom.llm.common import prepare, slices, stored, texts_of
from offerloom.plans.joins import lookup_join, unique_join

ROUNDS = 2
SHARES, WORD_BYTES = 400_000, 64
SLICE_BYTES = 4 << 20
CACHED_WORDS = 300_000
COUNTED_WORDS = 500_000
RANK_SHIFT = 2.7
SMOOTHING = 0.01

COUNTS = "word binary, n long, times long"
_LOG10 = math.log(10)


def vocabulary(model_path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, the space mark as a space, with all single bytes, and their first weights in logs."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    rank = {bytes([b]): float(model.get_piece_size()) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if b" " not in piece[1:]:
                rank[piece] = min(rank.get(piece, math.inf), max(0.0, -model.get_score(i)))
    pieces = sorted(rank)
    weight = 1 / (np.array([rank[p] for p in pieces]) + RANK_SHIFT)
    return pieces, np.log(weight / weight.sum())


class Model:
    """Log weights of the pieces and of the end, and the totals of the training tokens."""

    def __init__(self, pieces: list[bytes], weight: np.ndarray, end: float, tokens: int, distinct: int, ends: int):
        self.name = uuid.uuid4().hex
        self.pieces, self.weight, self.end = pieces, weight, end
        self.tokens, self.distinct, self.ends = tokens, distinct, ends


_tries: dict[int, lattice.Trie] = {}


def _trie(pieces: list[bytes]) -> lattice.Trie:
    key = hash(tuple(pieces))
    if key not in _tries:
        _tries.clear()
        _tries[key] = lattice.Trie(pieces)
    return _tries[key]


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trained: Counter[bytes] = Counter()
    other: Counter[bytes] = Counter()
    for batch in batches:
        for learn, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            (trained if learn else other).update(words_of(text))
            if len(trained) + len(other) >= COUNTED_WORDS:
                yield _listed(trained, True)
                yield _listed(other, False)
    yield _listed(trained, True)
    yield _listed(other, False)


def _listed(held: Counter[bytes], learn: bool) -> pa.RecordBatch:
    times = pa.array(held.values(), pa.int64())
    n = times if learn else pa.array(np.zeros(len(held), np.int64))
    arrays = [pa.array(held.keys(), pa.binary()), n, times]
    held.clear()
    return pa.RecordBatch.from_arrays(arrays, ["word", "n", "times"])


def word_counts(docs: DataFrame, text_col: str, learn: Column) -> DataFrame:
    """How often each word occurs in the rows to learn from, and in all: ``word, n, times``."""
    prepare(docs)
    rows = docs.select(learn.alias("learn"), F.col(text_col).cast("binary").alias("text")).filter("length(text) > 0")
    found = rows.mapInArrow(_counted, COUNTS).groupBy("word")
    return found.agg(F.sum("n").alias("n"), F.sum("times").alias("times"))


def _expected_use(counts: DataFrame, pieces: list[bytes], weight: np.ndarray) -> np.ndarray:
    shared = counts.sparkSession.sparkContext.broadcast((pieces, weight))  # one value per piece

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, weight = shared.value
        total, trie = np.zeros(len(pieces)), _trie(pieces)
        for batch in batches:
            words = [b" " + w for w in texts_of(batch.column(0))]
            times = batch.column(1).to_numpy().astype(float)
            for a, b in slices(words, SLICE_BYTES):
                total += lattice.expected(trie, words[a:b], times[a:b], weight)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "n"])

    found = np.zeros(len(pieces))
    counts = counts.filter("n > 0").select("word", "n")
    for piece, n in counts.mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n")).collect():
        found[piece] = n
    return found


def train(
    docs: DataFrame, text_col: str, learn: Column, model_path: str, rounds: int = ROUNDS
) -> tuple[Model, DataFrame]:
    """The model of the rows of ``docs`` to learn from, and the stored counts of all words."""
    counts = stored(word_counts(docs, text_col, learn), "words")
    ends = docs.filter(learn).count()
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    pieces, weight = vocabulary(model_path)
    end = math.log(0.5)
    for _ in range(rounds if tokens else 0):
        use = _expected_use(counts, pieces, weight) + SMOOTHING
        total = use.sum() + ends
        weight, end = np.log(use / total), math.log(ends / total)
    return Model(pieces, weight, end, tokens + ends, distinct + (ends > 0), ends), counts


def score(docs: DataFrame, id_col: str, text_col: str, model: Model, counts: DataFrame, flag: Column) -> DataFrame:
    """Each row's ``id, held_out`` (the flag)``, n_tokens, n_known, train_tokens, base_score, score``."""
    spark = prepare(docs)
    rows = docs.select(F.col(id_col).alias("id"), flag.alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    total = counts.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    is_frequent = (F.col("times") * SHARES >= total) & (F.octet_length("word") <= WORD_BYTES)
    frequent = {bytes(r["word"]): r["n"] for r in counts.filter(is_frequent).collect()}
    shared = spark.sparkContext.broadcast((model, frequent))
    schema = rows.drop("text").schema
    for name in ("n_tokens", "n_found"):
        schema = schema.add(name, "long")
    for name in ("logs", "score"):
        schema = schema.add(name, "double")
    rare = "array<struct<word: binary, times: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(*shared.value)
        for batch in batches:
            texts = texts_of(batch.column(2))
            parts = [scorer.table(texts[a:b]) for a, b in slices(texts, SLICE_BYTES)]
            columns = [pa.concat_arrays(c) for c in zip(*parts, strict=True)] if parts else scorer.table([])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names)

    schema = schema.add("rare", spark.createDataFrame([], f"rare {rare}").schema["rare"].dataType)
    names = schema.names
    found = rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    found = stored(found, "scored")  # the row numbers are fixed from here on
    listed = found.select("row", F.inline("rare"))
    seldom = counts.filter(~is_frequent & (F.col("n") > 0)).select("word", "n")
    is_long = F.octet_length("word") > WORD_BYTES
    hits = listed.filter(~is_long).join(seldom.filter(~is_long), "word").select("row", "times", "n")
    long = lookup_join(listed.filter(is_long), seldom.filter(is_long), ["word"], "inner").select("row", "times", "n")
    hits = hits.unionByName(long).groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"), F.sum("times").alias("more_found")
    )
    joined = unique_join(found.drop("rare"), hits, ["row"], "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    every = math.log10(model.tokens + model.distinct + 1)
    return joined.select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_found") + F.coalesce("more_found", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(every)).alias("base_score"),
        "score",
    )


class _Scorer:
    """Scores texts in one task; log probabilities of words are kept, up to ``CACHED_WORDS`` of them."""

    def __init__(self, model: Model, frequent: dict[bytes, int]):
        self.model, self.frequent = model, frequent
        self.trie = _trie(model.pieces)
        self.known: dict[bytes, float] = {}

    def chances(self, words: list[bytes]) -> np.ndarray:
        """Log probability of each of some distinct words."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        found = lattice.forward(self.trie, [b" " + w for w in new], self.model.weight[:, None])[:, 0]
        fresh = dict(zip(new, found.tolist(), strict=True))
        known = self.known
        out = np.fromiter((known[w] if w in known else fresh[w] for w in words), float, len(words))
        known.update((w, x) for w, x in fresh.items() if len(w) <= WORD_BYTES)
        return out

    def table(self, texts: list[bytes]) -> list[pa.Array]:
        ids: dict[bytes, int] = {}
        lists = [words_of(t) for t in texts]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        numbers = np.fromiter((ids.setdefault(w, len(ids)) for x in lists for w in x), np.int64, int(lengths.sum()))
        del lists
        words = list(ids)
        owner = np.repeat(np.arange(len(texts)), lengths)

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.bincount(owner, weights=values[numbers], minlength=len(texts))

        counts = np.fromiter((self.frequent.get(w, -1) for w in words), np.int64, len(words))
        rare = np.flatnonzero((counts < 0)[numbers])
        counts = np.maximum(counts, 0)
        ends = self.model.ends
        logs = per_text(np.log10(counts + 1.0)) + math.log10(ends + 1)
        found = per_text((counts > 0).astype(float)).astype(np.int64) + (ends > 0)
        score = (per_text(self.chances(words)) + self.model.end) / _LOG10

        pair, times = np.unique(owner[rare] * max(1, len(words)) + numbers[rare], return_counts=True)
        text = pa.array(words, pa.binary())
        entries = pa.StructArray.from_arrays(
            [text.take(pa.array(pair % max(1, len(words)))), pa.array(times.astype(np.int32))], ["word", "times"]
        )
        cuts = np.searchsorted(pair, np.arange(len(texts) + 1) * max(1, len(words)))
        return [
            pa.array(lengths + 1),
            pa.array(found),
            pa.array(logs),
            pa.array(score),
            pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), entries),
        ]


def held_out(id_col: Column, folds: int = 7, fold: int = 2) -> Column:
    """One fold by the CRC-32 of the id as text; a null id counts as held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(True))
