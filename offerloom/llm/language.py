"""Language identification by unigram models over pieces, with segmentations summed out.

A fixed public vocabulary gives the pieces; each language has a probability for each.
A word's probability in a language is the sum over all its segmentations into pieces,
computed by a forward pass over its bytes; a text's is the product over its words.
Single bytes are pieces too, so every word has a segmentation.

Training takes, for each language, the ``docs_per_lang`` labelled documents with the
smallest hash of their id: this sample is the documented bound on what a classifier is
fitted to.  Its words are counted by Spark; one task per language then runs
expectation maximisation (forward and backward over all segmentations) on distinct
words.  The driver gathers the probabilities of pieces in use, at most one row per piece
of the vocabulary and language.  Scoring covers every word of every text.

Words end at ASCII white space; A-Z count as a-z.  A word is scored whole, whatever its length and the
length of the pieces: beyond ``SHORT`` bytes its sums are kept as logarithms, in windows (``lattice``).  A text that is null or has no letter gets ``und`` and score
0; equal likelihoods go to the language first in code point order.  Repeated
rows are scored alike; without any labelled document every text gets ``und``.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from offerloom.llm import lattice
from offerloom.llm.common import prepare, slices, texts_of

SHORT = 32
DOCS_PER_LANG = 1500
ROUNDS = 4
SMOOTHING = 0.01
LEAST_COUNT = 0.05
SLICE_BYTES = 4 << 20
SEED = 11


def vocabulary(model_path: str) -> list[bytes]:
    """Pieces as bytes, the space mark as a space, and all single bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode()
            if not piece.startswith(b"  "):
                pieces.add(piece)
    return sorted(pieces)


class Lattice:
    """All places of pieces in a list of words, as edges between positions."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for number, piece in enumerate(pieces):
            node = 0
            for byte in piece:
                child = children[node].get(byte)
                if child is None:
                    child = children[node][byte] = len(children)
                    children.append({})
                    ends.append(-1)
                node = child
            ends[node] = number
        self.next = np.zeros((len(children), 256), np.int32)
        for node, known in enumerate(children):
            if known:
                self.next[node, list(known)] = list(known.values())
        self.piece = np.array(ends, np.int32)

    def edges(self, words: list[bytes]):
        """``(steps, first, last)``: for each length t the edges that end t bytes into
        their word, as (from, to, piece), by ``to``; and the first and last positions of words."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(words)), lengths)
        end = (begin + lengths)[word]
        at, state, depth = np.arange(len(data)), np.zeros(len(data), np.int32), 0
        froms, tos, pieces, steps = [], [], [], []
        while len(at):
            state = self.next[state, data[at + depth]]
            depth += 1
            alive = state > 0
            at, state = at[alive], state[alive]
            piece = self.piece[state]
            some = piece >= 0
            start = at[some]
            froms.append(start + word[start])  # a word of n bytes has n + 1 positions
            tos.append(froms[-1] + depth)
            steps.append(start + depth - begin[word[start]])
            pieces.append(piece[some])
            going = at + depth < end[at]
            at, state = at[going], state[going]
        froms, tos, steps, pieces = (np.concatenate(x) for x in (froms, tos, steps, pieces))
        order = np.lexsort((tos, steps))
        froms, tos, steps, pieces = froms[order], tos[order], steps[order], pieces[order]
        cuts = np.searchsorted(steps, np.arange(1, int(lengths.max(initial=0)) + 2))
        parts = [(froms[a:b], tos[a:b], pieces[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        first = begin + np.arange(len(words))
        return parts, first, first + lengths


def forward(parts, first: np.ndarray, positions: int, probability: np.ndarray) -> np.ndarray:
    """Sum over segmentations up to each position; ``probability``: pieces x languages."""
    alpha = np.zeros((positions, probability.shape[1]))
    alpha[first] = 1.0
    for source, target, piece in parts:
        if len(target):
            heads = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
            alpha[target[heads]] = np.add.reduceat(alpha[source] * probability[piece], heads, axis=0)
    return alpha


def expected(parts, first, last, weights: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Expected number of each piece in weighted words under one language."""
    positions = int(last[-1]) + 1
    alpha = forward(parts, first, positions, probability[:, None])[:, 0]
    beta = np.zeros(positions)
    beta[last] = weights / alpha[last]
    total = np.zeros(len(probability))
    for source, target, piece in reversed(parts):
        share = probability[piece] * beta[target]
        total += np.bincount(piece, weights=alpha[source] * share, minlength=len(total))
        np.add.at(beta, source, share)
    return total


def fit_words(words: list[bytes], weights: np.ndarray, pieces: list[bytes], rounds: int) -> np.ndarray:
    """Expected piece counts after some rounds of expectation maximisation."""
    is_long = np.fromiter((len(w) > SHORT for w in words), bool, len(words))
    short = [w for w, x in zip(words, is_long, strict=True) if not x]
    parts, first, last = Lattice(pieces).edges(short) if short else ([], None, None)
    long, trie = [w for w, x in zip(words, is_long, strict=True) if x], lattice.Trie(pieces)
    counts = np.ones(len(pieces))
    for _ in range(rounds):
        probability = (counts + SMOOTHING) / (counts + SMOOTHING).sum()
        counts = lattice.expected(trie, long, weights[is_long], np.log(probability))
        if short:
            counts += expected(parts, first, last, weights[~is_long], probability)
    return counts


def words_of(text: bytes) -> list[bytes]:
    """Words with a space before them."""
    return [b" " + w for w in text.lower().split()]


def training_sample(docs: DataFrame, id_col: str, lang_col: str, docs_per_lang: int) -> DataFrame:
    """The labelled rows with the smallest hashes of their ids in each language.

    Ranked on id and language alone, cut before the shuffle; repeats of an id count once.
    """
    rows = docs.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"))
    hashed = rows.groupBy("_id", "_lang").agg(F.xxhash64(F.lit(SEED), F.col("_id")).alias("_h"))
    place = F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_id"))
    chosen = hashed.withColumn("_place", place).filter(F.col("_place") <= docs_per_lang).select("_id", "_lang")
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col(lang_col) == F.col("_lang"))
    return docs.join(F.broadcast(chosen), same, "left_semi")  # at most docs_per_lang rows per language


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple[str, bytes], int] = defaultdict(int)
        for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            for word in words_of(text):
                counts[lang, word] += 1
        langs, words = zip(*counts, strict=True) if counts else ((), ())
        arrays = [pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(counts.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["lang", "word", "n"])


class Model:
    """Languages, pieces in use, and log-free probabilities (pieces x languages)."""

    def __init__(self, langs: list[str], pieces: list[bytes], probability: np.ndarray):
        self.name = uuid.uuid4().hex
        self.langs, self.pieces, self.probability = langs, pieces, probability


def train(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    lang_col: str,
    model_path: str,
    docs_per_lang: int = DOCS_PER_LANG,
    rounds: int = ROUNDS,
) -> Model:
    """Fit piece probabilities; ``docs`` holds the rows that may be learned from."""
    prepare(docs)
    columns = {"_a": id_col, "_b": text_col, "_c": lang_col}
    rows = docs.select(*[F.col(c).alias(n) for n, c in columns.items()])
    sample = training_sample(rows, "_a", "_c", docs_per_lang).select("_c", F.col("_b").cast("binary").alias("_b"))
    words = sample.mapInArrow(_word_counts, "lang string, word binary, n long")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def fit(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        pieces = vocabulary(model_path)
        listed = [bytes(w) for w in found["word"]]
        counts = fit_words(listed, found["n"].to_numpy(float), pieces, rounds)
        used = np.flatnonzero(counts >= LEAST_COUNT)
        return pd.DataFrame({"lang": key[0], "piece": [pieces[i] for i in used], "n": counts[used]})

    rows = words.groupBy("lang").applyInPandas(fit, "lang string, piece binary, n double").collect()
    langs = sorted({r["lang"] for r in rows}, key=lambda x: x.encode())
    pieces = sorted({bytes(r["piece"]) for r in rows} | {bytes([b]) for b in range(256)})
    counts = np.zeros((len(pieces), len(langs)))
    row_of, column_of = {p: i for i, p in enumerate(pieces)}, {x: i for i, x in enumerate(langs)}
    for r in rows:
        counts[row_of[bytes(r["piece"])], column_of[r["lang"]]] = r["n"]
    counts += SMOOTHING
    return Model(langs, pieces, counts / counts.sum(axis=0, keepdims=True) if langs else counts)


_lattices: dict[str, tuple[Lattice, lattice.Trie]] = {}


def _lattice(model: Model) -> tuple[Lattice, lattice.Trie]:
    if model.name not in _lattices:
        _lattices.clear()
        _lattices[model.name] = (Lattice(model.pieces), lattice.Trie(model.pieces))
    return _lattices[model.name]


def word_scores(model: Model, words: list[bytes]) -> np.ndarray:
    """Log probability of each word in each language."""
    short_words, trie = _lattice(model)
    is_long = np.fromiter((len(w) > SHORT for w in words), bool, len(words))
    out = np.zeros((len(words), len(model.langs)))
    out[is_long] = lattice.forward(trie, [words[i] for i in np.flatnonzero(is_long)], np.log(model.probability))
    if not is_long.all():
        parts, first, last = short_words.edges([words[i] for i in np.flatnonzero(~is_long)])
        out[~is_long] = np.log(forward(parts, first, int(last[-1]) + 1, model.probability)[last])
    return out


def text_scores(model: Model, texts: list[bytes]) -> np.ndarray:
    """Log probability of each text in each language."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    rows = [np.fromiter(map(numbers.__getitem__, words_of(t)), np.int64) for t in texts]
    total = np.zeros((len(texts), len(model.langs)))
    words = list(numbers)
    scores = np.zeros((len(words), len(model.langs)))
    for a in range(0, len(words), 50_000):
        scores[a : a + 50_000] = word_scores(model, words[a : a + 50_000])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    for k in range(len(model.langs)):
        total[:, k] = np.bincount(owner, weights=scores[flat, k], minlength=len(texts))
    return total


def identify(
    docs: DataFrame, text: Column, model: Model, lang_name: str = "lang_pred", score_name: str = "score"
) -> DataFrame:
    """All columns of ``docs`` and the language with its posterior probability (equal priors).

    Columns of ``docs`` with one of these two names are replaced.
    """
    prepare(docs)
    kept = [c for c in docs.columns if c not in (lang_name, score_name)]
    rows = docs.select(
        F.struct(*kept).alias("row"),
        text.cast("binary").alias("text"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    schema = StructType(
        [
            StructField("row", rows.schema["row"].dataType),
            StructField(lang_name, StringType()),
            StructField(score_name, DoubleType()),
        ]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces in use x languages

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts, letters = texts_of(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
            langs, scores = np.full(len(texts), "und", object), np.zeros(len(texts))
            for a, b in slices(texts, SLICE_BYTES) if model.langs else ():
                found = text_scores(model, texts[a:b])
                best = found.argmax(axis=1)
                posterior = 1 / np.exp(found - found.max(axis=1, keepdims=True)).sum(axis=1)
                langs[a:b] = np.where(letters[a:b], np.array(model.langs, object)[best], "und")
                scores[a:b] = np.where(letters[a:b], posterior, 0.0)
            arrays = [batch.column(0), pa.array(langs.tolist(), pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return rows.mapInArrow(work, schema).select("row.*", lang_name, score_name)


def held_out(id_col: Column) -> Column:
    """One of five folds by the CRC-32 of the id as text; a null id counts as held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))
