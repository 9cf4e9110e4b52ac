"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut into words by the pattern of the vocabulary; equal words of a batch
are encoded once.  All their bytes are one array of symbols linked to their
neighbours.  An index maps the rank of every mergeable pair to all its positions.
The active ranks are taken in ascending order: all positions of a rank are merged
at once, and the pairs that arise next to them are entered in the lists of their
own ranks.  Words are independent, so this gives for each what merging its best
pair again and again gives.  Strings of special tokens in a text are their own ids.

Decoding looks the bytes of every id up again, so the decoded text comes from the
ids alone.  Null and empty texts have no ids.  Only the id and the text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from offerloom.llm.common import prepare, slices, texts_of

SLICE_BYTES = 6 << 20
# Fixed value: the pattern that splits texts before the merges (public_tokenizers.PATTERN),
# with white space as the Unicode property.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# White space besides the space and the line feed; all that ``str.isspace`` knows.
OTHER_SPACE = re.compile(r"[^\S \n]")


def evenly_spaced(text: str) -> bool:
    """Whether each space stands alone between other characters."""
    return not (
        "  " in text
        or " \n" in text
        or "\n " in text
        or text[:1] == " "
        or text[-1:] == " "
        or OTHER_SPACE.search(text)
    )


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself,
    the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """A vocabulary: ranks of pairs, bytes of ids, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model, before = given["model"], given["pre_tokenizer"]
        if model["type"] != "BPE" or given["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"]:
            raise ValueError("only plain byte-level BPE is supported")
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = model["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in given["added_tokens"])]) + 1
        self.byte_id = np.array([vocab[c] for c in letters], np.int32)
        content: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            content[i] = bytes(byte_of[c] for c in token)
        self.special = {}
        for token in given["added_tokens"]:
            content[token["id"]] = token["content"].encode()
            self.special[token["content"]] = token["id"]
        names = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.content_len = np.array([len(c) for c in content], np.int64)
        self.content_start = np.cumsum(self.content_len) - self.content_len
        self.content = np.frombuffer(b"".join(content), np.uint8)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = self.left.astype(np.int64) * self.size + self.right
        # Open addressing at a quarter full; of a pair listed twice the later rank holds.
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot_rank = np.full(1 << self.bits, -1, np.int32)
        self._fill(keys)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray) -> None:
        last = {k: r for r, k in enumerate(keys.tolist())}
        keys, ranks = np.fromiter(last, np.int64, len(last)), np.fromiter(last.values(), np.int32, len(last))
        slots, mask = self._slots(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.slot_key[slots] == -1
            self.slot_key[slots[free]] = keys[free]
            placed = self.slot_key[slots] == keys
            self.slot_rank[slots[placed]] = ranks[placed]
            keys, ranks, slots = keys[~placed], ranks[~placed], (slots[~placed] + 1) & mask

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or -1."""
        keys = left.astype(np.int64) * self.size + right
        slots = self._slots(keys)
        met = self.slot_key[slots]
        found = np.where(met == keys, self.slot_rank[slots], np.int32(-1))
        open_ = np.flatnonzero((met != keys) & (met != -1))
        mask = (1 << self.bits) - 1
        at = slots[open_]
        while len(open_):
            at = (at + 1) & mask
            met, asked = self.slot_key[at], keys[open_]
            same = met == asked
            found[open_[same]] = self.slot_rank[at[same]]
            going = ~same & (met != -1)
            open_, at = open_[going], at[going]
        return found

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in a row, and how many each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int32), lengths
        ends = np.cumsum(lengths)
        right = np.arange(1, n + 1, dtype=np.int32)
        left = np.arange(-1, n - 1, dtype=np.int32)
        filled = lengths > 0
        right[ends[filled] - 1] = -1
        left[(ends - lengths)[filled]] = -1
        first = np.flatnonzero(right >= 0).astype(np.int32)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(positions: np.ndarray, ranks: np.ndarray) -> None:
            """Add positions to the lists of their ranks."""
            valid = ranks >= 0
            positions, ranks = positions[valid], ranks[valid]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            begins = [0, *cuts.tolist(), len(ranks)]
            for rank, a, b in zip(ranks[begins[:-1]].tolist(), begins, begins[1:], strict=False):
                held = index.get(rank)
                if held is None:
                    index[rank] = [positions[a:b]]
                    heapq.heappush(heap, rank)
                else:
                    held.append(positions[a:b])

        enter(first, self.ranks(symbols[first], symbols[first + 1]))
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[rank], self.right[rank]
            at = at[symbols[at] == a]
            after = right[at]
            good = after >= 0
            good &= symbols[after] == b  # of position -1 the outcome does not matter
            at = np.unique(at[good])
            if not len(at):
                continue
            after = right[at]
            if a == b and len(at) > 1:  # of a run of overlapping pairs every other one
                breaks = np.flatnonzero(np.append(True, at[1:] != after[:-1]))
                place = np.arange(len(at)) - np.repeat(breaks, np.diff(np.append(breaks, len(at))))
                at = at[place % 2 == 0]
                after = right[at]
            beyond = right[after]
            symbols[at] = self.made[rank]
            symbols[after] = -1
            right[at] = beyond
            inner = beyond >= 0
            left[beyond[inner]] = at[inner]
            before = left[at]
            outer = before >= 0
            starts = np.concatenate([before[outer], at[inner]])
            enter(starts, self.ranks(symbols[starts], symbols[right[starts]]))
        alive = symbols >= 0
        owner = np.repeat(np.arange(len(words)), lengths)
        return symbols[alive], np.bincount(owner[alive], minlength=len(words))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has.

        A space between other characters always begins a word, so most texts are
        cut there first, and the pattern runs on distinct stretches only.  A key
        stands for its text behind a space, or without one if it begins with a tab.
        """
        stretches: dict[str, int] = defaultdict(count().__next__)  # a new key gets the next number
        rows: list[np.ndarray] = []
        for text in texts:
            found: list[int] = []
            for part, special in self._parts(text.decode("utf-8", "replace")):
                if special is not None:
                    found.append(-1 - special)
                    continue
                if evenly_spaced(part):
                    keys = part.split(" ")
                    keys[0] = "\t" + keys[0]
                else:
                    keys = ["\t" + w for w in WORDS.findall(part)]
                found.extend(map(stretches.__getitem__, keys))
            rows.append(np.array(found, np.int64))
        words: dict[str, int] = defaultdict(count().__next__)
        inside: list[int] = []
        sizes: list[int] = []
        for key in stretches:
            cut = WORDS.findall(key[1:] if key[:1] == "\t" else " " + key)
            inside.extend(map(words.__getitem__, cut))
            sizes.append(len(cut))
        ids, counts = self.encode_words([w.encode() for w in words])
        # From ids of words to ids of stretches; special tokens stand behind them.
        inside_at = np.array(inside, np.int64)
        specials = np.fromiter(self.special.values(), np.int32, len(self.special))
        ids = np.concatenate([ids[ragged((np.cumsum(counts) - counts)[inside_at], counts[inside_at])], specials])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        counts = np.bincount(owner, weights=counts[inside_at], minlength=len(sizes)).astype(np.int64)
        counts = np.concatenate([counts, np.ones(len(specials), np.int64)])
        starts = np.cumsum(counts) - counts
        place = np.zeros(self.size, np.int64)
        place[specials] = len(sizes) + np.arange(len(specials))
        chosen = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        special = chosen < 0
        chosen[special] = place[-1 - chosen[special]]
        per_row = np.fromiter(map(len, rows), np.int64, len(rows))
        owner = np.repeat(np.arange(len(rows)), per_row)
        totals = np.bincount(owner, weights=counts[chosen], minlength=len(rows)).astype(np.int64)
        return ids[ragged(starts[chosen], counts[chosen])], totals

    def _parts(self, string: str) -> Iterator[tuple[str, int | None]]:
        at = 0
        for match in self.special_pattern.finditer(string) if self.special_pattern else ():
            if match.start() > at:
                yield string[at : match.start()], None
            yield "", self.special[match.group()]
            at = match.end()
        if at < len(string):
            yield string[at:], None

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids as UTF-8, with the replacement character for bytes that are none."""
        found = self.content[ragged(self.content_start[ids], self.content_len[ids])].tobytes()
        return found.decode("utf-8", "replace").encode()


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, in a row."""
    total = int(counts.sum())
    shift = starts - (np.cumsum(counts) - counts)
    return np.repeat(shift, counts) + np.arange(total)


_loaded: dict[str, Merges] = {}


def vocabulary(path: str) -> Merges:
    if path not in _loaded:
        _loaded[path] = Merges(path)
    return _loaded[path]


def _encoded(path: str, texts: list[bytes]) -> Iterator[np.ndarray]:
    """The ids of each text, slice by slice."""
    merges = vocabulary(path)
    for a, b in slices(texts, SLICE_BYTES):
        ids, totals = merges.encode(texts[a:b])
        ends = np.cumsum(totals)
        for end, total in zip(ends.tolist(), totals.tolist(), strict=True):
            yield ids[end - total : end]


def _mapped(docs: DataFrame, id_col: str, text_col: str, fields, row) -> DataFrame:
    prepare(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    schema = StructType([StructField("id", rows.schema["id"].dataType), *[StructField(n, t) for n, t, _ in fields]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in fields]
            for values in row(texts_of(batch.column(1))):
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            arrays = [pa.array(c, t) for c, (_, _, t) in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema.names)

    return rows.mapInArrow(work, schema)


def encode(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """``(id, n_tokens, ids)``: the ids as little-endian unsigned 32-bit integers."""
    fields = [("n_tokens", LongType(), pa.int64()), ("ids", BinaryType(), pa.binary())]
    return _mapped(
        docs, id_col, text_col, fields, lambda texts: ((len(i), i.astype("<u4").tobytes()) for i in _encoded(path, texts))
    )


def decode(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``(id, text)`` of encoded ids."""
    fields = [("text", StringType(), pa.string())]
    return _mapped(
        encoded,
        id_col,
        ids_col,
        fields,
        lambda rows: ((vocabulary(path).decode(np.frombuffer(r, "<u4").astype(np.int64)).decode(),) for r in rows),
    )


def encode_digests(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: encoded and decoded again in one pass,
    so that neither ids nor decoded texts leave the worker."""
    fields = [
        ("n_tokens", LongType(), pa.int64()),
        ("ids_sha256", StringType(), pa.string()),
        ("decoded_sha256", StringType(), pa.string()),
    ]

    def digests(texts: list[bytes]):
        merges = vocabulary(path)
        for ids in _encoded(path, texts):
            packed = hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()
            yield len(ids), packed, hashlib.sha256(merges.decode(ids)).hexdigest()

    return _mapped(docs, id_col, text_col, fields, digests)
