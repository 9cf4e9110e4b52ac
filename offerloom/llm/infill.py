"""Fill-in-the-middle training texts over seekable compressed frames.

``pack`` stores each text as independent zstandard frames of at most ``FRAME_BYTES`` bytes, cut
between code points, each with the units, code points and bytes before it.  A unit is a run
of A-Z and a-z or one other code point; a run longer than a frame goes on in the next one.
``place`` draws two cuts and a form per document.  ``rearrange`` finds the frames that hold the
cuts by their counts, decompresses these alone and hands the other ones on as they are;
the marked text is again a list of frames.  ``restore`` undoes it from the marked text and the form.
``digests`` and ``texts`` stream the frames in order, so no step but ``pack`` and ``texts``, whose
column holds a text anyway, has more than two frames of a document decompressed.

No step shuffles: a document's frames are one array in its row.

Null texts count as empty; an empty text, and one that contains a mark, stays plain and whole.  A null
id draws its cuts from the empty id.  Rows are treated one by one, so repeated rows give repeated rows, and
equal cuts an empty middle.  An empty table gives an empty one.  Columns besides the id and
the text are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom.llm.common import prepare, texts_of

FRAME_BYTES = 1 << 16
LEVEL = 1
# The marks, and the shares of forms in percent.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

FRAME = T.StructType().add("units", "long").add("chars", "long").add("bytes", "long").add("inside", "boolean")
FRAME = FRAME.add("data", "binary")
STORE = T.StructType().add("frames", T.ArrayType(FRAME))
STORE = STORE.add("n_units", "long").add("n_chars", "long").add("n_bytes", "long")
_FRAME = [("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("inside", pa.bool_()), ("data", pa.binary())]

_ZIP, _UNZIP = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()


def _is_letter(raw: np.ndarray) -> np.ndarray:
    return ((raw | 0x20) - np.uint8(97)) < 26


def _begins(raw: np.ndarray) -> np.ndarray:
    """Bytes that begin a code point."""
    return (raw & 0xC0) != 0x80


def unit_starts(raw: np.ndarray, inside: bool) -> np.ndarray:
    """Bytes that begin a unit; ``inside``: the byte before is a letter."""
    letter = _is_letter(raw)
    follows = np.empty(len(raw), bool)
    follows[:1] = inside
    follows[1:] = letter[:-1]
    return np.flatnonzero(_begins(raw) & ~(letter & follows))


class Writer:
    """Turns pieces of text, or frames that follow them unchanged, into a list of frames."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes = frame_bytes
        self.frames: list[tuple[int, int, int, bool, bytes]] = []
        self.held = b""
        self.letter = False  # the last byte written is a letter
        self.units = self.chars = self.bytes = 0

    def add(self, piece: bytes) -> None:
        self.held += piece
        begin = 0
        while len(self.held) - begin > self.frame_bytes:
            end = begin + self.frame_bytes
            while self.held[end] & 0xC0 == 0x80:
                end -= 1
            self._emit(self.held[begin:end])
            begin = end
        self.held = self.held[begin:]

    def _emit(self, text: bytes) -> None:
        raw = np.frombuffer(text, np.uint8)
        starts = len(unit_starts(raw, self.letter))
        last = bool(_is_letter(raw[-1:])[0])
        self._append(_ZIP.compress(text), starts, int(_begins(raw).sum()), len(raw), last)

    def _append(self, data: bytes, units: int, chars: int, size: int, letter: bool) -> None:
        self.frames.append((self.units, self.chars, self.bytes, self.letter, data))
        self.units, self.chars, self.bytes = self.units + units, self.chars + chars, self.bytes + size
        self.letter = letter

    def flush(self) -> None:
        if self.held:
            self._emit(self.held)
            self.held = b""

    def hand_on(self, source: Frames, k: int) -> None:
        """Append a frame without decompressing it; what goes before it is a mark or its own predecessor."""
        self.flush()
        units, chars, size = (int(counts[k + 1] - counts[k]) for counts in (source.units, source.chars, source.bytes))
        self._append(source.data[k], units, chars, size, source.inside[k + 1])


class Frames:
    """The frames of one text."""

    def __init__(self, units, chars, sizes, inside, data: list[bytes], totals: tuple[int, int, int]):
        self.units, self.chars, self.bytes = (
            np.append(x, total) for x, total in zip((units, chars, sizes), totals, strict=True)
        )
        self.inside, self.data = [*inside, False], data
        self.open: tuple[int, bytes] = (-1, b"")

    def __getitem__(self, k: int) -> bytes:
        if self.open[0] != k:
            self.open = (k, _UNZIP.decompress(self.data[k]))
        return self.open[1]

    def __iter__(self) -> Iterator[bytes]:
        return map(self.__getitem__, range(len(self.data)))

    def place_of(self, unit: int) -> tuple[int, int]:
        """Bytes and code points before a unit; only the frame it begins in is decompressed."""
        if unit >= self.units[-1]:
            return int(self.bytes[-1]), int(self.chars[-1])
        k = int(np.searchsorted(self.units, unit, side="right")) - 1
        raw = np.frombuffer(self[k], np.uint8)
        at = int(unit_starts(raw, self.inside[k])[unit - self.units[k]])
        return int(self.bytes[k]) + at, int(self.chars[k] + _begins(raw[:at]).sum())

    def copy(self, begin: int, end: int, out: Writer) -> None:
        """Write a range of bytes; frames that lie in it whole stay compressed."""
        k = int(np.searchsorted(self.bytes, begin, side="right")) - 1
        while begin < end:
            low, high = int(self.bytes[k]), int(self.bytes[k + 1])
            if begin == low and high <= end and high - low >= out.frame_bytes // 2:
                out.hand_on(self, k)
            else:
                out.add(self[k][begin - low : end - low])
            begin, k = high, k + 1

    def find(self, mark: bytes, begin: int) -> int:
        """First place of a mark at or after a byte, frame by frame."""
        k = int(np.searchsorted(self.bytes, begin, side="right")) - 1
        tail, before = b"", begin
        skip = begin - int(self.bytes[k])
        for n in range(k, len(self.data)):
            part = tail + self[n][skip:]
            skip = 0
            found = part.find(mark)
            if found >= 0:
                return before + found
            tail = part[-(len(mark) - 1) :]
            before += len(part) - len(tail)
        raise ValueError("the text lacks a mark")


def pack_text(text: bytes, frame_bytes: int = FRAME_BYTES) -> Writer:
    out = Writer(frame_bytes)
    out.add(text)
    out.flush()
    return out


def marked_text(source: Frames, form: str, first: int, second: int, frame_bytes: int = FRAME_BYTES):
    """The frames of the marked text, and the code points of prefix and middle."""
    (a, a_chars), (b, b_chars) = source.place_of(first), source.place_of(second)
    end = int(source.bytes[-1])
    parts = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, end)}
    out = Writer(frame_bytes)
    for mark in (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE):
        out.add(mark)
        source.copy(*parts[mark], out)
    out.flush()
    return out, a_chars, b_chars - a_chars


def plain_text(source: Frames, form: str, frame_bytes: int = FRAME_BYTES) -> Writer:
    """The text behind a marked one, from its marks and its form."""
    out, end = Writer(frame_bytes), int(source.bytes[-1])
    if form == "plain":
        source.copy(0, end, out)
    else:
        order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
        places, at = {}, 0
        for mark in order:
            at = source.find(mark, at)
            places[mark] = at
            at += len(mark)
        stops = [*(places[m] for m in order[1:]), end]
        spans = {m: (places[m] + len(m), stop) for m, stop in zip(order, stops, strict=True)}
        for mark in (PREFIX, MIDDLE, SUFFIX):
            source.copy(*spans[mark], out)
    out.flush()
    return out


def _readers(batch: pa.RecordBatch) -> Iterator[Frames]:
    """The frames of each row of a batch with the columns of a store."""
    column = batch.column("frames")
    ends = column.offsets.to_numpy()
    values = column.values
    units, chars, sizes = (values.field(n).to_numpy() for n in range(3))
    inside, data = values.field(3).to_pylist(), values.field(4)
    totals = [batch.column(n).to_pylist() for n in ("n_units", "n_chars", "n_bytes")]
    for a, b, *total in zip(ends, ends[1:], *totals, strict=False):
        yield Frames(units[a:b], chars[a:b], sizes[a:b], inside[a:b], data.slice(a, b - a).to_pylist(), tuple(total))


def _store(written: list[Writer]) -> list[pa.Array]:
    """The columns of a store."""
    ends = np.cumsum([0, *(len(w.frames) for w in written)])
    rows = [f for w in written for f in w.frames]
    fields = [pa.array([r[n] for r in rows], kind) for n, (_, kind) in enumerate(_FRAME)]
    frames = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, [n for n, _ in _FRAME]))
    return [frames, *(pa.array([getattr(w, n) for w in written], pa.int64()) for n in ("units", "chars", "bytes"))]


def _mapped(df: DataFrame, kept: list[str], added: T.StructType, work: Callable[[pa.RecordBatch], list[pa.Array]]):
    """``df`` with the columns ``kept`` and those that ``work`` makes of each batch."""
    prepare(df)
    schema = T.StructType([*(df.schema[c] for c in kept), *added.fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column(c) for c in kept] + work(batch)
            yield pa.RecordBatch.from_arrays(arrays, names)

    return df.mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str, text_col: str, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The store: ``id``, ``marked`` (the text contains a mark), the frames and their totals."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = text.contains(PREFIX.decode()) | text.contains(SUFFIX.decode()) | text.contains(MIDDLE.decode())
    rows = docs.select(F.col(id_col).alias("id"), marked.alias("marked"), text.cast("binary").alias("text"))

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        return _store([pack_text(text, frame_bytes) for text in texts_of(batch.column("text"))])

    return _mapped(rows, ["id", "marked"], STORE, work)


def _drawn(seed: int) -> list[Column]:
    """The first four groups of 32 bits of a hash of the seed and the id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    digest = F.sha2(named.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def place(store: DataFrame, seed: int = 1) -> DataFrame:
    """Adds ``form``, and the units before the cuts, ``first`` and ``second``."""
    h1, h2, h3, h4 = _drawn(seed)
    ends = F.col("n_units") + 1
    plain = (F.col("n_bytes") == 0) | F.col("marked") | (h3 % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(h4 % 100 < SPM_BELOW, "spm").otherwise("psm")
    return store.withColumns(
        {"form": form, "first": F.least(h1 % ends, h2 % ends), "second": F.greatest(h1 % ends, h2 % ends)}
    )


def rearrange(placed: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The store of the marked texts: ``id``, ``n`` (units of the text), ``form``, ``prefix_chars``, ``middle_chars``."""
    rows = placed.withColumn("n", F.col("n_units"))
    added = T.StructType().add("prefix_chars", "long").add("middle_chars", "long")

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        forms, firsts, seconds = (batch.column(c).to_pylist() for c in ("form", "first", "second"))
        written, prefix, middle = [], [], []
        for source, form, first, second in zip(_readers(batch), forms, firsts, seconds, strict=True):
            if form == "plain":
                out, a, b = plain_text(source, form, frame_bytes), None, None
            else:
                out, a, b = marked_text(source, form, first, second, frame_bytes)
            written.append(out)
            prefix.append(a)
            middle.append(b)
        return [pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), *_store(written)]

    return _mapped(rows, ["id", "n", "form"], T.StructType([*added.fields, *STORE.fields]), work)


def restore(marked: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """The store of the texts behind the marked ones, by ``form`` and marks alone."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        forms = batch.column("form").to_pylist()
        return _store([plain_text(s, f, frame_bytes) for s, f in zip(_readers(batch), forms, strict=True)])

    kept = [c for c in marked.columns if c not in STORE.names]
    return _mapped(marked, kept, STORE, work)


def _digest(source: Frames) -> str:
    total = hashlib.sha256()
    for part in source:
        total.update(part)
    return total.hexdigest()


def digests(store: DataFrame, name: str) -> DataFrame:
    """SHA-256 of the text in each row, in place of its frames."""
    kept = [c for c in store.columns if c not in STORE.names]

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([_digest(s) for s in _readers(batch)], pa.string())]

    return _mapped(store, kept, T.StructType().add(name, "string"), work)


def texts(store: DataFrame, name: str = "text") -> DataFrame:
    """The texts themselves, in place of their frames."""
    kept = [c for c in store.columns if c not in STORE.names]

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([b"".join(s).decode() for s in _readers(batch)], pa.string())]

    return _mapped(store, kept, T.StructType().add(name, "string"), work)


def round_trip(marked: DataFrame, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Digests of the marked text and of the one restored from it: ``output_sha256``, ``restored_sha256``."""
    kept = [c for c in marked.columns if c not in STORE.names]

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        output, restored = [], []
        for source, form in zip(_readers(batch), batch.column("form").to_pylist(), strict=True):
            output.append(_digest(source))
            back = plain_text(source, form, frame_bytes)
            units, chars, sizes, inside, data = zip(*back.frames, strict=True) if back.frames else ((),) * 5
            restored.append(_digest(Frames(units, chars, sizes, inside, list(data), (back.units, back.chars, back.bytes))))
        return [pa.array(output, pa.string()), pa.array(restored, pa.string())]

    return _mapped(marked, kept, T.StructType().add("output_sha256", "string").add("restored_sha256", "string"), work)
