"""Token counts of a piece vocabulary by a deterministic transducer.

A SentencePiece BPE model is compiled into a transducer over code points that
counts the pieces of everything read so far.  Two facts make it finite-state: a
row of pieces is what the merges give exactly if every two neighbours stay apart
when merged alone, and a piece that ends later starts within the longest suffix
that is a prefix of some piece.  So a state holds, for each such suffix, the piece
that ended before it and the count there relative to now; a transition extends
the suffixes by one code point, picks the piece that ends here and fits the one
before it, and is annotated with the change of the count.  States and transitions
are compiled as texts ask for them and kept by the worker.

No piece has white space after another character, so the state after the first
space behind a word does not depend on what came before, and neither does the
state after a code point outside the vocabulary (its bytes are a piece each).
These are the points where the state map of a chunk becomes constant.  Texts are
cut into chunks of equal length; all chunks of a batch are run side by side, which
gives each chunk's exit state and its count behind the first such point.  Heads of
chunks are then run from the exit state before them, chunks without such a point
one after the other, and the maps are composed by a sum over each text.

Null and empty texts have no tokens.  Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from offerloom.llm.common import prepare, slices, texts_of

SPACE = "▁"
CHUNK = 256
SLICE_BYTES = 4 << 20
STATES_KEPT = 400_000
NONE = -1
PERIODS = 64


class IntTable:
    """Integer keys to integer values with open addressing; looked up by the array."""

    def __init__(self, bits: int = 16):
        self.bits, self.count = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, or -1 where a key is absent."""
        slots = self._slots(keys)
        met = self.keys[slots]
        found = np.where(met == keys, self.values[slots], -1)
        open_ = np.flatnonzero((met != keys) & (met != -1))
        mask = (1 << self.bits) - 1
        at = slots[open_]
        while len(open_):
            at = (at + 1) & mask
            met, asked = self.keys[at], keys[open_]
            same = met == asked
            found[open_[same]] = self.values[at[same]]
            going = ~same & (met != -1)
            open_, at = open_[going], at[going]
        return found

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys that are absent and differ from each other."""
        if 2 * (self.count + len(keys)) > len(self.keys):
            held = self.keys >= 0
            keys = np.concatenate([self.keys[held], keys])
            values = np.concatenate([self.values[held], values])
            self.__init__((4 * len(keys)).bit_length())
        mask = (1 << self.bits) - 1
        self.count += len(keys)
        slots = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] == -1)
            self.keys[slots[free]] = keys[free]  # of several for one slot the last stays
            placed = self.keys[slots] == keys
            self.values[slots[placed]] = values[placed]
            keys, values, slots = keys[~placed], values[~placed], (slots[~placed] + 1) & mask


class Transducer:
    """Counts pieces code point by code point; see the module's text."""

    def __init__(self, model_path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)):
                pieces[model.id_to_piece(i)] = model.get_score(i)
        self.scores = pieces
        if any(SPACE in p.lstrip(SPACE) for p in pieces) or any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in pieces):
            raise ValueError("pieces with white space inside are not supported")
        for probe in ("a", " a  b ", "ﬁ"):
            if "".join(model.encode(probe, out_type=str)).replace(SPACE, " ") != " " + probe:
                raise ValueError("the model changes texts before it cuts them; only plain models are supported")
        chars = sorted({c for p in pieces for c in p})
        if any(c not in pieces for c in chars):
            raise ValueError("every character of a piece has to be a piece")
        # Symbols: 1 to 4 for unknown code points by their bytes, then the characters of the vocabulary.
        self.symbol_of = np.repeat(np.array([1, 2, 3, 4], np.int32), [0x80, 0x780, 0xF800, 0x100000])
        self.symbols = ["", "", "", "", "", *chars]
        for i, c in enumerate(chars):
            self.symbol_of[ord(c)] = 5 + i
        self.space = self.symbols.index(SPACE)
        self.symbol_of[ord(" ")] = self.space
        self.children: list[dict[int, int]] = [{}]
        self.piece_at: list[str | None] = [None]
        sym = {c: i for i, c in enumerate(self.symbols) if c}
        for piece in pieces:
            if piece.startswith(SPACE * 2):
                continue
            node = 0
            for c in piece:
                child = self.children[node].get(sym[c])
                if child is None:
                    child = self.children[node][sym[c]] = len(self.children)
                    self.children.append({})
                    self.piece_at.append(None)
                node = child
            self.piece_at[node] = piece
        self.spines: dict[str, tuple[list, list]] = {}
        self.runs = [0, 1]
        self.period, self.per_period = self._find_period()
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.listed: list[tuple] = []
        self.table = IntTable()
        self.start = self._number((0, ((0, None, 0),)))

    def _number(self, state: tuple) -> int:
        known = self.states.get(state)
        if known is None:
            known = self.states[state] = len(self.listed)
            self.listed.append(state)
        return known

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text: best score first, leftmost first."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def run_tokens(self, length: int) -> int:
        """Pieces of so many spaces alone."""
        while len(self.runs) <= length:
            self.runs.append(len(self.merge(SPACE * len(self.runs))))
        return self.runs[length]

    def _find_period(self) -> tuple[int, int]:
        self.run_tokens(4 * PERIODS)
        for p in range(1, PERIODS + 1):
            steps = {self.runs[k + p] - self.runs[k] for k in range(1, 3 * PERIODS)}
            if len(steps) == 1:
                return p, steps.pop()
        raise ValueError("the pieces of runs of spaces follow no period")

    def _spines(self, piece: str) -> tuple[list, list]:
        """The parts of a piece at its left and at its right edge, as its merges make them.

        Each with the rank (the score, negated) at which it exists, and that and
        the own rank of the merge that takes it up.
        """
        known = self.spines.get(piece)
        if known is not None:
            return known
        never = (float("inf"), float("inf"))
        parts = [(c, (-float("inf"), -float("inf"))) for c in piece]
        left, right = [[parts[0], never]], [[parts[-1], never]]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i][0] + parts[i + 1][0])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            first, second = parts[at], parts[at + 1]
            made = (first[0] + second[0], (max(-best, first[1][0], second[1][0]), -best))
            parts[at : at + 2] = [made]
            if at == 0:
                left[-1][1] = made[1]
                left.append([made, never])
            if at == len(parts) - 1:
                right[-1][1] = made[1]
                right.append([made, never])
        known = tuple([(text, exists[0], taken) for (text, exists), taken in side] for side in (left, right))
        self.spines[piece] = known
        return known

    def _apart(self, left: str | None, right: str) -> bool:
        """Whether two neighbours stay as they are when merged together.

        They do not if some part at the right edge of the one and some part at the
        left edge of the other make a piece before either is taken up otherwise;
        of equal ranks the leftmost merge comes first.
        """
        if left is None:
            return True
        scores = self.scores
        ours, theirs = self._spines(left)[1], self._spines(right)[0]
        for a, a_exists, a_taken in ours:
            for b, b_exists, b_taken in theirs:
                score = scores.get(a + b)
                if score is not None:
                    cross = (max(-score, a_exists, b_exists), -score)
                    if cross < a_taken and cross <= b_taken:
                        return False
        return True

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state and the change of the count."""
        run, chain = self.listed[state]
        if symbol < 5:
            return self._number((0, ((0, None, 0),))), symbol
        if symbol == self.space:
            now, before = self.run_tokens(run + 1), self.run_tokens(run)
            grown = run + 1 if run < self.period else run + 1 - self.period
            node = self.children[0][symbol]
            return self._number((grown, ((node, None, before - now), (0, SPACE, 0)))), now - before
        ended, carried = None, []
        for node, piece, count in chain:
            child = self.children[node].get(symbol)
            if child is None:
                continue
            carried.append((child, piece, count))
            last = self.piece_at[child]
            if ended is None and last is not None and self._apart(piece, last):
                ended = (last, count + 1)
        if ended is None:
            raise ValueError("no piece ends here; the vocabulary is not closed under merges")
        last, change = ended
        entries = tuple((node, piece, count - change) for node, piece, count in carried)
        return self._number((0, (*entries, (0, last, 0)))), change

    def advance(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One transition for each lane."""
        keys = states * np.int64(1 << 15) + symbols
        found = self.table.get(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = np.unique(keys[missing])
            made = [self.step(key >> 15, key & 0x7FFF) for key in new.tolist()]
            self.table.put(new, np.array([state << 8 | (change + 64) for state, change in made]))
            found[missing] = self.table.get(keys[missing])
        return found >> 8, (found & 255) - 64

    def run(self, symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray, states: np.ndarray, points=None):
        """Run lanes ``[begin, end)`` of ``symbols`` side by side.

        Returns exit states and counts, the counts from ``points`` on (positions
        in ``symbols``) if those are given.
        """
        order = np.argsort(begins - ends, kind="stable")
        at, length = begins[order], (ends - begins)[order]
        states, counts = states[order].copy(), np.zeros(len(order), np.int64)
        point = points[order] if points is not None else at
        active = len(order)
        for t in range(int(length[0]) if len(order) else 0):
            while length[active - 1] <= t:
                active -= 1
            now = at[:active] + t
            after, change = self.advance(states[:active], symbols[now])
            states[:active] = after
            counts[:active] += np.where(now >= point[:active], change, 0)
        out_states, out_counts = np.empty_like(states), np.empty_like(counts)
        out_states[order], out_counts[order] = states, counts
        return out_states, out_counts

    def count(self, texts: list[bytes]) -> np.ndarray:
        """Pieces of each text."""
        if len(self.listed) > STATES_KEPT:
            self.reset()
        decoded = [(" " + t.decode("utf-8", "replace")) if t else "" for t in texts]
        points = np.frombuffer("".join(decoded).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbol_of[points].astype(np.int64)
        lengths = np.fromiter(map(len, decoded), np.int64, len(decoded))
        total = np.zeros(len(texts), np.int64)
        if not len(symbols):
            return total
        text_end = np.cumsum(lengths)
        chunks = -(-lengths // CHUNK)
        owner = np.repeat(np.arange(len(texts)), chunks)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        begins = (text_end - lengths)[owner] + place * CHUNK
        ends = np.minimum(begins + CHUNK, text_end[owner])
        # Points behind which nothing depends on what came before.
        space = symbols == self.space
        fixed = symbols < 5
        fixed[1:] |= space[1:] & ~space[:-1]
        places = np.append(np.flatnonzero(fixed), len(symbols))
        point = places[np.searchsorted(places, begins)]
        first = place == 0
        point = np.where(first, begins, point)
        constant = point < ends
        exits = np.full(len(owner), self.start)
        counts = np.zeros(len(owner), np.int64)
        some = np.flatnonzero(constant)
        exits[some], counts[some] = self.run(
            symbols, point[some], ends[some], np.full(len(some), self.start), None
        )
        # Heads of chunks with a constant map, and whole chunks without, from the exit before.
        waiting = np.flatnonzero(~first)
        known = constant.copy()
        while len(waiting):
            ready = waiting[known[waiting - 1]]
            stop = np.where(constant[ready], point[ready], ends[ready])
            states, heads = self.run(symbols, begins[ready], stop, exits[ready - 1])
            counts[ready] += heads
            open_ = ~constant[ready]
            exits[ready[open_]] = states[open_]
            before = known.copy()
            known[ready] = True
            waiting = waiting[~before[waiting - 1]]
        np.add.at(total, owner, counts)
        return total


_compiled: dict[str, Transducer] = {}


def transducer(model_path: str) -> Transducer:
    """The worker's transducer of a model; what it has compiled serves all its tasks."""
    if model_path not in _compiled:
        _compiled[model_path] = Transducer(model_path)
    return _compiled[model_path]


def token_counts(docs: DataFrame, id_col: str, text_col: str, model_path: str, limit: int = 4096) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` of every row."""
    prepare(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    fields = [("n_bytes", LongType()), ("n_tokens", LongType()), ("over_limit", BooleanType())]
    schema = StructType([StructField("id", rows.schema["id"].dataType), *[StructField(n, t) for n, t in fields]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column(1))
            counts = np.zeros(len(texts), np.int64)
            for a, b in slices(texts, SLICE_BYTES):
                counts[a:b] = transducer(model_path).count(texts[a:b])
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            columns = [batch.column(0), pa.array(sizes), pa.array(counts), pa.array(counts > limit)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(work, schema)
