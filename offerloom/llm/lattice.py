"""The lattice of all segmentations of words into pieces of a vocabulary, in log space.

``forward`` sums the weights of all segmentations of a word, ``expected`` gives the expected
use of each piece in weighted words.  Weights are logarithms throughout, so a word of any length
neither underflows nor has to be cut.  Short words are computed side by side, one step
for each byte of the longest; one of over ``LONG`` bytes alone, in windows of ``WINDOW``
bytes that hand over the positions a piece can still reach, so edges are held for one window only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LONG, WINDOW = 256, 1 << 14
SLICE_BYTES = 1 << 18
NEVER = -np.inf


def _sums(values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log sums of values with equal keys, which follow each other, and their first rows."""
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return np.logaddexp.reduceat(values, heads, axis=0), heads


class Trie:
    """Pieces as a trie over bytes."""

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
        self.size = len(pieces)
        self.longest = max(map(len, pieces), default=1)

    def edges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and number of each piece that begins at one of ``starts`` and ends by its ``ends``."""
        at, state, depth = starts, np.zeros(len(starts), np.int32), 0
        begins, stops, pieces = [], [], []
        while len(at):
            state = self.next[state, data[at + depth]]
            depth += 1
            alive = state > 0
            at, ends, state = at[alive], ends[alive], state[alive]
            piece = self.piece[state]
            some = piece >= 0
            begins.append(at[some])
            stops.append(begins[-1] + depth)
            pieces.append(piece[some])
            going = at + depth < ends
            at, ends, state = at[going], ends[going], state[going]
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) if x else none for x in (begins, stops, pieces))


class Words:
    """The lattice of several short words: positions are bytes, and one more at the end of each."""

    def __init__(self, trie: Trie, words: list[bytes]):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(words)), lengths)
        source, target, piece = trie.edges(data, np.arange(len(data)), (begin + lengths)[word])
        owner = word[source]
        self.source, self.target, self.piece = source + owner, target + owner, piece
        self.from_byte, self.to_byte = source - begin[owner], target - begin[owner]
        self.first = begin + np.arange(len(words))
        self.last = self.first + lengths
        self.longest = int(lengths.max(initial=0))
        self.positions = len(data) + len(words)

    def _steps(self, byte: np.ndarray, position: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        order = np.lexsort((position, byte))
        cuts = np.searchsorted(byte[order], np.arange(self.longest + 2))
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                chosen = order[a:b]
                yield self.source[chosen], self.target[chosen], self.piece[chosen]

    def forward(self, weight: np.ndarray) -> np.ndarray:
        """Log sum over segmentations up to each position; ``weight``: pieces x columns."""
        alpha = np.full((self.positions, weight.shape[1]), NEVER)
        alpha[self.first] = 0.0
        for source, target, piece in self._steps(self.to_byte, self.target):
            total, heads = _sums(alpha[source] + weight[piece], target)
            alpha[target[heads]] = total
        return alpha

    def expected(self, weight: np.ndarray, times: np.ndarray) -> np.ndarray:
        alpha = self.forward(weight[:, None])[:, 0]
        beta = np.full(self.positions, NEVER)
        # Counted down by what a word weighs, so that shares come out weighted.
        beta[self.last] = np.log(times) - alpha[self.last]
        found = np.zeros(len(weight))
        for source, target, piece in reversed(list(self._steps(self.from_byte, self.source))):
            onward = weight[piece] + beta[target]
            found += np.bincount(piece, weights=np.exp(alpha[source] + onward), minlength=len(found))
            total, heads = _sums(onward, source)
            beta[source[heads]] = total
        return found


def _windows(trie: Trie, word: bytes) -> list[tuple[int, int]]:
    return [(b, min(b + WINDOW, len(word))) for b in range(0, len(word), WINDOW)]


def _window_edges(trie: Trie, word: bytes, begin: int, end: int, by_target: bool):
    """Edges that begin in a window, as places within it, with the borders of equal targets (or sources)."""
    data = np.frombuffer(word[begin : end + trie.longest], np.uint8)
    source, target, piece = trie.edges(data, np.arange(end - begin), np.full(end - begin, len(data)))
    order = np.argsort(target if by_target else source, kind="stable")
    source, target, piece = source[order], target[order], piece[order]
    key = target if by_target else source
    borders = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist()
    return source, target, piece, key, [*borders, len(key)]


def _long_forward(trie: Trie, word: bytes, weight: np.ndarray, keep: bool = False) -> np.ndarray:
    """Log sums at the end of a long word, or at all its positions."""
    columns = weight.shape[1]
    ahead, kept = np.zeros((1, columns)), []
    for begin, end in _windows(trie, word):
        size = end - begin
        alpha = np.full((size + trie.longest + 1, columns), NEVER)
        alpha[: len(ahead)] = ahead
        source, target, piece, key, borders = _window_edges(trie, word, begin, end, True)
        for a, b in zip(borders, borders[1:], strict=False):
            into = np.logaddexp.reduce(alpha[source[a:b]] + weight[piece[a:b]], axis=0)
            alpha[key[a]] = np.logaddexp(alpha[key[a]], into)
        ahead = alpha[size:]
        if keep:
            kept.append(alpha[:size])
    return np.concatenate([*kept, ahead[:1]]) if keep else ahead[0]


def _long_expected(trie: Trie, word: bytes, weight: np.ndarray, times: float) -> np.ndarray:
    alpha = _long_forward(trie, word, weight[:, None], keep=True)[:, 0]
    found = np.zeros(len(weight))
    after = np.full(trie.longest + 1, NEVER)
    after[0] = np.log(times) - alpha[-1]
    for begin, end in reversed(_windows(trie, word)):
        size = end - begin
        beta = np.concatenate([np.full(size, NEVER), after])
        source, target, piece, key, borders = _window_edges(trie, word, begin, end, False)
        for a, b in reversed(list(zip(borders, borders[1:], strict=False))):
            beta[key[a]] = np.logaddexp.reduce(weight[piece[a:b]] + beta[target[a:b]])
        share = np.exp(alpha[begin + source] + weight[piece] + beta[target])
        found += np.bincount(piece, weights=share, minlength=len(found))
        after = beta[: trie.longest + 1]
        if len(after) <= trie.longest:
            after = np.append(after, np.full(trie.longest + 1 - len(after), NEVER))
    return found


def _short(words: list[bytes], chosen: np.ndarray) -> Iterator[np.ndarray]:
    """The short ones among the chosen words, in slices of about ``SLICE_BYTES``, alike lengths together."""
    lengths = np.fromiter((len(words[i]) for i in chosen), np.int64, len(chosen))
    chosen = chosen[np.argsort(lengths, kind="stable")]
    total = np.cumsum(np.sort(lengths))
    cuts = np.searchsorted(total, np.arange(0, int(total[-1]) if len(total) else 0, SLICE_BYTES))
    yield from (x for x in np.split(chosen, cuts) if len(x))


def forward(trie: Trie, words: list[bytes], weight: np.ndarray) -> np.ndarray:
    """Log sum over all segmentations of each word; ``weight``: pieces x columns."""
    out = np.zeros((len(words), weight.shape[1]))
    is_long = np.fromiter((len(w) > LONG for w in words), bool, len(words))
    for chosen in _short(words, np.flatnonzero(~is_long)):
        part = Words(trie, [words[i] for i in chosen])
        out[chosen] = part.forward(weight)[part.last]
    for i in np.flatnonzero(is_long):
        out[i] = _long_forward(trie, words[i], weight)
    return out


def expected(trie: Trie, words: list[bytes], times: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected number of each piece in words that occur ``times`` times."""
    found = np.zeros(len(weight))
    is_long = np.fromiter((len(w) > LONG for w in words), bool, len(words))
    for chosen in _short(words, np.flatnonzero(~is_long)):
        found += Words(trie, [words[i] for i in chosen]).expected(weight, times[chosen])
    for i in np.flatnonzero(is_long):
        found += _long_expected(trie, words[i], weight, float(times[i]))
    return found
