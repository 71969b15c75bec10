"""Recompression of word sequences: rounds that name runs and pairs of symbols, the same names everywhere.

A round first names each run of one symbol by the symbol and the run's length, then each pair of neighbours whose
first symbol is on the left side and whose second is on the right side of a split of all names. Names are hashes of
what they stand for and the split is a bit of a hash, so every task gives equal content equal names without a shared
dictionary. Beside each symbol stands its context: the words that decide that the symbol is there. Wherever the same
words stand, the symbol stands too.
"""

from __future__ import annotations

import numpy as np

from tablescope.llm.common import mix

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
#: A context that reaches beyond an end of the text.
BEYOND = 1 << 40


def _accumulate(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Ranges:
    """Hashes of any range of a sequence of names, the same wherever the range stands."""

    def __init__(self, names: np.ndarray, seed: int = 0):
        # every range hash is divided by a power of the base; the powers of the inverse are made once
        self.sums = np.zeros(len(names) + 1, np.uint64)
        np.cumsum(mix(names + np.uint64(seed)) * _accumulate(_STEP, len(names))[:-1], out=self.sums[1:])
        self.back = _accumulate(_BACK, len(names))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


class Symbols:
    """Symbols of a round: name, text, first word, and the words ``left`` to ``right`` that decide them."""

    def __init__(self, name, text, word, left, right):
        self.name, self.text, self.word, self.left, self.right = name, text, word, left, right

    @classmethod
    def of_words(cls, hashes: np.ndarray, text: np.ndarray) -> Symbols:
        at = np.arange(len(hashes))
        return cls(hashes, text, at, at, at + 1)

    def runs(self, level: int) -> Symbols:
        """Name maximal runs. What stands before and behind a run decides where it ends."""
        n = len(self.name)
        if not n:
            return self
        new = np.ones(n, bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.text[1:] != self.text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        length = (last - first + 1).astype(np.uint64)
        name = self.name[first]
        named = mix(name + mix(length + np.uint64(level << 8)))
        left = self.left[first].copy()
        right = self.right[last].copy()
        left[1:] = np.minimum(left[1:], self.left[first[1:] - 1])
        right[:-1] = np.maximum(right[:-1], self.right[last[:-1] + 1])
        edge = np.ones(len(first), bool)
        edge[1:] = self.text[first[1:]] != self.text[first[1:] - 1]
        left[edge] = -BEYOND
        right[np.append(edge[1:], True)] = BEYOND
        return Symbols(np.where(length > 1, named, name), self.text[first], self.word[first], left, right)

    def pairs(self, level: int) -> Symbols:
        """Name pairs of a left and a right symbol. A pair is decided by itself, any other symbol by its neighbour."""
        n = len(self.name)
        if n < 2:
            return Symbols(self.name, self.text, self.word, self.left - BEYOND, self.right + BEYOND)
        on_right = (mix(self.name + np.uint64(0xABCD + level)) >> np.uint64(63)).astype(bool)
        same = self.text[1:] == self.text[:-1]
        pair = ~on_right[:-1] & on_right[1:] & same
        begins, second = np.append(pair, False), np.append(False, pair)
        name, left, right = self.name.copy(), self.left.copy(), self.right.copy()
        j = np.flatnonzero(pair)
        name[j] = mix(self.name[j] * np.uint64(3) + mix(self.name[j + 1] + np.uint64(level)))
        left[j] = np.minimum(self.left[j], self.left[j + 1])
        right[j] = np.maximum(self.right[j], self.right[j + 1])
        alone = ~begins & ~second
        k = np.flatnonzero(alone & ~on_right)
        has = np.append(same, False)[k]
        right[k[has]] = np.maximum(right[k[has]], self.right[np.minimum(k[has] + 1, n - 1)])
        left[k[has]] = np.minimum(left[k[has]], self.left[np.minimum(k[has] + 1, n - 1)])
        right[k[~has]] = BEYOND
        k = np.flatnonzero(alone & on_right)
        has = np.append(False, same)[k]
        left[k[has]] = np.minimum(left[k[has]], self.left[np.maximum(k[has] - 1, 0)])
        right[k[has]] = np.maximum(right[k[has]], self.right[np.maximum(k[has] - 1, 0)])
        left[k[~has]] = -BEYOND
        kept = ~second
        return Symbols(name[kept], self.text[kept], self.word[kept], left[kept], right[kept])


def recompress(hashes: np.ndarray, text: np.ndarray, rounds: int) -> Symbols:
    symbols = Symbols.of_words(hashes, text)
    for level in range(rounds):
        symbols = symbols.runs(level).pairs(level)
    return symbols


def window_symbols(
    hashes: np.ndarray, text: np.ndarray, starts: np.ndarray, width: int, rounds: int
) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``width`` words from ``starts`` on: the key of one symbol, and the word where it stands.

    Among the symbols of the last round whose contexts lie within the window it is the one with the smallest key, so
    equal windows choose equal symbols in equal places. The key names the symbol together with its context. A window
    without such a symbol is a key of its own, at place ``-1 - start``.
    """
    symbols = recompress(hashes, text, rounds)
    ranges = Ranges(hashes)
    inner = np.flatnonzero((symbols.left > -BEYOND // 2) & (symbols.right < BEYOND // 2))
    inner = inner[symbols.right[inner] - symbols.left[inner] <= width]
    left, right, word = symbols.left[inner], symbols.right[inner], symbols.word[inner]
    keys = mix(ranges.of(left, right) ^ mix((word - left).astype(np.uint64) ^ symbols.name[inner]))
    # both ends of the contexts ascend along the text, so a window's symbols are neighbours
    low = np.searchsorted(left, starts)
    high = np.searchsorted(right, starts + width, side="right")
    size = np.maximum(high - low, 0)
    # smallest key of each range of symbols: minima over 1, 2, 4, ... symbols, two of which cover a range
    key = ranges.of(starts, starts + width) ^ np.uint64(0x5555555555555555)
    place = -1 - starts
    best = np.arange(len(keys))
    span = 1
    while (size >= span).any():
        now = np.flatnonzero((size >= span) & (size < 2 * span))
        if len(now):
            a, b = best[low[now]], best[high[now] - span]
            pick = np.where((keys[b] < keys[a]) | ((keys[b] == keys[a]) & (b < a)), b, a)
            key[now], place[now] = keys[pick], word[pick]
        if len(best) > span:
            a, b = best[:-span], best[span:]
            best = np.where(keys[b] < keys[a], b, a)
        else:
            break
        span *= 2
    return key, place
