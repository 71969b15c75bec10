"""A byte-level BPE tokenizer compiled to finite-state machines.

Two deterministic machines stand for the tokenizer:

* The *cutter* reads classes of characters and marks where the tokenizer's pattern cuts a text into pieces. It has a
  dozen states, so what a chunk of any length does is a map from states to states. The maps of all chunks are found
  in lockstep and composed by a parallel prefix scan; then every chunk is read again from its known first state.
* The *merger* reads the bytes of a piece. Each transition carries the number of tokens by which the encoding of the
  prefix grows (it may shrink: a byte can join tokens), and each state knows the last token of the prefix. All pieces
  of a slice are read in lockstep.

The merger is determinised while it is read. For every prefix the last token is the only token that ends there and
may follow the last token of the prefix before it. What later bytes can still ask for are the places from which some
token may reach beyond the prefix; a state is these places: the node of the vocabulary's trie that the bytes from
there spell, the last token before the place, and the number of tokens since.
"""

from __future__ import annotations

import json
import re
import sys
import types
import zlib

import numpy as np

#: States of the merger beyond which it is compiled anew (about 500 bytes each, transitions included).
MOST_STATES = 300_000
#: Characters that one lane of the cutter reads.
LANE = 128
#: Lanes of the merger below which single steps are cheaper.
FEW = 24
#: Bytes of one text that are cut and merged at a time.
WINDOW = 1 << 20

# --- classes of characters -------------------------------------------------------------------------------------
LETTER, STMD, R, V, E, L, NUMBER, MARK, APOSTROPHE, SPACE, WHITE, END = range(12)


def character_classes(path: str) -> bytes:
    """The class of every code point as the tokenizer itself takes it, compressed.

    A letter is what does not end a run of letters, and so on; so the table agrees with the library's Unicode version.
    """
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(path).pre_tokenizer
    kind = np.full(0x110000, WHITE, np.uint8)
    samples = (("!", MARK), ("a", LETTER), ("1", NUMBER))
    for first in range(0, 0x110000, 256):
        points = [p for p in range(first, first + 256) if not 0xD800 <= p < 0xE000]
        if not points:
            continue
        alike = "".join(map(chr, points))
        for sample, name in samples:
            if len(cut.pre_tokenize_str(sample + alike)) == 1:  # most blocks are all letters or all marks
                kind[points] = name
                break
        else:
            for sample, name in samples:
                pieces = cut.pre_tokenize_str("".join(sample + c for c in alike))
                begins = np.zeros(2 * len(points) + 1, bool)
                begins[[start for _, (start, _) in pieces]] = True
                kind[np.array(points)[~begins[1 : 2 * len(points) : 2]]] = name
    for letters, name in (("stmd", STMD), ("r", R), ("v", V), ("e", E), ("l", L), ("'", APOSTROPHE), (" ", SPACE)):
        kind[[ord(c) for c in letters]] = name
    return zlib.compress(kind.tobytes())


# --- the cutter ------------------------------------------------------------------------------------------------
(FRESH, LETTERS, NUMBERS, MARKS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, ONE_SPACE, ONE_WHITE, SPACE_LAST, WHITE_LAST) = range(12)
_HERE, _BEFORE = 1, 2  # a piece begins at this character; at the one before it


def _cutter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and cuts, by 16 * class + state."""
    letters, blanks = (LETTER, STMD, R, V, E, L), (SPACE, WHITE)

    def fresh(c: int) -> int:
        if c in letters:
            return LETTERS
        return {NUMBER: NUMBERS, MARK: MARKS, APOSTROPHE: QUOTE, SPACE: ONE_SPACE, WHITE: ONE_WHITE}[c]

    def step(q: int, c: int) -> tuple[int, int]:
        if c == END:  # of a text: what follows begins anew
            return FRESH, _BEFORE if q in (QUOTE_R, QUOTE_V, QUOTE_L) else 0
        if q == FRESH:
            return fresh(c), _HERE
        if q in (QUOTE_R, QUOTE_V, QUOTE_L):
            if c == (L if q == QUOTE_L else E):
                return FRESH, 0
            return (LETTERS, _BEFORE) if c in letters else (fresh(c), _BEFORE | _HERE)
        if q == QUOTE and c in (STMD, R, V, L):
            return {STMD: FRESH, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[c], 0
        if q in (QUOTE, MARKS) and c in (MARK, APOSTROPHE):
            return MARKS, 0
        if (q == LETTERS and c in letters) or (q == NUMBERS and c == NUMBER):
            return q, 0
        if q in (ONE_SPACE, ONE_WHITE, SPACE_LAST, WHITE_LAST):
            if c in blanks:
                return (SPACE_LAST if c == SPACE else WHITE_LAST), 0
            cuts = _BEFORE if q in (SPACE_LAST, WHITE_LAST) else 0
            if q in (ONE_SPACE, SPACE_LAST):  # the last space belongs to what follows
                return (MARKS if c == APOSTROPHE else fresh(c)), cuts
            return fresh(c), cuts | _HERE
        return fresh(c), _HERE

    nexts, cuts = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
    for c in range(12):
        for q in range(12):
            nexts[16 * c + q], cuts[16 * c + q] = step(q, c)
    return nexts, cuts


_NEXT, _CUTS = (table.tobytes() for table in _cutter())
_STATES = 12


def _look_up(table: bytes, at: np.ndarray) -> np.ndarray:
    return np.frombuffer(at.tobytes().translate(table), np.uint8).reshape(at.shape)


def compose_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan over maps of states (one row each): row ``i`` becomes what rows ``0..i`` do in turn."""
    out = maps.copy()
    span = 1
    while span < len(out):
        out[span:] = np.take_along_axis(out[span:], out[:-span].astype(np.intp), 1)
        span *= 2
    return out


def cut_marks(kinds: np.ndarray, first: int = FRESH, lane: int = LANE) -> np.ndarray:
    """Whether a piece begins at each character of a sequence of classes, read from state ``first`` on."""
    n = len(kinds)
    lanes = -(-n // lane)
    grid = np.full(lanes * lane, END, np.uint8)
    grid[:n] = kinds
    shifted = np.ascontiguousarray(grid.reshape(lanes, lane).T) << 4
    maps = np.repeat(np.arange(_STATES, dtype=np.uint8)[:, None], lanes, 1)
    for row in shifted:
        maps = _look_up(_NEXT, row | maps)
    state = np.full(lanes, first, np.uint8)
    state[1:] = compose_maps(np.ascontiguousarray(maps.T))[:-1, first]
    cuts = np.empty((lane, lanes), np.uint8)
    for k, row in enumerate(shifted):
        at = row | state
        cuts[k] = _look_up(_CUTS, at)
        state = _look_up(_NEXT, at)
    cuts = cuts.T.reshape(-1)
    begins = (cuts & _HERE).astype(bool)
    begins[:-1] |= (cuts[1:] & _BEFORE).astype(bool)
    return begins[:n]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the place of each one's first byte."""
    if not len(data) or int(data.max()) < 0x80:
        return data.astype(np.int32), np.arange(len(data))
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    points = lead.copy()
    for least, bits, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        wide = np.flatnonzero(lead >= least)
        value = lead[wide] & bits
        for k in range(1, more + 1):
            value = (value << 6) | (data[np.minimum(at[wide] + k, len(data) - 1)] & 0x3F)
        points[wide] = value
    return points, at


# --- the merger ------------------------------------------------------------------------------------------------
def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as code points from 256 on."""
    out, others = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            out[chr(byte)] = byte
        else:
            out[chr(others)] = byte
            others += 1
    return out


_NEVER = 1 << 60
_ROOT, _NONE = 0, -1


class Merger:
    """The machine of merges; its transitions are compiled when they are first met."""

    def __init__(self, model: dict, most_states: int = MOST_STATES):
        bytes_of = _byte_of_character()
        names = {name: bytes(bytes_of[c] for c in name) for name in model["vocab"]}
        self.length = np.zeros(max(model["vocab"].values()) + 1, np.int32)
        self.child: dict[int, int] = {}
        self.token_at = [_NONE]
        self.inner = [True]
        for name, token in model["vocab"].items():
            self.length[token] = len(names[name])
            node = _ROOT
            for byte in names[name]:
                self.inner[node] = True
                node = self.child.setdefault(node << 8 | byte, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(_NONE)
                    self.inner.append(False)
            self.token_at[node] = token
        self.rank: dict[tuple[int, int], int] = {}
        halves: dict[int, tuple[int, int, int]] = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, made = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.rank[left, right] = k
            halves.setdefault(made, (left, right, k))
        self.halves = halves
        self.may_follow: dict[tuple[int, int], bool] = {}
        self.most_states = most_states
        self.clear()

    def clear(self) -> None:
        self.may_follow.clear()
        self.number: dict[tuple, int] = {}
        self.state: list[tuple] = []
        self.last = np.full(1024, _NONE, np.int32)
        self.bits = 14
        self.used = 0
        self._empty_table()
        self.start = self._state(((_ROOT, _NONE, 0),), _NONE)

    def _empty_table(self) -> None:
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.nexts = np.zeros(1 << self.bits, np.int32)
        self.grows = np.zeros(1 << self.bits, np.int16)

    def _state(self, places: tuple, last: int) -> int:
        number = self.number.get(places)
        if number is None:
            number = self.number[places] = len(self.state)
            self.state.append(places)
            if number == len(self.last):
                self.last = np.concatenate([self.last, np.full(number, _NONE, np.int32)])
            self.last[number] = last
        return number

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """A token and its outermost parts on one side, each with the rank of the merge that takes it up."""
        out = [(token, _NEVER)]
        while token in self.halves:
            rank = self.halves[token][2]
            token = self.halves[token][side]
            out.append((token, rank))
        return out

    def follows(self, a: int, b: int) -> bool:
        """Whether token ``b`` may stand behind token ``a``: no merge across their border comes first.

        Parts that touch there are merged if that merge has a lower rank than the one that takes the left part up
        inside ``a``, and not a higher one than that for the right part inside ``b`` (equal merges go from the left).
        """
        known = self.may_follow.get((a, b))
        if known is None:
            lefts, rights = self._spine(a, 1), self._spine(b, 0)
            known = True
            for left, before in lefts:
                for right, until in rights:
                    rank = self.rank.get((left, right))
                    if rank is not None and rank < before and rank <= until:
                        known = False
            self.may_follow[a, b] = known
        return known

    def compile(self, key: int) -> tuple[int, int]:
        """Next state and growth of the transition ``state << 8 | byte``."""
        places, byte = self.state[key >> 8], key & 255
        token, grows = _NONE, 0
        reached = []
        for node, last, since in places:  # from the farthest place on
            node = self.child.get(node << 8 | byte, _NONE)
            if node == _NONE:
                continue
            if token == _NONE:
                t = self.token_at[node]
                if t != _NONE and (last == _NONE or self.follows(last, t)):
                    token, grows = t, 1 - since
            if self.inner[node]:
                reached.append((node, last, since))
        if token == _NONE:
            raise ValueError("the vocabulary does not hold every byte")
        kept = tuple((node, last, since + grows) for node, last, since in reached)
        return self._state((*kept, (_ROOT, token, 0)), token), grows

    def _add(self, key: np.ndarray, number: np.ndarray, grows: np.ndarray) -> None:
        """Put new transitions into the table, which is kept at most half full."""
        self.used += len(key)
        if 2 * self.used > len(self.keys):
            held = np.flatnonzero(self.keys >= 0)
            key = np.concatenate([self.keys[held], key])
            number = np.concatenate([self.nexts[held], number])
            grows = np.concatenate([self.grows[held], grows])
            while 2 * self.used > 1 << self.bits:
                self.bits += 1
            self._empty_table()
        slot = self._first_slot(key)
        todo = np.arange(len(key))
        while len(todo):  # all that find their slot free try to take it, one of them does
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = key[free]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = slot[todo] + 1 & len(self.keys) - 1
        self.nexts[slot], self.grows[slot] = number, grows

    def _first_slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def slots(self, key: np.ndarray) -> np.ndarray:
        """Where the transitions stand in the table; those not yet known are compiled."""
        slot = self._first_slot(key)
        todo = np.flatnonzero(self.keys[slot] != key)
        new = []
        while len(todo):
            found = self.keys[slot[todo]]
            new.append(todo[found == -1])
            todo = todo[(found != -1) & (found != key[todo])]
            slot[todo] = slot[todo] + 1 & len(self.keys) - 1
        if new and len(missing := np.concatenate(new)):
            unknown = np.unique(key[missing])
            made = np.array([self.compile(k) for k in unknown.tolist()], np.int64).reshape(-1, 2)
            bits = self.bits
            self._add(unknown, made[:, 0].astype(np.int32), made[:, 1].astype(np.int16))
            again = missing if bits == self.bits else np.arange(len(key))
            slot[again] = self.slots(key[again])
        return slot

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
        """Number of tokens of each piece; with ``last``, the last token of each prefix is left at its last byte."""
        if len(self.state) > self.most_states:
            self.clear()
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        begins, sizes = starts[order], size[order]
        lanes = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1 if len(sizes) else 1), side="right")
        state = np.full(len(starts), self.start, np.int64)
        count = np.zeros(len(starts), np.int64)
        for j, m in enumerate(lanes.tolist()):
            if m < FEW:
                for p in range(m):
                    state[p], more = self._walk(data, int(begins[p]) + j, int(begins[p] + sizes[p]), int(state[p]), last)
                    count[p] += more
                break
            at = begins[:m] + j
            slot = self.slots(state[:m] << 8 | data[at])
            state[:m] = self.nexts[slot]
            count[:m] += self.grows[slot]
            if last is not None:
                last[at] = self.last[state[:m]]
        out = np.empty_like(count)
        out[order] = count
        return out

    def _walk(self, data: np.ndarray, a: int, b: int, state: int, last: np.ndarray | None) -> tuple[int, int]:
        count = 0
        known: dict[int, tuple[int, int]] = {}
        for at, byte in enumerate(data[a:b].tolist(), a):
            key = state << 8 | byte
            step = known.get(key)
            if step is None:
                slot = self.slots(np.array([key], np.int64))[0]
                step = known[key] = (int(self.nexts[slot]), int(self.grows[slot]))
                if len(known) > self.most_states:
                    known.clear()
            state, grows = step
            count += grows
            if last is not None:
                last[at] = self.last[state]
        return state, count


# --- both ------------------------------------------------------------------------------------------------------
class Transducer:
    """Token counts and ids of whole texts, equal to those of the ``tokenizers`` library.

    Takes byte-level BPE files with the usual pattern, without normaliser or space in front. Strings of added tokens
    that stand in a text are tokens of their own, as is the library's default.
    """

    def __init__(self, path: str, classes: bytes, most_states: int = MOST_STATES):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, cut = whole["model"], whole["pre_tokenizer"] or {}
        plain = (
            model.get("type", "BPE") == "BPE"
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and cut.get("type") == "ByteLevel"
            and not cut.get("add_prefix_space")
            and cut.get("use_regex", True)
            and whole["normalizer"] is None
            and not any(t[k] for t in whole["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        )
        if not plain:
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        self.merger = Merger(model, most_states)
        self.kind = np.frombuffer(zlib.decompress(classes), np.uint8)
        self.added = {t["content"].encode(): t["id"] for t in whole["added_tokens"]}
        longest = sorted(self.added, key=lambda s: (-len(s), s))
        self.special = re.compile(b"|".join(map(re.escape, longest))) if longest else None

    def _spans(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Starts and ends of the parts between added tokens, and ``(start, end, id)`` of these tokens."""
        if self.special is None:
            return places[:-1], places[1:], []
        raw = data.tobytes()
        found = []
        starts, ends = [places[:-1]], [places[1:]]
        if self.special.search(raw):
            for t in range(len(places) - 1):
                found += [(m.start(), m.end(), self.added[m.group()]) for m in self.special.finditer(raw, int(places[t]), int(places[t + 1]))]
            starts.append(np.array([b for _, b, _ in found], np.int64))
            ends.append(np.array([a for a, _, _ in found], np.int64))
        return np.sort(np.concatenate(starts), kind="stable"), np.sort(np.concatenate(ends), kind="stable"), found

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of all parts; a piece never leaves its part."""
        full = ends > starts
        starts, ends = starts[full], ends[full]
        if not len(starts):
            return starts, ends
        points, at = code_points(data)
        kinds = self.kind[points]
        # an END behind each part; the bytes between parts (added tokens) are left out
        a, b = (starts, ends) if len(at) == len(data) else (np.searchsorted(at, starts), np.searchsorted(at, ends))
        part = np.repeat(np.arange(len(a)), b - a)
        line = np.full(len(part) + len(a), END, np.uint8)
        spot = np.arange(len(part)) + part
        if len(part) < len(at):
            kept = spot - part + (a - np.append(0, np.cumsum(b - a)[:-1]))[part]
            kinds, at = kinds[kept], at[kept]
        line[spot] = kinds
        first = np.flatnonzero(cut_marks(line)[spot])
        begins = at[first]
        # the next piece of the same part, or the part's end
        return begins, np.minimum(np.append(begins[1:], len(data)), ends[part[first]])

    def counts(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Number of tokens of each text."""
        out = np.zeros(len(places) - 1, np.int64)
        if len(out) == 1 and len(data) > 2 * WINDOW:
            out[0] = sum(int(self._counted(w, np.array([0, len(w)]))[0]) for w in self._windows(data))
            return out
        return self._counted(data, places)

    def _counted(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        starts, ends, found = self._spans(data, places)
        begins, closes = self.pieces(data, starts, ends)
        count = self.merger.run(data, begins, closes)
        sums = np.concatenate([[0], np.cumsum(count)])
        out = np.diff(sums[np.searchsorted(begins, places)])
        if found:
            np.add.at(out, np.searchsorted(places, [a for a, _, _ in found], side="right") - 1, 1)
        return out

    def ids(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another (unsigned 32 bits), and the places where the texts begin."""
        if len(places) == 2 and len(data) > 2 * WINDOW:
            made = [self._encoded(w, np.array([0, len(w)]))[0] for w in self._windows(data)]
            ids = np.concatenate(made)
            return ids, np.array([0, len(ids)])
        return self._encoded(data, places)

    def _encoded(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, found = self._spans(data, places)
        begins, closes = self.pieces(data, starts, ends)
        last = np.full(len(data), _NONE, np.int32)
        self.merger.run(data, begins, closes, last)
        token = np.full(len(data), _NONE, np.int32)
        # from the end of each piece back: the last token, then the last token of what is before it
        first, at = begins, closes
        while len(at):
            t = last[at - 1]
            at = at - self.merger.length[t]
            token[at] = t
            more = at > first
            first, at = first[more], at[more]
        for a, _, t in found:
            token[a] = t
        where = np.flatnonzero(token >= 0)
        return token[where].astype("<u4"), np.searchsorted(where, places)

    def _windows(self, data: np.ndarray):
        """A long text in parts that are cut where a piece begins, far from where the parts are read to."""
        a, size = 0, WINDOW
        while a < len(data):
            b = min(a + size, len(data))
            if b < len(data):
                while b > a and (data[b] & 0xC0) == 0x80:
                    b -= 1
                part = data[a:b]
                starts, ends, found = self._spans(part, np.array([0, len(part)]))
                begins, _ = self.pieces(part, starts, ends)
                # what the end of the window can still change: its last pieces, and an added token that it divides
                least = len(part) - max([len(s) for s in self.added], default=0) - 16
                safe = begins[:-3][begins[:-3] <= least]
                if not len(safe) or safe[-1] == 0:
                    size *= 2
                    continue
                b = a + int(safe[-1])
            yield data[a:b]
            a, size = b, WINDOW


def transducer(path: str, classes: bytes) -> Transducer:
    """The compiled tokenizer of this Python worker; later tasks of the worker find what earlier ones compiled."""
    kept = sys.modules.setdefault("_tablescope_compiled", types.ModuleType("_tablescope_compiled"))
    made = getattr(kept, "made", None)
    if made is None or made[0] != (path, classes):
        made = kept.made = ((path, classes), Transducer(path, classes))
    return made[1]
