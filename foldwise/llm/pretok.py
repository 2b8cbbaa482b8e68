"""Vectorised pre-tokenisation without a regex engine.

Every code point gets a class (letter, number, other, space that joins the next token, ...);
classes that need lookahead are told apart by shifted comparisons. A finite automaton over
these classes marks token starts. Each class is a function state -> state; the closure of
those functions under composition is a small table, so the states before all characters come
from an associative scan: compose per column, scan the column totals, replay with entry states.
"""

from __future__ import annotations

import sys
import unicodedata
from itertools import chain

import numpy as np

L, N, O, Q2, Q3, SPL, WL, WM, E = range(9)  # classes
FRESH, IN_L, IN_N, IN_O, AFTER_SP, IN_WS, C1, C2 = range(8)  # states

# The code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
               0x3000]
#: End of the planes with letters and numbers.
PLANES = 0x40000
# Letters that follow an apostrophe in the pattern's contractions.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

_START = {L: IN_L, N: IN_N, O: IN_O, Q2: C1, Q3: C2, SPL: AFTER_SP, WL: FRESH, WM: IN_WS, E: FRESH}
_WS = 9  # white space before its lookahead is known; only inside classify()


def _step(state: int, cls: int) -> tuple[int, bool]:
    """(next state, does a token start before this character)."""
    if cls == E:
        return FRESH, True
    if state in (C1, C2):
        return (FRESH if state == C1 else C1), False
    word = cls if cls in (L, N) else O if cls in (O, Q2, Q3) else None
    goes_on = {IN_L: word == L, IN_N: word == N, IN_O: word == O, AFTER_SP: word is not None,
               IN_WS: cls == WM}.get(state, False)
    if goes_on:
        return (IN_WS if cls == WM else {L: IN_L, N: IN_N, O: IN_O}[word]), False
    return _START[cls], True


def _tables():
    delta = np.array([[_step(s, c)[0] for c in range(9)] for s in range(8)], np.uint8)
    starts = np.array([[_step(s, c)[1] for c in range(9)] for s in range(8)], bool)
    gens = [tuple(int(x) for x in delta[:, c]) for c in range(9)]
    ident = tuple(range(8))
    index, queue = {ident: 0}, [ident]
    for g in gens:
        if g not in index:
            index[g] = len(queue)
            queue.append(g)
    i = 0
    while i < len(queue):  # closure under "then apply a class"
        for g in gens:
            h = tuple(g[s] for s in queue[i])
            if h not in index:
                index[h] = len(queue)
                queue.append(h)
        i += 1
    maps = np.array(queue, np.uint8)
    m = len(queue)
    then = np.array([[index[tuple(int(maps[b][s]) for s in maps[a])] for b in range(m)] for a in range(m)], np.uint16)
    of_class = np.array([index[g] for g in gens], np.uint16)
    return delta, starts, maps, then, of_class


DELTA, STARTS, MAPS, THEN, OF_CLASS = _tables()
THEN_CLASS = THEN[:, OF_CLASS].astype(np.intp).reshape(-1)  # a map, then a class
# by state * 9 + class
NEXT_STATE, IS_START = (t.astype(np.uint8).tobytes().ljust(256, b"\0") for t in (DELTA, STARTS))
_classes: np.ndarray | None = None


def class_table() -> np.ndarray:
    """Class of every code point, by its Unicode category."""
    global _classes
    if _classes is None:
        t = np.full(sys.maxunicode + 1, O, np.uint8)
        # above, Unicode has no letters or numbers: tags, selectors and private use
        a = np.array([unicodedata.category(chr(c))[0] for c in range(PLANES)])
        t[:PLANES][a == "L"] = L
        t[:PLANES][a == "N"] = N
        t[WHITE_SPACE] = _WS
        _classes = t
    return _classes


def classify(cp: np.ndarray, seps: np.ndarray) -> np.ndarray:
    """Automaton classes of code points `cp`; positions `seps` hold the text separators."""
    raw = class_table()[cp]
    raw[seps] = E
    nxt = np.append(raw[1:], E)
    ws = raw == _WS
    last = (nxt != _WS) & (nxt != E)
    cls = raw
    ends = ws & last
    cls[ws & ~last] = WM
    cls[ends] = np.where(cp[ends] == 0x20, SPL, WL)
    q = np.flatnonzero(cp == ord("'"))
    if len(q):
        q = q[raw[q] != E]
        pad = np.append(cp, [0, 0])
        a, b = pad[q + 1], pad[q + 2]
        two = np.zeros(len(q), bool)
        for x, y in TWO_LETTERS:
            two |= (a == ord(x)) & (b == ord(y))
        cls[q[two]] = Q3
        cls[q[np.isin(a, [ord(x) for x in ONE_LETTER])]] = Q2
    return cls


def states_before(cls: np.ndarray, height: int = 64) -> np.ndarray:
    """State before every character, by the associative scan."""
    n = len(cls)
    width = -(-n // height)
    grid = np.full(width * height, E, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(width, height).T)  # column j: a run of the text
    total = np.zeros(width, np.intp)
    for row in grid:
        total = THEN_CLASS.take(total * 9 + row)
    step = 1
    while step < width:  # inclusive scan of the column functions
        total = np.concatenate([total[:step], THEN[total[:-step], total[step:]]])
        step *= 2
    state = np.empty(width, np.uint8)
    state[:1] = FRESH
    state[1:] = MAPS[total[:-1], FRESH]
    before = np.empty_like(grid)
    for k, row in enumerate(grid):
        before[k] = state
        state = np.frombuffer((state * 9 + row).tobytes().translate(NEXT_STATE), np.uint8)
    return before.T.reshape(-1)[:n]


def split(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All slices of the texts in order, and per text the index of its first slice (one more at the end)."""
    if not texts:
        return [], np.zeros(1, np.int64)
    joined = "\0".join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    seps = np.cumsum(lens + 1) - 1
    cls = classify(cp, seps)
    marks = (states_before(cls) * 9 + cls).tobytes().translate(IS_START)
    at = np.flatnonzero(np.frombuffer(marks, bool))
    real = cls[at] != E
    begins, ends = at[real], np.append(at[1:], len(cp))[real]
    first = np.searchsorted(begins, np.concatenate([[0], seps + 1]))
    return [joined[a:b] for a, b in zip(begins.tolist(), ends.tolist())], first


class _Rows(dict):
    """Slice -> row number; an unknown slice gets the next one and is noted in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, s: str) -> int:
        row = self[s] = len(self)
        self.new.append(s)
        return row


def one_by_one(encode):
    """encode_many of a function that encodes one slice to a list of ids."""
    def many(slices):
        found = [encode(s) for s in slices]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts
    return many


class SliceTable:
    """Ids of text slices, each distinct slice encoded once. When it holds `limit` slices, those that came in one call only
    go (or all, if more than half of them are left)."""

    def __init__(self, encode_many, limit: int = 600_000):
        """encode_many: slices -> (ids of all in a row, ids per slice)."""
        self.encode_many, self.limit = encode_many, limit
        self._clear()

    def _clear(self):
        self.rows = _Rows()
        self.used = 0
        self.starts, self.counts = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.again = np.zeros(1 << 12, bool)  # rows that came in a later call, too

    def _make_room(self):
        kept = np.flatnonzero(self.again[:len(self.rows)])
        if 2 * len(kept) > self.limit:
            kept = kept[:0]
        slices, rows = list(self.rows), _Rows()
        rows.update(zip([slices[i] for i in kept.tolist()], range(len(kept))))
        flat, ends = self._ids(kept)
        counts = self.counts[kept]
        self._clear()
        if len(kept):
            self.rows, self.used, self.flat, self.counts = rows, len(flat), flat, counts
            self.starts, self.again = ends[:-1], np.zeros(len(kept), bool)

    def _ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of rows, and where each begins (and the last ends)."""
        counts = self.counts[rows]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return self.flat[np.repeat(self.starts[rows] - ends[:-1], counts) + np.arange(ends[-1])], ends

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])

    def _add(self, new: list[str]):
        flat, counts = self.encode_many(new)
        n, base = len(self.rows), len(self.rows) - len(new)
        self.starts, self.counts = self._room(self.starts, n), self._room(self.counts, n)
        self.flat = self._room(self.flat, self.used + len(flat))
        self.starts[base:n] = self.used + np.cumsum(counts) - counts
        self.counts[base:n] = counts
        self.flat[self.used:self.used + len(flat)] = flat
        self.used += len(flat)

    def row_numbers(self, slices: list[str]) -> np.ndarray:
        if len(self.rows) >= self.limit:
            self._make_room()
        before = len(self.rows)
        rows = np.fromiter(map(self.rows.__getitem__, slices), np.int64, len(slices))
        self.again = self._room(self.again, len(self.rows))
        self.again[rows[rows < before]] = True
        if self.rows.new:
            self._add(self.rows.new)
            self.rows.new = []
        return rows

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated ids of all texts, and the offset of each text in them (one more at the end)."""
        slices, first = split(texts)
        rows = self.row_numbers(slices)
        ids, ends = self._ids(rows)
        return ids, ends[first]


def byte_of_char() -> dict[str, int]:
    """Inverse of the byte-level alphabet: printable bytes stand for themselves, the others
    follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def with_special(texts: list[str], special: dict[str, int], encode) -> tuple[np.ndarray, np.ndarray]:
    """`encode` for texts that may hold special strings: these become single ids, the parts
    between them are encoded alone, as a tokenizer with added tokens does."""
    if not special or not any(s in t for t in texts for s in special):
        return encode(texts)
    import regex
    pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")
    parts = [pattern.split(t) for t in texts]
    plain = [p for ps in parts for p in ps[::2]]
    ids, offs = encode(plain)
    out, ends, k = [], [0], 0
    for ps in parts:
        size = 0
        for j, p in enumerate(ps):
            if j % 2:
                out.append(np.array([special[p]], np.uint32))
            else:
                out.append(ids[offs[k]:offs[k + 1]])
                k += 1
            size += len(out[-1])
        ends.append(ends[-1] + size)
    return np.concatenate(out), np.array(ends)
