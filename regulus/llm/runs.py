"""Periodic runs of words, found exactly by recompression.

A text's words are numbered and compressed level by level: block compression turns every maximal run a..a of one
symbol into one symbol, pair compression splits the alphabet in two halves by a hash and turns every pair of a left
and a right symbol into one. Equal stretches are therefore parsed alike except at their borders, and the longest
common extension (LCE) of two positions is read off the levels: upwards while whole symbols agree, downwards from the
first two that do not, a constant number of steps a level. One such grammar serves forward extensions, one over the
reversed words backward extensions.

Candidates. A run of period q that is at least 2q long covers two neighbouring points of the grid 0, q, 2q, ... So
all grid pairs of all periods are tried, n ln n in all; those whose words agree, and some of whose neighbours do, are
extended exactly both ways. A repetition found under a multiple of its period has the same bounds as under the period
itself, so the least period of equal bounds is the run's.

Many texts are compressed at once, each closed by a symbol of its own, so no match crosses texts. Everything stays in
one task: a text is worked on whole, about ``PIECE`` bytes of texts at a time, and grid pairs in slices of
``GRID`` pairs, so memory is bounded by the piece or by the longest single text.

NULL, empty and blank texts have no words and no run. A NULL key is never made periodic. Repeated rows give repeated
results, further columns are not read, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulus.llm.textops import mix, pieces, thin

LEAST_LENGTH = 12
GRID = 2_000_000
_SEEDS = 4


@dataclass
class _Level:
    """One compression step: symbols above, first child of each (and the end), and for every symbol below its
    parent and whether it is that parent's first child."""

    symbols: np.ndarray
    first: np.ndarray
    parent: np.ndarray
    starts: np.ndarray
    blocks: bool


class Grammar:
    """Run-length grammar of a sequence of integers; its last symbol must occur nowhere else."""

    def __init__(self, symbols: np.ndarray):
        self.base = symbols.astype(np.int64)
        self.levels: list[_Level] = []
        top, fresh = self.base, int(self.base.max(initial=0)) + 1
        while True:
            before = len(top)
            for step in (self._blocks, self._pairs):
                level = step(top, fresh)
                if level is not None:
                    self.levels.append(level)
                    top = level.symbols
                    fresh = max(fresh, int(top.max(initial=0)) + 1)
            if len(top) > 0.95 * before or len(top) < 8:
                return

    def _level(self, below: np.ndarray, starts: np.ndarray, blocks: bool, fresh: int) -> _Level:
        at = np.flatnonzero(starts)
        width = np.diff(np.append(at, len(below)))
        symbols = below[at]
        joint = np.flatnonzero(width > 1)
        # a block is its symbol and length, a pair its two symbols
        second = width[joint] if blocks else below[at[joint] + 1]
        _, name = np.unique(symbols[joint] * (max(fresh, len(below)) + 1) + second, return_inverse=True)
        symbols[joint] = fresh + name
        return _Level(symbols, np.append(at, len(below)), np.cumsum(starts) - 1, starts, blocks)

    def _blocks(self, below: np.ndarray, fresh: int) -> _Level | None:
        starts = np.ones(len(below), bool)
        starts[1:] = below[1:] != below[:-1]
        return None if starts.all() else self._level(below, starts, True, fresh)

    def _pairs(self, below: np.ndarray, fresh: int) -> _Level | None:
        best, most = None, 0
        for seed in range(_SEEDS):
            right = (mix(below.astype(np.uint64) + np.uint64(977 * (len(self.levels) + 1) + 31 * seed)) & np.uint64(1)).astype(bool)
            for side in (right, ~right):
                pair = ~side[:-1] & side[1:]
                n = int(np.count_nonzero(pair))
                if n > most:
                    best, most = pair, n
            if most >= 0.22 * len(below):
                break
        if best is None:
            return None
        starts = np.ones(len(below), bool)
        starts[1:] = ~best
        return self._level(below, starts, False, fresh)

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from ``i`` and from ``j`` (different positions) on agree, for arrays of positions."""
        n = len(i)
        a, b, query = i.astype(np.int64), j.astype(np.int64), np.arange(n)
        parted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        symbols = self.base
        for level in self.levels:
            # upwards: leave a level at its first disagreement, or when both sides begin a symbol of the next one
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            up: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for _ in range(3):
                same = symbols[a] == symbols[b]
                out.append((a[~same], b[~same], query[~same]))
                a, b, query = a[same], b[same], query[same]
                both = level.starts[a] & level.starts[b]
                up.append((a[both], b[both], query[both]))
                a, b, query = a[~both], b[~both], query[~both]
                if not len(a):
                    break
                step = 1
                if level.blocks:
                    step = np.minimum(level.first[level.parent[a] + 1] - a, level.first[level.parent[b] + 1] - b)
                a, b = a + step, b + step
            parted.append(tuple(np.concatenate(x) for x in zip(*out)))
            a, b, query = (np.concatenate(x) for x in zip(*up))
            a, b = level.parent[a], level.parent[b]
            symbols = level.symbols
        out = []
        while len(a):
            same = symbols[a] == symbols[b]
            out.append((a[~same], b[~same], query[~same]))
            a, b, query = a[same] + 1, b[same] + 1, query[same]
        parted.append(tuple(np.concatenate(x) for x in zip(*out)) if out else (a, b, query))
        a, b, query = parted.pop()
        for level, below in zip(reversed(self.levels), reversed([self.base, *(x.symbols for x in self.levels)][:-1])):
            # downwards: two different symbols differ within their children
            wide_a, wide_b = level.first[a + 1] - level.first[a], level.first[b + 1] - level.first[b]
            a, b = level.first[a], level.first[b]
            same = below[a] == below[b]
            step = np.where(same, np.minimum(wide_a, wide_b) if level.blocks else 1, 0)
            more = parted.pop()
            a, b, query = (np.concatenate(x) for x in ((a + step, more[0]), (b + step, more[1]), (query, more[2])))
        result = np.empty(n, np.int64)
        result[query] = a
        return result - i


def _grid(lengths: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) of all neighbouring grid points, in slices: both points lie in one text of at least 2q words."""
    periods = lengths // 2
    text = np.repeat(np.arange(len(lengths)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    pairs = (lengths[text] - 1) // q
    total = np.cumsum(pairs)
    lo = 0
    while lo < len(q):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + GRID, "right")))
        c = pairs[lo:hi]
        which = np.repeat(np.arange(lo, hi), c)
        i = np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)
        yield first[text[which]] + i * q[which], q[which]
        lo = hi


def _least_periods(start: np.ndarray, length: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    new = np.ones(len(q), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[new], length[new], q[new]


def find_runs(words: np.ndarray, lengths: np.ndarray, least: int = LEAST_LENGTH) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in this order; ``words`` holds one closing symbol after every text."""
    first = np.cumsum(lengths + 1) - lengths - 1
    n = len(words)
    if not n:
        return np.zeros((0, 4), np.int64)
    padded = np.concatenate((np.full(3, -1), words, np.full(3, -2)))
    forward = backward = None
    parts = []
    for x, q in _grid(lengths, first):
        keep = words[x] == words[x + q]
        x, q = x[keep], q[keep]
        # words agree at q apart over at least max(q, least - q) places around x, so over three more on one side
        need = np.maximum(q, least - q) >= 6
        agree = {d: padded[x + d + 3] == padded[np.minimum(x + q + d, n + 2) + 3] for d in (-3, -2, -1, 1, 2)}
        keep = ~need | (agree[1] & agree[2]) | (agree[-1] & agree[-2] & agree[-3])
        x, q = x[keep], q[keep]
        if not len(x):
            continue
        if forward is None or backward is None:
            # reversed: the closing symbol of the text before ends an extension, a new one stands before the first text
            forward, backward = Grammar(words), Grammar(np.concatenate((words[::-1], [words.max() + 1])))
        ahead, behind = forward.lce(x, x + q), backward.lce(n - x, n - (x + q))
        found = (ahead + behind >= q) & (ahead + behind + q >= least)
        parts.append(_least_periods((x - behind)[found], (ahead + behind + q)[found], q[found]))
    if not parts:
        return np.zeros((0, 4), np.int64)
    start, length, q = _least_periods(*(np.concatenate(c) for c in zip(*parts)))
    text = np.searchsorted(first, start, "right") - 1
    rows = np.stack((text, start - first[text], length, q), 1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def made_periodic(words: list[bytes], key: object) -> list[bytes]:
    """The contract's planted period: every tenth key, by crc32, repeats a stretch of its text from some word on."""
    if key is None or not words:
        return words
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[:n - a]


def _report(texts: list[list[bytes]], least: int) -> list[tuple]:
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = [np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts]
    flat = np.concatenate([x for i, t in enumerate(ids) for x in (t, [-1 - i])]) if ids else np.zeros(0, np.int64)
    flat = np.where(flat < 0, len(number) - 1 - flat, flat)
    rows = find_runs(flat, np.array([len(t) for t in texts], np.int64), least)
    edge = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    out = []
    for i, t in enumerate(texts):
        own = rows[edge[i]:edge[i + 1], 1:].tolist()
        digest = hashlib.sha256(b"".join(b"%d,%d,%d\n" % tuple(r) for r in own)).hexdigest()
        start = length = period = None
        if own:
            start, length, period = min(own, key=lambda r: (-r[1], r[0], r[2]))
            step = np.zeros(len(t) + 1, np.int64)
            for s, m, q in own:
                step[s + q] += 1
                step[s + m] -= 1
            t = [t[x] for x in np.flatnonzero(np.cumsum(step[:-1]) == 0)]
        out.append((len(own), start, length, period, None if start is None else 1000 * length // period, digest,
                    hashlib.sha256(b" ".join(t)).hexdigest()))
    return out


_FIELDS = [("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
           ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", planted: bool = False,
                  least: int = LEAST_LENGTH) -> DataFrame:
    """key, number of runs, the longest run, and digests of all runs and of the text without their repeats.

    A run is a maximal stretch of words with least period q that is at least max(``least``, 2q) words long. Words of a
    run after its first q are its repeats. ``planted`` makes every tenth text periodic first (``made_periodic``).
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in thin(batches):
            for p in pieces(b.column(1)):
                keys = b.column(0).slice(p.lo, p.hi - p.lo)
                # bytes.split parts at the six ASCII blanks
                texts = [p.row(i).split() for i in range(p.hi - p.lo)]
                if planted:
                    texts = [made_periodic(t, k) for t, k in zip(texts, keys.to_pylist())]
                columns = zip(*_report(texts, least))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS))],
                                                 names=["k", *(f for f, _ in _FIELDS)])

    out = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(
        run, f"k {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
             "collapsed_sha256 string")
    return out.withColumnRenamed("k", key)
