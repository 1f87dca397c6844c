"""Arrow string batches as flat byte arrays: words, word hashes and shingles without a loop per row.

Text is handled in pieces of whole rows of about ``PIECE`` bytes, so memory in a worker is bounded by
the piece (or by the longest single text), never by the partition.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PIECE = 1 << 20
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9DDFEA08EB382D69
_BASE_INV = pow(_BASE, -1, 1 << 64)


def table(members: bytes | range, value: bool = True) -> np.ndarray:
    out = np.full(256, not value)
    out[list(members)] = value
    return out


NOT_BLANK = table(BLANKS, False)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# ASCII other than digits and lower-case letters separates words of the second kind.
LETTER_OR_DIGIT = np.array([c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 for c in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose low and high bits all depend on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Piece:
    """Rows ``lo`` to ``hi`` of a batch: their bytes, and where each row starts (one more at the end)."""

    lo: int
    hi: int
    data: np.ndarray
    at: np.ndarray

    def row(self, i: int) -> bytes:
        return self.data[self.at[i]:self.at[i + 1]].tobytes()


def pieces(column: pa.Array | pa.ChunkedArray, size: int = PIECE) -> Iterator[Piece]:
    """Whole rows of a string column as bytes; a NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield Piece(lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def thin(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches (views, no copies), so that Python objects are made for few rows at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
    give_back()


def give_back() -> None:
    """Return freed memory of this worker to the system: idle workers of earlier tasks stay alive for a while."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # only the GNU library has it


def runs(piece: Piece, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``member`` bytes that do not cross rows: starts, ends, row of each run."""
    n = len(piece.data)
    starts_of_rows = piece.at[:-1][piece.at[:-1] < n]
    inside = member[piece.data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[starts_of_rows] = inside[starts_of_rows]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = starts_of_rows[starts_of_rows > 0] - 1
    end[last] = inside[last]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(piece.at, s, "right") - 1


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = max(PIECE, n) + 2
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
        del _powers[:-2]
    return _powers[0], _powers[1]


# runs of so many bytes are hashed one by one
LONG_RUN = 32


def run_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every run, from one running sum over the piece.

    Sums of powers modulo 2^64 are equal for some different long strings whatever the base (Thue-Morse strings of 512 or
    1024 letters), so long runs get a digest of their bytes instead.
    """
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    out = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _MULT)
    for i in np.flatnonzero(e - s >= LONG_RUN):
        out[i] = int.from_bytes(hashlib.blake2b(data[s[i]:e[i]], digest_size=8).digest(), "little")
    return out


def chain(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive word hashes, ignoring rows: length ``len(words) - k + 1``."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64) * _MULT
    for i in range(k):
        h = (h ^ words[i:i + n]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return mix(h)


def word_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n)


def shingle_sets(piece: Piece, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of every row, sorted by row: (row, hash).

    A row with fewer words has its whole word sequence as its only shingle, a row without words none.
    """
    low = Piece(piece.lo, piece.hi, LOWER[piece.data], piece.at)
    s, e, row = runs(low, NOT_BLANK)
    w = run_hashes(low.data, s, e)
    h = chain(w, k)
    same = row[k - 1:] == row[:len(row) - k + 1] if len(row) >= k else np.zeros(0, bool)
    rows, hashes = row[:len(h)][same], h[same]
    n_rows = piece.hi - piece.lo
    counts = word_counts(row, n_rows)
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if n_rows else np.zeros(0, int)
    short_rows, short_hashes = [], []
    for m in range(1, k):
        at = np.flatnonzero(counts == m)
        if len(at):
            short_rows.append(at)
            short_hashes.append(chain(w, m)[first[at]])
    if short_rows:
        rows = np.concatenate([rows, *short_rows])
        hashes = np.concatenate([hashes, *short_hashes])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[keep], hashes[keep]


def n_letters_missing(text: str | None) -> bool:
    """True for a NULL text and for one without any letter."""
    return text is None or not any(map(str.isalpha, text))
