"""Packing tokenised documents into fixed-length sequences, with bins certified by lower bounds.

Documents become pieces of at most ``capacity`` tokens. Pieces are spread over partitions of bounded size and
packed there by best-fit decreasing. Dual feasible functions give a lower bound on the bins any packing of a
partition needs. A partition that meets it is certified: its bins are final but for the emptiest one, which
only exists because the partition's own sum was rounded up. In each following round partitions exchange
documents: those emptiest bins and all bins with room of partitions above their bound are dealt anew, by another
hash and over as few partitions of the same size as hold them, and packed again by best-fit decreasing, with new bounds. After ``rounds`` rounds what is left is
kept as packed; ``gap`` in the result says how many bins its partition is above its bound.

A NULL text is an empty one: one piece that holds only the end token. Only documents longer than the capacity
are cut. Repeated rows are packed one by one, and no key is used to place rows, so hot keys and copies do not
gather anywhere. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulus.llm.textops import thin
from regulus.session import cut

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
END = 0
PIECES_PER_PARTITION = 40_000
ROUNDS = 3
CACHE_WORDS = 200_000
# The vocabulary's own rule for parting normalised text, over ASCII and Latin-1 letters (fixed by the vocabulary).
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-\xff]+")
# Other characters may change under NFC or lower-casing, or count as letters, digits or blanks by other rules.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf-\xff]|<\\|")
_CONTROL = re.compile("[\x1c-\x1f]")
PIECE_DDL = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class Recent(dict):
    """Values of ``make`` by key, remembered within bounds in two generations: when the young one (this mapping) is full it
    becomes the old one, whose own entries go unless they were asked for meanwhile. So frequent entries stay
    however many rare ones pass."""

    def __init__(self, make: Callable[[str], bytes], size: int):
        super().__init__()
        self.make, self.size = make, size
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


class Encoder:
    """Ids of a text as little-endian 32-bit bytes, recent parts of words remembered.

    A text of usual characters (ASCII and Latin-1 letters and marks, which NFC keeps) is lower-cased and parted by the
    vocabulary's rule, and each part goes to the library's model. White space always parts tokens of this vocabulary,
    so in other texts only words with unusual characters go through the library's whole chain; texts with
    control characters that part words in Python but not there do so as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts, self.words = Recent(self._part, CACHE_WORDS), Recent(self._whole, CACHE_WORDS // 10)
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256
        keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
        other = iter(range(256, 512))
        self.alphabet = {b: chr(b if b in keep else next(other)) for b in range(256)}

    def _part(self, s: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(s.encode().decode("latin-1").translate(self.alphabet))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _usual(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, _PARTS.findall(text.lower())))

    def _word(self, w: str) -> bytes:
        return self.words[w] if _UNUSUAL.search(w) else self._usual(w)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not _UNUSUAL.search(text):
            return self._usual(text)
        return self._whole(text) if _CONTROL.search(text) else b"".join([self._word(w) for w in text.split()])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder a worker process: later tasks of the process find its words."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece; ``uid`` numbers the rows of the written table."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        uid = TaskContext.get().partitionId() << 36
        end = np.array([END], "<u4").tobytes()
        for b in thin(batches):
            keys, col = b.column(0).to_pylist(), b.column(1)
            rows: list[tuple] = []
            for i, k in enumerate(keys):
                ids = enc.encode(col[i].as_py()) + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((uid, k, n, at // 4, len(part) // 4, zlib.crc32(part)))
                    uid += 1
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
                pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, PIECE_DDL)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Best of three families of dual feasible functions over integer sizes (at least the sum bound)."""
    size, n = np.unique(lengths, return_counts=True)
    if not len(size):
        return 0
    best = -(-int((size * n).sum()) // capacity)
    c = capacity
    # f_eps: sizes above c - e count a whole bin, sizes below e nothing
    for e in np.unique(size[size <= c // 2]):
        v = np.where(size > c - e, c, np.where(size < e, 0, size))
        best = max(best, -(-int((v * n).sum()) // c))
    for k in range(1, 65):
        # u_k: floor((k + 1) x) / k unless (k + 1) x is whole
        t = size * (k + 1)
        v = np.where(t % c == 0, size * k, (t // c) * c)
        best = max(best, -(-int((v * n).sum()) // (k * c)))
    for d in range(2, min(c // 2, 130)):
        # steps of width d: sizes above the half count the steps their complement leaves
        steps = c // d
        half = size * 2
        v = np.where(half > c, 2 * (steps - (c - size) // d), np.where(half == c, steps, 2 * (size // d)))
        best = max(best, -(-int((v * n).sum()) // (2 * steps)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number of every item and its offset there. Open bins are kept by free space; a bitmap of the
    free spaces in use finds the tightest one in a few steps."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    n = 0
    for i in order.tolist():
        size = int(lengths[i])
        fits = used >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                used &= ~(1 << free)
        else:
            free, b = capacity, n
            n += 1
        bins[i], offsets[i] = b, capacity - free
        left = free - size
        if left:
            by_free[left].append(b)
            used |= 1 << left
    return bins, offsets


def _packer(capacity: int, last: bool):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        lengths = g["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        total = int(bins.max()) + 1
        gap = total - lower_bound(lengths, capacity)
        fill = np.bincount(bins, lengths, total)
        if last:
            done = np.full(len(g), True)
        elif gap == 0:
            done = bins != int(np.argmin(fill)) if fill.min() < capacity else np.full(len(g), True)
        else:
            done = fill[bins] == capacity
        part = int(g["part"].iloc[0])
        return pd.DataFrame({"uid": g["uid"], "part": part, "bin": bins, "offset": offsets, "length": lengths, "gap": gap,
                             "done": done})
    return run


def pack(items: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION, rounds: int = ROUNDS) -> DataFrame:
    """uid, sequence_id, offset, gap for rows (uid, length) of a written table with distinct ``uid``.

    Each round is written, so a lost executor repeats one round at most.
    """
    n = items.count()
    parts = max(1, -(-n // per_partition))
    left, closed = items.select("uid", "length"), None
    for r in range(rounds + 1):
        last = r == rounds
        dealt = left.withColumn("part", F.pmod(F.xxhash64(F.lit(r), "uid"), F.lit(parts)).cast("int"))
        packed = cut(dealt.groupBy("part").applyInPandas(
            _packer(capacity, last), "uid long, part int, bin long, offset long, length long, gap long, done boolean"))
        final = packed.where("done").select(
            "uid", (F.lit(r).cast("long") * F.lit(1 << 58) + F.col("part").cast("long") * F.lit(1 << 32) + F.col("bin")).alias("sequence_id"),
            "offset", "gap")
        closed = final if closed is None else closed.unionByName(final)
        left = packed.where("not done").select("uid", "length")
        rest = left.count()
        if last or not rest:
            return closed
        parts = max(1, -(-rest // per_partition))
    return closed


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text",
                     **params) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap of every piece."""
    table = cut(pieces(docs, path, capacity, key, text))
    return table.join(pack(table, capacity, **params), "uid").drop("uid")
