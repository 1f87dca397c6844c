"""Personal data: exact patterns, and a linear-chain conditional random field over word-shape features.

The patterns give the base spans. The field is trained from a small labelled table (words of a bounded sample
of rows, tagged by the base spans or by any table of the caller), so it learns what personal data look like
beside their surroundings, and adds spans of that kind which the patterns miss; base spans always stay.

Features of a word are its shape (kinds of characters, counts of digits and dots, first and last character,
length) and the shapes of its neighbours in the line. Tasks decode whole lines by Viterbi in numpy batches:
a word whose score for "outside" beats every other tag by more than any transitions could win back is outside
on every best path, so such words part a line into short stretches, and only those need the recursion.

A NULL text counts as an empty one. Repeated rows are handled one by one. An empty table gives an empty
result and an untrained field, which adds nothing. Other columns pass through ``redact`` unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulus.llm.textops import NOT_BLANK, Piece, pieces, runs, table, thin

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + len(KINDS)
# Bounds of the labelled sample.
SAMPLE_TEXTS, SAMPLE_CHARS, SEGMENT = 500, 5000, 32

# The starts of runs only: a later start in the same run fails or succeeds with the same rest.
_EMAIL_TAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])" + _EMAIL_TAIL)
_EMAIL_HERE = re.compile(_EMAIL_TAIL)
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans per kind in the order of ``KINDS``: leftmost, non-overlapping, failing matches dropped."""
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    if "@" in text:
        at = 0
        while (m := _EMAIL_HERE.match(text, at) if at else None) or (m := _EMAIL.search(text, at)):
            out[0].append(m.span())
            at = m.end()
    if _DIGIT.search(text):
        if "." in text:
            out[1] = [m.span() for m in _IP.finditer(text) if all(
                len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = _digits(m[0])
                if 13 <= len(d) <= 19 and luhn(d):
                    out[2].append(m.span())
        if "+" in text:
            out[3] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# ---- word shapes

_CLASSES = {"digit": table(range(48, 58)), "lower": table(range(97, 123)), "upper": table(range(65, 91)),
            "at": table(b"@"), "dot": table(b"."), "plus": table(b"+"), "dash": table(b"-"), "paren": table(b"()"),
            "far": table(range(128, 256))}
_EDGE = np.full(256, 6, np.int64)
for _i, _c in enumerate(("lower", "upper", "digit", "plus", "paren", "far")):
    _EDGE[_CLASSES[_c]] = _i
_DIGIT_STEPS = np.array([1, 2, 3, 4, 5, 7, 10, 13, 20])
_LENGTH_STEPS = np.array([2, 4, 7, 10, 13, 16, 22])
_FLAGS, _DIGITS, _DOTS, _EDGES, _LENGTHS = 256, 10, 5, 7, 8
_OWN = (_FLAGS, _DIGITS, _DOTS, _EDGES, _EDGES, _LENGTHS)
_NEAR = _FLAGS * _DIGITS + 1  # the last value stands for "no neighbour"


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    line: np.ndarray
    own: np.ndarray    # (words, 6) feature values
    near: np.ndarray   # flags and digits as one value


def shapes(p: Piece) -> Words:
    s, e, row = runs(p, NOT_BLANK)
    counts = {}
    for name, member in _CLASSES.items():
        c = np.zeros(len(p.data) + 1, np.int32)
        np.cumsum(member[p.data], out=c[1:])
        counts[name] = c[e] - c[s]
    breaks = np.cumsum(p.data == 10, dtype=np.int32)
    line = breaks[s] + row if len(s) else np.zeros(0, int)
    flags = np.zeros(len(s), np.int64)
    for i, name in enumerate(("digit", "lower", "upper", "at", "plus", "dash", "paren", "far")):
        flags |= (counts[name] > 0).astype(np.int64) << i
    digits = np.searchsorted(_DIGIT_STEPS, counts["digit"], "right")
    own = np.stack([flags, digits, np.minimum(counts["dot"], _DOTS - 1), _EDGE[p.data[s]], _EDGE[p.data[e - 1]],
                    np.searchsorted(_LENGTH_STEPS, e - s, "right")], 1) if len(s) else np.zeros((0, 6), np.int64)
    return Words(s, e, row, line, own, flags * _DIGITS + digits)


def _neighbours(w: Words) -> tuple[np.ndarray, np.ndarray]:
    n = len(w.start)
    before, after = np.full(n, _NEAR - 1), np.full(n, _NEAR - 1)
    same = w.line[1:] == w.line[:-1]
    before[1:][same] = w.near[:-1][same]
    after[:-1][same] = w.near[1:][same]
    return before, after


@dataclass(frozen=True)
class Field:
    """Weights of a linear chain: own features, neighbours' features, transitions (state TAGS: line edge)."""

    own: tuple[np.ndarray, ...]
    before: np.ndarray
    after: np.ndarray
    step: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        before, after = _neighbours(w)
        out = self.before[before] + self.after[after]
        for i, t in enumerate(self.own):
            out += t[w.own[:, i]]
        return out


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def train(texts: list[str], tags=None, rounds: int = 120, rate: float = 0.15, ridge: float = 2e-4) -> Field | None:
    """Maximum likelihood by full-batch gradients. ``tags(text)`` gives labelled spans per kind (base spans)."""
    tags = tags or base_spans
    own, near_b, near_a, gold, seg = [], [], [], [], []
    offset = 0
    for p in pieces(pa.array(texts, pa.string())):
        w = shapes(p)
        before, after = _neighbours(w)
        y = np.zeros(len(w.start), np.int64)
        first = np.searchsorted(w.row, np.arange(p.hi - p.lo + 1))
        for i in range(p.hi - p.lo):
            text = texts[p.lo + i]
            lo, hi = first[i], first[i + 1]
            for k, spans in enumerate(tags(text)):
                for a, b in spans:
                    a, b = (p.at[i] + len(text[:x].encode()) for x in (a, b))
                    y[lo:hi][(w.start[lo:hi] < b) & (w.end[lo:hi] > a)] = k + 1
        new = np.ones(len(y), bool)
        new[1:] = w.line[1:] != w.line[:-1]
        at = np.arange(len(y))
        in_line = at - np.maximum.accumulate(np.where(new, at, 0))
        own.append(w.own)
        near_b.append(before)
        near_a.append(after)
        gold.append(y)
        seg.append(offset + np.cumsum(in_line % SEGMENT == 0))
        offset += len(y) + 1
    if not texts or not any(len(g) for g in gold):
        return None
    own, near_b, near_a, gold, seg = (np.concatenate(x) for x in (own, near_b, near_a, gold, seg))
    _, seg = np.unique(seg, return_inverse=True)
    # stretches with a digit or an at sign, and every eighth of the plain ones
    busy = np.bincount(seg, (own[:, 1] > 0) | ((own[:, 0] >> 3) & 1).astype(bool)) > 0
    use = (busy | (np.arange(len(busy)) % 8 == 0))[seg]
    own, near_b, near_a, gold = own[use], near_b[use], near_a[use], gold[use]
    _, seg = np.unique(seg[use], return_inverse=True)
    n_seg = int(seg.max()) + 1
    pos = np.arange(len(seg)) - np.searchsorted(seg, np.arange(n_seg))[seg]
    length = np.bincount(seg)
    tables = [np.zeros((n, TAGS)) for n in (*_OWN, _NEAR, _NEAR)]
    ids = [*own.T, near_b, near_a]
    step = np.zeros((TAGS + 1, TAGS + 1))
    grads2 = [np.zeros_like(t) for t in (*tables, step)]
    want = [np.stack([np.bincount(i[gold == y], minlength=len(t)) for y in range(TAGS)], 1) for i, t in zip(ids, tables)]
    full = np.full((n_seg, SEGMENT), 0)
    there = np.arange(SEGMENT) < length[:, None]
    full[seg, pos] = gold
    want_step = np.zeros_like(step)
    np.add.at(want_step, (TAGS, full[:, 0]), 1)
    np.add.at(want_step, (full[np.arange(n_seg), length - 1], TAGS), 1)
    both = there[:, 1:]
    np.add.at(want_step, (full[:, :-1][both], full[:, 1:][both]), 1)
    for _ in range(rounds):
        e = np.zeros((n_seg, SEGMENT, TAGS))
        e[seg, pos] = sum(t[i] for t, i in zip(tables, ids))
        inner = step[:TAGS, :TAGS]
        f, b = np.zeros_like(e), np.zeros_like(e)
        f[:, 0] = step[TAGS, :TAGS] + e[:, 0]
        for t in range(1, SEGMENT):
            go = _log_sum(f[:, t - 1, :, None] + inner, 1) + e[:, t]
            f[:, t] = np.where(there[:, t, None], go, f[:, t - 1])
        z = _log_sum(f[:, -1] + step[:TAGS, TAGS], 1)
        b[:, -1] = step[:TAGS, TAGS]
        for t in range(SEGMENT - 2, -1, -1):
            go = _log_sum(inner[None] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            b[:, t] = np.where(there[:, t + 1, None], go, step[:TAGS, TAGS])
        m = np.exp(f + b - z[:, None, None])[seg, pos]
        pair = np.exp(f[:, :-1, :, None] + inner + (e + b)[:, 1:, None, :] - z[:, None, None, None])
        got_step = np.zeros_like(step)
        got_step[:TAGS, :TAGS] = (pair * both[:, :, None, None]).sum((0, 1))
        got_step[TAGS, :TAGS] = np.exp(f[:, 0] + b[:, 0] - z[:, None]).sum(0)
        last = np.exp(f[:, -1] + step[:TAGS, TAGS] - z[:, None])
        got_step[:TAGS, TAGS] = last.sum(0)
        grads = [np.stack([np.bincount(i, m[:, y], len(t)) for y in range(TAGS)], 1) - w for i, t, w in zip(ids, tables, want)]
        grads.append(got_step - want_step)
        for t, g, g2 in zip((*tables, step), grads, grads2):
            g = g / n_seg + ridge * t
            g2 += g * g
            t -= rate * g / (np.sqrt(g2) + 1e-9)
    step[TAGS, TAGS] = 0
    return Field(tuple(tables[:6]), tables[6], tables[7], step)


def decode(field: Field, w: Words) -> np.ndarray:
    """The best tag of every word, lines decoded whole."""
    n = len(w.start)
    tag = np.zeros(n, np.int64)
    if not n:
        return tag
    e = field.emissions(w)
    step = field.step
    # what a word could win at most, over all neighbours, by leaving "outside"
    win = np.array([(step[:, k, None] + step[None, k, :] - step[:, 0, None] - step[None, 0, :]).max() for k in range(1, TAGS)])
    sure = (e[:, 0:1] > e[:, 1:] + win).all(1)
    open_ = np.flatnonzero(~sure)
    if not len(open_):
        return tag
    new = np.ones(len(open_), bool)
    new[1:] = (np.diff(open_) != 1) | (w.line[open_[1:]] != w.line[open_[:-1]])
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(open_)))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    a = open_[first]
    z = open_[first + length - 1]
    left = np.where((a > 0) & (w.line[a - 1] == w.line[a]), 0, TAGS)
    right = np.where((z < n - 1) & (w.line[np.minimum(z + 1, n - 1)] == w.line[z]), 0, TAGS)
    best = step[left][:, :TAGS] + e[a]
    back: list[np.ndarray] = []
    for t in range(1, int(length[0])):
        live = int(np.searchsorted(-length, -t, "left"))
        s = best[:live, :, None] + step[:TAGS, :TAGS]
        back.append(s.argmax(1))
        best[:live] = s.max(1) + e[a[:live] + t]
    now = (best + step[:TAGS, right].T).argmax(1)
    tag[z] = now
    for t in range(int(length[0]) - 1, 0, -1):
        live = int(np.searchsorted(-length, -t, "left"))
        now[:live] = back[t - 1][np.arange(live), now[:live]]
        tag[a[:live] + t - 1] = now[:live]
    return tag


def field_spans(field: Field, p: Piece) -> dict[int, list[tuple[int, int, int]]]:
    """Per row of the piece: (kind, start, end) in bytes of the row, marks at the edges trimmed."""
    w = shapes(p)
    tag = decode(field, w)
    out: dict[int, list[tuple[int, int, int]]] = {}
    at = np.flatnonzero(tag)
    if not len(at):
        return out
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (tag[at[1:]] != tag[at[:-1]]) | (w.line[at[1:]] != w.line[at[:-1]])
    first = np.flatnonzero(new)
    for i, j in zip(first, np.append(first[1:], len(at)) - 1):
        s, e, row = int(w.start[at[i]]), int(w.end[at[j]]), int(w.row[at[i]])
        body = p.data[s:e].tobytes()
        lead = len(body) - len(body.lstrip(b".,;:!?\"'<>[]{}="))
        body = body[lead:].rstrip(b".,;:!?\"'<>[]{}=")
        if body:
            base = int(p.at[row])
            out.setdefault(row, []).append((int(tag[at[i]]) - 1, s + lead - base, s + lead - base + len(body)))
    return out


def all_spans(field: Field | None, p: Piece) -> Iterator[tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]]:
    """For every row: base spans per kind, and all spans per kind, in code points."""
    extra = field_spans(field, p) if field is not None else {}
    for i in range(p.hi - p.lo):
        raw = p.row(i)
        text = raw.decode()
        base = base_spans(text)
        spans = [list(x) for x in base]
        more = extra.get(i)
        if more:
            # code point of every byte, and the ends reached so far of the base spans by start: one pass over the text
            point = np.concatenate([[0], np.cumsum((p.data[p.at[i]:p.at[i + 1]] & 0xC0) != 0x80)])
            own = np.array(sorted(x for of_kind in base for x in of_kind), np.int64).reshape(-1, 2)
            kinds, s, e = np.array(more).T
            s, e = point[s], point[e]
            before = np.searchsorted(own[:, 0], e)  # base spans that start before the end
            reach = np.concatenate([[0], np.maximum.accumulate(own[:, 1])])
            for kind, a, b in zip(*(x[reach[before] <= s].tolist() for x in (kinds, s, e))):
                spans[kind].append((a, b))
        yield base, [sorted(x) for x in spans]


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, own in zip(KINDS, spans) for s, e in own)


def labelled_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SAMPLE_TEXTS,
                   max_chars: int = SAMPLE_CHARS) -> list[str]:
    """At most ``n`` rows with a digit or an at sign, by hash of the key: the small table that is labelled.

    Texts of at most ``max_chars`` characters come first; where they are too few, longer ones fill the sample up with
    their first ``max_chars`` characters. The bound is one of rows: a key that many rows share counts once for each.
    """
    part = F.substring(text, 1, max_chars)
    fit = docs.select(F.col(key).alias("k"), part.alias("t"), (F.length(text) > max_chars).alias("outside"), F.xxhash64(F.col(key)).alias("h"))
    first = fit.where(F.col("t").rlike("[0-9@]")).orderBy("outside", "h", "k", "t").limit(n)
    return [r[0] for r in first.orderBy("k", "t").select("t").collect()]


def fitted(docs: DataFrame, **params) -> Field | None:
    return train(labelled_texts(docs, **params))


def find(docs: DataFrame, field: Field | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, counts of base spans per kind, digest of base spans, and all spans: one pass, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in thin(batches):
            counts, digest, spans = [], [], []
            for p in pieces(b.column(1)):
                for base, every in all_spans(held.value, p):
                    counts.append([len(x) for x in base])
                    digest.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(every))
            c = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c[:, i]) for i in range(len(KINDS))], pa.array(digest, pa.string()), pa.array(spans, pa.string())],
                names=["k", *[f"n_{x}" for x in KINDS], "base_sha256", "spans"])

    ddl = f"k {kind}, " + ", ".join(f"n_{x} long" for x in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, ddl).withColumnRenamed("k", key)


def _masked(text: str, spans: list[list[tuple[int, int]]]) -> str:
    flat = sorted((s, e, k) for k, own in zip(KINDS, spans) for s, e in own)
    out, at = [], 0
    for s, e, k in flat:
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """Every row in its own columns, each found span replaced by its kind in angle brackets; NULL stays NULL."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index(text)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in thin(batches):
            col = b.column(at)
            out = []
            for p in pieces(col):
                for i, (_, every) in enumerate(all_spans(held.value, p)):
                    out.append(_masked(p.row(i).decode(), every) if any(every) else p.row(i).decode())
            fresh = pa.array([x if ok else None for x, ok in zip(out, col.is_valid().to_pylist())], pa.string())
            yield b.set_column(at, pa.field(b.schema.field(at).name, pa.string()), fresh)

    return docs.mapInArrow(run, schema)
