"""Suffix-array deduplication: remove every byte under a ``span``-byte string that starts anywhere else.

1. Anchors. The least hash of the 32-byte grams inside a ``span``-byte window is a function of the window's
   bytes, so equal windows have equal keys. Consecutive windows with one key form a run (about one run per
   85 bytes). A key that only one text has, and has once, certifies that all windows of its run are unique.
2. Shards. Runs whose key occurs again are sent to shards by key, each as the bytes its windows span. A shard
   sorts all suffixes of its distinct runs by Larsson-Sadakane refinement (prefix doubling that sorts only
   unfinished groups) and gets the common prefixes of neighbours by Kasai's rule in its permuted form; a window
   is repeated if a neighbour shares ``span`` bytes. Runs with equal bytes stand for each other.
3. Merging. A key of very many texts would make a shard large, so its runs are dealt over all shards by their
   bytes. What such shards cannot see in their own suffix arrays is merged across shards: every shard sends
   the sorted fingerprints of its windows, and merge tasks look the shards' lists up in one another by
   binary search.
4. Texts that occur more than once as a whole are removed entirely; one of them stands for all above.

Nothing is decided by a sample: all windows of all texts are covered by 1 to 4. Spans and fingerprints travel in
packed blobs. A NULL text is an empty one, texts shorter than ``span`` lose nothing. Matches never
cross rows. Repeated rows are copies of each other. Equality over 64-bit hashes (anchor keys, text names, and the
fingerprints of step 3) has a chance of error below 1e-6 for 10^7 texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulus.llm.textops import Piece, _power_tables, mix, pieces, thin
from regulus.session import cut, lookup_join, shuffle_partitions

SPAN = 200
GRAM = 32
SHARD_BYTES = 1_500_000
HOME_BYTES = 4_000_000
HOT_TEXTS = 256
BROADCAST_KEYS = 3_000_000
# bytes hashed at once: the arrays of eight bytes a position then stay in a core's cache
HASHED = 1 << 16


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive bytes."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n])


def _sliding(a: np.ndarray, w: int, best: np.ufunc) -> np.ndarray:
    """``best`` of every ``w`` consecutive values, by doubling."""
    step = 1
    while step * 2 <= w:
        a = best(a[:-step], a[step:])
        step *= 2
    return best(a[:-(w - step)], a[w - step:]) if w > step else a


def window_keys(p: Piece, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams of a piece, and the least in every window."""
    h = gram_hashes(p.data, gram)
    w = span - gram + 1
    return h, _sliding(h, w, np.minimum) if len(h) >= w else h[:0]


def repeated_keys(p: Piece, span: int = SPAN, gram: int = GRAM, known: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """(row, key) pairs, as a structure-free two-column array, of keys that more than one gram of a row supplies."""
    h, m = known or window_keys(p, span, gram)
    w = span - gram + 1
    if not len(m):
        return np.zeros((0, 2), np.uint64)
    edge = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(h == _sliding(np.concatenate([edge, m, edge]), w, np.maximum))
    row = np.searchsorted(p.at, at, "right") - 1
    pairs = np.stack([row.astype(np.uint64), h[at]], 1)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[1:][(pairs[1:] == pairs[:-1]).all(1)]


def window_runs(p: Piece, span: int = SPAN, gram: int = GRAM,
                known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key: row, first window (in the piece), number of windows, key."""
    _, m = known or window_keys(p, span, gram)
    none = np.zeros(0, np.int64)
    n = len(m)
    if not n:
        return none, none, none, np.zeros(0, np.uint64)
    row = np.repeat(np.arange(p.hi - p.lo), np.diff(p.at))[:n]
    ok = np.arange(n) + span <= p.at[row + 1]
    new = np.ones(n, bool)
    new[1:] = (m[1:] != m[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new & ok)
    # a row's last windows that fit end its runs: count fitting windows per run
    edges = np.flatnonzero(new)
    fit = np.add.reduceat(ok.astype(np.int64), edges)
    length = fit[np.searchsorted(edges, at)]
    return row[at], at, length, m[at]


def suffix_array(data: np.ndarray, lengths: np.ndarray, first: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all strings (given end to end) in order, and the rank of every position.

    A string's end sorts before any byte, ends in the order of the strings.
    """
    n = len(data)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
    padded = np.concatenate([data, np.zeros(first, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(first):
        key = (key << np.uint64(8)) | np.where(left > i, padded[i:n + i], 0).astype(np.uint64)
    sa = np.argsort(key, kind="stable")
    short = np.minimum(left, first)
    k = key[sa]
    new = np.ones(n, bool)
    new[1:] = k[1:] != k[:-1]
    # a zero byte and an end look alike in the first key: order such groups by what is left
    if not data.all() or (left < first).any():
        group = np.cumsum(new)
        sa = sa[np.lexsort((short[sa], group))]
        k, s = key[sa], short[sa]
        new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = start
    h = first
    longest = int(lengths.max()) if len(lengths) else 0
    single = new.copy()
    single[:-1] &= new[1:]
    active = np.flatnonzero(~single)
    while len(active) and h < longest:
        pos = sa[active]
        ahead = np.where(left[pos] > h, rank[np.minimum(pos + h, n - 1)] + 1, 0)
        joint = rank[pos] * (n + 1) + ahead
        order = np.argsort(joint, kind="stable")
        pos, joint = pos[order], joint[order]
        sa[active] = pos
        new = np.ones(len(active), bool)
        new[1:] = joint[1:] != joint[:-1]
        start = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]
        rank[pos] = start
        single = new.copy()
        single[:-1] &= new[1:]
        active = active[~single]
        h *= 2
    if len(active):
        # equal to their ends: the order of the strings decides
        pos = sa[active]
        sa[active] = pos[np.lexsort((pos, rank[pos]))]
    rank[sa] = np.arange(n)
    return sa, rank


def common_prefixes(data: np.ndarray, lengths: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the common prefix of every suffix (by position) with its predecessor in ``sa``.

    If the bytes before a suffix and before its predecessor are equal, the previous position's value less
    one is the answer (Kasai); only the other positions are compared, all at once, eight bytes a step.
    """
    n = len(data)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    string = np.repeat(np.arange(len(lengths)), lengths)
    i = np.arange(n)
    inner = (i > 0) & (before > 0)
    inner[1:] &= string[1:] == string[:-1]
    q = np.maximum(before, 1)
    inner &= string[q] == string[q - 1]
    inner[inner] = data[i[inner] - 1] == data[before[inner] - 1]
    # the rule also needs the previous suffix's predecessor to be the one just before this one's
    inner[inner] = before[i[inner] - 1] == before[inner] - 1
    out = np.zeros(n, np.int64)
    todo = np.flatnonzero(~inner & (before >= 0))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = padded[:n].astype(np.uint64)
    for b in range(1, 8):
        words = (words << np.uint64(8)) | padded[b:n + b]
    words = np.concatenate([words, np.zeros(1, np.uint64)])
    limit = np.minimum(left[todo], left[before[todo]])
    depth = np.zeros(len(todo), np.int64)
    live = np.arange(len(todo))
    while len(live):
        a, b = todo[live] + depth[live], before[todo[live]] + depth[live]
        x = words[np.minimum(a, n)] ^ words[np.minimum(b, n)]
        full = (x == 0) & (depth[live] + 8 < limit[live])
        stop = live[~full]
        y = x[~full]
        zero = np.full(len(y), 8)
        some = y != 0
        zero[some] = (63 - np.floor(np.log2(y[some].astype(np.float64))).astype(np.int64)) // 8
        # log2 of a number just under a power of two may round up to it
        fix = some & (zero < 8)
        top = np.zeros(len(y), np.uint64)
        top[fix] = (y[fix] >> ((7 - zero[fix]).astype(np.uint64) * np.uint64(8))) & np.uint64(0xFF)
        zero[fix & (top == 0)] += 1
        depth[stop] = np.minimum(depth[stop] + zero, limit[stop])
        depth[live[full]] += 8
        live = live[full]
    out[todo] = depth
    lead = np.maximum.accumulate(np.where(~inner, i, 0))
    return np.where(inner, np.maximum(out[lead] - (i - lead), 0), out)


def shared_suffixes(data: np.ndarray, lengths: np.ndarray, depth: int, first: int = 8) -> np.ndarray:
    """The part of the suffix array whose suffixes share their first ``depth`` bytes with a neighbour.

    Ranks by the first ``first`` bytes are refined as in ``suffix_array``, but only to ``depth``, two or three of them at
    a time as 63 bits allow. A suffix that stands alone at some depth, or is followed by one that does, shares no more and is
    finished; one shorter than the next depth is not asked for any more. So ranks count shared suffixes only.
    """
    n = len(data)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
    h = min(first, depth)
    pos = np.flatnonzero(left >= h)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([data, np.zeros(h, np.uint8)])
    for i in range(h):
        key = (key << np.uint64(8)) | padded[i:n + i]
    joint = key[pos]
    # none: finished or too short
    rank = np.full(n, -1, np.int64)
    while True:
        order = np.argsort(joint)
        joint, sa = joint[order], pos[order]
        new = np.ones(len(sa) + 1, bool)
        new[1:-1] = joint[1:] != joint[:-1]
        shared = ~(new[:-1] & new[1:])
        sa, new = sa[shared], new[:-1][shared]
        if h == depth or not len(sa):
            return sa
        group = np.cumsum(new) - 1
        rank.fill(-1)
        rank[sa] = group
        bits = max(1, int(group[-1]).bit_length())
        reach = min(depth, h * min(3, 63 // bits))
        steps = [*range(h, reach - h, h), reach - h]
        pos = pos[(left[pos] >= reach) & (rank[pos] >= 0)]
        joint = rank[pos]
        for step in steps:
            ahead = rank[pos + step]
            keep = ahead >= 0
            pos, joint = pos[keep], (joint[keep] << bits) | ahead[keep]
        h = reach


def repeated_windows(data: np.ndarray, lengths: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Positions whose next ``span`` bytes lie in one string and also start elsewhere in ``data``."""
    flag = np.zeros(len(data), bool)
    flag[shared_suffixes(data, lengths, span)] = True
    return flag


def _key_rows(docs: DataFrame, span: int) -> DataFrame:
    """(tid, key, many) for every distinct key of every row; many: more than one window position may carry it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tid = b.column(0).to_numpy()
            found = []
            for p in pieces(b.column(1), HASHED):
                known = window_keys(p, span)
                row, _, _, key = window_runs(p, span, known=known)
                order = np.lexsort((key, row))
                row, key = row[order], key[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
                at = np.flatnonzero(new)
                again = {(int(a), int(k)) for a, k in repeated_keys(p, span, known=known)}
                many = np.diff(np.append(at, len(row))) > 1
                if again:
                    many |= np.array([(a, k) in again for a, k in zip(row[at].tolist(), key[at].tolist())], bool)
                found.append((tid[p.lo + row[at]], key[at].view(np.int64), many))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["tid", "key", "many"])

    return docs.select("tid", "t").mapInArrow(run, "tid long, key long, many boolean")


def _run_rows(cand: DataFrame, shards: int, span: int) -> DataFrame:
    """Every run of a candidate key with the bytes of its windows, and its shard.

    Runs of a batch with equal bytes become one row with all their places before anything is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in thin(batches, 2000):
            tid = b.column(0).to_numpy()
            keys, hot = b.column(2), b.column(3)
            held: dict[tuple[int, bytes], list] = {}
            for p in pieces(b.column(1), HASHED):
                row, at, length, key = window_runs(p, span)
                key = key.view(np.int64)
                # whether a key is a candidate, and hot, is the same for all texts that have it
                known = keys.slice(p.lo, p.hi - p.lo).flatten().to_numpy()
                hot_known = hot.slice(p.lo, p.hi - p.lo).flatten().to_numpy(zero_copy_only=False).astype(bool)
                keep, busy = np.isin(key, known), np.isin(key, known[hot_known])
                row, at, length, key, busy = row[keep], at[keep], length[keep], key[keep], busy[keep]
                ctx = [p.data[a:a + n + span - 1].tobytes() for a, n in zip(at.tolist(), length.tolist())]
                shard = np.where(busy, np.array([zlib.crc32(c) for c in ctx], np.int64) % shards, key % shards) if len(ctx) else key
                for c, s, h, t, a in zip(ctx, shard.tolist(), busy.tolist(), tid[p.lo + row].tolist(), (at - p.at[row]).tolist()):
                    group = held.setdefault((s, c), [h, [], []])
                    group[1].append(t)
                    group[2].append(a)
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in held], pa.int64()), pa.array([v[0] for v in held.values()], pa.bool_()),
                 pa.array([np.array(v[1], np.int64).tobytes() for v in held.values()], pa.binary()),
                 pa.array([np.array(v[2], np.int64).tobytes() for v in held.values()], pa.binary()),
                 pa.array([c for _, c in held], pa.binary())], names=["shard", "hot", "tids", "starts", "ctx"])

    return cand.mapInArrow(run, "shard long, hot boolean, tids binary, starts binary, ctx binary")


_PACKED = "home long, bucket long, tids binary, starts binary, lens binary, prints binary"


def _by_home(tid: np.ndarray, start: np.ndarray, length: np.ndarray, homes: int) -> list[tuple]:
    home = tid % homes
    order = np.argsort(home, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], np.diff(home[order]) != 0))) if len(home) else []
    return [(int(home[o[0]]), -1, tid[o].tobytes(), start[o].tobytes(), length[o].tobytes(), None)
            for o in np.split(order, edge[1:]) if len(o)]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["home", "bucket", "tids", "starts", "lens", "prints"]).astype({"home": "int64", "bucket": "int64"})


def _shard(homes: int, buckets: int, span: int):
    """Spans of repeated windows within a shard, and fingerprints of the windows of hot keys."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        # back to one entry per place of a run
        many = np.array([len(x) // 8 for x in g["tids"]])
        ctx = np.repeat(g["ctx"].to_numpy(), many)
        tid = np.concatenate([np.frombuffer(x, np.int64) for x in g["tids"]])
        start = np.concatenate([np.frombuffer(x, np.int64) for x in g["starts"]])
        names, kind, count = np.unique(np.array([hashlib.blake2b(c, digest_size=16).digest() for c in ctx], "V16"),
                                       return_inverse=True, return_counts=True)
        first = np.full(len(names), -1)
        first[kind[::-1]] = np.arange(len(ctx))[::-1]
        data = np.frombuffer(b"".join(ctx[i] for i in first), np.uint8)
        lengths = np.array([len(ctx[i]) for i in first], np.int64)
        flag = repeated_windows(data, lengths, span)
        begin = np.concatenate(([0], np.cumsum(lengths)))
        several = np.repeat(count > 1, lengths)
        inside = np.repeat(begin[1:], lengths) - np.arange(len(data)) >= span
        flag = (flag | several) & inside
        # flagged stretches of every distinct run, then once per text that has it
        edge = np.flatnonzero(np.diff(np.concatenate(([0], flag.view(np.int8), [0]))))
        s, e = edge[::2], edge[1::2]
        which = np.searchsorted(begin, s, "right") - 1
        # a stretch may run over the border of two runs only if the border is not inside: it is, windows end before
        per = np.bincount(which, minlength=len(names))
        base = np.concatenate(([0], np.cumsum(per)))
        reps = per[kind]
        owner = np.repeat(np.arange(len(ctx)), reps)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(reps) - reps, reps)
        item = base[kind[owner]] + nth
        rows = _by_home(tid[owner], start[owner] + s[item] - begin[kind[owner]], e[item] - s[item], homes)
        hot = np.repeat(g["hot"].to_numpy(), many)
        if hot.any():
            lone = [i for i in np.flatnonzero(hot) if count[kind[i]] == 1]
            evidence = [i for i in np.flatnonzero(hot) if count[kind[i]] > 1 and first[kind[i]] == i]
            prints, owners, places = [], [], []
            for i in [*lone, *evidence]:
                h = gram_hashes(np.frombuffer(ctx[i], np.uint8), span)
                prints.append(h)
                owners.append(np.full(len(h), tid[i]))
                places.append(start[i] + np.arange(len(h)))
            p, o, a = np.concatenate(prints), np.concatenate(owners), np.concatenate(places)
            order = np.argsort(p, kind="stable")
            p, o, a = p[order], o[order], a[order]
            where = (p >> np.uint64(32)).astype(np.int64) % buckets
            for b in range(buckets):
                own = where == b
                if own.any():
                    rows.append((-1, b, o[own].tobytes(), a[own].tobytes(), None, p[own].tobytes()))
        return _frame(rows)
    return run


def _merge(homes: int):
    """One bucket of fingerprints: each shard's sorted list is looked up in the list of all others."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        lists = [np.frombuffer(x, np.uint64) for x in g["prints"]]
        tids = np.concatenate([np.frombuffer(x, np.int64) for x in g["tids"]])
        at = np.concatenate([np.frombuffer(x, np.int64) for x in g["starts"]])
        every = np.sort(np.concatenate(lists), kind="stable")
        twice = np.concatenate([np.searchsorted(every, p, "right") - np.searchsorted(every, p, "left") for p in lists]) > 1
        tids, at = tids[twice], at[twice]
        order = np.lexsort((at, tids))
        tids, at = tids[order], at[order]
        new = np.ones(len(tids), bool)
        new[1:] = (tids[1:] != tids[:-1]) | (at[1:] != at[:-1] + 1)
        edge = np.flatnonzero(new)
        return _frame(_by_home(tids[edge], at[edge], np.diff(np.append(edge, len(tids))), homes))
    return run


def _finish(span: int, with_bytes: bool):
    """Texts of one home with their spans: removed bytes, maximal removed runs, digest of the rest."""
    def run(texts: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        cat = lambda c: np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, np.int64) for x in spans[c]]])
        tid, start, length = cat("tids"), cat("starts"), cat("lens")
        order = np.argsort(tid, kind="stable")
        tid, start, length = tid[order], start[order], length[order]
        out = []
        for r in texts.drop_duplicates("tid").itertuples():
            lo, hi = np.searchsorted(tid, [r.tid, r.tid + 1]) if r.tid < (1 << 63) - 1 else (np.searchsorted(tid, r.tid), len(tid))
            raw = r.t.encode()
            mark = np.zeros(len(raw) + 1, np.int32)
            np.add.at(mark, start[lo:hi], 1)
            np.add.at(mark, start[lo:hi] + length[lo:hi] + span - 1, -1)
            gone = np.cumsum(mark)[:-1] > 0
            runs_ = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
            kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            out.append((r.tid, int(gone.sum()), runs_, hashlib.sha256(kept).hexdigest(), kept if with_bytes else None))
        return pd.DataFrame(out, columns=["tid", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def removal(docs: DataFrame, span: int = SPAN, key: str = "doc_id", text: str = "text", hot_texts: int = HOT_TEXTS,
            shard_bytes: int = SHARD_BYTES, with_bytes: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    ``with_bytes`` adds ``kept``, the remaining bytes of rows that lose a part (NULL: all stay or all go).
    """
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(key).alias("k"), t.alias("t"), F.xxhash64(t).alias("tid"))
    base = cut(named.select("k", "tid", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2(F.col("t").cast("binary"), 256).alias("sha")))
    keys = cut(_key_rows(named.where(F.octet_length("t") >= span), span))
    # a key of two texts, or twice in one
    dup = (keys.groupBy("key").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi"), F.max("many").alias("many"), F.count(F.lit(1)).alias("c"))
           .where((F.col("lo") != F.col("hi")) | F.col("many")).select("key", (F.col("c") > hot_texts).alias("hot")))
    own = keys.select("key", "tid").join(dup, "key").groupBy("tid").agg(F.collect_set(F.struct("key", "hot")).alias("ks"))
    need = cut(own.join(base.groupBy("tid").agg(F.min("k").alias("rep")), "tid")
               .select("tid", "rep", F.col("ks.key").alias("keys"), F.col("ks.hot").alias("hot")))
    n_keys = need.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    side = F.broadcast(need) if n_keys <= BROADCAST_KEYS else need
    cand = cut(named.alias("a").join(side.alias("b"), (F.col("a.tid") == F.col("b.tid")) & F.col("a.k").eqNullSafe(F.col("b.rep")))
               .select("a.tid", "a.t", "b.keys", "b.hot"))
    size = cand.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    least = shuffle_partitions(spark)
    homes = max(least, -(-size // HOME_BYTES))
    shards = max(2 * least, -(-n_keys * 3 * span // (2 * shard_bytes)))
    packed = cut(_run_rows(cand, shards, span).groupBy("shard").applyInPandas(_shard(homes, least, span), _PACKED))
    merged = packed.where("bucket >= 0").groupBy("bucket").applyInPandas(_merge(homes), _PACKED)
    spans = packed.where("home >= 0").unionByName(merged)
    texts = cand.select("tid", "t", F.pmod("tid", F.lit(homes)).alias("home"))
    found = texts.groupBy("home").cogroup(spans.groupBy("home")).applyInPandas(
        _finish(span, with_bytes), "tid long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    copies = base.groupBy("sha").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("sha", F.lit(True).alias("copied"))
    out = lookup_join(base, copies, ["sha"])
    # with its bytes the table is as large as texts: then it is joined by shuffling, and base has few rows per text but for copies
    out = out.join(found, "tid", "left") if with_bytes else lookup_join(out, found.drop("kept"), ["tid"])
    whole = F.col("copied") & (F.col("n_bytes") >= span)
    return out.select(
        F.col("k").alias(key), "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([F.when(~F.coalesce(whole, F.lit(False)), F.col("kept")).alias("kept")] if with_bytes else []))
