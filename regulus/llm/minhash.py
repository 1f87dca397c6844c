"""MinHash near-duplicates with sequential Bayesian verification.

1. Signatures. A text's set of word shingles gets ``BANDS * ROWS`` minimum hashes; texts with one set share everything, so
   only different sets count from here on. Every band of ``ROWS`` minima is one key. Two sets of similarity s share
   a key with probability 1 - (1 - s^ROWS)^BANDS: at 0.85 all but 2.4e-7 of the pairs do.
2. Candidates. A band key shared by different sets links each of them to its least set (a star, never pairs).
   Connected stars are a candidate cluster.
3. Roots. Every set is checked against the one least set with which it shares most bands: at most one check a set, and
   in groups of near copies nearly all links are found by it. Sets linked so far carry one label.
4. Blocks. Only clusters that still hold several labels go on. Their sets meet in blocks of bounded size, sets of the
   most common label never among themselves, and a set is compared with those only that share a band with it
   and have another label.
5. Verification of a pair, in both steps: the signatures are compared ``BATCH`` minima at a time, and after each batch the
   pair is given up if, under a uniform prior, the posterior probability of reaching the threshold is below
   ``MISS``. What survives is confirmed on the full sets. A pair at the threshold is given up with a probability of at most
   MISS a batch, more similar pairs still less.

So no pair of links is ever listed in full, links between different texts are lost with a chance of about 1e-6 a
pair at the threshold itself only, and no link is wrong. Signatures are fixed hashes: reruns agree.

Words: runs of anything but ASCII blanks, A-Z lower-cased. A set: distinct k-word shingles, by 64-bit hashes; with fewer
words, the whole sequence as one. NULL, empty and blank texts have an empty set and are linked with nothing. Repeated
rows are members of one class. NULL keys are never a class's least key unless all are NULL. Further columns are not
read, and an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulus.llm.components import connected
from regulus.llm.textops import mix, pieces, shingle_sets
from regulus.session import cut, lookup_join, salted_join, with_size_hint

SHINGLE = 5
PERCENT = 85
BANDS = 48
ROWS = 8
BATCH = 32
MISS = 1e-8
BLOCK = 1024
BLOCK_SHINGLES = 1_000_000
# rows of checks are wide, so a set that many others are checked against is split early
HOT_CHECKS = 20_000


@cache
def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64)).astype(np.uint32)
    return seeds[:n] | np.uint32(1), seeds[n:]


def signatures(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Minimum hashes (n x BANDS * ROWS) of sets given as (row, hash) sorted by row; empty sets get the largest value."""
    out = np.full((BANDS * ROWS, n), 0xFFFFFFFF, np.uint32)
    at = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.zeros(0, int)
    if len(at):
        base = (mix(hashes) >> np.uint64(32)).astype(np.uint32)
        some, h = rows[at], np.empty_like(base)
        for i, (a, b) in enumerate(zip(*_family(BANDS * ROWS))):
            np.multiply(base, a, out=h)
            np.add(h, b, out=h)
            out[i, some] = np.minimum.reduceat(h, at)
    return np.ascontiguousarray(out.T)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key a band (n x BANDS), different for different bands."""
    s = signature.reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2]).copy()
    for i in range(ROWS):
        h = mix((h * np.uint64(0x9E3779B97F4A7C15)) ^ s[:, :, i].astype(np.uint64))
    return h


def least_matches(percent: int, miss: float = MISS, total: int = BANDS * ROWS, batch: int = BATCH) -> list[int]:
    """After 1, 2, ... batches: the fewest equal minima at which the threshold is still likely enough.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), and its mass above t is the chance
    of at most m successes in n + 1 trials of chance t.
    """
    t, out = percent / 100, []
    for n in range(batch, total + 1, batch):
        below, m = 0.0, 0
        while m <= n:
            below += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
                              + m * math.log(t) + (n + 1 - m) * math.log1p(-t)) if t < 1 else float(m == n + 1)
            if below >= miss:
                break
            m += 1
        out.append(min(m, n))
    return out


def plausible(one: np.ndarray, others: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of ``others`` no batch of minima gives up against ``one`` (a row, or as many rows as ``others``)."""
    left = np.arange(len(others))
    equal = np.zeros(len(others), np.int64)
    for i, need in enumerate(least):
        part = slice(i * BATCH, (i + 1) * BATCH)
        mine = one[part] if one.ndim == 1 else one[left, part]
        equal += (others[left, part] == mine).sum(1)
        keep = equal >= need
        left, equal = left[keep], equal[keep]
        if not len(left):
            break
    return left


def _named(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes and 128-bit names (two integers a set) that depend on the members only."""
    size = np.bincount(rows, minlength=n)
    edge = np.concatenate(([0], np.cumsum(size)))
    names = []
    for seed in (np.uint64(11), np.uint64(12)):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ mix(np.full(1, seed))), dtype=np.uint64)))
        names.append(mix(total[edge[1:]] - total[edge[:-1]] + size.astype(np.uint64)))
    return size, np.stack(names, 1)


def _name_column(names: np.ndarray, size: np.ndarray) -> pa.Array:
    raw = names.tobytes()
    return pa.array([raw[16 * i:16 * i + 16] if s else None for i, s in enumerate(size)], pa.binary())


def signed(docs: DataFrame, k: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k (key), n (set size), sid (name of the set, NULL if empty), s (its first half) and bands (keys) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b.column(1)):
                rows, hashes = shingle_sets(p, k)
                n = p.hi - p.lo
                size, names = _named(rows, hashes, n)
                bands = band_keys(signatures(rows, hashes, n)).view(np.int64)
                edge = np.concatenate(([0], np.cumsum(np.where(size > 0, BANDS, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(p.lo, n), pa.array(size, pa.int64()), _name_column(names, size), pa.array(names[:, 0].view(np.int64)),
                     pa.ListArray.from_arrays(edge, pa.array(bands[size > 0].ravel()))], names=["k", "n", "sid", "s", "bands"])

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"k {kind}, n long, sid binary, s long, bands array<long>")


def _sets(texts: DataFrame, k: int) -> DataFrame:
    """sid, s, n, shingles and signature of every non-empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in pieces(b.column(0)):
                rows, hashes = shingle_sets(p, k)
                n = p.hi - p.lo
                size, names = _named(rows, hashes, n)
                edge = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                raw, width = signatures(rows, hashes, n).tobytes(), 4 * BANDS * ROWS
                yield pa.RecordBatch.from_arrays(
                    [_name_column(names, size), pa.array(names[:, 0].view(np.int64)), pa.array(size, pa.int64()),
                     pa.ListArray.from_arrays(edge, pa.array(hashes.view(np.int64))),
                     pa.array([raw[width * i:width * (i + 1)] for i in range(n)], pa.binary())], names=["sid", "s", "n", "toks", "sig"])

    return texts.mapInArrow(run, "sid binary, s long, n long, toks array<long>, sig binary").where("n > 0")


def _stars(base: DataFrame) -> DataFrame:
    """(s, pivot, shared): sets and the least set of a band key they share, with the number of such bands."""
    bands = base.where("n > 0").select("s", F.explode("bands").alias("b"))
    # counts, minima and maxima combine before the shuffle, so very many equal texts are one row a task here
    shared = (bands.groupBy("b").agg(F.min("s").alias("pivot"), F.max("s").alias("most")).where("pivot < most").select("b", "pivot"))
    met = lookup_join(bands, shared, ["b"], "inner").where("s != pivot")
    rows = met.groupBy("s", "b", "pivot").agg(F.lit(1).alias("one"))  # equal texts once
    return rows.groupBy("s", "pivot").agg(F.count(F.lit(1)).alias("shared"))


def _contracted(stars: DataFrame) -> DataFrame:
    """Links with the same components as ``stars``, about one a set: a set keeps the link to its least pivot, and its other
    pivots are tied to that one once for all sets that share them. A set has at most BANDS pivots."""
    per = stars.groupBy("s").agg(F.min("pivot").alias("least"), F.collect_set("pivot").alias("pivots"))
    own = per.select("s", F.col("least").alias("pivot"))
    others = per.select(F.explode("pivots").alias("s"), F.col("least").alias("pivot")).where("s != pivot")
    return own.unionByName(others.distinct())


def _roots_checked(least: list[int], percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                sig = [np.stack([np.frombuffer(x, np.uint32) for x in b.column(c).to_pylist()]) for c in ("sig", "rsig")]
                good = []
                for i in plausible(sig[1], sig[0], least):
                    x, y = (b.column(c)[int(i)].values.to_numpy(zero_copy_only=False) for c in ("toks", "rtoks"))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        good.append(i)
                pick = pa.array(good, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("sid").take(pick), b.column("rsid").take(pick)], names=["a", "b"])
    return run


def link_block(size: np.ndarray, toks: list[np.ndarray], sig: np.ndarray, label: np.ndarray, least: list[int],
               percent: int) -> list[tuple[int, int]]:
    """Links (member, root) that, with equal labels as links, connect the members as all their banded pairs would."""
    n = len(size)
    _, label = np.unique(label, return_inverse=True)
    by_label = np.argsort(label, kind="stable")
    edge = np.searchsorted(label[by_label], np.arange(label.max(initial=-1) + 2))
    keys = band_keys(sig)
    toks = [np.sort(t) for t in toks]
    free = np.ones(n, bool)
    links: list[tuple[int, int]] = []

    def joined(x: int) -> list[int]:
        """Members with the label of ``x`` that were still free."""
        own = by_label[edge[label[x]]:edge[label[x] + 1]]
        own = own[free[own]]
        free[own] = False
        return own.tolist()

    for root in range(n):
        queue = joined(root) if free[root] else []
        while queue:
            x = queue.pop()
            others = np.flatnonzero(free)
            if not len(others):
                break
            others = others[(keys[others] == keys[x]).any(1)]
            for y in others[plausible(sig[x], sig[others], least)]:
                if not free[y]:
                    continue
                a, b = (toks[x], toks[y]) if len(toks[x]) < len(toks[y]) else (toks[y], toks[x])
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int(np.count_nonzero(b[at] == a))
                if 100 * both >= percent * (size[x] + size[y] - both):
                    links.append((int(y), root))
                    queue += joined(y)
    return links


def _blocks_checked(least: list[int], percent: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        sids = g["sid"].tolist()
        found = link_block(g["n"].to_numpy(), [np.asarray(t) for t in g["toks"]], np.stack([np.frombuffer(x, np.uint32) for x in g["sig"]]),
                           g["label"].to_numpy(), least, percent)
        return pd.DataFrame({"a": [sids[i] for i, _ in found], "b": [sids[j] for _, j in found]})
    return run


def _block_rows(sets: DataFrame, block: int) -> DataFrame:
    """Every set of a cluster with several labels once for every pair of blocks (i, j) that it has to meet in."""
    per_label = sets.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    open_ = (per_label.groupBy("cluster").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("m", "w", "label")).alias("main"),
                                              F.sum("m").alias("m"), F.sum("w").alias("w")).where("labels > 1"))

    def parts(m, w):
        return F.greatest(F.lit(1), F.ceil(m / F.lit(block)), F.ceil(w / F.lit(BLOCK_SHINGLES))).cast("int")

    small = parts(F.col("m"), F.col("w")) == 1
    open_ = open_.select("cluster", F.when(~small, F.col("main.label")).alias("main"),
                         F.when(small, 1).otherwise(parts(F.col("m") - F.col("main.m"), F.col("w") - F.col("main.w"))).alias("others"),
                         F.when(small, 0).otherwise(parts(F.col("main.m"), F.col("main.w"))).alias("mains"))
    rows = lookup_join(sets, open_, ["cluster"], "inner")
    is_main = F.coalesce(F.col("label") == F.col("main"), F.lit(False))
    row = F.xxhash64("sid")
    # blocks of the main label are numbered -1, -2, ... and meet every block of the rest; those meet among themselves
    rows = rows.withColumn("own", F.when(is_main, -1 - F.pmod(row, F.col("mains"))).otherwise(F.pmod(row, F.col("others"))).cast("int"))
    meets = F.when(is_main, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(
        F.concat(F.sequence(F.lit(0), F.col("others") - 1),
                 F.when(F.col("mains") > 0, F.sequence(-F.col("mains"), F.lit(-1))).otherwise(F.array().cast("array<int>"))))
    rows = rows.withColumn("other", F.explode(meets))
    return rows.select("sid", "n", "toks", "sig", "label", "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def links(sets: DataFrame, stars: DataFrame, percent: int = PERCENT, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between set names that connect exactly the classes of near-duplicates. ``sets`` has its cluster."""
    least = least_matches(percent, miss)
    best = stars.groupBy("s").agg(F.max(F.struct("shared", "pivot")).alias("best")).select("s", F.col("best.pivot").alias("root"))
    right = sets.select(F.col("s").alias("root"), F.col("sid").alias("rsid"), F.col("toks").alias("rtoks"), F.col("sig").alias("rsig"))
    checks = salted_join(sets.select("s", "sid", "toks", "sig").join(best, "s"), right, ["root"], "inner", HOT_CHECKS)
    first = cut(checks.select("sid", "rsid", "toks", "rtoks", "sig", "rsig").mapInArrow(_roots_checked(least, percent), "a binary, b binary"))
    labels = connected(first).select(F.col("node").alias("sid"), "label")
    labelled = lookup_join(sets, labels, ["sid"]).withColumn("label", F.coalesce("label", "sid"))
    second = (_block_rows(cut(labelled), block).groupBy("cluster", "i", "j").applyInPandas(_blocks_checked(least, percent), "a binary, b binary"))
    return first.unionByName(second)


def classes(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, key: str = "doc_id", text: str = "text",
            miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """key, n_shingles, component_id (the least key of its class) and kept (the key is that least key) of every row."""
    base = cut(signed(docs, k, key, text))
    stars = cut(_stars(base))
    cluster = connected(_contracted(stars), "s", "pivot").select(F.col("node").alias("s"), F.col("label").alias("cluster"))
    # one row of the documents stands for each set in a cluster
    chosen = lookup_join(base.select("k", "sid", "s").where("sid is not null"), cluster, ["s"], "inner")
    reps = cut(chosen.groupBy("sid").agg(F.min("k").alias("rep")).select("rep").distinct())
    texts = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(
        with_size_hint(reps), F.col("k").eqNullSafe(F.col("rep")), "left_semi").select("t")
    sets = cut(lookup_join(_sets(texts, k).dropDuplicates(["sid"]), cluster, ["s"], "inner"))
    names = connected(cut(links(sets, stars, percent, miss, block))).select(F.col("node").alias("sid"), "label")
    rows = lookup_join(base.select("k", "n", "sid"), names, ["sid"]).withColumn("label", F.coalesce("label", "sid"))
    least = (rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("k").alias("least"), F.count(F.lit(1)).alias("c"))
             .where("c > 1").drop("c"))
    out = lookup_join(rows, least, ["label"])
    component = F.coalesce("least", "k")
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("k").eqNullSafe(component).alias("kept"))
