"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. A bounded sample of labelled texts gives a lexicon: words and word beginnings that stand out in toxic
   texts. Near copies are thinned first, so that one text copied often does not look like evidence.
2. Every word and word beginning of the lexicon is a voter of its own (toxic where present; clean for those that
   stand out in clean texts), beside pattern voters; each votes toxic or clean on a sampled text, or abstains.
3. The label model has a latent class and one table of vote probabilities per voter and class, fitted by
   EM, so a good and a weak word get accuracies of their own. Voters that stay correlated given the class are joined
   into groups of any size, and a group has one joint table (over its patterns of votes, or over its
   numbers of toxic and clean votes where it is large), so agreeing copies of one voter do not count several times.
   The result is a posterior probability per text.
4. A linear (logistic) classifier over hashed words and word beginnings (their counts, and whether they come
   often in the text) is trained on the posteriors and scores every whole text; in tasks this is one array
   lookup per word and beginning.

Labels, language, source and key are no inputs of a score. NULL and empty texts get the score of a text
without features. Without any training row every score is 0. Repeated rows are scored one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulus.llm.textops import LETTER_OR_DIGIT, LOWER, Piece, mix, pieces, run_hashes, runs, shingle_sets
from regulus.session import cut, lookup_join

# Bounds of the training sample: toxic texts, clean texts, characters taken of a text.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 1200, 2400, 6000
BEGINNINGS = (4, 5, 6, 8)
# Voters taken from the lexicon at most, strongest first; groups of more voters than PATTERNS share a table of vote counts.
TOXIC_VOTERS, CLEAN_VOTERS, PATTERNS, COUNTED = 300, 100, 3, 6
# Votes that correlate by more than this, whatever the class, are copies.
COPIES = 0.7
MAX_COUNT = 3
OFTEN = 3
# Well-known insults, one pattern voter per language group.
INSULTS = (
    r"\b(idiot|moron|stupid|loser|scum|pathetic|worthless|disgusting|trash|imbecile|dumb|jerk)s?\b",
    r"\b(trottel|dummkopf|arschloch|versager|abschaum|connard|abruti|débile|salaud|estúpido|imbécil|basura|idiota)\w*\b",
)


@dataclass(frozen=True)
class Model:
    keys: np.ndarray      # sorted feature hashes
    weights: np.ndarray   # per occurrence, up to MAX_COUNT
    often: np.ndarray     # added from the OFTEN-th occurrence on
    bias: float


def features(p: Piece) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and of every beginning of a longer word."""
    low = Piece(p.lo, p.hi, LOWER[p.data], p.at)
    s, e, row = runs(low, LETTER_OR_DIGIT)
    rows, hashes = [row], [run_hashes(low.data, s, e)]
    for k in BEGINNINGS:
        long = e - s > k
        rows.append(row[long])
        hashes.append(mix(run_hashes(low.data, s[long], s[long] + k) + np.uint64(k)))
    return np.concatenate(rows), np.concatenate(hashes)


def sample(docs: DataFrame, labels: DataFrame, keep: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
           n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN, max_chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """At most ``n_toxic`` and ``n_clean`` different labelled rows where ``keep`` holds, by hash of the key.

    Only rows with a text are picked from. Texts of at most ``max_chars`` characters come first; where a class has too
    few of them, the first ``max_chars`` characters of longer ones fill it up.
    """
    own = (labels.select(F.col(key), F.col(label).alias("y")).where(keep & F.col("y").isin(0, 1) & F.col(key).isNotNull())
           .groupBy(key).agg(F.max("y").alias("y")))
    texts = (docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
             .select(F.col(key).alias("k"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("row")))
    there = texts.groupBy("k", "row").agg(F.min(F.length("text") > max_chars).alias("outside"))
    there = cut(lookup_join(there, own.select(F.col(key).alias("k"), "y"), ["k"], how="inner"))
    chosen: dict = {}
    for y, n in ((1, n_toxic), (0, n_clean)):
        chosen |= {r[0]: y for r in there.where(F.col("y") == y).orderBy("outside", F.xxhash64("k"), "k", "row").limit(n)
                   .select("row").collect()}
    rows = (texts.where(F.col("row").isin(list(chosen))).select("k", F.substring("text", 1, max_chars).alias("text"), "row")
            .distinct().orderBy("k", "text", "row").collect())
    return [(r[1], chosen[r[2]]) for r in rows]


def _thinned(texts: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """One text of every group that shares a least shingle under one of three hash orders."""
    seen: set[tuple[int, int]] = set()
    out = []
    for p in pieces(pa.array([t for t, _ in texts], pa.string())):
        row, h = shingle_sets(p)
        least = np.full((3, p.hi - p.lo), np.iinfo(np.uint64).max, np.uint64)
        for k in range(3):
            np.minimum.at(least[k], row, mix(h + np.uint64(k + 1)))
        for i in range(p.hi - p.lo):
            marks = {(k, int(least[k, i])) for k in range(3)}
            if not marks & seen:
                out.append(texts[p.lo + i])
            seen |= marks
    return out


def _voter_groups(votes: np.ndarray, post: np.ndarray, excess: float) -> list[list[int]]:
    """Voters joined, closest first, while every pair of a group correlates by more than ``excess`` given the class."""
    n, m = votes.shape
    residual = np.zeros((n, m))
    for w in (post, 1 - post):
        residual += w[:, None] * (votes - (w @ votes / max(w.sum(), 1e-9)))
    sd = np.sqrt((residual ** 2).mean(0))
    corr = (residual.T @ residual / max(n, 1)) / np.maximum(np.outer(sd, sd), 1e-9)
    low = np.abs(corr)          # least correlation of a member of the row's group with one of the column's
    low[np.arange(m), np.arange(m)] = 0
    groups = {i: [i] for i in range(m)}
    while m > 1:
        i, j = sorted(divmod(int(low.argmax()), m))
        if low[i, j] <= excess:
            break
        groups[i] += groups.pop(j)
        low[i] = low[:, i] = np.minimum(low[i], low[j])
        low[j] = low[:, j] = 0
        low[i, i] = 0
    return [sorted(g) for _, g in sorted(groups.items())]


def _patterns(votes: np.ndarray) -> np.ndarray:
    """A code per row of a group's votes: the pattern itself, or the counts of toxic and clean votes of a large group."""
    if votes.shape[1] > PATTERNS:
        return (np.minimum((votes > 0).sum(1), COUNTED) * (COUNTED + 1) + np.minimum((votes < 0).sum(1), COUNTED)).astype(np.int64)
    return np.unique(votes, axis=0, return_inverse=True)[1].ravel()


def label_model(votes: np.ndarray, prior: float, rounds: int = 50, excess: float = 0.3) -> tuple[np.ndarray, list[list[int]]]:
    """Posterior of the toxic class per row from votes (1 toxic, -1 clean, 0 abstain), and the voter groups."""
    n = len(votes)
    # near copies are one voter from the start: else a handful of them would look like the class itself
    copies = _voter_groups(votes, np.full(n, prior), COPIES)
    total = sum((np.sign(votes[:, g].sum(1, dtype=np.int64)) for g in copies), np.zeros(n))
    start = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + np.clip(total, -4, 4))))

    def fit(groups: list[list[int]], post: np.ndarray) -> np.ndarray:
        codes = [_patterns(votes[:, g]) for g in groups]
        for _ in range(rounds):
            pi = np.clip(post.mean(), 0.01, 0.99)
            logit = np.full(n, np.log(pi / (1 - pi)))
            for c in codes:
                k = c.max() + 1
                on, off = np.bincount(c, post, k) + 0.5, np.bincount(c, 1 - post, k) + 0.5
                logit += (np.log(on / on.sum()) - np.log(off / off.sum()))[c]
            new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            if np.abs(new - post).max() < 1e-6:
                break
            post = new
        return post

    groups = _voter_groups(votes, fit(copies, start), excess)
    return fit(groups, start), groups


def _votes(texts: list[str], toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """A column per toxic and per clean lexicon word, then the patterns, then silence of the toxic lexicon as a clean vote."""
    insult = np.stack([[bool(re.search(p, t.lower())) for t in texts] for p in INSULTS], 1)
    shout = np.array([[sum(map(str.isupper, t)) > 0.5 * max(1, sum(map(str.isalpha, t))), "!!" in t] for t in texts])
    silent = ~toxic.any(1) & ~insult.any(1)
    return np.concatenate([toxic, -clean.astype(np.int8), insult, shout, -silent[:, None].astype(np.int8)], 1).astype(np.int8)


def train(texts: list[tuple[str, int]], max_features: int = 4000, rounds: int = 300, ridge: float = 1e-3) -> Model | None:
    """Lexicon, votes, posteriors and the linear classifier, all from the bounded sample."""
    texts = _thinned([(t or "", y) for t, y in texts])
    y = np.array([v for _, v in texts])
    if len(texts) == 0 or y.min() == y.max():
        return None
    rows, keys = [], []
    for p in pieces(pa.array([t for t, _ in texts], pa.string())):
        r, h = features(p)
        rows.append(r + p.lo)
        keys.append(h)
    row, key = np.concatenate(rows), np.concatenate(keys)
    names, col = np.unique(key, return_inverse=True)
    cell, count = np.unique(row.astype(np.int64) * len(names) + col, return_counts=True)
    row, col = cell // len(names), cell % len(names)
    # a second feature of every word and beginning: it comes often in the text
    more = count >= OFTEN
    row, col = np.concatenate([row, row[more]]), np.concatenate([col, col[more] + len(names)])
    count = np.concatenate([count, np.ones(more.sum(), count.dtype)])
    n_words, names = len(names), np.concatenate([names, mix(names)])
    on = np.bincount(col, y[row], len(names))
    off = np.bincount(col, 1 - y[row], len(names))
    odds = np.log((on + 0.3) / (y.sum() + 0.6)) - np.log((off + 0.3) / (len(y) - y.sum() + 0.6))
    # a feature counts when it stands out by more than chance in enough different texts
    strength = np.abs(odds) * np.sqrt(on + off)
    # and, if it speaks for toxic, when three of four texts that hold it are toxic
    chosen = np.flatnonzero((on + off >= 5) & (strength > 5) & ((odds < 0) | (on >= 3 * off)))
    chosen = np.sort(chosen[np.argsort(-strength[chosen], kind="stable")[:max_features]])
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(texts), len(chosen)), np.float32)
    has = place[col] >= 0
    x[row[has], place[col[has]]] = np.minimum(count[has], MAX_COUNT)
    by_strength = np.argsort(-strength[chosen], kind="stable")
    toxic = by_strength[(odds[chosen] > 2.0)[by_strength] & (on[chosen] >= 4)[by_strength]][:TOXIC_VOTERS]
    clean = by_strength[(odds[chosen] < -1.0)[by_strength]][:CLEAN_VOTERS]
    votes = _votes([t for t, _ in texts], x[:, toxic] > 0, x[:, clean] > 0)
    post, _ = label_model(votes, float(np.clip(y.mean(), 0.02, 0.98)))
    w, b = np.zeros(len(chosen), np.float32), float(np.log(post.mean() / (1 - post.mean())))
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        miss = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - post
        gw, gb = x.T @ miss.astype(np.float32) / len(texts) + ridge * w, float(miss.mean())
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9 ** t, 1 - 0.99 ** t
        w -= 0.05 * (mw / c1) / (np.sqrt(vw / c2) + 1e-8)
        b -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    # small weights only add noise, which would grow with the length of a text
    used = np.abs(w) > 0.25
    at, w = chosen[used], w[used].astype(float)
    keys = np.unique(names[at % n_words])
    base, often = np.zeros(len(keys)), np.zeros(len(keys))
    for into, mine in ((base, at < n_words), (often, at >= n_words)):
        into[np.searchsorted(keys, names[at[mine] % n_words])] = w[mine]
    return Model(keys, base, often, b)


def score_rows(model: Model, column: pa.Array) -> np.ndarray:
    sieve = np.zeros(1 << 20, bool)
    sieve[(model.keys >> np.uint64(44)).astype(np.int64)] = True
    out = []
    for p in pieces(column, 2 << 20):
        row, h = features(p)
        near = sieve[(h >> np.uint64(44)).astype(np.int64)]
        row, h = row[near], h[near]
        at = np.minimum(np.searchsorted(model.keys, h), max(len(model.keys) - 1, 0))
        hit = model.keys[at] == h if len(model.keys) else np.zeros(len(h), bool)
        cell, count = np.unique(row[hit].astype(np.int64) * max(len(model.keys), 1) + at[hit], return_counts=True)
        width = max(len(model.keys), 1)
        worth = (model.weights[cell % width] * np.minimum(count, MAX_COUNT) + model.often[cell % width] * (count >= OFTEN)) if len(
            cell) else np.zeros(0)
        total = np.bincount(cell // width, worth, p.hi - p.lo)
        out.append(1 / (1 + np.exp(-np.clip(total + model.bias, -30, 30))))
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` of every row: one pass, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            s = score_rows(m, b.column(1)) if m is not None else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["k", "score"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"k {kind}, score double").withColumnRenamed("k", key)


def held_out(key: str = "doc_id") -> Column:
    """Rows whose crc32 of the key as text leaves 1 when divided by 3; a NULL key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
