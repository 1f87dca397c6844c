"""Ranked lexical search over impact lists by the Best Position Algorithm.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased, known by 64-bit
hashes. Two passes over the documents: one counts, per task, the documents and words and the documents holding each
query term; the other scores. Only the queries' terms are kept, so a pass shuffles counts and final candidates only.

A block of documents is turned into impact lists, one a query term, highest impact first, and a row per document
that tells its place in every list. For one query its lists are read downwards from their best positions (the end of
the stretch from the top that has been seen whole, no matter how). Every document met for the first time is scored by
direct access through its row, which also marks its places in the other lists as seen. A document not met yet
stands, in every list, at or below the first place not seen; the sum of the impacts there is the threshold, and
reading stops when it is strictly below the k-th best score, so ties are found whole. The k best of a query go on from
block to block of a task; what the tasks emit, k rows a query, is ranked by a window (each task keeps k rows first).

Queries are worked on in chunks of at most ``CHUNK_BYTES`` of text, so what is sent to the executors is bounded
however long the table of queries is.

NULL and empty texts have no term: as documents they are never found, as queries they find nothing. Every row of
either table stands for itself: repeated keys are ranked (or asked) row by row. Equal scores stand in ascending order
of the key, NULL keys last. Further columns are not read. Without documents or queries the result is empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regulus.llm.textops import LETTER_OR_DIGIT, LOWER, Piece, pieces, run_hashes, runs
from regulus.session import cut

BLOCK_DOCS = 4096
BLOCK_POSTINGS = 1_500_000
CHUNK_BYTES = 4_000_000
DEPTH = 8

Scorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _terms(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every term."""
    low = LOWER[piece.data]
    s, e, row = runs(Piece(piece.lo, piece.hi, low, piece.at), LETTER_OR_DIGIT)
    return run_hashes(low, s, e), row


def _postings(piece: Piece, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of every row; and (row, query term, occurrences), sorted."""
    h, row = _terms(piece)
    n = np.bincount(row, minlength=piece.hi - piece.lo)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    hit = vocabulary[at] == h
    cell, tf = np.unique(row[hit].astype(np.int64) * len(vocabulary) + at[hit], return_counts=True)
    return n, cell // len(vocabulary), cell % len(vocabulary), tf


def _statistics(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and the documents holding each query term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary) + 2, np.int64)
        for b in batches:
            for p in pieces(b.column(0)):
                n, _, term, _ = _postings(p, vocabulary)
                df[:-2] += np.bincount(term, minlength=len(vocabulary))
                df[-2] += np.count_nonzero(n)
                df[-1] += n.sum()
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], names=["t", "c"])

    counts = np.zeros(len(vocabulary) + 2, np.int64)
    for t, c in docs.mapInArrow(run, "t long, c long").groupBy("t").agg(F.sum("c").alias("c")).collect():
        counts[t] = c
    return int(counts[-2]), int(counts[-1]), counts[:-2]


class Block:
    """Impact lists over some documents: postings in list order, and for every document its postings."""

    def __init__(self, n_docs: int, n_terms: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        order = np.lexsort((-impact, term))
        self.doc, self.term, self.impact = doc[order], term[order], impact[order]
        self.list_at = np.searchsorted(self.term, np.arange(n_terms + 1))
        self.by_doc = np.argsort(self.doc, kind="stable")
        self.doc_at = np.searchsorted(self.doc[self.by_doc], np.arange(n_docs + 1))
        self.n_docs, self.n_terms = n_docs, n_terms

    def best(self, terms: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the ``k`` best with ``floor``, scores already found elsewhere; their scores;
        and how many documents were scored."""
        asked = np.zeros(self.n_terms, bool)
        asked[terms] = True
        end, position = self.list_at[terms + 1], self.list_at[terms].copy()
        seen = np.zeros(len(self.doc), bool)
        score = np.full(self.n_docs, -1, np.int64)
        top = np.sort(floor)[::-1][:k]
        depth = DEPTH
        while True:
            open_ = position < end
            if not open_.any():
                break
            threshold = int(self.impact[position[open_]].sum())
            if threshold <= 0 or (len(top) == k and threshold < top[-1]):
                break
            # sorted access: the next places of every list
            width = np.minimum(end - position, depth)
            places = np.arange(width.sum()) + np.repeat(position - np.cumsum(width) + width, width)
            seen[places] = True
            new = np.unique(self.doc[places])
            new = new[score[new] < 0]
            if len(new):
                # direct access: all places of the documents met for the first time
                n = self.doc_at[new + 1] - self.doc_at[new]
                edge = np.concatenate(([0], np.cumsum(n)))
                own = self.by_doc[np.arange(edge[-1]) + np.repeat(self.doc_at[new] - edge[:-1], n)]
                mine = asked[self.term[own]]
                seen[own[mine]] = True
                running = np.concatenate(([0], np.cumsum(np.where(mine, self.impact[own], 0))))
                score[new] = running[edge[1:]] - running[edge[:-1]]
                top = np.sort(np.concatenate((top, score[new])))[::-1][:k]
            for i in np.flatnonzero(open_):
                rest = seen[position[i]:end[i]]
                position[i] = position[i] + int(rest.argmin()) if not rest.all() else end[i]
            depth = min(2 * depth, 1024)
        least = max(1, int(top[-1])) if len(top) == k else 1
        found = np.flatnonzero(score >= least)
        return found, score[found], int(np.count_nonzero(score >= 0))


def _order(row: tuple) -> tuple:
    return -row[0], row[1] is None, row[1]


def _rank_chunk(docs: DataFrame, ids: list, texts: list[str | None], key: str, text: str, id_type: pa.DataType,
                item: str, k: int) -> DataFrame | None:
    table = [np.unique(_terms(p)[0]) for t in texts for p in pieces(pa.array([t], pa.string()))]
    vocabulary = np.unique(np.concatenate(table))
    if not len(vocabulary):
        return None
    n_docs, n_terms, df = _statistics(docs.select(F.col(f"`{text}`")), vocabulary)
    if not n_docs:
        return None
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    weight[df == 0] = 0
    # only lists that can add to a score are read
    queries = [q[(weight[q] > 0)] for q in (np.searchsorted(vocabulary, x) for x in table)]
    key_type, item_type = (docs.schema[key].dataType.simpleString(), item)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[list[tuple]] = [[] for _ in queries]
        held: list[tuple] = []

        def flush() -> None:
            base = np.cumsum([0, *(len(h[0]) for h in held)])
            doc = np.concatenate([h[1] + b for h, b in zip(held, base)])
            n = np.concatenate([h[0] for h in held]).astype(np.int64)
            term, tf = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]).astype(np.int64)
            keys = [x for h in held for x in h[4].to_pylist()]
            m = 10 + (90 * n * n_docs) // n_terms
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            block = Block(len(n), len(vocabulary), doc, term, impact)
            for i, q in enumerate(queries):
                if len(q):
                    found, score, _ = block.best(q, k, np.array([r[0] for r in top[i]], np.int64))
                    top[i] = heapq.nsmallest(k, top[i] + [(int(s), keys[d]) for d, s in zip(found, score)], key=_order)
            held.clear()

        docs_held = postings = 0
        for b in batches:
            for p in pieces(b.column(1)):
                held.append((*_postings(p, vocabulary), b.column(0).slice(p.lo, p.hi - p.lo)))
                docs_held, postings = docs_held + p.hi - p.lo, postings + len(held[-1][1])
                if docs_held >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    flush()
                    docs_held = postings = 0
        if held:
            flush()
        rows = [(i, ids[i], d, s) for i, t in enumerate(top) for s, d in t]
        no, item_ids, keys, scores = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(item_ids, id_type), pa.array(keys, key_arrow),
                                          pa.array(scores, pa.int64())], names=["no", "item", "k", "score"])

    key_arrow = _arrow_type(docs, key)
    found = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, f"no long, item {item_type}, k {key_type}, score long")
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("k"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    return df.select(F.col(f"`{name}`")).limit(0).toArrow().schema.field(0).type


def search(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id",
           query_text: str = "text") -> DataFrame:
    """item, rank, key and score of the ``k`` best documents of every query, all scores above 0."""
    asked = queries.select(F.col(f"`{item}`").alias("item"), F.col(f"`{query_text}`").alias("t"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    chunks = max(1, -(-(size.b + 100 * size.n) // CHUNK_BYTES))
    # a single query longer than a chunk is a chunk of its own size
    dealt = asked.withColumn("c", F.pmod(F.xxhash64("item", "t"), F.lit(chunks)))
    if chunks > 1:
        dealt = cut(dealt)
    id_type, item_type = _arrow_type(queries, item), queries.schema[item].dataType.simpleString()
    parts = []
    for c in range(chunks):
        rows = dealt.where(F.col("c") == c).select("item", "t").orderBy("item", "t").collect()
        if rows:
            part = _rank_chunk(docs, [r.item for r in rows], [r.t for r in rows], key, text, id_type, item_type, k)
            parts += [part] if part is not None else []
    names = [F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("k").alias(key), "score"]
    if not parts:
        kinds = f"item {item_type}, rank int, k {docs.schema[key].dataType.simpleString()}, score long"
        return docs.sparkSession.createDataFrame([], kinds).select(*names)
    return reduce(DataFrame.unionByName, parts).select(*names)
