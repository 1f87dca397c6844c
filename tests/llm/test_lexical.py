"""Ranked search against scoring every document for every query, and against SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from regulus.llm import lexical
from regulus.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def terms(t):
    return TERM.findall((t or "").translate(UPPER))


def brute(docs, items, k=10):
    bags = [Counter(terms(t)) for _, t in docs]
    n_docs, total = sum(bool(b) for b in bags), sum(sum(b.values()) for b in bags)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        rows = []
        for (key, _), bag in zip(docs, bags):
            n = sum(bag.values())
            score = 0
            for t in set(terms(text)) & set(bag):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 90 + (90 * n * n_docs) // total
                score += w * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                rows.append((-score, key is None, key))
        rows.sort()
        out += [(item, i + 1, key, -s) for i, (s, _, key) in enumerate(rows[:k])]
    return Counter(out)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "Über", "x-ray", "naïve", "7"]) if r.random() < 0.4 else f"W{int(r.paretovariate(0.7)) % 300}"
    docs = [(None, None), (1, ""), (2, " -- "), (None, "null key w1 w2 the"), (5, "the the the"), (5, "the the the")]
    docs += [(k, " ".join(word() for _ in range(r.choice([1, 8, 60])))) for k in range(10, 300)]
    docs += [(k, docs[30][1]) for k in range(300, 330)]  # thirty equal texts: ties at every rank
    items = [(None, "w1 w2"), (1, None), (2, "..."), (3, docs[30][1]), (3, "the"), (4, "unheard"), (5, "THE of w3 W3, w4\x00w5")]
    items += [(i, " ".join(word() for _ in range(r.choice([2, 10, 40])))) for i in range(10, 40)]
    return docs, items


def test_search_equals_scoring_everything(spark, monkeypatch):
    docs, items = corpus(5)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("k", F.lit(1)).withColumn("score", F.lit("clash"))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash"))
    want = brute(docs, items)
    assert Counter(map(tuple, lexical.search(d.repartition(3), q).collect())) == want
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 20)
    monkeypatch.setattr(lexical, "DEPTH", 1)
    monkeypatch.setattr(lexical, "CHUNK_BYTES", 2000)  # queries in several chunks, documents in many blocks
    assert Counter(map(tuple, lexical.search(d, q).collect())) == want
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0


def test_reading_stops_early_and_strictly():
    n = 5000
    r = np.random.default_rng(2)
    doc, term = np.repeat(np.arange(n), 3), np.tile(np.arange(3), n)
    impact = r.integers(1, 1000, 3 * n)
    impact[:90] = 5000  # thirty documents far ahead, all equal
    block = lexical.Block(n, 3, doc, term, impact)
    found, score, touched = block.best(np.arange(3), 10, np.zeros(0, np.int64))
    assert sorted(found.tolist()) == list(range(30)) and set(score.tolist()) == {15000}
    assert touched < 200
    # a score known from elsewhere stops the reading at once
    assert block.best(np.arange(3), 1, np.array([15001]))[2] == 0
    assert block.best(np.arange(3), 1, np.array([15000]))[2] > 0


def test_op13(spark, sf):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()]
                   for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = Counter(map(tuple, QUERIES["op13_lexical"](spark, sf).collect()))
    assert got == brute(docs, items)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert Counter(con.execute(ORACLES["op13_lexical"]).fetchall()) == got
