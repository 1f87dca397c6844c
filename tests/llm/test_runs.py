"""Periodic runs against a direct search; grammar extensions against comparing symbol by symbol."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from regulus.llm import runs
from regulus.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def direct(key, text):
    """The contract, by comparing words q apart for every q."""
    w = WORD.findall(text or "")
    n = len(w)
    if key is not None and n:
        h = zlib.crc32(str(key).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    least = {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s >= q:
                least.setdefault((s, i + q), q)
    found = sorted((s, e - s, q) for (s, e), q in least.items() if e - s >= 12)
    gone = {x for s, m, q in found for x in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    return (key, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def test_extensions_equal_direct_comparison():
    r = np.random.default_rng(1)
    for case in range(60):
        n = int(r.integers(2, 400))
        s = r.integers(0, r.choice([1, 2, 3, 40]), n)
        if case % 3 == 0:
            unit = s[: max(1, n // 7)]
            s = np.tile(unit, 8)[:n]
        s = np.append(s, 1000)
        i, j = r.integers(0, len(s), 300), r.integers(0, len(s), 300)
        i, j = i[i != j], j[i != j]
        want = []
        for a, b in zip(i, j):
            k = 0
            while s[a + k] == s[b + k]:
                k += 1
            want.append(k)
        assert runs.Grammar(s).lce(i, j).tolist() == want


def cases():
    r = random.Random(3)
    docs = [(None, None), (1, ""), (2, " \n "), (3, "a"), (4, "a " * 11), (5, "a " * 12), (6, "a b " * 6), (None, "x y " * 9),
            (7, "a b c d e f " * 2 + "q"), (7, "a b c d e f " * 2 + "q"), (8, "aa " * 5 + "b " + "aa " * 5 + "b " + "c " * 30), (9, "a b c\x0bd " * 20)]
    for k in range(10, 160):
        n, letters = r.choice([5, 30, 80, 200]), r.choice([2, 3, 50])
        w = [f"w{r.randrange(letters)}" for _ in range(n)]
        for _ in range(r.randrange(4)):
            at, q = r.randrange(n), r.randrange(1, 12)
            unit = w[at:at + q]
            w[at:at] = unit * r.randrange(2, 6)
        docs.append((k, r.choice([" ", "\n", "  "]).join(w)))
    return docs


def test_runs_equal_direct_search(spark, monkeypatch):
    docs = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("k", F.lit(1)).withColumn("start", F.lit("clash"))
    want = sorted((direct(*x) for x in docs), key=repr)
    got = runs.periodic_runs(d.repartition(3), planted=True)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert runs.periodic_runs(d.limit(0)).count() == 0
    monkeypatch.setattr(runs, "GRID", 50)  # grid pairs in many slices
    texts = [WORD.findall(t or "") for _, t in docs]
    sliced = [(x[0], *x[1:4]) for x in runs._report([[w.encode() for w in t] for t in texts], 12)]
    assert sliced == [direct(None, t)[1:5] for _, t in docs]


def test_a_long_text_of_one_word_and_one_without_runs():
    r = np.random.default_rng(0)
    one, none = np.zeros(60_000, np.int64), r.permutation(60_000) + 1
    rows = runs.find_runs(np.concatenate((one, [70_000], none, [70_001])), np.array([60_000, 60_000]))
    assert rows.tolist() == [[0, 0, 60_000, 1]]


def test_op12(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op12_runs"](spark, sf).collect()))
    assert got == sorted(direct(*d) for d in docs)
    assert sum(g[1] > 0 for g in got) > len(docs) // 20
