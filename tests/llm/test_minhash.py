"""MinHash classes against all pairs, posterior bounds against the definition, and SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from regulus.llm import minhash
from regulus.llm.queries import ORACLES, QUERIES
from regulus.llm.textops import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def shingles(t):
    w = WORD.findall((t or "").translate(UPPER))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def components(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def brute(docs, percent=85):
    s = [shingles(t) for _, t in docs]
    at = {}
    for i, x in enumerate(s):
        for g in x:
            at.setdefault(g, []).append(i)
    both = Counter((i, j) for v in at.values() for a, i in enumerate(v) for j in v[a + 1:])
    root = components(len(docs), [(i, j) for (i, j), c in both.items() if 100 * c >= percent * (len(s[i]) + len(s[j]) - c)])
    least = {}
    for (k, _), r in zip(docs, root):
        if k is not None:
            least[r] = min(least.get(r, k), k)
    out = [(k, len(s[i]), least.get(root[i]) if s[i] else k) for i, (k, _) in enumerate(docs)]
    return Counter((*x, x[0] == x[2]) for x in out)


def noisy(r, words, share):
    return [r.choice("pqrstuv") + str(r.randrange(999)) if r.random() < share else w for w in words]


def corpus(seed):
    r = random.Random(seed)
    docs = [(None, None), (1, ""), (2, " \t "), (3, "One two"), (4, "one TWO"), (5, "one two three four five"), (None, "null key text a b c d"),
            (6, "null key text a b c d"), (7, "one two"), (7, "one two"), (8, "x"), (None, "only nulls here")]
    k = 10
    for g in range(14):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([12, 40, 150]))]
        for _ in range(r.choice([2, 5, 40])):
            docs.append((k, " ".join(noisy(r, base, r.choice([0, 0.005, 0.015, 0.03])))))
            k += 1
    text = [f"c{i}" for i in range(240)]  # a chain: neighbours are similar, ends are not
    for i in range(30):
        docs.append((k, " ".join(text[i * 4:i * 4 + 120])))
        k += 1
    passage = [f"p{i}" for i in range(60)]
    docs += [(k + i, " ".join([f"z{r.randrange(9999)}" for _ in range(r.choice([5, 20, 60]))] + passage)) for i in range(40)]
    r.shuffle(docs)
    return docs


def test_classes_equal_all_pairs(spark, monkeypatch):
    docs = corpus(4)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("sid", F.lit(1)).withColumn("k", F.lit("clash"))
    want = brute(docs)
    assert Counter(map(tuple, minhash.classes(d.repartition(5)).collect())) == want
    assert len({c for _, _, c, _ in want}) < len(docs) - 60
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(minhash, "HOT_CHECKS", 3)
    assert Counter(map(tuple, minhash.classes(d, block=7).collect())) == want  # clusters split, hot roots salted
    assert minhash.classes(d.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        both = mix(r.integers(0, 2**62, 400).astype(np.uint64))
        got = []
        for _ in range(30):
            own = int(round(400 * (1 - share) / share / 2))
            a, b = (np.concatenate((both, mix(r.integers(0, 2**62, own).astype(np.uint64)))) for _ in range(2))
            s = minhash.signatures(np.repeat([0, 1], len(a)), np.concatenate((a, b)), 2)
            got.append((s[0] == s[1]).mean())
        assert abs(np.mean(got) - share) < 0.02


def test_posterior_bounds():
    r = np.random.default_rng(1)
    least = minhash.least_matches(85, miss=0.05)
    assert len(least) == 12 and all(a <= b for a, b in zip(least, least[1:]))
    for i in (0, 5, 11):
        n = 32 * (i + 1)
        for m, above in ((least[i], True), (least[i] - 1, False)):
            mass = (r.beta(m + 1, n - m + 1, 200_000) >= 0.85).mean()
            assert (mass > 0.045) if above else (mass < 0.055)
    # pairs at the threshold are hardly ever given up, unlike ones well below it
    sure = minhash.least_matches(85)
    one = r.integers(0, 2**31, 384).astype(np.uint32)

    def others(similarity):
        return np.where(r.random((20_000, 384)) < similarity, one, one + np.uint32(1))

    assert len(minhash.plausible(one, others(0.85), sure)) == 20_000
    assert len(minhash.plausible(one, others(0.5), sure)) == 0


def test_block_links_equal_all_pairs():
    r = np.random.default_rng(0)
    least = minhash.least_matches(85)
    for case in range(15):
        base = mix(np.arange(80, dtype=np.uint64) + np.uint64(1000 * case))
        sets = [np.unique(np.where(r.random(80) < r.choice([0, 0.04, 0.1]), mix(r.integers(0, 2**60, 80).astype(np.uint64)), base)) for _ in range(30)]
        size = np.array([len(x) for x in sets])
        sig = minhash.signatures(np.repeat(np.arange(30), size), np.concatenate(sets), 30)
        label = np.array([b"%d" % (i // 2 if case % 2 else i) for i in range(30)], object)
        given = [(i, i - 1) for i in range(1, 30, 2)] if case % 2 else []
        want = list(given)
        for i in range(30):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (size[i] + size[j] - both):
                    want.append((i, j))
        got = minhash.link_block(size, sets, sig, label, least, 85)
        groups = [{frozenset(np.flatnonzero(np.array(c) == x)) for x in c} for c in (components(30, want), components(30, got + given))]
        assert groups[0] == groups[1]


def test_op11(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = Counter(map(tuple, QUERIES["op11_minhash"](spark, sf).collect()))
    assert got == brute(docs)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert Counter(con.execute(ORACLES["op11_minhash"]).fetchall()) == got


def test_stars_are_contracted_before_components(spark):
    # 300 sets with 12 pivots each, and a second cluster: many links, about one a set are left
    r = random.Random(3)
    links = {(100 + i, p) for i in range(300) for p in r.sample(range(20), 12)} | {(900 + i, 800 + p) for i in range(5) for p in range(i + 1)}
    stars = spark.createDataFrame([(s, p, 1) for s, p in links], "s long, pivot long, shared long")
    few = minhash._contracted(stars)
    assert few.count() < 500 < len(links)
    got = {x.node: x.label for x in minhash.connected(few, "s", "pivot").collect()}
    assert got == {x.node: x.label for x in minhash.connected(stars, "s", "pivot").collect()}
