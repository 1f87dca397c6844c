"""Phrase places against plain Python; templates with edits must be found and near misses not."""

import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from regulus.llm import licenses
from regulus.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def base(t):
    w = WORD.findall((t or "").translate(UPPER))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


MIT = licenses.TEMPLATES["mit"]
ODD = [(1, None), (2, ""), (3, "MIT License"), (4, "é mit\nlicense mitlicense mit license cc-by CC BY cc by"),
       (5, "gnu general public license apache license, apache-license"), (6, MIT.title()), (7, MIT.replace("copy ", "copy or two ")),
       (8, " ".join(MIT.split()[:10])), (9, "we rights to use copy of a merge and sell copies now " * 3), (9, MIT), (9, MIT),
       (None, "xmit license mit licensed ccby"), (10, "İ MIT\x00LICENSE ünd apache license"), (11, "w " * 30000 + MIT)]


def test_odd_rows(spark):
    d = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("uid", F.lit(1))
    rows = licenses.scan(d).collect()
    assert Counter((r[0], *tuple(r)[1:6]) for r in rows) == Counter((k, *base(t)) for k, t in ODD)
    found = {r.doc_id: r for r in rows}
    assert all("mit" in found[k].labels.split(",") for k in (6, 7, 11))
    assert sorted(r.labels for r in rows if r.doc_id == 9) == ["", "mit", "mit"]  # three rows share the id
    assert found[8].labels == "" and found[1].score == 0 and found[3].score == 1
    assert licenses.scan(d.limit(0)).count() == 0


def test_op9(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op9_licenses"](spark, sf).collect()
    assert Counter((r.doc_id, *tuple(r)[1:6]) for r in rows) == Counter((d.doc_id, *base(d.text)) for d in docs)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)


def chains(w, template, k=licenses.GRAM, gap=licenses.MERGE_GAP):
    """Best accepted share by plain loops over all pairs of matched stretches."""
    tw = template.split()
    match = {(i, j) for i in range(len(w) - k + 1) for j in range(len(tw) - k + 1) if w[i:i + k] == tw[j:j + k]}
    runs = []
    for i, j in sorted(match):
        if (i - 1, j - 1) not in match:
            m = 1
            while (i + m, j + m) in match:
                m += 1
            runs.append((i, j, m + k - 1))
    state, best = [], 0.0
    for i, j, n in runs:
        top = (n, n, i - j)
        for (i0, j0, n0), (worth, words, home) in zip(runs, list(state)):
            new = min(i + n - i0 - n0, j + n - j0 - n0, n)
            near = abs(i0 - j0 - i + j) <= gap and i - i0 - n0 <= len(tw) // 2 + gap and abs(home - i + j) <= len(tw) // 2
            if i0 < i and j0 < j and new > 0 and near and worth + new - max(i - i0 - n0, 0) > top[0]:
                top = (worth + new - max(i - i0 - n0, 0), words + new, home)
        state.append(top)
        if top[0] >= 0 and top[1] >= licenses.LEAST_COVER * len(tw):
            best = max(best, min(1.0, top[1] / len(tw)))
    return best


def method(t):
    w = WORD.findall((t or "").translate(UPPER))
    share = {name: chains(w, x) for name, x in licenses.TEMPLATES.items()}
    n, places, *_, labels = base(t)
    every = {licenses.LABEL.get(k, k) for k, v in share.items() if v > 0} | set(filter(None, labels.split(",")))
    return ",".join(sorted(every)), 1.0 if places else max(share.values())


def mixed_texts(n, seed=3):
    r = random.Random(seed)
    names = list(licenses.TEMPLATES)
    for _ in range(n):
        out = []
        for _ in range(r.randint(1, 4)):
            w = licenses.TEMPLATES[r.choice(names)].split()
            kind = r.randrange(5)
            if kind == 0:
                w = w[:r.randint(4, len(w))] * r.randint(1, 6)  # a beginning, repeated
            elif kind == 1:
                cut = r.randrange(len(w))
                w = w[cut:] + w[:cut]  # halves in the wrong order
            elif kind == 2:
                w = [y for x in w for y in ([x] if r.random() < 0.85 else [x, "extra", "words"])]
            elif kind == 3:
                w = [x for x in w if r.random() < 0.9]
            out += w + ["between"] * r.randint(0, 30)
        yield " ".join(out)


def test_labels_and_scores_equal_brute_force(spark):
    texts = [t for _, t in ODD if t is None or len(t) < 5000] + list(mixed_texts(60))
    texts += [MIT.replace("software", "program"), " ".join(["permission is hereby granted"] * 30), " ".join(["permission is hereby granted"] * 30) + " " + MIT]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: (r.labels, round(r.score, 12)) for r in rows}
    want = {i: (x, round(y, 12)) for i, (x, y) in enumerate(map(method, texts))}
    assert got == want and len({x for x, _ in want.values()}) > 8


def test_a_repeated_passage_is_no_license(spark):
    t = "permission is hereby granted " * 30
    halves = MIT.split()
    d = [(1, t), (2, t + MIT), (3, " ".join(halves[25:] + halves[:25])), (4, "this program is free software " * 500)]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(d, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "mit", 3: "", 4: ""}


def test_very_many_places_and_votes(spark):
    d = [(1, "the mit license, " * 60_000), (2, "permission is hereby granted " * 35_000), (3, (MIT + " ") * 3_000)]
    t0 = time.time()
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(d, "doc_id long, text string")).collect()}
    assert time.time() - t0 < 60
    assert (got[1].n_base, got[1].first_word, got[1].last_word) == (60_000, 1, 3 * 59_999 + 1)
    assert got[2].labels == "" and got[3].labels == "mit" and got[3].score == 1
