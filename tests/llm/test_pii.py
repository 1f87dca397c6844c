"""Patterns against plain searches, the decoder against full Viterbi, and the field against near misses."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from regulus.llm import pii
from regulus.llm.queries import QUERIES
from regulus.llm.textops import pieces

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(text):
    out = []
    for k, p in PATTERNS.items():
        own = []
        for m in p.finditer(text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            if (k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or k == "card" and 13 <= len(d) <= 19 and pii.luhn(d) or k == "phone" and 9 <= len(d) <= 15):
                own.append(m.span())
        out.append(own)
    return out


ODD = [None, "", "a@b.c_d@e.f", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.04", "4111 1111-1111 1111", "+1 (415) 555-2671 x",
       "+1((((((", "5", "a" * 20000 + "@b.co", "9" * 5000, "1." * 3000, "é 4111111111111111, ñ@x.yy z@x.yy", "+" * 50 + "1234567890",
       "a@b.c@d.e", "..@..a.b", "\n\n1.1.1.1\n+49 30 1234567"]


def test_patterns_on_odd_and_random_texts():
    r = random.Random(5)
    texts = ODD + ["".join(r.choice("ab1239.@+-() \né4") for _ in range(r.randrange(60))) for _ in range(4000)]
    for t in texts:
        assert pii.base_spans(t or "") == plain(t), t


def test_stretches_decode_like_whole_lines():
    r = np.random.default_rng(2)
    f = pii.Field(tuple(r.normal(0, 1, (n, pii.TAGS)) for n in pii._OWN), r.normal(0, 1, (pii._NEAR, pii.TAGS)),
                  r.normal(0, 1, (pii._NEAR, pii.TAGS)), r.normal(0, 1, (pii.TAGS + 1, pii.TAGS + 1)))
    f.own[0][:, 0] += 6
    rnd = random.Random(1)
    text = "".join(rnd.choice(["ab ", "A1 ", "+4 ", "x@y.z ", "1.2 ", "\n", "12-3 ", "é "]) for _ in range(3000))
    w = pii.shapes(next(pieces(pa.array([text]))))
    e, got = f.emissions(w), pii.decode(f, w)
    for line in np.unique(w.line):
        at = np.flatnonzero(w.line == line)

        def worth(tags):
            path = [pii.TAGS, *tags, pii.TAGS]
            return sum(f.step[a, b] for a, b in zip(path, path[1:])) + sum(e[i, t] for i, t in zip(at, tags))

        best = f.step[pii.TAGS, :pii.TAGS] + e[at[0]]
        for i in at[1:]:
            best = (best[:, None] + f.step[:pii.TAGS, :pii.TAGS]).max(0) + e[i]
        assert abs((best + f.step[:pii.TAGS, pii.TAGS]).max() - worth(got[at].tolist())) < 1e-6


def test_field_learns_and_base_spans_stay(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    lines = []
    for i in range(300):
        w = [word() for _ in range(12)]
        w[5] = r.choice([f"{word()}@{word()}.com", f"{r.randrange(1, 250)}.{r.randrange(250)}.{r.randrange(250)}.{r.randrange(250)}", word(), word()])
        lines.append(" ".join(w))
    field = pii.train(lines)
    t = "abc def us@ma_ch.de ghi 10.20.30.40 plain words here"
    base, every = next(pii.all_spans(field, next(pieces(pa.array([t])))))
    assert base[0] == [] and every[0] == [(8, 19)] and every[1] == base[1] == [(24, 35)]
    docs = spark.createDataFrame([(1, t, "x"), (2, None, "y"), (2, None, "y"), (None, "", "z")], "doc_id long, text string, spans string")
    out = pii.redact(docs, field)
    assert out.columns == docs.columns
    assert Counter(r.text for r in out.collect()) == Counter(["abc def <EMAIL> ghi <IP> plain words here", None, None, ""])
    assert pii.find(docs.limit(0), None).count() == 0 and pii.find(docs, None).where("spans = ''").count() == 3
    assert pii.fitted(docs.limit(0)) is None


def test_op1(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op1_pii"](spark, sf).collect()
    want = Counter()
    for d in docs:
        b = plain(d.text)
        want[(d.doc_id, *map(len, b), hashlib.sha256(pii.joined(b).encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:6] for r in rows) == want
    texts = {d.doc_id: d.text for d in docs}
    extra = 0
    for r in rows:
        base = set(filter(None, pii.joined(plain(texts[r.doc_id])).split(",")))
        assert base <= set(r.spans.split(",")) | {""}
        extra += len(set(filter(None, r.spans.split(","))) - base)
        for x in set(filter(None, r.spans.split(","))) - base:
            print(x, texts[r.doc_id][int(x.split(":")[1]):int(x.split(":")[2])])
    assert extra < 40


def test_the_sample_is_bounded_in_rows_and_filled_by_long_texts(spark):
    many = spark.range(300).select(F.lit(7).alias("doc_id"), F.concat(F.lit("call +1 555 010 "), F.lpad(F.col("id").cast("string"), 4, "0")).alias("text"))
    assert len(pii.labelled_texts(many, n=50)) == 50
    long = spark.createDataFrame([(None, "a@b.cc " + "x " * 40), (2, "word " * 40 + "1.2.3.4"), (3, "short 10.0.0.1"), (4, None), (5, "")], "doc_id long, text string")
    got = pii.labelled_texts(long, n=10, max_chars=50)
    assert sorted(got) == sorted([("a@b.cc " + "x " * 40)[:50], "short 10.0.0.1"])  # a long text without a digit in its beginning teaches nothing
    assert pii.labelled_texts(long, n=1, max_chars=50) == ["short 10.0.0.1"]  # short ones first
    assert pii.fitted(long, max_chars=10) is not None


def plain_spans(field, text):
    """Spans of the field as before: prefixes decoded, every base span compared."""
    p = next(pieces(pa.array([text], pa.string())))
    raw, base = text.encode(), pii.base_spans(text)
    out = [list(x) for x in base]
    for kind, s, e in pii.field_spans(field, p).get(0, ()):
        s, e = len(raw[:s].decode()), len(raw[:e].decode())
        if not any(a < e and s < b for own in base for a, b in own):
            out[kind].append((s, e))
    return [sorted(x) for x in out]


def test_many_spans_in_one_text(spark):
    # the field learns from valid numbers and adds those that fail the check digit
    rows = [(i, f"pay 4111 1111 1111 1111 or mail me.{i}@ex.org é at 10.0.{i % 300}.1 now +44 20 7946 0{i:03d}") for i in range(200)]
    field = pii.fitted(spark.createDataFrame(rows, "doc_id long, text string"))
    text = " ü ".join(t.replace("1111 or", f"{1000 + i} or") for i, t in rows)
    got = list(pii.all_spans(field, next(pieces(pa.array([text], pa.string())))))[0][1]
    want = plain_spans(field, text)
    assert got == want and sum(map(len, got)) > sum(map(len, pii.base_spans(text)))
    big = " ".join([text] * 60)  # about a megabyte
    t0 = time.time()
    n = sum(map(len, list(pii.all_spans(field, next(pieces(pa.array([big], pa.string())))))[0][1]))
    assert n >= 59 * sum(map(len, got)) and time.time() - t0 < 20
