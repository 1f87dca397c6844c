"""Suffix arrays against sorted suffixes, removal against a search for every window."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from regulus.llm import suffix
from regulus.llm.queries import QUERIES


def test_arrays_equal_sorting():
    r = random.Random(3)
    for trial in range(60):
        alphabet = r.choice(["ab", "a", "abcdefgh", "\0a\x01"])
        strings = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 60))).encode() for _ in range(r.randrange(1, 8))]
        if trial % 3 == 0:
            strings += [strings[0], strings[0][1:] or b"a"]
        data = np.frombuffer(b"".join(strings), np.uint8)
        lengths = np.array([len(s) for s in strings])
        suffixes = [([*[b + 1 for b in s[i:]], 0, k], s[i:]) for k, s in enumerate(strings) for i in range(len(s))]
        want = sorted(range(len(suffixes)), key=lambda i: (suffixes[i][0][:-2], suffixes[i][0][-1]))
        sa, _ = suffix.suffix_array(data, lengths)
        assert sa.tolist() == want
        lcp = suffix.common_prefixes(data, lengths, sa)
        for a, b in zip(want, want[1:]):
            x, y = suffixes[a][1], suffixes[b][1]
            n = next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))
            assert lcp[b] == n
        assert lcp[want[0]] == 0


def brute(docs, span):
    raws = [(t or "").encode() for _, t in docs]
    at = Counter(x[i:i + span] for x in raws for i in range(len(x) - span + 1))
    out = []
    for (k, _), x in zip(docs, raws):
        gone = bytearray(len(x))
        for i in range(len(x) - span + 1):
            if at[x[i:i + span]] > 1:
                gone[i:i + span] = b"\1" * span
        kept = bytes(c for c, g in zip(x, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((k, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefghij é\n") for _ in range(n))
    passage, common = text(150), text(90)
    docs = [(None, None), (1, ""), (2, "short"), (3, "x" * 500), (4, "ab" * 200), (5, passage + passage), (5, passage + passage), (6, "\0" * 70)]
    for i in range(10, 60):
        docs.append((i, text(r.randrange(0, 200)) + (passage[r.randrange(40):] if i % 3 else "") + text(r.randrange(0, 90))))
    for i in range(60, 140):
        docs.append((i, text(r.randrange(3, 60)) + common + text(r.randrange(3, 60))))
    docs += [(200 + i, docs[20][1]) for i in range(4)] + [(None, docs[30][1]), (300, docs[30][1][:-1] + "Z")]
    r.shuffle(docs)
    return docs


def test_removal_equals_search(spark):
    docs = corpus(8)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("tid", F.lit("clash")).withColumn("key", F.lit(1))
    want = brute(docs, 60)
    assert Counter(map(tuple, suffix.removal(d.repartition(4), span=60).collect())) == want
    assert Counter(map(tuple, suffix.removal(d, span=60, hot_texts=5, shard_bytes=3000).collect())) == want  # hot keys across shards
    assert suffix.removal(d.limit(0)).count() == 0
    texts = suffix.removal(d, span=60, with_bytes=True).where("kept is not null").collect()
    assert texts and all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in texts)


def test_op10(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, QUERIES["op10_suffix"](spark, sf).collect())) == brute(docs, 200)


def test_shared_suffixes_are_those_with_a_neighbour_of_equal_depth():
    r = random.Random(8)
    for trial in range(80):
        alphabet = r.choice(["ab", "a", "abcdefgh", "\0a\x01"])
        strings = ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 90))).encode() for _ in range(r.randrange(1, 8))]
        strings += [strings[0], strings[0][1:]]
        data = np.frombuffer(b"".join(strings), np.uint8)
        lengths = np.array([len(s) for s in strings])
        for depth in (3, 8, 9, 20, 40):
            begins = np.cumsum(lengths) - lengths
            windows = {int(a) + i: s[i:i + depth] for a, s in zip(begins, strings) for i in range(len(s) - depth + 1)}
            times = Counter(windows.values())
            got = suffix.shared_suffixes(data, lengths, depth).tolist()
            assert sorted(got) == [i for i, x in windows.items() if times[x] > 1]
            assert [windows[i] for i in got] == sorted(windows[i] for i in got)


def test_sorting_stops_at_the_window():
    # two texts that differ in their first byte only: the order of whole suffixes took a step for every doubling of their length
    r = random.Random(9)
    body = bytes(r.randrange(1, 256) for _ in range(60_000))
    data = np.frombuffer(b"a" + body + b"b" + body, np.uint8)
    sorts, plain = [], np.argsort
    try:
        np.argsort = lambda a, *args, **kw: sorts.append(len(a)) or plain(a, *args, **kw)
        flag = suffix.repeated_windows(data, np.array([60_001, 60_001]), 200)
    finally:
        np.argsort = plain
    assert flag.sum() == 2 * (60_000 - 199) and not flag[0] and not flag[60_001]
    assert len(sorts) <= 6
