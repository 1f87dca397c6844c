"""Tokens against the library as a whole, bounds and packings against exact facts."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from regulus.llm import packing
from regulus.llm.queries import QUERIES

ODD = ["Don't stop", "naïve café ÉTÉ", "a\x1cb c", "été ẛ̣", "İstanbul ΣΑΣ ß ẞ", "x<|endoftext|>y", "", "  \n", "日本語 text",
       "ﬁne ½ ²", "word,. word!? (paren) 'll", "x's ''s 1a2 A¡b ×÷ a\xadb a\x0bc d\xa0e É\u0301 ###&&& é#s", "a b c", "ÿ Ÿ µ ª º", "́abc abć d"]


def test_encoder_equals_the_library(spark, sf):
    path = packing.vocabulary_path()
    lib, own = Tokenizer.from_file(path), packing.Encoder(path)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def optimum(sizes, c):
    for n in range(1, len(sizes) + 1):
        for way in itertools.product(range(n), repeat=len(sizes)):
            load = [0] * n
            for s, b in zip(sizes, way):
                load[b] += s
            if max(load) <= c:
                return n
    return 0


def test_bounds_never_exceed_the_optimum():
    r = np.random.default_rng(3)
    for _ in range(60):
        sizes = r.integers(1, 41, r.integers(1, 7))
        bins, offsets = packing.best_fit_decreasing(sizes, 40)
        best = optimum(sizes.tolist(), 40)
        assert packing.lower_bound(sizes, 40) <= best <= bins.max() + 1
        check_places([(b, o, s) for b, o, s in zip(bins, offsets, sizes)], 40)
    assert packing.lower_bound(np.array([1100] * 9), 2048) == 9


def check_places(rows, c):
    by = defaultdict(list)
    for b, o, n in rows:
        by[b].append((o, n))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= c


def test_exchange_rounds(spark):
    docs = [(i % 50, "word " * (i % 37)) for i in range(900)] + [(None, None), (1, "long " * 300)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    out = packing.packed_documents(d, capacity=64, per_partition=60).collect()
    check_places([(r.sequence_id, r.offset, r.length) for r in out], 64)
    total = sum(r.length for r in out)
    assert total == sum((t or "").count(" ") for _, t in docs) + len(docs)
    assert len({r.sequence_id for r in out}) <= -(-total // 64) + 2
    assert packing.packed_documents(d.limit(0)).count() == 0


def test_op2(spark, sf):
    lib = Tokenizer.from_file(packing.vocabulary_path())
    docs = {r.doc_id: lib.encode(r.text or "", add_special_tokens=False).ids + [0]
            for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = QUERIES["op2_packing"](spark, sf).collect()
    check_places([(r.sequence_id, r.offset, r.length) for r in out], 2048)
    got = defaultdict(int)
    for r in out:
        ids = docs[r.doc_id][r.start:r.start + r.length]
        assert r.start == r.piece * 2048 and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        got[r.doc_id] += r.length
    assert dict(got) == {k: len(v) for k, v in docs.items()}
    assert len({r.sequence_id for r in out}) <= -(-sum(map(len, docs.values())) // 2048) + 1


def test_groups_stay_within_their_size(spark, monkeypatch):
    sizes = []
    real = packing._packer

    def watched(capacity, last):
        run = real(capacity, last)

        def spy(g):
            out = run(g)
            out["gap"] = len(g)  # carried out in place of the gap
            return out
        return spy

    monkeypatch.setattr(packing, "_packer", watched)
    r = np.random.default_rng(7)
    items = spark.createDataFrame([(i, int(x)) for i, x in enumerate(r.integers(500, 900, 6000))], "uid long, length long")
    sizes = [x.gap for x in packing.pack(items, per_partition=250).select("gap").distinct().collect()]
    assert max(sizes) < 1.3 * 250  # dealt by hash: about 250 each in every round


def test_memory_of_words_is_bounded_and_keeps_frequent_ones():
    made = []
    m = packing.Recent(lambda k: made.append(k) or k.encode(), 10)
    for i in range(200):
        assert m[f"rare {i}"] == f"rare {i}".encode() and m["frequent"] == b"frequent"
        assert len(m) + len(m.old) <= 20
    assert made.count("frequent") == 1
