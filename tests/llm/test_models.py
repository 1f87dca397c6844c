"""Language and toxicity models: odd rows, parts against plain computation, held-out accuracy."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from regulus.llm import language, toxicity
from regulus.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.01"


def plain_cost(texts, text):
    """Code length of ``text`` under PPM method C of orders 0 to 3, straight from the definition."""
    counts = {}
    for t in texts:
        data = b"\0\0\0" + t.encode()
        for i in range(3, len(data)):
            for o in range(4):
                counts.setdefault((o, data[i - o:i]), Counter())[data[i]] += 1
    bits = 0.0
    data = b"\0\0\0" + text.encode()
    for i in range(3, len(data)):
        for o in (3, 2, 1, 0):
            c = counts.get((o, data[i - o:i]))
            if c is None:
                continue
            n, q = sum(c.values()), len(c)
            if data[i] in c:
                bits -= math.log2(c[data[i]] / (n + q))
                break
            bits -= math.log2(q / (n + q))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_the_definition():
    a = ["abracadabra abba", "bar abba cab"]
    b = ["zyx wvu zzyx é"]
    m = language.train([("a", t) for t in a] + [("b", t) for t in b])
    for t in ("abba", "zyx q", "é a", "\0\0", "cadabra zzy" * 20):
        best, post, rate = language.score_rows(m, pa.array([t, "", t]))
        want = [plain_cost(a, t), plain_cost(b, t)]
        n = len(t.encode())
        assert best[0] == best[2] == int(np.argmin(want))
        assert abs(rate[0] - min(want) / n) < 0.01
        assert abs(post[0] - 1 / (1 + 2 ** -abs(want[0] - want[1]))) < 0.05


def test_language_of_odd_rows(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the cat"), (4, "the cat"), (None, "der hund")], "doc_id long, text string")
    d = d.withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit("clash"))
    m = language.train([("en", "the cat and the dog sat on the mat " * 5), ("de", "der hund und die katze sind auf der matte " * 5)])
    got = Counter((r.doc_id, r.lang_pred) for r in language.predict(d, m).collect())
    assert got == Counter([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de")])
    assert {r.lang_pred for r in language.predict(d, None).collect()} == {"und"}
    assert language.predict(d.limit(0), m).count() == 0 and language.fitted(d.withColumn("lang", F.lit(None).cast("string")), F.lit(True)) is None


def test_languages_of_short_or_long_texts_only_are_learned(spark):
    en, de, el = "the cat and the dog sat on the mat ", "der hund und die katze sind auf der matte ", "η γάτα και ο σκύλος "
    rows = [(i, "en", en * 3 + str(i)) for i in range(20)] + [(100 + i, "de", de * 200 + str(i)) for i in range(20)]
    rows += [(200 + i, "el", el + str(i)) for i in range(20)] + [(300, "en", ""), (301, "xx", ""), (302, "xx", None)]
    rows += [(400, "en", en * 2 + str(i)) for i in range(500)] + [(None, "fi", "kissa ja koira istuivat matolla"), (1, "en", en * 3 + "1")]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    texts = language.training_texts(d, F.lit(True), per_lang=30)
    assert Counter(la for la, _ in texts) == Counter(en=30, de=20, el=20, fi=1)
    assert all(0 < len(t) <= language.SAMPLE_CHARS for _, t in texts) and all(len(t) >= 50 for la, t in texts if la == "en")
    asked = spark.createDataFrame([(1, "ο σκύλος και η γάτα"), (2, de), (3, en)], "doc_id long, text string")
    got = language.accepted(language.predict(asked, language.train(texts))).collect()
    assert {(r.doc_id, r.lang_pred) for r in got} == {(1, "el"), (2, "de"), (3, "en")}


def test_op8_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang")
    r = QUERIES["op8_language"](spark, MEDIUM).join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert len(r) > 150 and sum(x.lang == x.lang_pred for x in r) >= 0.98 * len(r)
    assert all(0 <= x.score <= 1 for x in r)


def test_label_model_weighs_voters_and_joins_copies():
    r = np.random.default_rng(0)
    y = r.random(2000) < 0.2
    good = np.where(r.random((2000, 5)) < 0.9, y[:, None], ~y[:, None])
    noise = r.random((2000, 1)) < 0.5
    votes = np.where(np.concatenate([good, noise, noise], 1), 1, -1).astype(np.int8)
    post, groups = toxicity.label_model(votes, 0.2)
    assert [5, 6] in groups
    assert ((post > 0.5) == y).mean() > 0.95


def test_label_model_tells_good_words_from_weak_ones():
    r = np.random.default_rng(3)
    n = 4000
    y = r.random(n) < 0.25
    good = (r.random((n, 30)) < np.where(y, 0.25, 0.002)[:, None]).astype(np.int8)
    weak = (r.random((n, 30)) < 0.08).astype(np.int8)
    copies = np.repeat((r.random((n, 1)) < 0.15).astype(np.int8), 8, 1)
    silent = -(good.sum(1, keepdims=True) == 0).astype(np.int8)
    post, groups = toxicity.label_model(np.concatenate([good, weak, copies, silent], 1), 0.25)
    # eight copies of one weak voter are one group, and neither they nor the weak words move a posterior
    assert list(range(60, 68)) in groups
    assert ((post > 0.5) == y).mean() > 0.94
    quiet = good.sum(1) == 0
    assert (post[quiet & (copies[:, 0] == 1)] > 0.5).mean() < 0.02


def test_label_model_of_few_voters():
    post, groups = toxicity.label_model(np.array([[1], [0], [1]], np.int8), 0.5)
    assert groups == [[0]] and len(post) == 3


def test_language_sample_leaves_few_rows_to_rank(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, "xx").otherwise("yy").alias("lang"),
                                     F.concat(F.lit("word " * 20), F.col("id").cast("string")).alias("text"))
    got = Counter(la for la, _ in language.training_texts(docs, F.lit(True), per_lang=40))
    assert got == {"xx": 40, "yy": 40}
    # short texts fill up, repeated rows count once, a NULL key is a key
    short = spark.createDataFrame([(None, "xx", f"t {i % 7}") for i in range(500)] + [(1, "xx", "a text long enough " * 5), (2, "zz", "")], "doc_id long, lang string, text string")
    assert len(language.training_texts(short, F.lit(True), per_lang=40)) == 8
    assert len(language.training_texts(short, F.lit(True), per_lang=4)) == 4


def test_toxicity_of_odd_rows(spark):
    r = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    bad = ["gromp", "blarg", "snortel", "vexxing"]
    texts = []
    for i in range(400):
        t = list(r.choice(words, 40))
        if i % 4 == 0:
            t[::9] = list(r.choice(bad, len(t[::9])))
        texts.append((" ".join(t), int(i % 4 == 0)))
    m = toxicity.train(texts)
    rows = [(1, None), (2, ""), (3, "a gromp of blarg and snortel, vexxing gromp " * 3), (4, " ".join(words)), (None, "x"), (4, "w1")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = toxicity.score(d, m).collect()
    assert len(got) == 6 and {x.doc_id for x in got if x.score >= 0.7} == {3}
    assert {x.score for x in toxicity.score(d, None).collect()} == {0.0} and toxicity.score(d.limit(0), m).count() == 0
    assert toxicity.train([("a", 1)]) is None and toxicity.train([]) is None


def test_toxicity_sample_is_filled_up(spark):
    docs = [(i, "x" * 200 + str(i)) for i in range(60)] + [(i, f"short {i}") for i in range(60, 100)] + [(100, None), (61, "short 61")]
    labels = [(i, int(i % 3 == 0)) for i in range(400)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, F.lit(True), n_toxic=25, n_clean=25, max_chars=100)
    assert sorted(y for _, y in got) == [0] * 25 + [1] * 25
    assert sum(len(t) == 100 for t, y in got if y == 1) == 25 - 14 and not any(len(t) == 100 for t, y in got if y == 0)
    long_only = toxicity.sample(docs.where("doc_id < 60"), labels, F.lit(True), max_chars=100)
    assert Counter(y for _, y in long_only) == {1: 20, 0: 40}
    assert toxicity.sample(docs.limit(0), labels, F.lit(True)) == []
    same_id = spark.createDataFrame([(3, f"text {i}") for i in range(50)], "doc_id long, text string")
    assert len(toxicity.sample(same_id, labels, F.lit(True), n_toxic=5)) == 5


def test_op6_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    r = QUERIES["op6_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = [x.predicted for x in r if x.toxic == 1]
    false = [x.predicted for x in r if x.toxic == 0]
    assert sum(hit) >= 0.7 * len(hit) and sum(false) <= 0.02 * len(false)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in r)
