"""Line-first cleaning and curriculum mixing against plain Python, on odd rows and on the smallest tables."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from regulus.llm import mixing, quality
from regulus.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c d e f a b c d e f"), (5, "a b c d e a b c d e"), (6, "x " * 50),
       (7, "one line.\none line.\n\n \none line.\nother"), (8, "Home\nlogin\n" + "This is a sentence of ten words, and it stays here. " * 3),
       (9, "# * $ | < > & % done"), (9, "# * $ | < > & % done"), (None, "a\x0bb\x0cc\x85d e"), (10, "é" * 3 + " ñ ñ o"),
       (11, "home | about | news | contact | help | jobs\n" + " ".join(f"w{i}." for i in range(30)))]


def base(t):
    t = t or ""
    w = WORD.findall(t)
    at = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if at[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed)


def test_base_counts_on_odd_rows(spark):
    d = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("quality", F.lit(0))
    got = Counter((r.doc_id, *tuple(r.quality)[:6]) for r in quality.assess(d).collect())
    assert got == Counter((k, *base(t)) for k, t in ODD)
    assert quality.assess(d.limit(0)).count() == 0


def test_cleaning_removes_lines_then_documents(spark):
    d = spark.createDataFrame(ODD, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in quality.clean(d).collect()}
    assert "home | about" not in kept[11] and kept[11].startswith("w0.")
    assert kept.get(8) is None or not kept[8].startswith("Home")
    assert 6 not in kept and 1 not in kept


def test_op5_matches_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op5_quality"](spark, sf).collect()
    assert Counter(tuple(r)[:7] for r in rows) == Counter((d.doc_id, *base(d.text)) for d in docs)
    assert all(not (r.kept and r.base_failed) for r in rows)


def water(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = left / sum(w[s] for s in free)
        over = [s for s in free if share * w[s] > cap * sizes[s]]
        if not over:
            return out | {s: share * w[s] for s in free}
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
            free.discard(s)
    return out


def check_mix(docs, rows):
    size = defaultdict(int)
    for _, t, s in docs:
        size[s] += len(WORD.findall(t or ""))
    want = water(dict(size))
    by_id = defaultdict(list)
    for k, t, s in docs:
        by_id[k].append((len(WORD.findall(t or "")), s))
    taken = defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        n, s = next(x for x in by_id[r.doc_id] if x[0] == r.size and abs(want[x[1]] - r.target) < 1e-6 * max(1, r.target))
        assert r.source_size == size[s] and r.taken <= 3 * r.size and (r.taken % r.size == 0 if r.size else r.taken == 0)
        taken[s] += r.taken
    for s in size:
        longest = max([n for v in by_id.values() for n, x in v if x == s])
        assert abs(taken[s] - want[s]) <= longest / 2 + 1, s


def test_op7_targets_and_takes(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = QUERIES["op7_mixing"](spark, sf).collect()
    check_mix(docs, rows)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, QUERIES["op7_mixing"](spark, sf).collect()))


def test_mix_on_odd_tables(spark):
    docs = [(i, "w " * (i % 7), "big") for i in range(300)] + [(1000 + i, "v " * 3, None) for i in range(5)]
    docs += [(2000, None, "a"), (2001, "", "a"), (None, "one two", "é"), (7, "w " * 0, "big"), (3000, "z " * 900, "zz")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    p = mixing.plan(d, mixing.n_words(F.col("text")), tile_rows=16)
    rows = p.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_total").alias("source_size"),
                    F.col("_mix_target").alias("target"), (F.col("_mix_copies") * F.col("_mix_size")).alias("taken")).collect()
    check_mix(docs, rows)
    mix = mixing.mixture(d, mixing.n_words(F.col("text")), tile_rows=16)
    assert mix.columns == d.columns
    assert mix.count() == p.agg(F.sum("_mix_copies")).first()[0]
    assert mixing.mixture(d.limit(0), mixing.n_words(F.col("text"))).count() == 0


def test_positions_follow_the_integral(spark):
    d = spark.createDataFrame([(i, "w " * 10, "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    p = mixing.plan(d, mixing.n_words(F.col("text")), cap=1).where("_mix_copies > 0").select("source", mixing.position(F.lit(0)).alias("p"))
    r = {x.source: x.h / x.n for x in p.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.expr("int(p < 0.5)")).alias("h")).collect()}
    assert abs(r["a"] - 0.625) < 0.02 and abs(r["b"] - 0.5) < 0.02 and abs(r["c"] - 0.375) < 0.02
