"""Plan patterns against plain sequential versions, with tiles and hot limits small enough to matter."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from regulus.plans.greedy import cover_regions, greedy_positions
from regulus.plans.ordered import add_average_ranks, exact_percentiles, ordered_values
from regulus.plans.range_join import overlap_join, point_join
from regulus.plans.tiling import depth_segments, gap_clusters, neighbours
from regulus.session import salted_join


def random_points(seed, n, span):
    rng = random.Random(seed)
    return [(rng.choice("ab"), rng.randrange(span)) for _ in range(n)]


@pytest.mark.parametrize("step", [3, 17, 90])
def test_greedy_equals_sequential(spark, step):
    pts = random_points(step, 800, 3000) + [("a", p) for p in range(500, 700)]
    want = set()
    for c in "ab":
        last = None
        for p in sorted(p for k, p in pts if k == c):
            if last is None or p - last >= step:
                want.add((c, p))
                last = p
    df = spark.createDataFrame(pts, "contig string, pos long")
    # a tile of 16 * step positions, so dense runs cross many tiles
    got = {tuple(r) for r in greedy_positions(df, ["contig"], "pos", step, width=1).collect()}
    assert got == want


def test_greedy_skips_empty_tiles(spark):
    df = spark.createDataFrame([("a", 0), ("a", 10), ("a", 100_000), ("a", 100_001)], "contig string, pos long")
    assert {r.pos for r in greedy_positions(df, ["contig"], "pos", 5, width=80).collect()} == {0, 10, 100_000}


def test_greedy_composes_many_tiles(spark):
    rng = random.Random(8)
    pos = sorted({rng.randrange(-40_000, 60_000) for _ in range(9000)} | set(range(0, 900)))
    want, last = [], None
    for p in pos:
        if last is None or p - last >= 6:
            want.append(p)
            last = p
    df = spark.createDataFrame([(None, p) for p in pos] + [("b", p) for p in pos[:50]], "contig string, pos long")
    # tiles of 96 positions: over 1,000 on the NULL contig, composed three at a time over seven levels
    for fan in (3, 32):
        got = greedy_positions(df, ["contig"], "pos", 6, width=1, fan=fan).collect()
        assert sorted(r.pos for r in got if r.contig is None) == want
        assert sorted(r.pos for r in got if r.contig == "b") == [p for p in want if p <= pos[49]]
    assert greedy_positions(df.limit(0), ["contig"], "pos", 6).count() == 0


def sequential_cover(regions, size, half, span, length):
    off = (length - span) // 2
    out = {}
    pending = sorted(regions, key=lambda r: (r[1], r[0]))
    while pending:
        first = pending[0][1]
        w = max(0, min(first - half - off, size - length))
        took = [r for r in pending if r[1] - half >= w + off and r[1] + half <= w + off + span]
        if not took:
            out[pending.pop(0)[0]] = None
            continue
        for r in took:
            out[r[0]] = w
        gone = {r[0] for r in took}
        pending = [r for r in pending if r[0] not in gone]
    return out


@pytest.mark.parametrize("size", [400, 1000, 60])
def test_window_cover_equals_sequential(spark, size):
    rng = random.Random(size)
    half, span, length = 4, 40, 100
    for lo in (0, 45):
        regions = [(i, rng.randrange(lo, max(size, lo + 1))) for i in range(60)]
        want = sequential_cover(regions, size, half, span, length)
        df = spark.createDataFrame([(i, "a", p) for i, p in regions], "id long, contig string, center long")
        sizes = spark.createDataFrame([("a", size)], "contig string, size long")
        got = {r.id: r.wstart for r in cover_regions(df, sizes, half, span, length).collect()}
        assert got == want


def test_window_cover_reports_unknown_contig(spark):
    df = spark.createDataFrame([(1, "zz", 50)], "id long, contig string, center long")
    sizes = spark.createDataFrame([("a", 400)], "contig string, size long")
    row = cover_regions(df, sizes, 4, 40, 100).collect()[0]
    assert (row.wstart, row.status) == (None, "no_contig")


def sequential_depth(intervals, k):
    events = sorted([(s, 1) for s, e in intervals] + [(e, -1) for s, e in intervals])
    depth, start, out = 0, None, []
    for pos, d in events:
        prev, depth = depth, depth + d
        if prev < k <= depth:
            start = pos
        elif prev >= k > depth and start is not None:
            out.append((start, pos))
            start = None
    return out


@pytest.mark.parametrize("k", [1, 2, 3])
def test_depth_equals_sweep(spark, k):
    rng = random.Random(k)
    data = []
    for c in "ab":
        for _ in range(200):
            s = rng.randrange(600)
            data.append((c, s, s + rng.randrange(1, 30)))
    df = spark.createDataFrame(data, "contig string, s long, e long")
    got = {(r.contig, r.start, r.end) for r in depth_segments(df, ["contig"], "s", "e", k, width=16).collect()}
    want = {(c, *x) for c in "ab" for x in sequential_depth([(s, e) for cc, s, e in data if cc == c], k)}
    assert got == want


def test_depth_abutting_and_touching(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 10, 20)], "contig string, s long, e long")
    assert depth_segments(df, ["contig"], "s", "e", 2).count() == 0
    apart = {(r.start, r.end) for r in depth_segments(df, ["contig"], "s", "e", 1).collect()}
    merged = {(r.start, r.end) for r in depth_segments(df, ["contig"], "s", "e", 1, touching=True).collect()}
    assert apart == {(0, 10), (10, 20)} and merged == {(0, 20)}


def test_neighbours_across_tiles(spark):
    table = [5, 400, 401, 9000]
    asked = [0, 5, 6, 250, 400, 402, 8999, 9000, 9001]
    t = spark.createDataFrame([("a", x) for x in table], "contig string, tpos long")
    p = spark.createDataFrame([("a", x) for x in asked] + [("empty", 3)], "contig string, pos long")
    got = {(r.contig, r.pos): (r.prev.at if r.prev else None, r.next.at if r.next else None)
           for r in neighbours(p, t, ["contig"], "pos", "tpos", width=100).collect()}
    for x in asked:
        i, j = bisect.bisect_right(table, x), bisect.bisect_left(table, x)
        assert got["a", x] == (table[i - 1] if i else None, table[j] if j < len(table) else None)
    assert got["empty", 3] == (None, None)


def test_gap_clusters_across_tiles(spark):
    pos = [0, 9, 19, 30, 100, 109, 500]
    df = spark.createDataFrame([("a", p) for p in pos], "contig string, pos long")
    got = {r.pos: r.cluster for r in gap_clusters(df, ["contig"], "pos", 10, width=8).collect()}
    assert got == {0: 1, 9: 1, 19: 1, 30: 2, 100: 3, 109: 3, 500: 4}


def average_ranks(values):
    order = sorted(values)
    return [bisect.bisect_left(order, v) + (order.count(v) + 1) / 2 for v in values]


def test_average_ranks_with_a_hot_value(spark):
    rng = random.Random(1)
    # a third of one group shares a value; the other group is all tied
    rows = [("a", i, 7.0 if i % 3 == 0 else rng.uniform(0, 20), float(i % 5)) for i in range(600)]
    rows += [("b", 1000 + i, 1.0, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double")
    got = {r.id: (r.rx, r.ry) for r in add_average_ranks(df, ["g"], {"x": "rx", "y": "ry"}).collect()}
    for g in "ab":
        part = [r for r in rows if r[0] == g]
        for r, rx, ry in zip(part, average_ranks([r[2] for r in part]), average_ranks([r[3] for r in part])):
            assert got[r[1]] == (rx, ry)


def test_exact_percentiles_interpolate(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 5.0)] * 7, "g string, v double")
    got = {r.g: (r.q0, r.q1) for r in exact_percentiles(df, ["g"], "v", [0.95, 0.5]).collect()}
    assert got["a"] == pytest.approx((3.85, 2.5)) and got["b"] == (5.0, 5.0)


def test_ordered_values_skip_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 1.0), ("a", 3.0)], "g string, v double")
    got = [(r.v, r.n, r.cum_n) for r in ordered_values(df, ["g"], "v").orderBy("v").collect()]
    assert got == [(1.0, 2, 2), (3.0, 1, 3)]


@pytest.mark.parametrize("hot_rows", [10, 10**6])
def test_range_joins_with_hot_bins(spark, hot_rows):
    rng = random.Random(3)
    left = [("a", i, s, s + rng.randrange(1, 40)) for i, s in enumerate(rng.choice([100, 101, rng.randrange(900)]) for _ in range(300))]
    right = [("a", j, s, s + 25) for j, s in enumerate(range(0, 900, 30))]
    ldf = spark.createDataFrame(left, "contig string, i long, ls long, le long")
    rdf = spark.createDataFrame(right, "contig string, j long, rs long, re long")
    got = [(r.i, r.j) for r in overlap_join(ldf, rdf, ["contig"], ("ls", "le"), ("rs", "re"), 16, hot_rows).collect()]
    want = {(i, j) for _, i, a, b in left for _, j, c, d in right if a < d and b > c}
    assert len(got) == len(set(got)) and set(got) == want
    pts = [(r.i, r.j) for r in point_join(ldf, rdf, ["contig"], "ls", ("rs", "re"), 16, hot_rows).collect()]
    want = {(i, j) for _, i, a, _ in left for _, j, c, d in right if c <= a < d}
    assert len(pts) == len(set(pts)) and set(pts) == want


def test_salted_join_keeps_every_row(spark):
    big = spark.range(500).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    small = spark.createDataFrame([(0, "hot"), (1, "one")], "k long, name string")
    got = salted_join(big, small, ["k"], "left", hot_rows=20)
    assert got.count() == 500 and got.where("name = 'hot'").count() == 167 and got.where("name = 'one'").count() == 1
    with pytest.raises(ValueError):
        salted_join(big, small, ["k"], "right")


def test_paths_beyond_the_broadcast_bound(spark, monkeypatch):
    import regulus.plans.ordered as ordered
    import regulus.session as session
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ordered, "BROADCAST_BYTES", 0)
    rows = [("a", i, 7.0 if i % 3 == 0 else float(i)) for i in range(200)] + [("b", 500 + i, float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, id long, x double")
    got = {r.id: r.rx for r in add_average_ranks(df, ["g"], {"x": "rx"}).collect()}
    for g in "ab":
        part = [r for r in rows if r[0] == g]
        assert [got[r[1]] for r in part] == average_ranks([r[2] for r in part])
    small = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    joined = session.lookup_join(df, small, ["g"], "left", max_rows=0)
    assert joined.count() == 220 and joined.where("g = 'a' and n = 200").count() == 200


def test_checkpoint_folder_is_read_from_the_session(spark):
    from regulus.session import cut, ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    before = spark.sparkContext.getCheckpointDir()
    assert cut(spark.range(5)).count() == 5 and spark.sparkContext.getCheckpointDir() == before
    empty = cut(spark.range(0))
    assert empty.columns == ["id"] and empty.count() == 0
