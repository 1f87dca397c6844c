"""Interval queries over the event-, order- and lineitem-derived intervals, points and tracks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from regulus.catalog.registry import query, rd
from regulus.operators import intervals as I
from regulus.operators import selection as SEL
from regulus.operators import signal as S
from regulus.plans.greedy import cover_points, cover_regions, greedy_positions
from regulus.plans.ordered import exact_percentiles
from regulus.session import lookup_join

SIZE = 1_100_000
V = ("v_intervals",)
# merge per sample and contig: islands at start > running maximum end
MERGED = """isl as (select *, case when s <= max(e) over (partition by sample, contig order by s, e
   rows between unbounded preceding and 1 preceding) then 0 else 1 end f from v_intervals),
 num as (select *, sum(f) over (partition by sample, contig order by s, e rows unbounded preceding) g from isl),
 merged as (select sample, contig, min(s) s, max(e) e from num group by sample, contig, g)"""


def sweep(k: int) -> str:
    return f"""{MERGED}, ev as (select contig, s pos, 1 d from merged union all select contig, e, -1 from merged),
 dp as (select contig, pos, d, sum(d) over (partition by contig order by pos, d rows unbounded preceding) cur from ev),
 ed as (select contig, pos, case when cur - d < {k} and cur >= {k} then 1 when cur - d >= {k} and cur < {k} then -1 end w,
   row_number() over (partition by contig order by pos, d) rn from dp),
 sg as (select contig, pos s, w, lead(pos) over (partition by contig order by rn) e from ed where w is not null),
 seg as (select contig, s, e from sg where w = 1)"""


@query("w01_merge_overlapping", "W1", f"with {MERGED} select sample, contig, s, e from merged", V)
def _(t):
    return I.merge_intervals(t("v_intervals"), ["sample", "contig"]).select(
        "sample", "contig", F.col("start").alias("s"), F.col("end").alias("e"))


def segments(t, k=2):
    return I.consensus(t("v_intervals"), "sample", "contig", "s", "e", k)


@query("w02_depth_consensus", "W2", f"with {sweep(2)} select contig, s, e from seg", V)
def _(t):
    return segments(t).select("contig", F.col("start").alias("s"), F.col("end").alias("e"))


@query("w02_depth_consensus_three", "W2", f"with {sweep(3)} select contig, s, e from seg", V)
def _(t):
    return segments(t, 3).select("contig", F.col("start").alias("s"), F.col("end").alias("e"))


@query("w03_gap_clusters", "W3", """with a as (select contig, pos, sample,
  case when pos - lag(pos) over (partition by contig order by pos) <= 150 then 0 else 1 end f from v_points),
 g as (select *, sum(f) over (partition by contig order by pos, f desc rows unbounded preceding) c from a)
select contig, count(*) n_points, count(distinct sample) n_samples, cast(floor(median(pos)) as bigint) summit
from g group by contig, c having count(distinct sample) >= 2""", ("v_points",))
def _(t):
    return I.summit_clusters(t("v_points"), "contig", "pos", "sample", 150, 2)


@query("w03_gap_clusters_dense", "W3", """with a as (select contig, pos, sample,
  case when pos - lag(pos) over (partition by contig order by pos) <= 2000 then 0 else 1 end f from v_points),
 g as (select *, sum(f) over (partition by contig order by pos, f desc rows unbounded preceding) c from a)
select contig, count(*) n_points, count(distinct sample) n_samples, cast(floor(median(pos)) as bigint) summit
from g group by contig, c having count(distinct sample) >= 2""", ("v_points",))
def _(t):
    return I.summit_clusters(t("v_points"), "contig", "pos", "sample", 2000, 2)


@query("w04_fixed_width_recentring", "W4", f"""with {sweep(2)} select contig, (s + e) // 2 mid, (s + e) // 2 - 500 win_start,
 (s + e) // 2 + 500 win_end from seg where (s + e) // 2 - 500 >= 0""", V)
def _(t):
    return I.recentre(segments(t), "start", "end", 1000).select("contig", "mid", "win_start", "win_end")


def greedy_sql(step: int) -> str:
    return f"""with recursive d as (select distinct contig, pos from v_points),
 nx as (select contig, pos, min(pos) over (partition by contig order by pos range between {step} following and unbounded following) nxt from d),
 keep(contig, pos) as (select contig, min(pos) from d group by 1
   union all select nx.contig, nx.nxt from keep join nx using (contig, pos) where nx.nxt is not null)"""


for _step in (300, 2000):
    @query(f"w05_minimum_distance_{_step}", "W5", greedy_sql(_step) + " select contig, pos from keep", ("v_points",))
    def _(t, step=_step):
        return greedy_positions(t("v_points"), ["contig"], "pos", step)


@query("w06_point_covering", "W6", greedy_sql(20000) + """ select contig, pos window_start, (select count(*) from v_points p
 where p.contig = keep.contig and p.pos >= keep.pos and p.pos < keep.pos + 20000) n_points from keep""", ("v_points",))
def _(t):
    heads = cover_points(t("v_points"), ["contig"], "pos", 20000)
    heads = heads.withColumn("window_end", F.col("window_start") + 20000)
    return I.count_overlaps(heads, t("v_points").withColumn("pe", F.col("pos") + 1), "contig",
                            ("window_start", "window_end"), ("pos", "pe"), "n_points").select(
        "contig", "window_start", "n_points")


HALF, SPAN, LENGTH = 500, 20_000, 60_000
OFF = (LENGTH - SPAN) // 2


def sizes(t):
    """Contig sizes are one constant here; the table has one row per contig."""
    return t("v_points").select("contig").distinct().withColumn("size", F.lit(SIZE).cast("long"))


def placed(t):
    return cover_regions(t("v_points").select("point_id", "contig", F.col("pos").alias("center")), sizes(t), HALF, SPAN, LENGTH)


COVER = f"""with recursive d as (select contig, pos c from v_points where pos - {HALF} >= {OFF} and pos + {HALF} <= {SIZE} - {OFF} group by 1, 2),
 lost as (select distinct contig from v_points where pos - {HALF} < {OFF}),
 r as (select d.* from d left join lost using (contig) where lost.contig is null or c + {HALF} > {OFF + SPAN}),
 nx as (select contig, c, min(c) over (partition by contig order by c range between {SPAN - 2 * HALF + 1} following and unbounded following) nxt from r),
 keep(contig, c) as (select contig, min(c) from r group by 1
   union all select nx.contig, nx.nxt from keep join nx using (contig, c) where nx.nxt is not null),
 asg as (select p.point_id, p.contig, p.pos center, case when p.pos - {HALF} < {OFF} or p.pos + {HALF} > {SIZE} - {OFF} then null
    when l.contig is not null and p.pos + {HALF} <= {OFF + SPAN} then 0::bigint
    else greatest(0, least(k.c - {HALF} - {OFF}, {SIZE} - {LENGTH})) end wstart
  from v_points p left join lost l on l.contig = p.contig asof left join keep k on k.contig = p.contig and k.c <= p.pos)"""


@query("w06_window_assignment", "W6", COVER + """ select point_id, contig, center, wstart,
 case when wstart is null then 'unplaceable' else 'placed' end status from asg""", ("v_points",))
def _(t):
    return placed(t).select("point_id", "contig", "center", "wstart", "status")


BIN, NBINS = 32, SPAN // 32


@query("w07_bin_ranges", "W7", COVER + f""" select point_id, cast(floor((center - {HALF} - wstart - {OFF}) / {BIN}) as bigint) bin0,
 cast(ceil((center + {HALF} - wstart - {OFF}) / {BIN}) as bigint) bin1,
 {NBINS} - cast(ceil((center + {HALF} - wstart - {OFF}) / {BIN}) as bigint) rc_bin0,
 {NBINS} - cast(floor((center - {HALF} - wstart - {OFF}) / {BIN}) as bigint) rc_bin1,
 floor((center - {HALF} - wstart - {OFF}) / {BIN}) >= 0 and ceil((center + {HALF} - wstart - {OFF}) / {BIN}) <= {NBINS} valid
 from asg where wstart is not null""", ("v_points",))
def _(t):
    return I.bin_ranges(placed(t).where("wstart is not null"), "center", HALF, OFF, BIN, NBINS).select(
        "point_id", "bin0", "bin1", "rc_bin0", "rc_bin1", "valid")


@query("w07_adjacent_pair_check", "W7", COVER + f""", b as (select contig, wstart, center, point_id,
   cast(floor((center - {HALF} - wstart - {OFF}) / {BIN}) as bigint) bin0 from asg where wstart is not null),
 p as (select contig, wstart, center - lag(center) over w dg, (bin0 - lag(bin0) over w) * {BIN} db from b
   window w as (partition by contig, wstart order by center, point_id))
select contig, count(dg) checked, count(*) filter (abs(dg - db) > {BIN} or (db = 0 and dg > {BIN})) bad from p group by 1""", ("v_points",))
def _(t):
    b = I.bin_ranges(placed(t).where("wstart is not null"), "center", HALF, OFF, BIN, NBINS)
    # equal centres add only zero steps, so one row per centre decides and piled-up centres are counted
    per = b.groupBy("contig", "wstart", "center").agg(F.min("bin0").alias("bin0"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("contig", "wstart").orderBy("center")  # at most SPAN distinct centres
    dg = F.col("center") - F.lag("center").over(w)
    db = (F.col("bin0") - F.lag("bin0").over(w)) * BIN
    p = per.select("contig", "wstart", "n", dg.alias("dg"), db.alias("db"))
    wrong = (F.abs(F.col("dg") - F.col("db")) > BIN) | ((F.col("db") == 0) & (F.col("dg") > BIN))
    return p.groupBy("contig").agg(F.sum(F.col("n") - F.when(F.col("dg").isNull(), 1).otherwise(0)).alias("checked"),
                                   F.count_if(wrong).alias("bad"))


@query("j01_point_in_interval_flag", "J1", """select point_id, exists (select 1 from v_intervals i where i.contig = p.contig
 and p.pos >= i.s and p.pos < i.e) inside from v_points p""", ("v_points", "v_intervals"))
def _(t):
    return I.flag_points(t("v_points"), t("v_intervals"), "contig", "pos", "s", "e", "inside").select("point_id", "inside")


@query("j02_asof_containment", "J2", """with i as (select contig, s, max(struct_pack(e := e, event_id := event_id)) b from v_intervals group by 1, 2),
 j as (select p.point_id, p.pos, i.s, i.b.e e, i.b.event_id event_id from v_points p asof left join i on i.contig = p.contig and i.s <= p.pos)
select point_id, case when pos < e then s end hit_start, case when pos < e then e end hit_end,
 case when pos < e then event_id end event_id from j""", ("v_points", "v_intervals"))
def _(t):
    return I.last_started(t("v_points").select("point_id", "contig", "pos"), t("v_intervals").drop("sample"), "contig",
                          "pos", "s", "e", ["event_id"]).select("point_id", "hit_start", "hit_end", "event_id")


NEAREST = """d as (select distinct contig, s from v_intervals),
 n as (select p.point_id, p.pos, a.s l, b.s r from v_points p asof left join d a on a.contig = p.contig and a.s <= p.pos
   asof left join d b on b.contig = p.contig and b.s >= p.pos),
 near as (select point_id, case when r is null or pos - l <= r - pos then l else r end nearest,
   case when r is null or pos - l <= r - pos then pos - l else r - pos end distance from n)"""


@query("j03_nearest_neighbour", "J3", f"with {NEAREST} select point_id, nearest, distance from near", ("v_points", "v_intervals"))
def _(t):
    return I.nearest(t("v_points"), t("v_intervals"), "contig", "pos", "s").select("point_id", "nearest", "distance")


@query("a63_nearest_distance_summary", "A63", f"""with {NEAREST} select count(*) n, count(*) filter (distance <= 100) n_within,
 round(count(*) filter (distance <= 100) / count(*), 6) share_within, median(distance) median_distance from near""", ("v_points", "v_intervals"))
def _(t):
    near = I.nearest(t("v_points"), t("v_intervals"), "contig", "pos", "s").select(F.lit(1).alias("g"), "distance")
    return I.distance_summary(near, ["g"], "distance", 100).drop("g").withColumn("share_within", rd("share_within"))


LOCI = "loci as (select s_suppkey locus, concat('c', cast(s_suppkey % 5 as varchar)) contig, s_suppkey * 10000 ls, s_suppkey * 10000 + 3000 le, s_nationkey % 2 = 0 plus from supplier)"


def loci(t):
    k = F.col("s_suppkey")
    return t("supplier").select(k.alias("locus"), F.concat(F.lit("c"), (k % 5).cast("string")).alias("contig"),
                                (k * 10000).alias("ls"), (k * 10000 + 3000).alias("le"), (F.col("s_nationkey") % 2 == 0).alias("plus"))


@query("j04_overlap_counts", "J4", f"""with {LOCI} select locus,
 (select count(*) from v_intervals i where i.contig = l.contig and i.s < l.le and i.e > l.ls) n_overlap,
 (select count(*) from v_intervals i where i.contig = l.contig and i.s < case when plus then ls + 200 else le + 1000 end
   and i.e > case when plus then ls - 1000 else le - 200 end) n_promoter from loci l""", V)
def _(t):
    plus = F.col("plus")
    lo = (loci(t).withColumn("ps", F.when(plus, F.col("ls") - 1000).otherwise(F.col("le") - 200))
          .withColumn("pe", F.when(plus, F.col("ls") + 200).otherwise(F.col("le") + 1000)))
    spans = {"n_overlap": ("ls", "le"), "n_promoter": ("ps", "pe")}
    return I.count_overlaps_of(lo, t("v_intervals"), "contig", spans, ("s", "e")).select("locus", "n_overlap", "n_promoter")


@query("j04_overlap_hits", "J4", f"with {LOCI} select locus, event_id, s, e from loci l join v_intervals i on i.contig = l.contig and i.s < l.le and i.e > l.ls", V)
def _(t):
    return I.interval_hits(loci(t), t("v_intervals"), "contig", ("ls", "le"), ("s", "e")).select("locus", "event_id", "s", "e")


@query("j05_locus_flank_distance", "J5", f"""with {LOCI} select locus, point_id, greatest(ls - pos, pos - le, 0) distance,
 case when greatest(ls - pos, pos - le, 0) <= 1000 then 'proximal' else 'distal' end locus_class
 from v_points p join loci l on l.contig = p.contig and pos >= ls - 5000 and pos <= le + 5000""", ("v_points",))
def _(t):
    return I.locus_class(t("v_points"), loci(t), "contig", "pos", ("ls", "le"), 5000, 1000).select(
        "locus", "point_id", "distance", "locus_class")


@query("a27_locus_class_response", "A27", f"""with {LOCI}, h as (select locus, point_id, payload / 100000 v,
 case when greatest(ls - pos, pos - le, 0) <= 1000 then 'proximal' else 'distal' end locus_class
 from v_points p join loci l on l.contig = p.contig and pos >= ls - 5000 and pos <= le + 5000)
select locus, locus_class, count(*) n, round(avg(v), 6) mean, round(max(abs(v)), 6) max_abs, round(max(v), 6) max_v from h group by 1, 2""", ("v_points",))
def _(t):
    h = I.locus_class(t("v_points"), loci(t), "contig", "pos", ("ls", "le"), 5000, 1000).withColumn("v", F.col("payload") / 100000)
    return h.groupBy("locus", "locus_class").agg(F.count(F.lit(1)).alias("n"), rd(F.avg("v")).alias("mean"),
                                                 rd(F.max(F.abs("v"))).alias("max_abs"), rd(F.max("v")).alias("max_v"))


REMAP = """m as (select point_id, contig, pos, case when d = contig then block_id end block_id, case when d = contig then moved end mapped from (
 select point_id, p.contig, pos, min(block_id) block_id, min_by(dst_contig, block_id) d, min_by(case when strand = '-' then dst_start + (src_end - src_start) - 1 - (pos - src_start)
   else dst_start + pos - src_start end, block_id) moved from v_points p left join v_blocks b
   on b.src_contig = p.contig and pos >= src_start and pos < src_end group by 1, 2, 3))"""


@query("j06_coordinate_remap", "J6", f"with {REMAP} select point_id, pos, mapped, block_id from m", ("v_points", "v_blocks"))
def _(t):
    return I.remap(t("v_points"), t("v_blocks"), "point_id", "contig", "pos").select("point_id", "pos", "mapped", "block_id")


@query("j06_remap_success", "J6", f"with {REMAP} select contig, count(*) n, count(mapped) n_mapped, round(100.0 * count(mapped) / count(*), 6) pct from m group by 1", ("v_points", "v_blocks"))
def _(t):
    m = I.remap(t("v_points"), t("v_blocks"), "point_id", "contig", "pos")
    return m.groupBy("contig").agg(F.count(F.lit(1)).alias("n"), F.count("mapped").alias("n_mapped"),
                                   rd(100.0 * F.count("mapped") / F.count(F.lit(1))).alias("pct"))


@query("j07_span_integrity", "J7", """with q as (select point_id, contig, pos a, pos + 999 b from v_points),
 ends as (select point_id, contig, a pos, 0 side from q union all select point_id, contig, b, 1 from q),
 m as (select point_id, side, case when min_by(dst_contig, block_id) = any_value(p.contig) then min_by(case when strand = '-' then dst_start + (src_end - src_start) - 1 - (pos - src_start)
   else dst_start + pos - src_start end, block_id) end mapped from ends p join v_blocks b
   on b.src_contig = p.contig and pos >= src_start and pos < src_end group by 1, 2),
 w as (select point_id, max(mapped) filter (side = 0) x, max(mapped) filter (side = 1) y from m group by 1)
select (select count(*) from q) n, count(*) filter (x is not null and y is not null) both_mapped,
 count(*) filter (abs(abs(y - x) - 999) <= 50) span_kept from w""", ("v_points", "v_blocks"))
def _(t):
    return I.span_integrity(t("v_points"), t("v_blocks"), "point_id", "contig", "pos", 1000, 50)


@query("j08_remap_collisions", "J8", f"""with {REMAP}, c as (select point_id, contig, mapped // 50 target from m where mapped is not null)
select point_id, contig, target from c qualify count(*) over (partition by contig, target) = 1""", ("v_points", "v_blocks"))
def _(t):
    m = I.remap(t("v_points"), t("v_blocks"), "point_id", "contig", "pos").where("mapped is not null")
    return I.drop_collisions(m.withColumn("target", F.expr("mapped div 50")), "contig", "target").select("point_id", "contig", "target")


@query("a01_track_over_regions", "A1", """with g as (select event_id, t.sample, sum(least(te, e) - greatest(ts, s)) covered,
 sum(value * (least(te, e) - greatest(ts, s))) w from v_intervals i join v_track t on t.contig = i.contig and ts < e and te > s group by 1, 2),
 k as (select i.event_id, x.sample from v_intervals i, (select distinct l_returnflag sample from lineitem) x)
select k.event_id, k.sample, cast(covered as bigint) covered, round(w, 6) / covered mean_signal from k left join g using (event_id, sample)""", ("v_intervals", "v_track"))
def _(t):
    return quantified(t("v_track"), t("v_intervals").drop("sample"))


def quantified(track, regions):
    got = S.region_signal(track, regions, ["contig"], ("ts", "te"), ("s", "e"), "value", ["sample"], ["event_id"])
    return got.select("event_id", "sample", "covered", (rd("weighted") / F.col("covered")).alias("mean_signal"))


# one sample's track names contigs chrc0, chrc1, ..., a stretch of it has no value, and regions on one contig are unknown to all
@query("a01_track_contig_alias", "A1", """with t as (select sample, case when sample = 'A' then 'chr' || contig else contig end contig, ts, te,
   case when l_linenumber = 7 then null else value end value from v_track),
 r as (select event_id, case when event_id % 97 = 0 then 'c9' else contig end contig, s, case when event_id % 89 = 0 then s else e end e from v_intervals),
 g as (select event_id, t.sample, sum(least(te, e) - greatest(ts, s)) covered, sum(value * (least(te, e) - greatest(ts, s))) w
   from r join t on regexp_replace(t.contig, '^chr', '') = r.contig and ts < e and te > s where value is not null and s < e group by 1, 2),
 k as (select r.event_id, x.sample from r, (select distinct l_returnflag sample from lineitem) x)
select k.event_id, k.sample, cast(covered as bigint) covered, round(w, 6) / covered mean_signal from k left join g using (event_id, sample)""", ("v_intervals", "v_track"))
def _(t):
    track = t("v_track").withColumn("contig", F.when(F.col("sample") == "A", F.concat(F.lit("chr"), "contig")).otherwise(F.col("contig")))
    track = track.withColumn("value", F.when(F.col("l_linenumber") != 7, F.col("value")))
    regions = t("v_intervals").drop("sample").withColumn("contig", F.when(F.col("event_id") % 97 == 0, "c9").otherwise(F.col("contig")))
    regions = regions.withColumn("e", F.when(F.col("event_id") % 89 == 0, F.col("s")).otherwise(F.col("e")))
    one = S.contig_alias(F.col("contig"))
    return quantified(track.withColumn("contig", one), regions.withColumn("contig", one))


@query("a16_union_length", "A16", """with i as (select *, case when s <= max(e) over (partition by contig order by s, e
   rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end f from v_intervals),
 n as (select *, sum(f) over (partition by contig order by s, e rows unbounded preceding) g from i),
 m as (select contig, g, max(e) - min(s) + 1 len from n group by 1, 2)
select contig, cast(sum(len) as bigint) union_length from m group by 1""", V)
def _(t):
    closed = t("v_intervals").withColumn("e1", F.col("e") + 1)
    return I.merge_intervals(closed, ["contig"], "s", "e1").groupBy("contig").agg(
        F.sum(F.col("end") - F.col("start")).alias("union_length"))


@query("a26_interval_set_summary", "A26", """with r as (select contig, s - s % 5000 s, s - s % 5000 + (e - s) - (e - s) % 100 + 100 e from v_intervals),
 d as (select distinct contig, s, e from r)
select contig, (select count(*) from r where r.contig = d.contig) n_raw, count(*) n_distinct,
 round((select count(*) from r where r.contig = d.contig) / count(*), 6) duplication,
 round(quantile_cont(e - s, 0.05), 6) w05, round(quantile_cont(e - s, 0.5), 6) w50, round(quantile_cont(e - s, 0.95), 6) w95 from d group by contig""", V)
def _(t):
    raw = t("v_intervals").select("contig", (F.col("s") - F.col("s") % 5000).alias("s0"), (F.col("e") - F.col("s")).alias("w"))
    raw = raw.select("contig", "s0", (F.col("s0") + F.col("w") - F.col("w") % 100 + 100).alias("e0"))
    d = raw.groupBy("contig", "s0", "e0").agg(F.count(F.lit(1)).alias("n")).withColumn("width", F.col("e0") - F.col("s0"))
    q = exact_percentiles(d, ["contig"], "width", [0.05, 0.5, 0.95])
    return (d.groupBy("contig").agg(F.sum("n").alias("n_raw"), F.count(F.lit(1)).alias("n_distinct"),
                                    rd(F.sum("n") / F.count(F.lit(1))).alias("duplication")).join(q, "contig")
            .select("contig", "n_raw", "n_distinct", "duplication", rd("q0").alias("w05"), rd("q1").alias("w50"), rd("q2").alias("w95")))


@query("t01_union_all_segments", "T1", f"with {sweep(2)} select contig, s, e, 'segment' kind from seg union all select contig, s, e, 'raw' from v_intervals", V)
def _(t):
    seg = segments(t).select("contig", F.col("start").alias("s"), F.col("end").alias("e"), F.lit("segment").alias("kind"))
    return seg.unionByName(t("v_intervals").select("contig", "s", "e", F.lit("raw").alias("kind")))


@query("t02_set_operations", "T2", """with a as (select distinct l_partkey k from lineitem where l_returnflag = 'A'),
 b as (select distinct l_partkey k from lineitem where l_returnflag = 'R' and l_quantity > 30)
select 'intersect' op, k from (select k from a intersect select k from b) union all
select 'except', k from (select k from a except select k from b) union all
select 'only_second', k from (select k from b except select k from a)""")
def _(t):
    li = t("lineitem")
    a = li.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("k"))
    b = li.where("l_returnflag = 'R' and l_quantity > 30").select(F.col("l_partkey").alias("k"))
    def tag(df, op):
        return df.select(F.lit(op).alias("op"), "k")
    return tag(a.intersect(b), "intersect").unionByName(tag(a.subtract(b), "except")).unionByName(tag(b.subtract(a), "only_second"))


@query("p16_centred_window_reasons", "P16", """with a as (select p.*, case when contig <> 'c4' then 1100000 end size,
 case when payload > 1000 then pos end center from v_points p)
select case when center is null then 'no annotation' when size is null then 'contig unknown' when center - 50000 < 0 then 'before start'
 when center + 50000 > size then 'past end' else 'valid' end reason, count(*) n, min(center) first_center from a group by 1""", ("v_points",))
def _(t):
    known = sizes(t).where("contig <> 'c4'")
    df = lookup_join(t("v_points").withColumn("center", F.when(F.col("payload") > 1000, F.col("pos"))), known, ["contig"])
    return I.centred_window_reason(df, "center", "size", 100_000).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.min("center").alias("first_center"))


SPLITS = {"test": ["c0"], "val": ["c1"], "stop": ["c2"]}


@query("p15_split_by_contig", "P15", """with s as (select *, case when contig = 'c0' then 'test' when contig = 'c1' then 'val' when contig = 'c2' then 'stop' else 'train' end split from v_points)
select split, count(*) n, (select count(*) from (select contig from s group by 1 having count(distinct split) > 1)) overlapping from s group by 1""", ("v_points",))
def _(t):
    s = t("v_points").withColumn("split", SEL.contig_split(F.col("contig"), SPLITS, "train"))
    return SEL.split_audit(s, "split", "contig").select("split", "n", F.col("n_shared").alias("overlapping"))


@query("p15_samples_across_splits", "P15", """with s as (select sample, case when contig = 'c0' then 'test' when contig = 'c1' then 'val' when contig = 'c2' then 'stop' else 'train' end split from v_points where payload % 7 < 1),
 k as (select sample from s where sample is not null group by 1 having count(distinct split) > 1)
select split, count(*) n, count(distinct sample) n_keys, count(distinct case when sample in (select sample from k) then sample end) n_shared from s group by 1""", ("v_points",))
def _(t):
    s = t("v_points").where("payload % 7 < 1").withColumn("split", SEL.contig_split(F.col("contig"), SPLITS, "train"))
    return SEL.split_audit(s, "split", "sample")


@query("f12_point_interval_distance", "F12", f"""with {LOCI} select l.locus, i.event_id, greatest(l.ls - i.s, i.s - l.le, 0) distance
 from v_intervals i join loci l on l.contig = i.contig and i.s >= ls - 2000 and i.s <= le + 2000""", V)
def _(t):
    return I.locus_class(t("v_intervals"), loci(t), "contig", "s", ("ls", "le"), 2000, 0).select("locus", "event_id", "distance")


@query("f13_strand_aware_promoter", "F13", f"""with {LOCI} select locus, case when plus then ls else le end tss,
 case when plus then ls - 1000 else le - 200 end prom_start, case when plus then ls + 200 else le + 1000 end prom_end from loci""")
def _(t):
    return loci(t).select("locus", I.promoter(F.col("ls"), F.col("le"), F.col("plus"), 1000, 200).alias("p")).select("locus", "p.*")
