"""Sequence, motif and designed-sequence queries over the document-derived 128-base regions."""

from pyspark.sql import functions as F

from regulus.catalog.registry import query, rd
from regulus.functions import sequence as Q
from regulus.operators import design as D
from regulus.operators import model as U
from regulus.operators import motifs as M
from regulus.operators import selection as SEL
from regulus.session import lookup_join, spread
from regulus.sources.genome import fetch_windows, split_chunks

VS = ("v_seqs",)
# Consensus words of the four motif families.
WORDS = {"NFKB_RELA": "GGGACTTTCC", "CEBPB": "TTGCGCAA", "AP1_FOSJUN": "TGACTCA", "ETS1": "AGGAAGT"}
MOTIFS = [M.motif_from_word(n, w) for n, w in WORDS.items()]
CUTOFFS = (0.7, 0.8, 0.9)


def _score(m: M.Motif, reverse: bool) -> str:
    w = m.weights[::-1, ::-1] if reverse else m.weights
    terms = [f"case substr(seq, i + {j + 1}, 1) " + " ".join(f"when '{b}' then {float(w[k, j])!r}::double" for k, b in enumerate("ACGT")) + " end"
             for j in range(m.length)]
    return f"({' + '.join(terms)} - {m.low!r}::double) / ({m.high!r}::double - {m.low!r}::double)".replace("- -", "+ ")


def scores_sql(source: str = "v_seqs", extra: str = "region_id") -> str:
    """Relative score of every window; terms are added left to right, like the vectorised scan."""
    parts = [f"""select {extra}, '{m.name}' motif, {m.length} len, i "start", '{s}' strand, {_score(m, s == '-')} rel
  from (select {extra}, upper(seq) seq, unnest(range(0, length(seq) - {m.length} + 1)) i from {source})""" for m in MOTIFS for s in "+-"]
    return "sc as (" + " union all ".join(parts) + ")"


def injected(t):
    """Regions with IUPAC letters written over some positions."""
    k = F.col("region_id")
    new = F.element_at(F.array(*[F.lit(x) for x in ("R", "NNN", "ryk", "aCgt")]), (k % 4 + 1).cast("int"))
    return t("v_seqs").select("region_id", Q.replace_at(F.col("seq"), (k % 97).cast("int"), new).alias("seq"))


INJ = """inj as (select region_id, substr(seq, 1, (region_id % 97)::int) || ['R', 'NNN', 'ryk', 'aCgt'][region_id % 4 + 1]
  || substr(seq, (region_id % 97)::int + length(['R', 'NNN', 'ryk', 'aCgt'][region_id % 4 + 1]) + 1) seq from v_seqs)"""


@query("f01_sanitise", "F1", f"with {INJ} select region_id, regexp_replace(upper(seq), '[^ACGTN]', 'N', 'g') clean from inj", VS)
def _(t):
    return injected(t).select("region_id", Q.sanitise(F.col("seq")).alias("clean"))


@query("f01_replaced_characters", "F1", f"""with {INJ}, c as (select region_id, unnest(regexp_extract_all(seq, '[^ACGTNacgtn]')) ch from inj)
select ascii(ch)::int code, count(*) n, count(distinct region_id) n_regions from c group by 1""", VS)
def _(t):
    c = injected(t).select("region_id", F.explode(F.regexp_extract_all("seq", F.lit("[^ACGTNacgtn]"), 0)).alias("ch"))
    return c.groupBy(F.ascii("ch").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("region_id").alias("n_regions"))


@query("f02_reverse_complement", "F2", "select region_id, reverse(translate(seq, 'ACGTN', 'TGCAN')) rc from v_seqs", VS)
def _(t):
    return t("v_seqs").select("region_id", Q.reverse_complement(F.col("seq")).alias("rc"))


BASES = "c as (select lang motif, pos, substr(seq, pos::int, 1) base, count(*) n from (select lang, seq, unnest(range(1, length(seq) + 1)) pos from v_seqs join documents on doc_id = region_id) group by 1, 2, 3)"
BGSQL = "case base when 'A' then 0.295 when 'T' then 0.295 else 0.205 end"
PWM = f"{BASES}, w as (select motif, pos, base, log2((n + 0.25) / sum(n + 0.25) over (partition by motif, pos) / {BGSQL}) w from c)"


def counts(t):
    s = t("v_seqs").join(t("documents").select(F.col("doc_id").alias("region_id"), F.col("lang").alias("motif")), "region_id")
    return (s.select("motif", F.posexplode(F.split("seq", "")).alias("i", "base"))
            .groupBy("motif", (F.col("i") + 1).cast("long").alias("pos"), "base").agg(F.count(F.lit(1)).alias("n")))


@query("f03_weights_from_counts", "F3", f"with {PWM} select motif, pos, base, round(w, 6) + 0.0 w from w", VS)
def _(t):
    return M.weights_from_counts(counts(t)).select("motif", "pos", "base", rd("w").alias("w"))


@query("f03_attainable_scores", "F3", f"with {PWM}, m as (select motif, pos, min(w) lo, max(w) hi from w group by 1, 2) select motif, count(*) len, round(sum(lo), 6) + 0.0 lo, round(sum(hi), 6) + 0.0 hi from m group by 1", VS)
def _(t):
    m = M.weights_from_counts(counts(t)).groupBy("motif", "pos").agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    return m.groupBy("motif").agg(F.count(F.lit(1)).alias("len"), rd(F.sum("lo")).alias("lo"), rd(F.sum("hi")).alias("hi"))


@query("f04_weight_matrix_scan", "F4", f'with {scores_sql()} select region_id, motif, "start", strand, round(rel, 6) rel from sc where rel >= 0.8', VS)
def _(t):
    return M.scan_hits(t("v_seqs"), "region_id", MOTIFS, 0.8).withColumn("rel", rd("rel"))


@query("f04_scan_with_unknown_bases", "F4", f'with {INJ}, {scores_sql("inj")} select region_id, motif, "start", strand, round(rel, 6) rel from sc where rel >= 0.8', VS)
def _(t):
    return M.scan_hits(injected(t), "region_id", MOTIFS, 0.8).withColumn("rel", rd("rel"))


# letters of a text read as bases, in turn; everything else is unknown
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ "
AS_BASES = ("ACGT" * 14)[:len(LETTERS)]
CHUNK = 1024


# the SQL takes ten-letter windows out of pieces of its own (letters of very long strings are slow to reach there) and scores every distinct one
@query("f04_text_chunk_scan", "F4", f"""with txt as (select doc_id, regexp_replace(translate(text, '{LETTERS}', '{AS_BASES}'), '[^ACGT]', 'N', 'g') whole from documents where text is not null),
 piece as (select doc_id, a, substr(whole, a + 1, 109) p from (select doc_id, whole, unnest(range(0, length(whole), 100)) a from txt)),
 win as (select doc_id, a + i pos, substr(p, i + 1, 10) seq from (select doc_id, a, p, unnest(range(0, least(100, length(p)))) i from piece)),
 word as (select distinct seq w, seq from win), {scores_sql("word", "w")}
select doc_id, motif, pos "start", strand, round(rel, 6) rel from win join sc on w = seq where rel >= 0.85 and "start" = 0""")
def _(t):
    """Sites in the letters of every whole text, stored as chunks; sites across chunk borders count once."""
    bases = F.regexp_replace(F.translate("text", LETTERS, AS_BASES), "[^ACGT]", "N")
    chunks = split_chunks(t("documents"), ["doc_id"], bases, CHUNK)
    return M.scan_chunks(chunks, ["doc_id"], CHUNK, MOTIFS, 0.85).withColumn("rel", rd("rel"))


BEST = """b as (select region_id, motif, "start" p, max(rel) rel from sc group by 1, 2, 3),
 best as (select region_id, motif, max(rel) best_rel, arg_max(p, struct_pack(r := rel, q := -p)) best_pos, count(*) filter (rel >= 0.7) n_70, count(*) filter (rel >= 0.8) n_80, count(*) filter (rel >= 0.9) n_90 from b group by 1, 2)"""


@query("f05_best_site", "F5", f"with {scores_sql()}, {BEST} select region_id, motif, round(best_rel, 6) best_rel, best_pos, n_70, n_80, n_90 from best", VS)
def _(t):
    return M.scan_best(t("v_seqs"), "region_id", MOTIFS, CUTOFFS).withColumn("best_rel", rd("best_rel"))


@query("a61_hit_rates", "A61", f"""with {scores_sql()}, k(cutoff) as (values (0.7::double), (0.8), (0.9), (0.99)), m as (select distinct motif from sc),
 h as (select motif, cutoff, count(distinct region_id) n_regions, count(*) n_hits from (select region_id, motif, "start", max(rel) rel from sc group by 1, 2, 3), k where rel >= cutoff group by 1, 2), tot as (select count(*) n from v_seqs)
select motif, cutoff, coalesce(n_regions, 0) n_regions, round(coalesce(n_regions, 0) / n, 6) fraction, round(coalesce(n_hits, 0) / n, 6) mean_hits from m cross join k left join h using (motif, cutoff), tot""", VS)
def _(t):
    hits = M.scan_hits(t("v_seqs"), "region_id", MOTIFS, 0.7)
    out = M.hit_rates(hits, t("v_seqs"), "region_id", list(WORDS), (0.7, 0.8, 0.9, 0.99))
    return out.withColumn("fraction", rd("fraction")).withColumn("mean_hits", rd("mean_hits"))


SITE = 7


def free_runs(t):
    lengths = F.create_map(*[F.lit(x) for m in MOTIFS for x in (m.name, m.length)])
    sites = M.scan_hits(t("v_seqs"), "region_id", MOTIFS, 0.8).select(
        "region_id", F.col("start").alias("s"), (F.col("start") + F.element_at(lengths, F.col("motif"))).alias("e"))
    return M.free_runs(sites, t("v_seqs").select("region_id", F.length("seq").alias("size")), ["region_id"], "s", "e", "size", SITE)


FREE = f"""h as (select distinct region_id, "start" s, "start" + len e from sc where rel >= 0.8), p as (select region_id, unnest(range(0, length(seq) - {SITE})) p from v_seqs),
 free as (select region_id, p from p where not exists (select 1 from h where h.region_id = p.region_id and h.s < p.p + {SITE} and h.e > p.p))"""


@query("f06_site_free_positions", "F6", f"with {scores_sql()}, {FREE} select region_id, count(*) n_free, min(p) first_free, max(p) last_free from free group by 1", VS)
def _(t):
    return free_runs(t).groupBy("region_id").agg(F.sum(F.col("free_end") - F.col("free_start")).alias("n_free"), F.min("free_start").alias("first_free"),
                                                 (F.max("free_end") - 1).alias("last_free"))


@query("o05_nearest_to_centre", "O5", f"with {scores_sql()}, {FREE} select region_id, arg_min(p, struct_pack(d := abs(p + 3.5 - 64), p := p)) position from free group by 1", VS)
def _(t):
    return M.nearest_free(free_runs(t), ["region_id"], 64 - SITE / 2)


@query("f07_seeded_scramble", "F7", """with c as (select region_id, i, substr(seq, i::int, 1) ch from (select region_id, seq, unnest(range(1, length(seq) + 1)) i from v_seqs))
select region_id, string_agg(ch, '' order by md5(region_id::varchar || '-' || i::varchar)) scrambled from c group by 1""", VS)
def _(t):
    return t("v_seqs").select("region_id", Q.scramble(F.col("seq"), F.col("region_id")).alias("scrambled"))


ARMS = (("AP1_FOSJUN", ("AP1_FOSJUN",), "single"), ("ETS1", ("ETS1",), "single"),
        ("AP1_FOSJUN+ETS1", ("AP1_FOSJUN", "ETS1"), "interleaved"), ("AP1_FOSJUN+ETS1", ("AP1_FOSJUN", "ETS1"), "clustered"))
LOADS = (4, 12)


def grid(t):
    """Every region as background x arms x loads x variants."""
    arms = F.array(*[F.struct(F.lit(n).alias("label"), F.array(*[F.lit(WORDS[x]) for x in m]).alias("members"), F.lit(a).alias("arrangement"))
                     for n, m, a in ARMS])
    # a word's shuffle depends on region and slot alone: it is made once, before arms, loads and variants multiply the rows
    words = sorted({WORDS[x] for _, m, _ in ARMS for x in m})
    seqs = spread(t("v_seqs"), "region_id").withColumn("shuffled", Q.scrambled_words(words, max(LOADS), F.col("region_id")))
    return (seqs.withColumn("arm", F.explode(arms)).withColumn("load", F.explode(F.array(*[F.lit(k) for k in LOADS])))
            .withColumn("variant", F.explode(F.array(F.lit("real"), F.lit("scrambled")))).select("region_id", "seq", "shuffled", "arm.*", "load", "variant"))


def cassettes(t):
    g = grid(t)
    built = Q.build_cassette(F.col("seq"), F.col("members"), F.col("load"), F.col("arrangement"), F.col("variant"), F.col("region_id"), F.col("shuffled"))
    inserted = F.aggregate(F.sequence(F.lit(0), F.col("load") - 1), F.lit(0), lambda a, j: a + F.length(Q.member_at(j, F.col("load"), F.col("members"), F.col("arrangement"))))
    return g.select("region_id", "label", "arrangement", "load", "variant", built.alias("cassette"), inserted.cast("long").alias("bases_inserted"))


GRID = """arms(label, members, arrangement) as (values """ + ", ".join(
    f"('{n}', {[WORDS[x] for x in m]!r}, '{a}')" for n, m, a in ARMS) + """),
 g as (select region_id, seq, label, members, arrangement, load, variant from v_seqs, arms, (values (4), (12)) l(load), (values ('real'), ('scrambled')) v(variant)),
 s as (select *, j, 128 // load span, members[(case when arrangement = 'clustered' then least(j // greatest(load // len(members), 1), len(members) - 1) else j % len(members) end) + 1] word
   from (select *, unnest(range(0, load)) j from g)),
 wc as (select region_id, word, load, j, string_agg(substr(word, i::int, 1), '' order by md5(region_id::varchar || '/' || word || '/' || j::varchar || '-' || i::varchar)) mixed
   from (select distinct region_id, word, load, j, unnest(range(1, length(word) + 1)) i from s) group by 1, 2, 3, 4),
 cas as (select s.region_id, label, arrangement, s.load, variant, string_agg(substr(seq, (s.j * span + 1)::int, ((span - length(s.word)) // 2)::int) || case when variant = 'real' then s.word else mixed end
   || substr(seq, (s.j * span + (span - length(s.word)) // 2 + length(s.word) + 1)::int, (span - length(s.word) - (span - length(s.word)) // 2)::int), '' order by s.j) || substr(any_value(seq), (s.load * any_value(span) + 1)::int) cassette,
   sum(length(s.word))::bigint bases_inserted from s join wc on wc.region_id = s.region_id and wc.word = s.word and wc.load = s.load and wc.j = s.j group by 1, 2, 3, 4, 5)"""


@query("t03_design_grid", "T3", f"with {GRID} select label, arrangement, load, variant, count(*) n from g group by 1, 2, 3, 4", VS)
def _(t):
    return grid(t).groupBy("label", "arrangement", "load", "variant").agg(F.count(F.lit(1)).alias("n"))


# arms of none to three members, for the return flags that a region has: a region meets an arm if it has all its members
@query("t03_design_arms", "T3", """with n as (select list_sort(list_distinct(list(l_returnflag))) al from lineitem), m as (select al, unnest(range(0, (2 ** len(al))::bigint)) mask from n),
 a as (select list_filter(al, lambda x, i: (mask >> (i - 1)) & 1 = 1) mem from m),
 b as (select case when len(mem) = 0 then 'empty' else array_to_string(mem, '+') end label, mem, len(mem)::int n_members from a where len(mem) <= 3),
 g as (select b.*, load, arrangement, variant from b, (values (0), (4), (12)) l(load), (values ('none'), ('single'), ('interleaved'), ('clustered')) r(arrangement), (values ('real'), ('scrambled')) v(variant)
   where case n_members when 0 then load = 0 and arrangement = 'none' and variant = 'real' when 1 then load > 0 and arrangement = 'single' else load > 0 and arrangement in ('interleaved', 'clustered') end),
 r as (select l_partkey, list(distinct l_returnflag) f from lineitem group by 1)
select label, n_members, load, arrangement, variant, count(l_partkey) n_regions from g left join r on list_has_all(f, mem) group by 1, 2, 3, 4, 5""")
def _(t):
    arms = D.design_arms(t("lineitem"), "l_returnflag", 3, (4, 12)).withColumn("_set", F.array_join("members", "+"))
    # regions are counted per set of flags first, and every set is spread to the arms it holds all members of
    sets = t("lineitem").groupBy("l_partkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    masks = sets.select("f", "n", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.size("f")).cast("int") - 1)).alias("m"))
    subset = F.array_join(F.filter("f", lambda x, i: F.bit_get(F.col("m").cast("long"), i) == 1), "+")
    have = masks.groupBy(subset.alias("_set")).agg(F.sum("n").alias("n_regions"))
    return arms.join(have, "_set", "left").select("label", "n_members", "load", "arrangement", "variant", F.coalesce("n_regions", F.lit(0)).cast("long").alias("n_regions"))


@query("t03_motif_pairs", "T3", """with m as (select distinct l_returnflag a from lineitem), p as (select x.a, y.a b from m x join m y on x.a < y.a)
select a, b, count(*) n_regions from p join (select l_partkey, bool_or(l_returnflag = 'A') ha, bool_or(l_returnflag = 'N') hn, bool_or(l_returnflag = 'R') hr from lineitem group by 1) q
 on (case a when 'A' then ha when 'N' then hn else hr end) and (case b when 'A' then ha when 'N' then hn else hr end) group by 1, 2""")
def _(t):
    import itertools
    names = [r[0] for r in t("lineitem").select("l_returnflag").distinct().orderBy("l_returnflag").collect()]  # a few motif names
    has = t("lineitem").groupBy("l_partkey").agg(*[F.bool_or(F.col("l_returnflag") == n).alias(f"has_{n}") for n in names])
    pairs = F.array(*[F.when(F.col(f"has_{a}") & F.col(f"has_{b}"), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))) for a, b in itertools.combinations(names, 2)])
    return has.select(F.explode(F.filter(pairs, lambda p: p.isNotNull())).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n_regions"))


@query("f08_slot_placement", "F8", f"with {GRID} select * from cas", VS)
def _(t):
    return cassettes(t)


@query("f15_realised_affinity", "F15", f"with {GRID}, b as (select region_id, label, arrangement, load, variant, cassette seq from cas), {scores_sql('b', 'region_id, label, arrangement, load, variant')}, "
       """p as (select label, arrangement, load, variant, region_id, motif, "start", max(rel) rel from sc group by all),
 k as (select label, arrangement, load, variant, region_id, max(rel) filter (motif = 'AP1_FOSJUN') best, count(*) filter (rel >= 0.9) n_sites,
  count(*) filter (rel >= 0.9 and not list_contains(string_split(label, '+'), motif)) n_other from p group by 1, 2, 3, 4, 5)
select label, arrangement, load, variant, count(*) n, round(avg(best), 6) mean_best, sum(n_sites)::bigint sites, sum(n_other)::bigint unintended from k group by 1, 2, 3, 4""", VS)
def _(t):
    built = cassettes(t).withColumnRenamed("cassette", "seq").withColumn("key", F.struct("region_id", "label", "arrangement", "load", "variant"))
    keyed = built.select(F.to_json("key").alias("key"), "seq")
    best = M.scan_best(keyed, "key", MOTIFS, (0.9,)).withColumn("k", F.from_json("key", "region_id long, label string, arrangement string, load int, variant string"))
    per = best.select("k.*", "motif", "best_rel", "n_90").groupBy("label", "arrangement", "load", "variant", "region_id").agg(
        F.max(F.when(F.col("motif") == "AP1_FOSJUN", F.col("best_rel"))).alias("best"), F.sum("n_90").alias("n_sites"),
        F.sum(F.when(~F.array_contains(F.split("label", r"\+"), F.col("motif")), F.col("n_90")).otherwise(0)).alias("n_other"))
    return per.groupBy("label", "arrangement", "load", "variant").agg(
        F.count(F.lit(1)).alias("n"), rd(F.avg("best")).alias("mean_best"), F.sum("n_sites").alias("sites"),
        F.sum("n_other").alias("unintended"))


@query("f09_ablate_best_site", "F9", f"""with {scores_sql()}, {BEST}, a as (select v.region_id, seq, best_pos from best b join v_seqs v using (region_id) where motif = 'AP1_FOSJUN'),
 c as (select region_id, seq, best_pos, string_agg(substr(seq, (best_pos + i)::int, 1), '' order by md5(region_id::varchar || '-' || i::varchar)) mixed from a, range(1, 8) r(i) group by 1, 2, 3)
select region_id, best_pos, substr(seq, 1, best_pos::int) || mixed || substr(seq, best_pos::int + 8) ablated from c""", VS)
def _(t):
    best = M.scan_best(t("v_seqs"), "region_id", [m for m in MOTIFS if m.name == "AP1_FOSJUN"], (0.9,)).where("best_pos is not null")
    pos = F.col("best_pos").cast("int")
    word = F.substring(F.col("seq"), pos + 1, F.lit(7))
    return t("v_seqs").join(best, "region_id").select("region_id", "best_pos", Q.replace_at(F.col("seq"), pos, Q.scramble(word, F.col("region_id"))).alias("ablated"))


@query("f10_single_base_variants", "F10", """select region_id, i pos, b base, substr(seq, 1, i::int) || b || substr(seq, i::int + 2) variant
 from (select region_id, seq, unnest(range(0, length(seq))) i from v_seqs), (values ('A'), ('C'), ('G'), ('T')) v(b) where substr(seq, i::int + 1, 1) <> b""", VS)
def _(t):
    seq = F.col("seq")
    at = spread(t("v_seqs"), "region_id").select("region_id", "seq", F.posexplode(F.split(seq, "")).alias("pos", "wt"))
    var = at.withColumn("base", F.explode(F.array(*[F.lit(b) for b in "ACGT"]))).where("base <> wt")
    return var.select("region_id", F.col("pos").cast("long").alias("pos"), "base", Q.replace_at(seq, F.col("pos"), F.col("base")).alias("variant"))


@query("f11_random_background", "F11", """with u as (select doc_id, i, ('0x' || substr(md5(doc_id::varchar || '-' || i::varchar), 1, 8))::bigint / 4294967296.0 u from documents, range(1, 65) r(i))
select doc_id region_id, string_agg(case when u < 0.295 then 'A' when u < 0.5 then 'C' when u < 0.705 then 'G' else 'T' end, '' order by i) background from u group by 1""")
def _(t):
    return t("documents").select(F.col("doc_id").alias("region_id"), Q.random_background(F.col("doc_id"), 64).alias("background"))


@query("f14_slice_pool", "F14", """select vec_id, round(list_sum(embedding[9:24]::double[]) / 16, 6) + 0.0 fwd, round(list_sum(embedding[41:56]::double[]) / 16, 6) + 0.0 rc from embeddings""")
def _(t):
    # bins [8, 24) forward; the mirrored bins [64 - 24, 64 - 8) on the reverse strand
    x, lo, hi = F.col("embedding"), F.lit(8), F.lit(24)
    return t("embeddings").select("vec_id", rd(U.pool_slice(x, lo, hi)).alias("fwd"), rd(U.pool_slice(x, lo, hi, mirrored=True)).alias("rc"))


@query("f14_row_slices", "F14", """with e as (select vec_id, embedding::double[] x, vec_id % 60 lo, vec_id % 60 + vec_id % 9 hi from embeddings)
select vec_id, case when hi > lo and hi <= 64 then round(list_sum(x[lo + 1:hi]) / (hi - lo), 6) + 0.0 end fwd, case when hi > lo and hi <= 64 then round(list_sum(x[64 - hi + 1:64 - lo]) / (hi - lo), 6) + 0.0 end rc from e""")
def _(t):
    x, lo = F.col("embedding"), F.col("vec_id") % 60
    hi = lo + F.col("vec_id") % 9
    return t("embeddings").select("vec_id", rd(U.pool_slice(x, lo, hi)).alias("fwd"), rd(U.pool_slice(x, lo, hi, mirrored=True)).alias("rc"))


@query("s16_genome_windows", "S16", """with ch as (select 'c' || (region_id % 5)::varchar contig, region_id // 5 chunk_id, seq from v_seqs), sz as (select contig, count(*) * 128 size from ch group by 1),
 w as (select point_id, contig, greatest(0, least(pos % size - 100, size - 200)) ws from v_points join sz using (contig)),
 j as (select point_id, ws, string_agg(seq, '' order by chunk_id) s, min(chunk_id) c0 from w join ch on ch.contig = w.contig and chunk_id between ws // 128 and (ws + 199) // 128 group by 1, 2)
select point_id, ws, substr(s, (ws - c0 * 128 + 1)::int, 200) seq from j""", ("v_seqs", "v_points"))
def _(t):
    chunks = t("v_seqs").select(F.concat(F.lit("c"), (F.col("region_id") % 5).cast("string")).alias("contig"), F.expr("region_id div 5").alias("chunk_id"), "seq")
    sizes = chunks.groupBy("contig").agg((F.count(F.lit(1)) * 128).alias("size"))
    pts = lookup_join(t("v_points").select("point_id", "contig", "pos"), sizes, ["contig"])
    ws = F.greatest(F.lit(0).cast("long"), F.least(F.col("pos") % F.col("size") - 100, F.col("size") - 200))
    return fetch_windows(pts.select("point_id", "contig", ws.alias("ws")), chunks, "point_id", 200, 128).select("point_id", "ws", "seq")


@query("o02_topk_with_predicate", "O2", f"with {scores_sql()}, {BEST} select region_id, round(best_rel, 6) best_rel from best where motif = 'ETS1' and n_80 >= 1 order by best.best_rel desc, region_id limit 50", VS)
def _(t):
    best = M.scan_best(t("v_seqs"), "region_id", [m for m in MOTIFS if m.name == "ETS1"], CUTOFFS)
    return best.where("n_80 >= 1").orderBy(F.col("best_rel").desc(), "region_id").limit(50).select("region_id", rd("best_rel").alias("best_rel"))


CAND = "cand as (select c_custkey, c_acctbal v from customer where c_acctbal >= 0 and c_mktsegment = 'BUILDING' and abs(c_nationkey - 12) <= 8)"


def candidates(t):
    chosen = SEL.candidates(t("customer").where("c_mktsegment = 'BUILDING'"), "c_acctbal", 0, "c_nationkey", 12, 8)
    return chosen.select("c_custkey", F.col("c_acctbal").alias("v"))


@query("p20_candidate_selection", "P20", f"with {CAND} select c_custkey, v from cand")
def _(t):
    return candidates(t)


@query("o03_bottom_and_top", "O3", f"with {CAND} select * from (select c_custkey, 'low' stratum from cand order by v, c_custkey limit 24) union all select * from (select c_custkey, 'high' from cand order by v desc, c_custkey desc limit 24)")
def _(t):
    c = candidates(t)
    low = c.orderBy("v", "c_custkey").limit(24).select("c_custkey", F.lit("low").alias("stratum"))
    return low.unionByName(c.orderBy(F.col("v").desc(), F.col("c_custkey").desc()).limit(24).select("c_custkey", F.lit("high").alias("stratum")))


@query("o04_first_per_group", "O4", """with f as (select contig, arg_min(point_id, struct_pack(p := pos, i := point_id)) point_id, min(pos) pos from v_points where payload > 1000 and pos - 200 >= 0 group by 1)
select contig, point_id, pos from f order by contig limit 4""", ("v_points",))
def _(t):
    ok = t("v_points").where("payload > 1000 and pos - 200 >= 0")
    first = ok.groupBy("contig").agg(F.min(F.struct("pos", "point_id")).alias("f"))
    return first.select("contig", "f.point_id", "f.pos").orderBy("contig").limit(4)


