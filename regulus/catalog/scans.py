"""Scan and sink queries. Text inputs are lines that Spark derives from the generated tables."""

from pyspark.sql import functions as F

from regulus.catalog.registry import query, rd
from regulus.sources import readers as R
from regulus.sources import sinks as K

CONTIGS = ("c0", "c1", "c2", "c3")


def peak_lines(t):
    """narrowPeak text; error events give short lines, as truncated files do."""
    i = t("v_intervals").join(t("events").select("event_id", "event_type"), "event_id")
    short = F.concat_ws("\t", "contig", "s")
    full = F.concat_ws("\t", F.col("contig"), F.col("s").cast("string"), F.col("e").cast("string"), F.concat(F.lit("p"), F.col("event_id").cast("string")),
                       F.lit("0"), F.lit("."), F.lit("1"), F.lit("2"), F.lit("3"), F.expr("cast((e - s) div 2 as string)"))
    return i.select("sample", F.when(F.col("event_type") == "error", short).otherwise(full).alias("value"))


LINES = """lines as (select i.sample, case when event_type = 'error' then concat_ws(chr(9), contig, s) else
 concat_ws(chr(9), contig, s, e, 'p' || i.event_id, 0, '.', 1, 2, 3, (e - s) // 2) end as line from v_intervals i join events v on v.event_id = i.event_id),
 f as (select sample, string_split(line, chr(9)) p from lines)"""


@query("s01_peak_scan", "S1", f"with {LINES} select sample, p[1] contig, p[2]::bigint \"start\", p[3]::bigint \"end\" from f where len(p) >= 3 and p[1] in {CONTIGS}", ("v_intervals",))
def _(t):
    return R.intervals_from_lines(peak_lines(t), CONTIGS, keep=["sample"])


@query("s02_summit_scan", "S2", f"with {LINES} select sample, p[1] contig, p[2]::bigint + p[10]::bigint pos from f where len(p) >= 10 and p[1] in {CONTIGS}", ("v_intervals",))
def _(t):
    return R.summits_from_lines(peak_lines(t), CONTIGS, keep=["sample"])


GTF = """g as (select case when p_partkey % 50 = 0 then '#comment ' || p_name else concat_ws(chr(9), 'c' || (p_partkey % 5), 'src', case when p_size % 3 = 0 then 'exon' else 'gene' end,
 p_partkey * 100 + 1, p_partkey * 100 + p_size * 10, '.', case when p_size % 2 = 0 then '+' else '-' end, '.', 'gene_id "G' || p_partkey || '"; gene_name "' || p_name || '"; gene_type "' || p_type || '";') end as line from part)"""


def gtf_lines(t):
    k, size = F.col("p_partkey"), F.col("p_size")
    attrs = F.concat(F.lit('gene_id "G'), k.cast("string"), F.lit('"; gene_name "'), F.col("p_name"), F.lit('"; gene_type "'), F.col("p_type"), F.lit('";'))
    row = F.concat_ws("\t", F.concat(F.lit("c"), (k % 5).cast("string")), F.lit("src"), F.when(size % 3 == 0, "exon").otherwise("gene"), (k * 100 + 1).cast("string"),
                      (k * 100 + size * 10).cast("string"), F.lit("."), F.when(size % 2 == 0, "+").otherwise("-"), F.lit("."), attrs)
    return t("part").select(F.when(k % 50 == 0, F.concat(F.lit("#comment "), F.col("p_name"))).otherwise(row).alias("value"))


@query("s03_annotation_scan", "S3", f"""with {GTF}, f as (select string_split(line, chr(9)) p from g where line not like '#%')
select p[1] contig, p[4]::bigint "start", p[5]::bigint "end", p[7] strand, regexp_extract(p[9], 'gene_name "([^"]+)"', 1) gene_name, regexp_extract(p[9], 'gene_type "([^"]+)"', 1) gene_type,
 case when p[7] = '+' then p[4]::bigint else p[5]::bigint end tss from f where p[3] = 'gene'""")
def _(t):
    return R.annotation_from_lines(gtf_lines(t), "gene")


@query("s04_contig_sizes", "S4", """with s as (select n_name contig, (n_nationkey + 1) * 1000000::bigint size from nation)
select n_name contig, size, count(c_custkey) n_points, count(*) filter (c_custkey * 1000 >= size) n_outside from nation join s on contig = n_name join customer on c_nationkey = n_nationkey group by 1, 2""")
def _(t):
    lines = t("nation").select(F.concat_ws("\t", "n_name", ((F.col("n_nationkey") + 1) * 1_000_000).cast("string")).alias("value"))
    sizes = R.sizes_from_lines(lines)
    pts = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("contig"))
    return pts.join(sizes, "contig").groupBy("contig", "size").agg(F.count("c_custkey").alias("n_points"), F.count_if(F.col("c_custkey") * 1000 >= F.col("size")).alias("n_outside"))


@query("s05_wide_matrix_scan", "S5", """with w as (select l_partkey gene, sum(l_quantity) filter (l_returnflag = 'A') A, sum(l_quantity) filter (l_returnflag = 'N') N, sum(l_quantity) filter (l_returnflag = 'R') R from lineitem group by 1)
select gene, 'A' sample, case when A >= 300 then A end as value from w union all select gene, 'N', case when N >= 300 then N end from w union all select gene, 'R', case when R >= 300 then R end from w""")
def _(t):
    w = t("lineitem").groupBy(F.col("l_partkey").alias("gene")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    text = w.select("gene", *[F.when(F.col(c) >= 300, F.col(c).cast("string")).otherwise(F.lit("n/a")).alias(c) for c in "ANR"])
    return R.wide_to_long(text, "gene", ["A", "N", "R"])


@query("s06_sectioned_text", "S6", """select doc_id, 1::bigint "row", 'ID' "column", 'd' || doc_id "value" from documents union all select doc_id, 1, 'CHARS', n_chars::varchar from documents
 union all select doc_id, 2, 'ID', 'lang' from documents union all select doc_id, 2, 'CHARS', lang from documents""")
def _(t):
    body = F.concat(F.lit('!title junk\n!series_matrix_table_begin\n"ID"\t"CHARS"\n"d'), F.col("doc_id").cast("string"), F.lit('"\t'), F.col("n_chars").cast("string"),
                    F.lit('\n"lang"\t"'), F.col("lang"), F.lit('"\n!series_matrix_table_end\n!tail\t1\n'))
    return R.sections_from_texts(t("documents").select("doc_id", body.alias("text")), "doc_id", "text", "!series_matrix_table_begin", "!series_matrix_table_end")


@query("s07_entity_blocks", "S7", """select 'E' || sample_id entity, 'Sample_title' "key", 1::bigint n, event_type "values" from v_chars
 union all select 'E' || sample_id, 'Sample_characteristics_ch1', 2, c1 || '|' || c2 from v_chars""", ("v_chars",))
def _(t):
    v = t("v_chars")
    block = F.concat(F.lit("SAMPLE = E"), F.col("sample_id").cast("string"), F.lit("\n!Sample_title = "), F.col("event_type"), F.lit("\n!Sample_characteristics_ch1 = "), F.col("c1"),
                     F.lit("\n!Sample_characteristics_ch1 = "), F.col("c2"))
    e = R.entities_from_blocks(v.select(block.alias("value")), "SAMPLE")
    return e.select("entity", "key", F.size("values").cast("long").alias("n"), F.concat_ws("|", "values").alias("values"))


def experiments(t):
    """One experiment document per order, with its lines as files (an order has few lines)."""
    f = F.struct(F.concat(F.lit("F"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_returnflag").alias("format"), F.col("l_linestatus").alias("output"),
                 F.array((F.col("l_linenumber") % 2 + 1).cast("int")).alias("replicates"),
                 F.filter(F.array(F.struct(F.lit("depth").alias("name"), F.col("l_quantity").alias("value")),
                                  F.when(F.col("l_linestatus") == "O", F.struct(F.lit("frip").alias("name"), F.col("l_discount").alias("value")))), lambda m: m.isNotNull()).alias("metrics"))
    files = t("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_discount", f.alias("f")))).alias("fs"))
    docs = files.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.to_json(F.struct(
        F.concat(F.lit("X"), F.col("o_orderkey").cast("string")).alias("accession"), F.transform("fs", lambda x: x["f"]).alias("files"),
        F.create_map(F.col("o_orderstatus"), F.array("o_orderpriority")).alias("audit"))).alias("doc"))
    return R.experiments_from_json(docs, "doc")


EX = "ex as (select l.*, o.* from lineitem l join orders o on l_orderkey = o_orderkey)"


@query("s08_file_inventory", "S8", f"""with {EX} select 'X' || o_orderkey accession, 'F' || l_linenumber file_id, l_returnflag format, l_linestatus output, (l_linenumber % 2 + 1)::varchar replicates from ex""")
def _(t):
    return R.file_inventory(experiments(t))


@query("s08_audit_rows", "S8", f"""with {EX} select distinct 'X' || o_orderkey accession, o_orderstatus "level", o_orderpriority message from ex""")
def _(t):
    return R.audit_rows(experiments(t))


@query("s09_replicate_quality", "S9", f"""with {EX}, r as (select distinct o_orderkey, l_linenumber % 2 + 1 replicate from ex),
 m as (select o_orderkey, l_linenumber % 2 + 1 replicate, min(struct_pack(k := l_linenumber, q := l_quantity, d := l_discount, s := l_linestatus)) b from ex where l_returnflag = 'A' group by 1, 2)
select 'X' || o_orderkey accession, replicate::int replicate, 'F' || b.k file_id, b.q depth, case when b.s = 'O' then b.d end frip from r left join m using (o_orderkey, replicate)""")
def _(t):
    return R.replicate_quality(experiments(t), "A", ["depth", "frip"])


# the pages' own lines, and a listing of three lines a page: quoted either way, not quoted, two links in a line, with and without a size
@query("s10_index_page_links", "S10", r"""with p as (select page_id, replace(replace(html, '</li>', chr(10)), '</p>', chr(10)) t from pages
   union all select -1 - page_id, concat('<A HREF=''file_', page_id, '.bw''>x</A> 2023-01-01 12:00 ', length(html), 'K', chr(10), '<a href=raw_', page_id, '.gz>y</a> and <a href = "b c.txt">z</a> 1.5M ', chr(10),
     '<a href="https://else.where/x">u</a> <a href="../up">v</a> - ') from pages),
 l as (select page_id, unnest(string_split(t, chr(10))) x, generate_subscripts(string_split(t, chr(10)), 1) - 1 line from p),
 k as (select page_id, line, x, unnest(f) q, generate_subscripts(f, 1) - 1 nth from (select *, regexp_extract_all(x, '(?i)\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1) f from l)),
 w as (select page_id, line, nth, regexp_replace(q, '^["'']|["'']$', '', 'g') link, string_split(trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), ' ')[-1] word from k),
 z as (select *, regexp_matches(word, '^([0-9]+|[0-9]+[.][0-9]+)[KMGT]?$') sized from w where not regexp_matches(link, '^([A-Za-z][A-Za-z0-9+.-]*:|[#?]|$)'))
select page_id, line::bigint line, nth::bigint nth, link, case when sized then word end size,
 case when sized then rtrim(word, 'KMGT')::double * 1024.0 ** case when regexp_matches(word, '[KMGT]$') then instr('KMGT', right(word, 1)) else 0 end end bytes from z""")
def _(t):
    p = t("pages")
    lines = p.select("page_id", F.regexp_replace("html", "</li>|</p>", "\n").alias("html"))
    ident = F.col("page_id").cast("string")
    listing = p.select((-1 - F.col("page_id")).alias("page_id"), F.concat(
        F.lit("<A HREF='file_"), ident, F.lit(".bw'>x</A> 2023-01-01 12:00 "), F.length("html").cast("string"), F.lit("K\n<a href=raw_"), ident,
        F.lit('.gz>y</a> and <a href = "b c.txt">z</a> 1.5M \n<a href="https://else.where/x">u</a> <a href="../up">v</a> - ')).alias("html"))
    return R.links_from_html(lines.unionByName(listing), "page_id", "html", rooted=True)


@query("s11_file_list_classification", "S11", """with f as (select case o_orderkey % 3 when 0 then 'GSM' || o_orderkey || '_a.narrowPeak.gz' when 1 then 'GSM' || o_orderkey || '_b.bw' else 'readme_' || o_orderkey || '.txt' end name,
   o_totalprice expected, o_totalprice * (1 + (o_custkey % 13) / 100.0) actual from orders)
select name, case when name like '%.narrowPeak.gz' then 'peaks' when name like '%.bw' then 'track' else 'other' end kind, nullif(regexp_extract(name, '^(GSM\\d+)_', 1), '') sample_id,
 abs(actual - expected) > 0.05 * expected size_mismatch from f""".replace("\\\\", "\\"))
def _(t):
    k = F.col("o_orderkey").cast("string")
    m = F.col("o_orderkey") % 3
    name = F.when(m == 0, F.concat(F.lit("GSM"), k, F.lit("_a.narrowPeak.gz"))).when(m == 1, F.concat(F.lit("GSM"), k, F.lit("_b.bw"))).otherwise(F.concat(F.lit("readme_"), k, F.lit(".txt")))
    f = t("orders").select(name.alias("name"), F.col("o_totalprice").alias("expected"), (F.col("o_totalprice") * (1 + (F.col("o_custkey") % 13) / 100.0)).alias("actual"))
    return R.classify_files(f, "name", "expected", "actual").select("name", "kind", "sample_id", "size_mismatch")


@query("s12_log_metrics", "S12", """select 'part ' || p_partkey || ' vs base (shared denom)' as name, round((p_size - 25) / 50.0, 2) + 0.0 rho, (p_retailprice * 10000)::bigint n from part where p_size % 5 <> 0""")
def _(t):
    rho = F.format_string("%+.2f", F.round((F.col("p_size") - 25) / 50.0, 2))
    n = F.format_number((F.col("p_retailprice") * 10000).cast("double"), 0)
    full = F.concat(F.lit("  part "), F.col("p_partkey").cast("string"), F.lit(" vs base (shared denom)   rho "), rho, F.lit("  n="), n)
    lines = t("part").select(F.when(F.col("p_size") % 5 == 0, F.lit("step done, nothing measured")).otherwise(full).alias("value"))
    return R.metrics_from_logs(lines).withColumn("rho", rd("rho"))


@query("s13_table_sinks", "S13", """select 'parquet' fmt, l_returnflag, count(*) n, round(sum(l_quantity), 2) q from lineitem group by 2 union all select 'csv', l_returnflag, count(*), round(sum(l_quantity), 2) from lineitem group by 2
 union all select 'json', l_returnflag, count(*), round(sum(l_quantity), 2) from lineitem group by 2""")
def _(t):
    out = None
    src = t("lineitem").select("l_returnflag", "l_quantity")
    for fmt in ("parquet", "csv", "json"):
        path = K.scratch_path(t.spark, fmt)
        K.write_table(src, path, fmt)
        reader = t.spark.read.schema(src.schema)
        back = (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)
        g = back.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), rd(F.sum("l_quantity"), 2).alias("q")).withColumn("fmt", F.lit(fmt))
        out = g if out is None else out.unionByName(g)
    return out


@query("s14_bed_lines", "S14", """select concat_ws(chr(9), contig, s - 1, e, event_id || '|' || sample) line from v_intervals where s > 0""", ("v_intervals",))
def _(t):
    return K.bed_lines(t("v_intervals").where("s > 0"), "contig", "s", "e", "event_id", "sample")


@query("s15_annotated_bundle", "S15", """with x as (select l_partkey region_id, l_returnflag task, avg(l_discount) v from lineitem group by 1, 2), f as (select region_id, task, v from (select distinct l_partkey region_id from lineitem) cross join
  (select distinct l_returnflag task from lineitem) left join x using (region_id, task))
select task, case when region_id % 10 = 0 then 'test' else 'train' end split, count(*) n, count(v) n_measured, round(sum(coalesce(v, 0)), 4) total from f group by 1, 2""")
def _(t):
    li = t("lineitem")
    x = li.groupBy(F.col("l_partkey").alias("region_id"), F.col("l_returnflag").alias("task")).agg(F.avg("l_discount").alias("v"))
    wide = x.groupBy("region_id").pivot("task", ["A", "N", "R"]).agg(F.first("v"))
    long = wide.unpivot(["region_id"], ["A", "N", "R"], "task", "v")
    obs = li.select(F.col("l_returnflag").alias("task")).distinct()
    var = wide.select("region_id", F.when(F.col("region_id") % 10 == 0, "test").otherwise("train").alias("split"))
    path = K.scratch_path(t.spark, "bundle")
    K.write_bundle(obs, var, long, {"policy": "missing stays NULL"}, path)
    o, v, xx = K.read_bundle(t.spark, path)
    j = K.filled(xx.withColumn("raw", F.col("v")), "v").join(o, "task").join(v, "region_id")
    return j.groupBy("task", "split").agg(F.count(F.lit(1)).alias("n"), F.count("raw").alias("n_measured"), rd(F.sum("v"), 4).alias("total"))


