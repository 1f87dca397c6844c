"""Scans of text formats. Each ``*_from_*`` works on a DataFrame of text, each ``read_*`` on a path.

Gzip files are one task each, so a folder of many files is the unit of parallelism; ``read_*``
repartitions after the scan when later steps are wide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The contigs kept at the scan.
STANDARD_CONTIGS = tuple(f"chr{i}" for i in range(1, 23)) + ("chrX", "chrY")
TRACK_SCHEMA = "contig string, start long, end long, value double"


def _field(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i))


def intervals_from_lines(lines: DataFrame, contigs: Sequence[str] = STANDARD_CONTIGS, min_fields: int = 3,
                         keep: Sequence[str] = ()) -> DataFrame:
    """BED/narrowPeak lines (column ``value``) to contig, start, end; short lines and other contigs drop."""
    parts = F.split("value", "\t")
    rows = lines.where(F.size(parts) >= min_fields).select(
        *keep, _field(parts, 0).alias("contig"), _field(parts, 1).try_cast("long").alias("start"),
        _field(parts, 2).try_cast("long").alias("end"))
    return rows.where(F.col("contig").isin(*contigs) & F.col("start").isNotNull() & F.col("end").isNotNull())


def summits_from_lines(lines: DataFrame, contigs: Sequence[str] = STANDARD_CONTIGS,
                       keep: Sequence[str] = ()) -> DataFrame:
    """narrowPeak lines to summit points: start + offset of column 10."""
    parts = F.split("value", "\t")
    rows = lines.where(F.size(parts) >= 10).select(
        *keep, _field(parts, 0).alias("contig"),
        (_field(parts, 1).try_cast("long") + _field(parts, 9).try_cast("long")).alias("pos"))
    return rows.where(F.col("contig").isin(*contigs) & F.col("pos").isNotNull())


def read_intervals(spark: SparkSession, path: str, partitions: int = 0, **kw) -> DataFrame:
    lines = spark.read.text(path).withColumn("sample", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[A-Za-z]+)*$", 1))
    out = intervals_from_lines(lines, keep=["sample"], **kw)
    return out.repartition(partitions) if partitions else out


def read_summits(spark: SparkSession, path: str, **kw) -> DataFrame:
    lines = spark.read.text(path).withColumn("sample", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[A-Za-z]+)*$", 1))
    return summits_from_lines(lines, keep=["sample"], **kw)


def read_track(spark: SparkSession, path: str) -> DataFrame:
    """bedGraph-shaped runs; NaN means uncovered and becomes NULL."""
    df = spark.read.schema(TRACK_SCHEMA).option("sep", "\t").csv(path)
    return df.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def attribute(attrs: Column, name: str) -> Column:
    """Quoted attribute of an annotation line, NULL when missing."""
    return F.nullif(F.regexp_extract(attrs, name + r' "([^"]+)"', 1), F.lit(""))


def annotation_from_lines(lines: DataFrame, feature: str) -> DataFrame:
    """Annotation lines of one feature type: contig, start, end (1-based, inclusive), strand, names, TSS."""
    parts = F.split("value", "\t")
    rows = lines.where(~F.startswith("value", F.lit("#"))).where((F.size(parts) >= 9) & (_field(parts, 2) == feature))
    attrs = _field(parts, 8)
    rows = rows.select(_field(parts, 0).alias("contig"), _field(parts, 3).try_cast("long").alias("start"),
                       _field(parts, 4).try_cast("long").alias("end"), _field(parts, 6).alias("strand"),
                       attribute(attrs, "gene_name").alias("gene_name"), attribute(attrs, "gene_type").alias("gene_type"))
    return rows.withColumn("tss", F.when(F.col("strand") == "+", F.col("start")).otherwise(F.col("end")))


def read_annotation(spark: SparkSession, path: str, feature: str) -> DataFrame:
    return annotation_from_lines(spark.read.text(path), feature)


def sizes_from_lines(lines: DataFrame) -> DataFrame:
    parts = F.split("value", r"\s+")
    return lines.select(_field(parts, 0).alias("contig"), _field(parts, 1).try_cast("long").alias("size")).where("size is not null")


def wide_to_long(df: DataFrame, ident: str, values: Sequence[str]) -> DataFrame:
    """Wide text matrix to (ident, sample, value); text that is not a number becomes NULL."""
    text = df.select(ident, *[F.col(v).cast("string").alias(v) for v in values])
    long = text.unpivot([ident], list(values), "sample", "text")
    value = F.col("text").try_cast("double")
    return long.select(ident, "sample", F.when(~F.isnan(value), value).alias("value"))


def sections_from_texts(files: DataFrame, ident: str, text: str, begin: str, end: str) -> DataFrame:
    """Tab-separated rows between two marker lines of whole-file texts; the first row is the header.

    Returns (ident, row, column, value), quotes removed.
    """
    body = F.regexp_extract(text, r"(?s)(?:^|\n)" + begin + r"\n(.*?)\n" + end, 1)
    lines = F.split(body, "\n")
    header = F.split(F.get(lines, F.lit(0)), "\t")
    rows = files.where(body != "").select(ident, header.alias("_h"), F.posexplode(lines).alias("row", "_line")).where("row > 0")
    cells = rows.select(ident, "row", F.explode(F.arrays_zip(F.col("_h").alias("h"), F.split("_line", "\t").alias("v"))).alias("_c"))
    def bare(c: Column) -> Column:
        return F.regexp_replace(c, '"', "")
    return cells.select(ident, F.col("row").cast("long").alias("row"), bare(F.col("_c.h")).alias("column"), bare(F.col("_c.v")).alias("value"))


def read_entity_blocks(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``^ENTITY = name`` block: the text source splits records on a newline and caret."""
    return spark.read.option("lineSep", "\n^").text(path)


def entities_from_blocks(blocks: DataFrame, kind: str) -> DataFrame:
    """Blocks of one entity kind to (entity, key, values): repeated keys keep their order."""
    lines = F.split(F.regexp_replace("value", r"^\^", ""), "\n")
    first = F.get(lines, F.lit(0))
    pairs = F.transform(F.filter(lines, lambda x: x.startswith("!")), lambda x: F.struct(
        F.regexp_extract(x, r"^!(\S+) = ?(.*)$", 1).alias("key"), F.regexp_extract(x, r"^!(\S+) = ?(.*)$", 2).alias("v")))
    rows = blocks.where(F.regexp_extract(first, r"^(\w+) = (.*)$", 1) == kind).select(
        F.regexp_extract(first, r"^(\w+) = (.*)$", 2).alias("entity"), pairs.alias("_p"))
    # everything happens inside the block's own row, so blocks that share a name never meet
    keys = rows.select("entity", "_p", F.explode(F.array_distinct(F.transform("_p", lambda x: x["key"]))).alias("key"))
    return keys.select("entity", "key", F.transform(F.filter("_p", lambda x: x["key"] == F.col("key")), lambda x: x["v"]).alias("values"))


EXPERIMENT_SCHEMA = T.StructType([
    T.StructField("accession", T.StringType()),
    T.StructField("files", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("format", T.StringType()),
        T.StructField("output", T.StringType()), T.StructField("replicates", T.ArrayType(T.IntegerType())),
        T.StructField("metrics", T.ArrayType(T.StructType([
            T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())])))]))),
    T.StructField("audit", T.MapType(T.StringType(), T.ArrayType(T.StringType())))])


def experiments_from_json(docs: DataFrame, column: str) -> DataFrame:
    return docs.select(F.from_json(column, EXPERIMENT_SCHEMA).alias("x")).select("x.*")


def file_inventory(experiments: DataFrame) -> DataFrame:
    """One flat row per file of every experiment."""
    f = experiments.select("accession", F.explode("files").alias("f"))
    return f.select("accession", F.col("f.id").alias("file_id"), F.col("f.format").alias("format"), F.col("f.output").alias("output"),
                    F.concat_ws(",", F.transform("f.replicates", lambda r: r.cast("string"))).alias("replicates"))


def audit_rows(experiments: DataFrame) -> DataFrame:
    a = experiments.select("accession", F.explode("audit").alias("level", "messages"))
    return a.select("accession", "level", F.explode("messages").alias("message"))


def replicate_quality(experiments: DataFrame, fmt: str, metrics: Sequence[str]) -> DataFrame:
    """Per experiment and replicate: the first file of the format and its named metrics (NULL if absent)."""
    reps = experiments.select("accession", "files", F.explode(F.array_distinct(F.flatten(F.transform("files", lambda f: f["replicates"])))).alias("replicate"))
    match = F.filter("files", lambda f: (f["format"] == fmt) & F.array_contains(f["replicates"], F.col("replicate")))
    first = reps.select("accession", "replicate", F.get(match, F.lit(0)).alias("f"))

    def metric(wanted: str) -> Column:
        return F.get(F.filter("f.metrics", lambda m: m["name"] == wanted), F.lit(0))["value"].alias(wanted)

    cols = [metric(n) for n in metrics]
    return first.select("accession", "replicate", F.col("f.id").alias("file_id"), *cols)


LINK_TARGET = r"""(?i)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def links_from_html(pages: DataFrame, ident: str, html: str, rooted: bool = False) -> DataFrame:
    """Every relative link of an index page: ident, line, nth (in its line), link, size and bytes.

    Targets may be quoted either way or not at all, and a line may hold several. Links with a scheme, fragments,
    bare queries and, unless ``rooted``, links from the root are left out. A line's size is its last word outside
    tags, if that is a number with or without a unit (K, M, G, T; powers of 1024); else size and bytes are NULL.
    """
    lines = pages.select(ident, F.posexplode(F.split(html, "\r?\n")).alias("line", "_x"))
    links = lines.select("*", F.posexplode(F.regexp_extract_all("_x", F.lit(LINK_TARGET), F.lit(1))).alias("nth", "_t"))
    link = F.regexp_replace("_t", "^[\"']|[\"']$", "")
    word = F.element_at(F.split(F.trim(F.regexp_replace(F.regexp_replace("_x", "<[^>]*>", " "), r"\s+", " ")), " "), -1)
    unit = F.instr(F.lit("KMGT"), F.regexp_extract("_word", "([A-Z])$", 1))
    number = F.regexp_extract("_word", "^([0-9]+|[0-9]+[.][0-9]+)[KMGT]?$", 1)
    rows = links.select(ident, F.col("line").cast("long").alias("line"), F.col("nth").cast("long").alias("nth"), link.alias("link"), word.alias("_word"))
    other = F.col("link").rlike("^([A-Za-z][A-Za-z0-9+.-]*:|[#?]|$)")
    kept = rows.where(~other if rooted else ~other & ~F.col("link").startswith("/")).withColumn("_number", number)
    sized = F.col("_number") != ""
    scale = F.pow(F.lit(1024.0), F.when(F.col("_word").rlike("[KMGT]$"), unit).otherwise(0))
    return kept.select(ident, "line", "nth", "link", F.when(sized, F.col("_word")).alias("size"),
                       F.when(sized, F.expr("try_cast(_number as double)") * scale).alias("bytes"))


def classify_files(files: DataFrame, name: str, expected: str, actual: str, tolerance: float = 0.05) -> DataFrame:
    """Extension class, sample id prefix and a flag for a size off by more than the tolerance."""
    n = F.col(name)
    kind = F.when(n.endswith(".narrowPeak.gz"), "peaks").when(n.endswith(".bw"), "track").otherwise("other")
    return (files.withColumn("kind", kind).withColumn("sample_id", F.nullif(F.regexp_extract(n, r"^(GSM\d+)_", 1), F.lit("")))
            .withColumn("size_mismatch", F.abs(F.col(actual) - F.col(expected)) > tolerance * F.col(expected)))


def metrics_from_logs(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``name rho +0.56 n=110,699`` lines to (name, rho, n); a name may hold blanks."""
    pat = r"^\s*(\S.*?)\s+rho\s+([+-]?\d+(?:\.\d+)?)\s+n=([\d,]+)"
    rows = lines.where(F.col("value").rlike(pat))
    return rows.select(*keep, F.regexp_extract("value", pat, 1).alias("name"), F.regexp_extract("value", pat, 2).cast("double").alias("rho"),
                       F.regexp_replace(F.regexp_extract("value", pat, 3), ",", "").cast("long").alias("n"))
