"""The generated tables and the genomic views built on them, once as DataFrames and once as SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regulus.operators.expression import means_in_order
from regulus.session import cut

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_COMBO = """case o_orderkey % 7 when 0 then 'x' when 1 then 'y' when 2 then 'z' when 3 then 'x+y'
        when 4 then 'x+z' when 5 then 'y+z' else 'x+y+z' end label, o_orderstatus arrangement,
        (o_custkey % 3) * 4 + 4 load, case when (o_orderkey / 7) % 2 < 1 then 'real' else 'scrambled' end variant,
        o_custkey % 10 seed"""

# SQL text valid in Spark and in the oracle engine; table names stand for the parquet tables.
VIEWS = {
    "v_signal": """select l_partkey region_id, l_returnflag study, l_linestatus arm,
        concat(l_returnflag, l_linestatus, cast(l_suppkey % 2 as varchar(4))) sample,
        avg(l_extendedprice) signal from lineitem group by 1, 2, 3, 4""",
    "v_intervals": """select event_id, concat('c', cast(event_id % 5 as varchar(4))) contig,
        (event_id * 7919) % 1000003 s, (event_id * 7919) % 1000003 + 50 + cast(floor(value * 10) as bigint) e,
        concat('s', cast(user_id % 4 as varchar(4))) sample from events""",
    "v_points": """select o_orderkey point_id, concat('c', cast(o_orderkey % 5 as varchar(4))) contig,
        (o_orderkey * 104729) % 1000003 pos, concat('s', cast(o_custkey % 4 as varchar(4))) sample,
        o_totalprice payload from orders""",
    "v_track": """select l_returnflag sample, concat('c', cast(l_orderkey % 5 as varchar(4))) contig,
        (l_orderkey * 31337 + l_linenumber * 611) % 1000003 ts,
        (l_orderkey * 31337 + l_linenumber * 611) % 1000003 + 20 + cast(l_quantity as bigint) te,
        l_discount value, l_orderkey, l_linenumber from lineitem""",
    "v_blocks": """select s_suppkey block_id, concat('c', cast(s_suppkey % 5 as varchar(4))) src_contig,
        s_suppkey * 10000 src_start, s_suppkey * 10000 + case when s_suppkey % 3 = 0 then 60000 else 9000 end src_end,
        concat('c', cast((s_suppkey + case when s_suppkey % 6 = 0 then 1 else 0 end) % 5 as varchar(4))) dst_contig,
        s_suppkey * 10000 + s_suppkey * 37 dst_start,
        case when s_suppkey % 7 = 0 then '-' else '+' end strand from supplier""",
    "v_seqs": """select doc_id region_id, translate(concat(md5(cast(doc_id as varchar(20))),
        md5(concat('a', cast(doc_id as varchar(20)))), md5(concat('b', cast(doc_id as varchar(20)))),
        md5(concat('c', cast(doc_id as varchar(20))))), '0123456789abcdef', 'ACGTACGTACGTACGT') seq
        from documents""",
    "v_design": """select o_orderpriority label, o_orderstatus arrangement,
        case when o_orderkey % 2 = 0 then 'real' else 'scrambled' end variant,
        o_custkey % 10 seed, avg(o_totalprice) / 100000 pred from orders group by 1, 2, 3, 4""",
    "v_scores": """select d.doc_id, d.source, cast(d.n_chars as double) score, l.quality y, l.toxic
        from documents d join labels l on d.doc_id = l.doc_id""",
    "v_chars": """select event_id sample_id, concat('type: ', event_type) c1,
        concat('User: ', cast(user_id as varchar(20))) c2, props, event_type, user_id, value from events""",
    "v_alias": """select p_partkey, p_name symbol, concat_ws('|', p_brand, substring(p_name, 1, 6)) prev_symbol
        from part""",
    "v_combo": f"""select {_COMBO}, avg(o_totalprice) / 100000 pred from orders group by 1, 2, 3, 4, 5""",
    "v_calls": """select p_partkey region_id, l_returnflag motif, p_retailprice price, cast(p_size as double) size,
        count(case when l_quantity >= 45 then 1 end) n_hits from part join lineitem on p_partkey = l_partkey
        group by 1, 2, 3, 4""",
    "v_lfc": """select region_id, study, log2((avg(case when arm = 'O' then signal / m end) + 0.05)
        / (avg(case when arm = 'F' then signal / m end) + 0.05)) lfc
        from v_signal join (select sample sm, avg(signal) m from v_signal group by 1) on sm = sample
        group by 1, 2""",
}
_NEEDS = {"v_lfc": ["v_signal"]}


def with_views(body: str, *names: str) -> str:
    """Oracle text: the named views as CTEs in front of ``body`` (which may start its own WITH)."""
    ordered: list[str] = []
    for n in names:
        for m in [*_NEEDS.get(n, []), n]:
            if m not in ordered:
                ordered.append(m)
    ctes = ",\n".join(f"{n} as ({VIEWS[n]})" for n in ordered)
    body = body.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[len('with '):]}"
    return f"with {ctes}\n{body}"


@dataclass(frozen=True)
class Tables:
    """Tables of one scale directory: ``t("lineitem")`` scans, ``t("v_signal")`` is a view over scans."""

    spark: SparkSession
    path: str

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.path}/{name}.parquet")
        if name == "v_combo":
            return self._combo()
        text = VIEWS[name]
        used = {n: self(n) for n in [*TABLES, *VIEWS] if _mentions(text, n) and n != name}
        for n in used:
            text = _replace(text, n)
        return self.spark.sql(text, **used)

    def _combo(self) -> DataFrame:
        """``v_combo``: its predictions are ranked, and some are equal but for rounding, so each is summed in the order of the table."""
        orders = self("orders").select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
        rows = self.spark.sql(f"select {_COMBO}, o_totalprice, file, row from {{orders}}", orders=orders)
        keys = ["label", "arrangement", "load", "variant", "seed"]
        means = means_in_order(rows, keys, [F.col("file"), F.col("row")], mean=F.col("o_totalprice"))
        # some thousand rows at most, and read several times by most queries
        return cut(means.select(*keys, (F.col("mean") / 100000).alias("pred")))


def _mentions(text: str, name: str) -> bool:
    words = text.replace("\n", " ").split()
    return any(a in ("from", "join") and b == name for a, b in zip(words, words[1:]))


def _replace(text: str, name: str) -> str:
    for lead in ("from", "join"):
        text = text.replace(f"{lead} {name} ", f"{lead} {{{name}}} ")
        if text.endswith(f"{lead} {name}"):
            text = text[: -len(name)] + f"{{{name}}}"
    return text
