"""Genomic tables as projections of the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SEQUENCE = "translate(concat(md5(concat(cast(l_partkey as varchar(20)), 'a')), md5(concat(cast(l_partkey as varchar(20)), 'b'))), '0123456789abcdef', 'ACGTACGTACGTACGT')"
SITES = {
    "chrom": "concat('chr', cast(1 + l_partkey % 22 as varchar(9)))",
    "pos": "cast((l_orderkey * 37 + l_linenumber * 11) % 100000 as bigint)",
    "strand": "case when l_suppkey % 2 = 0 then '+' else '-' end",
    "source": "l_returnflag",
    "sequence": SEQUENCE,
}
GENES = {
    "chrom": "concat('chr', cast(1 + p_partkey % 22 as varchar(9)))",
    "g_start": "(p_partkey * 97) % 100000",
    "g_end": "(p_partkey * 97) % 100000 + p_size * 60",
    "gene_id": "concat('G', cast(p_partkey as varchar(9)))",
    "ord": "p_partkey",
}
#: 3'UTR-like spans: the last 300 and more bases of a gene, on a strand.
UTRS = {
    "chrom": "concat('chr', cast(1 + p_partkey % 22 as varchar(9)))",
    "strand": "case when p_partkey % 2 = 0 then '+' else '-' end",
    "u_start": "(p_partkey * 97) % 100000",
    "u_end": "(p_partkey * 97) % 100000 + p_size * 60",
    "utr_id": "p_partkey",
}
CANDIDATES = {"key": "o_orderkey", "chrom": "concat('chr', cast(1 + o_custkey % 22 as varchar(9)))", "pos": "cast((o_orderkey * 53 + o_custkey) % 100000 as bigint)"}
SCORES = {"key": "concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)), '-', cast(l_partkey as varchar(20)), '-', cast(l_suppkey as varchar(20)))", "label": "case when l_returnflag = 'R' then 1 else 0 end", "prob": "l_discount * 10"}
DOCUMENTS = {"doc_id": "doc_id", "sequence": "text", "source": "source"}


def _sql(columns: dict[str, str], table: str) -> str:
    return "select " + ", ".join(f"{e} as {c}" for c, e in columns.items()) + f" from {table}"


TABLES = {"sites": (SITES, "lineitem"), "genes": (GENES, "part"), "utrs": (UTRS, "part"), "candidates": (CANDIDATES, "orders"), "scores": (SCORES, "lineitem"), "docs": (DOCUMENTS, "documents")}
#: Common table expressions of the same names, for the oracle.
CTE = {name: f"{name} as ({_sql(*t)})" for name, t in TABLES.items()}
#: Sites, one of each coordinate, in the order of source and sequence.
CTE["distinct_sites"] = "distinct_sites as (select chrom, pos, strand, source, sequence from (select *, row_number() over (partition by chrom, pos, strand order by source, sequence) as rn from sites) where rn = 1)"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    columns, table = TABLES[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e} as {c}" for c, e in columns.items()))


def with_(*names: str) -> str:
    return "with " + ",\n".join(CTE[n] for n in names)
