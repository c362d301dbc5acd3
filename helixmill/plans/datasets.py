"""Registered queries of the dataset stages as a whole: sites with genes and sequences, merged and clustered positives, the labelled
dataset halved and balanced, samples of the rest, and scores by a model that is read from a file."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixmill.functions import sequence as seq
from helixmill.plans import pipelines
from helixmill.plans.catalogue import _PARTS, KEYS, _parts, query
from helixmill.plans.files import _CHROM, _PART_LETTERS, _fasta_of_part, _lines, _part
from helixmill.plans.stages import held, new_path, remove
from helixmill.sources import genomic

# -- annotated sites and positives, on the contigs of part's bases ------------------------------------------------------

_SPOT = ("concat('chr', cast(1 + o_custkey % 22 as {0})) as chrom", "cast((o_orderkey * 37 + o_custkey * 11) % {1} as bigint) as pos", "case when (o_orderkey + o_custkey) % 2 = 0 then '+' else '-' end as strand")
_GENE = (_CHROM + " as chrom", "cast((p_partkey * 97) % {1} as bigint) as g_start", "cast((p_partkey * 97) % {1} + p_size * 4 as bigint) as g_end", "case when p_partkey % 2 = 0 then '+' else '-' end as strand", "concat('G', cast(p_partkey as {0})) as gene_id", "p_name as gene_name", "p_type as gene_type", "p_partkey as ord")


def _annotated_sql(match_strand: bool) -> str:
    side = " and s.strand = g.strand" if match_strand else ""
    key = "chrom, strand" if match_strand else "chrom"
    names = ("gene_id", "gene_name", "gene_type")
    named = ", ".join(f"case when n.g_end >= n.pos then n.{x} else coalesce(i.v.{x}, '') end as {x}" for x in names)
    return f"""with {_PART_LETTERS}, size as (select 64 * (count(*) // 22) as l from part),
spots as (select {", ".join(_SPOT).format("varchar", "l")}, o_orderstatus = 'F' as first from orders, size),
genes as (select {", ".join(_GENE).format("varchar", "l")} from part, size),
last_gene as (select * from genes qualify row_number() over (partition by {key}, g_start order by g_end desc, gene_id desc) = 1),
near as (select s.chrom, s.pos, s.strand, s.first, g.g_end, {", ".join(f"g.{x}" for x in names)} from spots s asof left join last_gene g on s.chrom = g.chrom{side} and s.pos >= g.g_start),
inside as (select s.chrom, s.pos, s.strand, arg_min(struct_pack({", ".join(f"{x} := g.{x}" for x in names)}), g.ord) as v from (select distinct chrom, pos, strand from spots) s join genes g on s.chrom = g.chrom{side} and s.pos between g.g_start and g.g_end group by s.chrom, s.pos, s.strand),
named as (select n.chrom, n.pos, n.strand, n.first, {named} from near n left join inside i on n.chrom = i.chrom and n.pos = i.pos and n.strand = i.strand),
cut as (select named.*, coalesce(substr(s, cast(greatest(pos - 101, 0) + 1 as int), cast(greatest(pos + 102 - greatest(pos - 101, 0), 0) as int)), '') as w from named left join letters using (chrom)),
annotated as (select * exclude (w), case when strand = '-' then reverse(translate(w, 'ACGT', 'TGCA')) else w end as sequence from cut)"""


def _annotated(spark, d, match_strand: bool = False) -> tuple[DataFrame, DataFrame]:
    """The sites of finished orders and those of the others, each with genes and sequences."""
    p, orders = _part(spark, d), spark.read.parquet(f"{d}/orders.parquet")
    size = 64 * (p.count() // 22)
    genes = p.selectExpr(*(x.format("string", size) for x in _GENE))
    chunks = _lines(spark, _fasta_of_part(spark, d), "fasta", lambda path: genomic.fasta_chunks(spark, path, 1000))
    spots = lambda test: orders.where(test).selectExpr(*(x.format("string", size) for x in _SPOT))
    return tuple(pipelines.annotated_sites(spots(f"o_orderstatus {op} 'F'"), genes, chunks, source, match_strand, 1000) for op, source in (("=", "atlas"), ("<>", "base, old")))


@query(f"{_annotated_sql(False)} select chrom, pos, strand, gene_id, gene_name, gene_type, case when first then 'atlas' else 'base, old' end as source, md5(sequence) as digest from annotated")
def annotated_sites(spark, d):
    """Sites of two collections with their gene and the 203 bases around them; the contigs come from a FASTA file."""
    a, b = _annotated(spark, d)
    return a.unionByName(b).select(*KEYS, "gene_id", "gene_name", "gene_type", "source", F.md5("sequence").alias("digest"))


@query(f"{_annotated_sql(True)} select chrom, pos, strand, gene_id, gene_name, gene_type, case when first then 'atlas' else 'base, old' end as source, md5(sequence) as digest from annotated")
def annotated_sites_by_strand(spark, d):
    """As annotated_sites, with genes of the site's own strand."""
    a, b = _annotated(spark, d, True)
    return a.unionByName(b).select(*KEYS, "gene_id", "gene_name", "gene_type", "source", F.md5("sequence").alias("digest"))


@query(f"""{_annotated_sql(False)}, merged as (select chrom, pos, strand, any_value(gene_name) as gene_name, any_value(sequence) as sequence, case when count(distinct first) = 2 then 'atlas,base,old' when bool_or(first) then 'atlas' else 'base,old' end as source from annotated group by chrom, pos, strand),
flagged as (select *, case when pos - lag(pos) over w <= 12 then 0 else 1 end as is_new from merged window w as (partition by chrom, strand order by pos)),
numbered as (select *, sum(is_new) over (partition by chrom, strand order by pos rows unbounded preceding) as cl from flagged),
stats as (select *, median(pos) over (partition by chrom, strand, cl) as med from numbered),
best as (select * from stats qualify row_number() over (partition by chrom, strand, cl order by abs(pos - med), pos, sequence) = 1),
names as (select chrom, strand, cl, string_agg(distinct n, ',' order by n) as source from (select chrom, strand, cl, unnest(string_split(source, ',')) as n from numbered) group by chrom, strand, cl)
select b.chrom, b.pos, b.strand, b.gene_name, n.source, md5(b.sequence) as digest from best b join names n using (chrom, strand, cl)""")
def positive_sites(spark, d):
    """Positives of both collections: annotated, merged by coordinates, clustered, each cluster's site nearest to its median with all sources. Their
    ids, which no SQL gives, are left out."""
    a, b = _annotated(spark, d)
    return pipelines.positives(a, b)["positives"].select(*KEYS, "gene_name", "source", F.md5("sequence").alias("digest"))


# -- the labelled dataset, its half and samples of the rest -------------------------------------------------------------

_BASES = "translate(concat(md5(concat(cast(l_orderkey as {0}), ':', cast(l_partkey % 3 as {0}))), md5(concat(cast(l_orderkey as {0}), '-', cast(l_partkey % 3 as {0})))), '0123456789abcdef', 'ACGTACGTACGTACGT')"
_ROW = (
    "md5(concat(cast(l_orderkey as {0}), '-', cast(l_linenumber as {0}), '-', cast(l_partkey as {0}), '-', cast(l_suppkey as {0}), '-', l_returnflag)) as id",
    "concat('chr', cast(1 + l_partkey % 22 as {0})) as chrom",
    "cast((l_orderkey * 37 + l_linenumber * 11) % 100000 as bigint) as pos",
    "case when l_suppkey % 2 = 0 then '+' else '-' end as strand",
    "concat('G', cast(l_suppkey as {0})) as gene_name",
    "case when l_linenumber = 2 then ' ' else l_returnflag end as source",
    f"case when l_returnflag = 'R' then lower({_BASES}) else {_BASES} end as sequence",
)
_DATASET = f"""with raw as (select {", ".join(_ROW).format("varchar")}, case when l_returnflag = 'R' then 1 else 0 end as label from lineitem),
shaped as (select id, chrom, pos, strand, gene_name, coalesce(nullif(trim(source), ''), 'unknown') as source, upper(sequence) as sequence, cast(label as int) as label from raw),
data as (select * from shaped qualify row_number() over (partition by chrom, pos, strand, label order by id, sequence, gene_name, source) = 1)"""
_HALF = f"""{_DATASET}, one as (select * from data qualify row_number() over (partition by sequence, label order by chrom, pos, strand, id) = 1),
kept as (select * from one where label = 1 or sequence not in (select sequence from one where label = 1)),
flagged as (select *, case when pos - lag(pos) over w <= 12 then 0 else 1 end as is_new from kept window w as (partition by chrom, strand, label order by pos)),
numbered as (select *, sum(is_new) over (partition by chrom, strand, label order by pos rows unbounded preceding) as cl from flagged),
stats as (select *, median(pos) over (partition by chrom, strand, label, cl) as med from numbered),
best as (select * exclude (is_new, cl, med) from stats qualify row_number() over (partition by chrom, strand, label, cl order by abs(pos - med), pos, id, sequence) = 1),
sizes as (select count(*) filter (label = 1) as p, count(*) filter (label = 0) as n from best),
each as (select least(p, n, greatest(2, (cast(round_even((p + n) * 0.5, 0) as bigint) // 2) * 2) // 2) as each_n from sizes),
ranked as (select *, row_number() over (partition by label order by md5(concat(chrom, ':', cast(pos as varchar), ':', strand, '|42'))) as rn from best),
half as (select id, chrom, pos, strand, gene_name, source, sequence, label from ranked, each where rn <= each_n)"""


def _dataset(spark, d) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    of = lambda test: t.where(test).selectExpr(*(x.format("string") for x in _ROW))
    return pipelines.dataset(of("l_returnflag = 'R'"), of("l_returnflag <> 'R'"))


@query(f"{_DATASET} select * from data")
def labelled_dataset(spark, d):
    """Positives and negatives as one dataset: sources filled, sequences in upper case, each site once for a label."""
    return _dataset(spark, d)


@query(f"{_HALF} select * from half")
def halved_dataset(spark, d):
    """Half of the dataset: duplicates and conflicting sequences out, clustered in each class, as many of each label."""
    return pipelines.halved(_dataset(spark, d))


@query(f"""{_HALF}, rest as (select *, md5(concat('ID::', id, '|42')) as draw from data where id not in (select id from half)),
chosen as (select * from rest qualify row_number() over (partition by label order by draw) <= 100)
select id, chrom, pos, strand, gene_name, source, sequence, label, row_number() over (order by draw) as rank from chosen""")
def sampled_remainder(spark, d):
    """100 rows of each class that the half lacks, in the order of a seeded shuffle."""
    full = _dataset(spark, d)
    return pipelines.test_samples(full, pipelines.halved(full))["sample"]


# -- inference by a model in a file -------------------------------------------------------------------------------------

_LABELLED_PARTS = f"parts as (select p_partkey, s, label from ({_PARTS}) join (select p_partkey, max(case when p_size > 25 then 1 else 0 end) as label from part group by p_partkey) using (p_partkey))"


def _linear(content: bytes):
    """predict() of a linear model over k-mers: the first logit is 0, the second the sum of the weights of a text's k-mers."""
    weights = {w["kmer"]: w["weight"] for w in json.loads(content)["weights"]}
    return lambda texts: pd.DataFrame({0: [0.0] * len(texts), 1: [sum(weights.get(k, 0.0) for k in x.split()) for x in texts]})


@query(f"""with {_LABELLED_PARTS}, k as (select p_partkey, label, unnest(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) as kmer from parts),
w as (select kmer, ln((1 + count(*) filter (label = 1)) / (1 + count(*) filter (label = 0))) as weight from k group by kmer)
select p_partkey, any_value(label) as label, round(1 / (1 + exp(-sum(weight))), 6) as prob from k join w using (kmer) group by p_partkey""")
def model_scores(spark, d):
    """Inference with a model from a file: weights of 3-mers (at most 125, whatever the table) are fitted by counts, written as JSON, and read back for
    scoring in batches of texts of alike length."""
    labels = _part(spark, d).groupBy("p_partkey").agg(F.max(F.expr("if(p_size > 25, 1, 0)")).alias("label"))
    samples = held(_parts(spark, d).join(labels, "p_partkey").select("p_partkey", "label", seq.kmer_text(F.col("s"), 3).alias("tokens")))
    counts = samples.select("label", F.explode(F.split("tokens", " ")).alias("kmer")).groupBy("kmer").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"))
    weights = counts.select("kmer", F.log((1 + F.col("p")) / (1 + F.col("n"))).alias("weight"))
    path = new_path(spark, "model")
    weights.agg(F.to_json(F.struct(F.collect_list(F.struct("kmer", "weight")).alias("weights")))).write.text(path)
    out = held(pipelines.scored_by_model(samples, path, _linear))
    remove(spark, path)
    return out.select("p_partkey", "label", F.round("prob", 6).alias("prob"))
