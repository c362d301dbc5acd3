"""The jobs as queries: each runs twice over the whole tables into a new folder and returns what is there then."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from helixmill.plans.adapters import with_
from helixmill.plans.stages import new_path
from jobs import new_sequences, site_dataset
from jobs.common import load_config

HERE = os.path.dirname(os.path.abspath(__file__))


def config(job) -> dict:
    return load_config(os.path.join(HERE, job.__name__.rsplit(".", 1)[-1] + ".json"), job.DEFAULTS)


def job1_site_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "job1")
    for _ in range(2):
        site_dataset.run(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/part.parquet", out, config(site_dataset))
    return site_dataset.read(spark, out)


def job2_new_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, source = new_path(spark, "job2"), f"{sf_dir}/documents.parque[t]"  # a pattern, as file streams take a folder or a pattern, and the table may be one file
    for _ in range(2):
        new_sequences.run(spark, source, f"{folder}/windows", f"{folder}/checkpoint", config(new_sequences))
    return new_sequences.read(spark, f"{folder}/windows")


_HEXAMERS = "AATAAA|ATTAAA|AGTAAA|TATAAA|CATAAA|GATAAA|AATACA|AATAGA|AATATA|AATGAA|ACTAAA|AAGAAA"
_HAS = f"regexp_matches({{0}}, '{_HEXAMERS}') or regexp_matches(reverse(translate({{0}}, 'ACGT', 'TGCA')), '{_HEXAMERS}')"
_SITES = f"""{with_('sites', 'genes')},
firsts as (select * from (select *, source <> 'A' as side, row_number() over (partition by chrom, pos, strand, source <> 'A' order by source, sequence) as rn from sites) where rn = 1),
merged as (select chrom, pos, strand, arg_min(sequence, (side, source, sequence)) as sequence, string_agg(distinct source, ',' order by source) as source from firsts group by chrom, pos, strand),
flagged as (select *, case when lag(pos) over w is null or pos - lag(pos) over w > 12 then 1 else 0 end as is_new from merged window w as (partition by chrom, strand order by pos)),
numbered as (select *, sum(is_new) over (partition by chrom, strand order by pos rows unbounded preceding) as cl from flagged),
stats as (select *, median(pos) over (partition by chrom, strand, cl) as med, min(pos) over (partition by chrom, strand, cl) as cluster_start, count(*) over (partition by chrom, strand, cl) as n_sites from numbered),
best as (select * from (select *, row_number() over (partition by chrom, strand, cl order by abs(pos - med), pos, source, sequence) as rn from stats) where rn = 1),
names as (select chrom, strand, cl, string_agg(distinct s, ',' order by s) as sources from (select chrom, strand, cl, unnest(string_split(source, ',')) as s from numbered) group by all),
last_gene as (select chrom, g_start, g_end, gene_id from (select *, row_number() over (partition by chrom, g_start order by g_end desc, gene_id desc) as rn from genes) where rn = 1),
near as (select s.*, case when s.pos <= g.g_end then g.gene_id end as near from best s asof left join last_gene g on s.chrom = g.chrom and s.pos >= g.g_start),
inside as (select s.chrom, s.pos, s.strand, arg_min(g.gene_id, g.ord) as inside from best s join genes g on s.chrom = g.chrom and s.pos between g.g_start and g.g_end group by all),
chroms as (select chrom, row_number() over (order by chrom desc) as r, count(*) over () as n from (select distinct chrom from sites))
select n.chrom, n.strand, n.cluster_start, n.n_sites, n.pos, n.sequence, names.sources as source, coalesce(n.near, i.inside, '') as gene_id, {_HAS.format('n.sequence')} as hexamer,
  case when c.r <= greatest(1, floor(c.n * 0.1)) then 'val' else 'train' end as split
from near n left join inside i using (chrom, pos, strand) join names on n.chrom = names.chrom and n.strand = names.strand and n.cl = names.cl join chroms c on n.chrom = c.chrom"""

_N = "(length(w) - length(replace(w, '{0}', '')))"
_WINDOWS = f"""with cleaned as (select doc_id, source, regexp_replace(translate(upper(regexp_replace(regexp_replace(text, '[^ -~\\n\\t\\r]', 'N', 'g'), '\\s+', '', 'g')), 'U', 'T'), '[^ACGTN]', 'N', 'g') as s from documents where doc_id is not null),
firsts as (select *, sha1(s) as key from (select *, row_number() over (partition by s order by doc_id, source) as rn from cleaned where s <> '') where rn = 1),
cut as (select *, unnest(range(0, greatest(length(s) - 203, 0) + 1, 100)) as o from firsts),
win as (select *, case when length(s) <= 203 then s else substr(s, o + 1, 203) end as w from cut)
select doc_id as id, source, key, cast(length(s) as int) as len_nt, cast(o // 100 as int) as win_index, w as window, 100.0::double * ({_N.format('G')} + {_N.format('C')}) / greatest(length(w), 1) as gc_pct, cast({_N.format('N')} as int) as n_count, {_HAS.format('w')} as hexamer,
  cast(0 as bigint) as batch, case when cast(concat('0x', substr(md5(concat(key, '|split')), 1, 7)) as bigint) % 100 < 10 then 'val' else 'train' end as split
from win"""

QUERIES = {f.__name__: f for f in (job1_site_dataset, job2_new_sequences)}
ORACLE = {"job1_site_dataset": _SITES, "job2_new_sequences": _WINDOWS}
