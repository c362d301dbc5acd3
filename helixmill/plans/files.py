"""Registered queries of the sources and sinks: each writes a file of the format from the test tables into the shared folder,
reads it back with the production reader, and removes it. Lines are written in order over several part files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from helixmill.functions import sequence as seq
from helixmill.operators import intervals, rows, sampling
from helixmill.plans import pipelines
from helixmill.plans.adapters import load, with_
from helixmill.plans.catalogue import _D, _GENOME, _PARTS, _TARGETS, KEYS, _distinct, _genome, _parts, _positives, _sites, query
from helixmill.plans.stages import held, new_path, remove
from helixmill.sources import genomic

_CHROM = "concat('chr', cast(1 + p_partkey % 22 as {0}))"


def _lines(spark: SparkSession, lines: DataFrame, name: str, read, together: int | None = None) -> DataFrame:
    """read(path) of the column value of lines, written in the order of the other columns, as a held table. Rows alike in the first
    `together` of these columns come into one file."""
    order = [c for c in lines.columns if c != "value"]
    path = new_path(spark, name)
    lines.repartitionByRange(3, *order[:together]).sortWithinPartitions(*order).select("value").write.text(path)
    out = held(read(path))
    remove(spark, path)
    return out


def _part(spark, d):
    return spark.read.parquet(f"{d}/part.parquet")


def _of_part(spark, d, value: str) -> DataFrame:
    return _part(spark, d).selectExpr("p_partkey", f"{value} as value")


# -- BED --------------------------------------------------------------------------------------------------------------


@query(f"select {_CHROM.format('varchar')} as chrom, p_partkey * 7 as start, p_partkey * 7 + p_size as \"end\", p_name as name, cast(p_size as varchar) as score, case when p_partkey % 2 = 0 then '+' else '-' end as strand from part where p_partkey % 11 <> 0")
def bed6_scan(spark, d):
    value = f"case when p_partkey % 11 = 0 then '# note' else concat_ws('\\t', {_CHROM.format('string')}, p_partkey * 7, p_partkey * 7 + p_size, p_name, p_size, if(p_partkey % 2 = 0, '+', '-'), 'more') end"
    return _lines(spark, _of_part(spark, d, value), "bed6", lambda p: genomic.bed6(spark, p))


@query(f"""with t as (select *, row_number() over (order by p_partkey) - 1 as line, {_CHROM.format('varchar')} as chrom from part)
select line, chrom, p_partkey * 7 as start, p_partkey * 7 + p_size as "end", case when p_partkey % 8 >= 5 then p_name else '' end as name, case when p_partkey % 8 >= 6 then cast(p_size as varchar) else '0' end as score, case when p_partkey % 8 = 7 then '-' else '+' end as strand from t where p_partkey % 8 >= 4""")
def bed_lines(spark, d):
    """Three to six fields; comments, track and blank lines and lines of two fields between them."""
    three = f"{_CHROM.format('string')}, p_partkey * 7, p_partkey * 7 + p_size"
    value = f"case p_partkey % 8 when 0 then '# note' when 1 then 'track name=x' when 2 then '' when 3 then 'chr1\\t5' when 4 then concat_ws('\\t', {three}) when 5 then concat_ws('\\t', {three}, p_name) when 6 then concat_ws('\\t', {three}, p_name, p_size) else concat_ws('\\t', {three}, p_name, p_size, '-') end"
    return _lines(spark, _of_part(spark, d, value), "bed", lambda p: genomic.bed(spark, p))


_RAW = "case p_partkey % 7 when 0 then '1' when 1 then 'chr2' when 2 then 'MT' when 3 then 'chrUn_KI270742v1' when 4 then 'GL000192.1' when 5 then 'Y' else '77' end"
_MAPPED = "case p_partkey % 7 when 0 then 'chr1' when 1 then 'chr2' when 2 then 'chrM' when 5 then 'chrY' end"


def _raw_bed(spark, d, name: str) -> DataFrame:
    return _of_part(spark, d, f"concat_ws('\\t', {_RAW}, p_partkey, p_partkey + 5, {name}, '0', case p_partkey % 3 when 0 then '+' when 1 then '-' else '.' end)")


@query(f"select {_MAPPED} as chrom, case p_partkey % 3 when 1 then p_partkey else p_partkey + 4 end as pos, case p_partkey % 3 when 1 then '-' else '+' end as strand, p_name as name from part where p_partkey % 7 in (0, 1, 2, 5)")
def bed_points(spark, d):
    """In the style of the chromosome sizes, primary chromosomes only; no strand counts as plus."""
    sizes = spark.createDataFrame([("chr1", 9)], "chrom string, length long")
    return _lines(spark, _raw_bed(spark, d, "p_name"), "points", lambda p: genomic.bed_points(spark, p, genomic.has_chr_prefix(sizes), primary_only=True, skip_alt=True))


@query("with t as (select *, row_number() over (order by p_partkey) - 1 as k from part where p_partkey % 7 not in (3, 4)) select case p_partkey % 7 when 0 then '1' when 1 then '2' when 2 then 'M' when 5 then 'Y' else '77' end as chrom, p_partkey as start, p_partkey + 5 as \"end\", case when p_partkey % 5 = 0 then p_name else concat('region_', cast(k as varchar)) end as region from t")
def bed_regions(spark, d):
    """A mask without chr prefixes; what has no name is numbered by its place among the kept lines."""
    return _lines(spark, _raw_bed(spark, d, "if(p_partkey % 5 = 0, p_name, '')"), "regions", lambda p: genomic.bed_regions(spark, p, prefixed=False, skip_alt=True))


@query(f"select {_RAW} as chrom, 'PolyASite2' as source, 'polyA_site' as feature, p_partkey + 1 as start, p_partkey + 5 as \"end\", '0' as score, case p_partkey % 3 when 0 then '+' when 1 then '-' else '.' end as strand, concat('name \"', p_name, '\"; dataset \"human_polyAsite\";') as attributes, '' as gene_id, '' as gene_name, '' as transcript_id, '' as transcript_biotype from part")
def bed_features(spark, d):
    return _lines(spark, _raw_bed(spark, d, "p_name"), "features", lambda p: genomic.bed_as_features(spark, p))


# -- GTF --------------------------------------------------------------------------------------------------------------

_FEATURE = "case p_partkey % 4 when 0 then 'gene' when 1 then 'transcript' when 2 then 'three_prime_UTR' else 'gene' end"
_GTF_CHROM = "case when p_partkey % 10 = 9 then 'chrUn_1' else {0} end"


def _gtf_lines(spark, d) -> DataFrame:
    chrom = _GTF_CHROM.format(_CHROM.format("string"))
    kind = "if(p_partkey % 3 = 0, concat('gene_type \"', p_type, '\";'), concat('gene_biotype  \"', p_type, '\"; transcript_biotype \"b', p_size, '\";'))"
    return _of_part(spark, d, f"if(p_partkey % 13 = 0, '#!note', concat_ws('\\t', {chrom}, 'made', {_FEATURE}, p_partkey * 5 + 1, p_partkey * 5 + p_size, '.', if(p_partkey % 2 = 0, '+', '-'), '.', concat('gene_id \"G', p_partkey, '\"; gene_name \"', p_brand, '\"; transcript_id \"T', p_size, '\"; ', {kind})))")


@query(f"""with g as (select *, row_number() over (order by p_partkey) - 1 as ord, {_CHROM.format('varchar')} as chrom from part where p_partkey % 4 in (0, 3) and p_partkey % 13 <> 0)
select chrom, p_partkey * 5 + 1 as g_start, p_partkey * 5 + p_size as g_end, case when p_partkey % 2 = 0 then '+' else '-' end as strand, concat('G', cast(p_partkey as varchar)) as gene_id, p_brand as gene_name, p_type as gene_type, ord from g where p_partkey % 10 <> 9""")
def gtf_genes(spark, d):
    return _lines(spark, _gtf_lines(spark, d), "genes", lambda p: genomic.genes(spark, p))


@query(f"select {_GTF_CHROM.format(_CHROM.format('varchar'))} as chrom, {_FEATURE} as feature, p_partkey * 5 + 1 as start, p_partkey * 5 + p_size as \"end\", concat('G', cast(p_partkey as varchar)) as gene_id, p_brand as gene_name, concat('T', cast(p_size as varchar)) as transcript_id, case when p_partkey % 3 = 0 then '' else concat('b', cast(p_size as varchar)) end as transcript_biotype from part where p_partkey % 13 <> 0")
def gtf_features(spark, d):
    keep = ["chrom", "feature", "start", "end", "gene_id", "gene_name", "transcript_id", "transcript_biotype"]
    return _lines(spark, _gtf_lines(spark, d), "gtf", lambda p: genomic.gtf(spark, p).select(*keep))


@query(f"select {_GTF_CHROM.format(_CHROM.format('varchar'))} as chrom, case when p_partkey % 2 = 0 then '+' else '-' end as strand, p_partkey * 5 as u_start, p_partkey * 5 + p_size as u_end, p_brand as gene_name from part where p_partkey % 4 = 2 and p_partkey % 13 <> 0")
def utr_scan(spark, d):
    return _lines(spark, _gtf_lines(spark, d), "utrs", lambda p: genomic.utrs(spark, p))


# -- PAS tables, chromosome sizes, FASTA, chains -----------------------------------------------------------------------


def _tabbed(spark, df: DataFrame, name: str, read, sep: str = "\t") -> DataFrame:
    path = new_path(spark, name)
    df.write.option("header", True).option("sep", sep).csv(path)
    out = held(read(path))
    remove(spark, path)
    return out


@query("select concat('chr', cast(1 + p_partkey % 22 as varchar)) as chrom, p_partkey * 3 as pos, case when p_partkey % 2 = 0 then '+' else '-' end as strand from part where p_partkey % 9 <> 0 union all select concat('chr', cast(p_partkey as varchar)), case when p_partkey % 2 = 0 then p_partkey + p_size else p_partkey end, case when p_partkey % 2 = 0 then '+' else '-' end from part")
def pas_scan_file(spark, d):
    """Two tables, one with a position, one with start and end, under other names; without a position rows go."""
    p = _part(spark, d)
    a = p.selectExpr("cast(1 + p_partkey % 22 as string) as Chr", "if(p_partkey % 9 = 0, 'none', cast(p_partkey * 3 as string)) as Site", "if(p_partkey % 2 = 0, 'plus', '-1') as Strand", "p_name")
    b = p.selectExpr("concat('chr', p_partkey) as Chromosome", "p_partkey as Start", "p_partkey + p_size as End", "if(p_partkey % 2 = 0, '+', 'minus') as Str")
    read = lambda path: genomic.pas_table(spark, path)
    return _tabbed(spark, a, "pas", read).unionByName(_tabbed(spark, b, "pas", read))


@query("select concat('chr', cast(p_partkey as varchar)) as chrom, p_partkey * 1000 + p_size as length from part where p_partkey % 6 > 1")
def chrom_sizes_scan(spark, d):
    value = "case p_partkey % 6 when 0 then '# note' when 1 then '' when 2 then concat('chr', p_partkey, '\\t', p_partkey * 1000 + p_size) else concat(' chr', p_partkey, '  ', p_partkey * 1000 + p_size, ' more') end"
    return _lines(spark, _of_part(spark, d, value), "sizes", lambda p: genomic.chrom_sizes(spark, p))


#: Contigs of part's rows: 64 bases a row, half of them A, in the order of keys.
_BASES = "translate(concat(md5(concat(cast(p_partkey as {0}), 'x')), md5(concat(cast(p_partkey as {0}), 'y'))), '0123456789abcdef', 'AACGTAATAGTAACTA')"
_PART_LETTERS = f"letters as (select {_CHROM.format('varchar')} as chrom, string_agg({_BASES.format('varchar')}, '' order by p_partkey) as s from part group by 1)"


def _fasta_of_part(spark, d) -> DataFrame:
    """The lines of its FASTA file: a header before each contig's first row."""
    p = _part(spark, d).selectExpr("p_partkey % 22 as contig", "p_partkey as line", f"{_BASES.format('string')} as value")
    heads = p.select("contig").distinct().selectExpr("contig", "cast(-1 as bigint) as line", "concat('>chr', 1 + contig, ' of part') as value")
    return heads.unionByName(p)


@query(f"with {_PART_LETTERS} select chrom, c as chunk, md5(substr(s, cast(c * 1000 + 1 as int), 1000)) as digest, length(substr(s, cast(c * 1000 + 1 as int), 1000)) as n from (select *, unnest(range(0, (length(s) + 999) // 1000)) as c from letters)")
def fasta_scan(spark, d):
    """Contigs of part's rows in lines of 64 bases, over several files, as chunks of 1,000 bases."""
    chunks = _lines(spark, _fasta_of_part(spark, d), "fasta", lambda p: genomic.fasta_chunks(spark, p, 1000))
    return chunks.select("chrom", "chunk", F.md5("sequence").alias("digest"), F.length("sequence").cast("long").alias("n"))


#: Windows of 20 bases before and 30 after places of part's contigs; some run over a contig's end, some lie beyond it.
_PLACES = ("{0} as chrom", "cast(p_partkey * 3 as bigint) as pos", "case when p_partkey % 2 = 0 then '+' else '-' end as strand")
_WINDOWS_SQL = f"with {_PART_LETTERS}, p as (select p_partkey, {', '.join(_PLACES).format(_CHROM.format('varchar'))} from part), w as (select p.*, coalesce(substr(s, cast(greatest(pos - 20, 0) + 1 as int), cast(pos + 30 - greatest(pos - 20, 0) as int)), '') as dna from p left join letters using (chrom)) select p_partkey, chrom, pos, strand, case strand when '-' then reverse(translate(dna, 'ACGT', 'TGCA')) else dna end as sequence from w"


@query(_WINDOWS_SQL)
def fasta_windows(spark, d):
    """By an index into the FASTA files of part's contigs; only the windows' bytes are read."""
    points = _part(spark, d).selectExpr("p_partkey", *(x.format(_CHROM.format("string")) for x in _PLACES))
    return _lines(spark, _fasta_of_part(spark, d), "fasta", lambda p: genomic.pipeline_windows(points, held(genomic.fasta_index(spark, p)), 20, right=30), 1)


@query(f"with {_PART_LETTERS} select chrom, cast(length(s) as bigint) as bases, cast(64 as bigint) as line_bases, cast(65 as bigint) as line_width from letters")
def fasta_index(spark, d):
    """The index of the FASTA files of part's contigs, but for where each lies, which depends on how contigs are dealt to files."""
    return _lines(spark, _fasta_of_part(spark, d), "fasta", lambda p: genomic.fasta_index(spark, p), 1).select("chrom", "bases", "line_bases", "line_width")


@query("""with t as (select *, p_partkey * 100 as a, case when p_partkey % 3 = 0 then '-' else '+' end as s from part)
select concat('chr', cast(p_partkey as varchar)) as src_chrom, a as src_start, a + 10 as src_end, 'chr1' as dst_chrom, case s when '+' then a + 7 else 1000000 - 1 - (a + 7) end as dst_start, s as dst_strand, cast(p_size as bigint) as score from t
union all select concat('chr', cast(p_partkey as varchar)), a + 15, a + 15 + p_size, 'chr1', case s when '+' then a + 7 + 13 else 1000000 - 1 - (a + 7 + 13) end, s, p_size from t""")
def chain_scan(spark, d):
    """Chains of two blocks each, over several files."""
    p = _part(spark, d).selectExpr("p_partkey", "p_size", "p_partkey * 100 as a", "if(p_partkey % 3 = 0, '-', '+') as s")
    head = "concat_ws(' ', 'chain', p_size, concat('chr', p_partkey), 5000000, '+', a, a + 15 + p_size, 'chr1', 1000000, s, a + 7, a + 20 + p_size, p_partkey)"
    lines = p.select("p_partkey", F.posexplode(F.expr(f"array({head}, '10\\t5\\t3', cast(p_size as string), '')")).alias("i", "value"))
    return _lines(spark, lines, "chain", lambda path: genomic.chain_blocks(spark, path))


# -- CSV, JSON, paths ---------------------------------------------------------------------------------------------------


@query("select cast(null as varchar) as id, p_name as chrom, case when p_partkey % 5 <> 0 then p_partkey end as pos, '+' as strand, cast(null as varchar) as gene_name, p_brand as source, cast(null as varchar) as sequence, cast(p_size as int) as label from part")
def csv_dataset(spark, d):
    """A CSV that lacks columns, in another order, with values that are no numbers, read in the shape of the dataset."""
    t = _part(spark, d).selectExpr("p_size as label", "'+' as strand", "p_name as chrom", "if(p_partkey % 5 = 0, 'n/a', cast(p_partkey as string)) as pos", "p_brand as source", "p_type as other")
    return _tabbed(spark, t, "dataset", lambda p: genomic.headed_csv(spark, p, pipelines.DATASET), ",")


@query("select cast(p_partkey as int) as a, p_name as b, p_retailprice as c, 'a,b,c' as header from part")
def csv_ordered(spark, d):
    """Written with a fixed order of fields, read back with inferred types."""
    path = new_path(spark, "ordered")
    genomic.write_csv(_part(spark, d).selectExpr("p_retailprice as c", "p_name as b", "p_partkey as a", "p_type as x"), path, ["a", "b", "c"])
    t = genomic.headed_csv(spark, path)
    out = held(t.select(F.col("a").cast("int").alias("a"), "b", F.col("c").cast("double").alias("c"), F.lit(",".join(t.columns)).alias("header")))
    remove(spark, path)
    return out


@query("select p_name as sequence, cast(p_size % 2 as int) as label, p_type as chrom from part where p_partkey % 4 <> 0 and p_partkey % 3 <> 0")
def training_scan(spark, d):
    """sequence, label and chrom of a wider CSV, rows with a null among them left out."""
    t = _part(spark, d).selectExpr("p_partkey as id", "if(p_partkey % 4 = 0, null, p_name) as sequence", "p_type as chrom", "if(p_partkey % 3 = 0, null, p_size % 2) as label", "p_brand as notes")
    return _tabbed(spark, t, "training", lambda p: genomic.training_rows(spark, p), ",")


@query("select count(*) as samples, round(avg(p_retailprice), 6) as loss from part")
def metrics_json(spark, d):
    path = new_path(spark, "metrics")
    genomic.write_metrics(_part(spark, d).agg(F.count("*").alias("samples"), F.round(F.avg("p_retailprice"), 6).alias("loss")), path)
    out = held(spark.read.schema("samples long, loss double").json(path))
    remove(spark, path)
    return out


@query("select 'v42' as version, count(*) as n from part")
def version_fallback(spark, d):
    """Of the versions v44 to v40 the first one that exists: v42 is written, and v40."""
    path = new_path(spark, "versions")
    for version in ("v42", "v40"):
        _part(spark, d).select("p_partkey").write.parquet(f"{path}/{version}")
    found = genomic.first_existing(spark, [f"{path}/v{k}" for k in (44, 43, 42, 41, 40)])
    out = held(spark.read.parquet(found).agg(F.lit(found.rsplit("/", 1)[-1]).alias("version"), F.count("*").alias("n")))
    remove(spark, path)
    return out


@query(f"select distinct {_RAW} as raw, case p_partkey % 7 when 0 then 'chr1' when 1 then 'chr2' when 2 then 'chrM' when 3 then 'chrUn_KI270742v1' when 4 then 'chrGL000192.1' when 5 then 'chrY' else 'chr77' end as chrom from part")
def chrom_mapping(spark, d):
    """The chromosome names of a BED file, peeked at, in the style of the sizes."""
    sizes = spark.createDataFrame([("chr1", 9), ("2", 9)], "chrom string, length long")
    return _lines(spark, _raw_bed(spark, d, "p_name"), "peek", lambda p: genomic.chrom_mapper(sizes, genomic.peeked(genomic.bed(spark, p))))


# -- reports, features, negatives ---------------------------------------------------------------------------------------


@query(f"""{with_('sites')}, n as (select count(*) over (partition by chrom, strand order by pos range between 12 preceding and 12 following) - count(*) over (partition by chrom, strand, pos) as k from sites),
r as (select (select count(*) from sites) as n_rows, (select count(*) - count(distinct (chrom, pos, strand)) from sites) as n_duplicates, (select count(distinct (chrom, pos, strand)) from sites) as n_distinct,
(select min(length(sequence)) from sites) as min_len, (select max(length(sequence)) from sites) as max_len, (select floor(median(length(sequence))) from sites) as median_len, (select count(*) filter (regexp_matches(sequence, '[^ACGT]')) from sites) as n_non_acgt, (select count(*) filter (k > 0) from n) as rows_near, (select sum(k) from n) as pairs_near)
select metric, cast(value as double) as value from (unpivot (select n_rows::double as n_rows, n_duplicates::double as n_duplicates, n_distinct::double as n_distinct, min_len::double as min_len, max_len::double as max_len, median_len::double as median_len, n_non_acgt::double as n_non_acgt, rows_near::double as rows_near, pairs_near::double as pairs_near from r) on columns(*) into name metric value value)""")
def quality_report(spark, d):
    return pipelines.quality_report(_sites(spark, d))


@query(f"""{with_('sites')}, a as (select distinct chrom, pos, strand from sites where source = 'A'), b as (select distinct chrom, pos, strand from sites where source = 'R'),
pairs as (select a.chrom, a.strand, a.pos as pos_a, b.pos as pos_b from a join b on a.chrom = b.chrom and a.strand = b.strand and b.pos between a.pos - 12 and a.pos + 12),
r as (select (select count(*) from a)::double as n_a, (select count(*) from b)::double as n_b, (select count(*) from a join b using (chrom, pos, strand))::double as n_both, (select count(*) from pairs)::double as near_pairs, (select count(distinct (chrom, strand, pos_a)) from pairs)::double as near_a, (select count(distinct (chrom, strand, pos_b)) from pairs)::double as near_b)
select metric, value from (unpivot (select *, n_both / n_a as share_a, n_both / n_b as share_b from r) on columns(*) into name metric value value)""")
def overlap_report(spark, d):
    a, b = (_sites(spark, d).where(F.col("source") == x) for x in "AR")
    return pipelines.overlap_report(a, b)


_RNA = "translate(case when f.strand = '+' then w else reverse(translate(w, 'ACGT', 'TGCA')) end, 'T', 'U')"
_COUNT = "(length(r) - length(replace(r, '{0}', '')))"


@query(f"""with {_GENOME}, f as (select p_partkey as k, case when p_partkey % 9 = 8 then 'scaffold' else cast(1 + p_partkey % 22 as varchar) end as c, 60 + (p_partkey * 31) % 12600 as s, 60 + (p_partkey * 31) % 12600 + p_size as e, case p_partkey % 3 when 0 then '+' when 1 then '-' else '.' end as strand from part),
x as (select f.*, case when c = 'scaffold' then null else concat('chr', c) end as chrom, case when strand = '+' then e else s end as cut from f),
y as (select f.*, {_RNA} as r from (select x.*, coalesce(substr(letters.s, cast(cut - 50 as int), 100), '') as w from x left join letters using (chrom)) f),
z as (select *, greatest(length(r), 1) as n, substr(r, 11, 30) as p from y),
m as (select *, cast(len(list_filter(range(1, greatest(length(p) - 4, 1)), lambda i: substr(p, i, 6) in ('AAUAAA', 'AUUAAA', 'AGUAAA', 'AAGAAA', 'AACAAA', 'AAUAUA', 'AAUUAA', 'AAUAAG', 'UAUAAA', 'GAUAAA', 'CAUAAA', 'ACUAAA', 'AAUGAA'))) as int) as v from z)
select chrom as Chromosome, s as Start_1based, e as End_1based, strand as Strand, 'x' as Score_or_ReadCount, concat('G', cast(k as varchar)) as gene_id, '' as gene_name, '' as transcript_id, 'gene' as Feature_type, '' as transcript_biotype,
case when contains(p, 'AAUAAA') then 1 else 0 end as presence_AAUAAA, v as pas_variant_count, case when v > 0 then 1 else 0 end as presence_any_PAS_variant, {', '.join(f"cast({_COUNT.format(b)} as int) as {b}" for b in 'AUGC')}, {', '.join(f"100.0::double * {_COUNT.format(b)} / n as {b}_pct" for b in 'AUGC')}, 100.0::double * ({_COUNT.format('G')} + {_COUNT.format('C')}) / n as GC_pct, cast({_COUNT.format('N')} as int) as N_count from m where e >= s""")
def feature_table(spark, d):
    """The 23-column feature table of made-up features on the made-up genome; scaffolds are no contigs of it."""
    place = "60 + (p_partkey * 31) % 12600"
    t = _part(spark, d).selectExpr("if(p_partkey % 9 = 8, 'scaffold', cast(1 + p_partkey % 22 as string)) as chrom", f"{place} as start", f"{place} + p_size as end", "case p_partkey % 3 when 0 then '+' when 1 then '-' else '.' end as strand", "'x' as score", "'gene' as feature", "concat('G', p_partkey) as gene_id", "'' as gene_name", "'' as transcript_id", "'' as transcript_biotype")
    chunks = _genome(spark, 1024)
    return pipelines.site_features(t, chunks, chunks.select(F.col("chrom").alias("contig")).distinct(), size=1024)


@query("select concat('G', cast(p_partkey as varchar)) as gene_id, p_partkey * 3 as start_1based, p_partkey * 3 + p_size - 25 as end_1based from part where p_size >= 25 and p_partkey % 7 <> 0 and p_partkey % 11 <> 0")
def feature_rows(spark, d):
    """Of features of which many end before they start, lack a contig or a strand, those that the feature table takes."""
    t = _part(spark, d).selectExpr("if(p_partkey % 7 = 0, null, 'chr1') as chrom", "p_partkey * 3 as start", "p_partkey * 3 + p_size - 25 as end", "if(p_partkey % 11 = 0, null, '+') as strand", "'x' as score", "'gene' as feature", "concat('G', p_partkey) as gene_id", "'' as gene_name", "'' as transcript_id", "'' as transcript_biotype")
    chunks = _genome(spark, 1024)
    out = pipelines.site_features(t, chunks, chunks.select(F.col("chrom").alias("contig")).distinct(), size=1024)
    return out.select("gene_id", F.col("Start_1based").alias("start_1based"), F.col("End_1based").alias("end_1based"))


_PLACE = "cast(concat('0x', substr(md5(concat({0}, '|place')), 1, 13)) as bigint)"


@query(f"""{_D}, pos as (select chrom, pos, strand, source from distinct_sites where source = 'R'), spans as (select distinct chrom, greatest(pos - 200, 0) as s, pos + 201 as e from pos),
f as (select *, case when s > max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as is_new from spans),
g as (select *, sum(is_new) over (partition by chrom order by s, e rows unbounded preceding) as k from f), merged as (select chrom, min(s) as s, max(e) as e from g group by chrom, k),
sizes as (select 'chr' || cast(k as varchar) as chrom, 300000000 + k as length from range(1, 23) t(k) where k <> 7),
edges as (select chrom, s, e from merged union all select chrom, length, length from sizes),
runs as (select * from (select chrom, coalesce(max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding), 0) as a, s as b from edges) where a < b),
summed as (select *, sum(b - a) over (partition by chrom order by a rows unbounded preceding) - (b - a) as before, sum(b - a) over (partition by chrom) as free from runs where chrom <> 'chr7'),
todo as (select chrom, pos, strand, concat(chrom, ':', cast(pos as varchar), ':', strand, ':', cast(n as varchar), ':42') as k from pos, (select unnest(range(1, 3)) as n)),
drawn as (select t.*, {_PLACE.format('k')} % cast(free as bigint) as r from todo t join (select distinct chrom, free from summed) using (chrom)),
neg as (select d.chrom, d.strand, a + r - before as pos from drawn d asof join summed s on d.chrom = s.chrom and d.r >= s.before)
select chrom, cast(pos as bigint) as pos, strand, 1 as label, source as source_id from pos union all select chrom, cast(pos as bigint), strand, 0, '' from neg""")
def generated_neg(spark, d):
    """Positives from a Parquet table and two negatives for each, anywhere on chromosomes of over 2^28 bases; chr7 has no size."""
    path = new_path(spark, "points")
    _distinct(spark, d).where("source = 'R'").select(*KEYS, F.col("source").alias("name")).write.parquet(path)
    sizes = spark.range(1, 23).where("id <> 7").select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chrom"), (F.col("id") + 300_000_000).alias("length"))
    out = held(pipelines.generated(spark.read.parquet(path), sizes, k=2).select(*KEYS, "label", "source_id"))
    remove(spark, path)
    return out


_SCREENED = f"""with {_PART_LETTERS}, sizes as (select chrom, length(s) as length from letters where chrom <> 'chr7'),
points as (select concat('chr', cast(1 + p_partkey % 22 as varchar)) as chrom, (p_partkey * 13) % 4000 as pos, case p_partkey % 3 when 0 then '+' when 1 then '-' else '.' end as strand, p_name as name from part where p_size <= 2),
mask as (select concat('chr', cast(1 + p_partkey % 22 as varchar)) as chrom, (p_partkey * 29) % 5000 as a, (p_partkey * 29) % 5000 + (p_size - 3) * 100 as b, concat('r', cast(p_partkey as varchar)) as region from part where p_size between 3 and 6 and p_partkey % 22 % 2 = 0),
near as (select distinct chrom, unnest(range(pos - 50, pos + 51)) as p from points),
bases as (select chrom, s, side, unnest(range(0, length(s))) as p from letters, (select unnest([false, true]) as side) where chrom <> 'chr7'),
above as (select chrom, side, p, substr(s, cast(greatest(p - 40, 0) + 1 as int), cast(least(p, 40) as int)) as w from bases b where not exists (select 1 from near n where n.chrom = b.chrom and n.p = b.p)),
free as (select chrom, side, p, row_number() over (partition by chrom, side order by p) - 1 as r from above where not regexp_matches(case when side then reverse(translate(w, 'ACGT', 'TGCA')) else w end, 'AATAAA|ATTAAA|AGTAAA')),
totals as (select chrom, side, count(*) as free from free group by all),
regions as (select m.chrom, f.side, a, b, region, min(f.r) as first, count(*) as n, greatest(1, count(*) * 1048576 // (b - a)) as weight from mask m join free f on m.chrom = f.chrom and f.p >= a and f.p < b where b - a > 1 group by m.chrom, f.side, a, b, region),
weighted as (select *, sum(weight) over (partition by chrom, side order by a, b, region rows unbounded preceding) - weight as before, sum(weight) over (partition by chrom, side) as total from regions),
todo as (select chrom, pos, strand, strand = '-' as side, concat(chrom, ':', cast(pos as varchar), ':', strand, ':', cast(n as varchar), ':42') as k from (select chrom, pos, strand, unnest(range(1, 3 * c + 1)) as n from (select chrom, pos, strand, count(*) as c from points group by chrom, pos, strand))),
masked as (select t.*, w.region, first + {_PLACE.format('k')} % n as r from (select t.*, {_PLACE.format('k').replace('|place', '|region')} % cast(total as bigint) as v from todo t join (select distinct chrom, side, total from weighted) using (chrom, side)) t asof join weighted w on t.chrom = w.chrom and t.side = w.side and t.v >= w.before),
drawn as (select chrom, side, strand, region, r from masked union all select t.chrom, t.side, t.strand, '', {_PLACE.format('k')} % free from todo t join totals using (chrom, side) where chrom not in (select chrom from mask)),
rows as (select d.chrom, f.p as pos, d.strand, 0 as label, '' as source_id, d.region as region_id, 'neg' as notes from drawn d join free f using (chrom, side, r) union all select chrom, pos, strand, 1, name, '', '' from points),
cut as (select rows.*, coalesce(substr(s, cast(greatest(pos - 200, 0) + 1 as int), cast(greatest(least(pos + 100, length(s)) - greatest(pos - 200, 0), 0) as int)), '') as w from rows left join letters using (chrom))
select chrom, cast(pos as bigint) as pos, strand, label, source_id, region_id, notes, md5(case when strand = '-' then reverse(translate(w, 'ACGT', 'TGCA')) else w end) as digest from cut"""


@query(_SCREENED)
def generated_screened(spark, d):
    """Three negatives for each positive, with a mask on half of the chromosomes, some of its regions empty or one base wide, and without
    motifs before them; the genome comes from a FASTA file of part's bases. The SQL goes through every base."""
    p = _part(spark, d)
    chrom = _CHROM.format("string")
    points = p.where("p_size <= 2").selectExpr(f"{chrom} as chrom", "(p_partkey * 13) % 4000 as pos", "case p_partkey % 3 when 0 then '+' when 1 then '-' else '.' end as strand", "p_name as name")
    mask = p.where("p_size between 3 and 6 and p_partkey % 22 % 2 = 0").selectExpr(f"{chrom} as chrom", "(p_partkey * 29) % 5000 as start", "(p_partkey * 29) % 5000 + (p_size - 3) * 100 as end", "concat('r', p_partkey) as region")
    chunks = _lines(spark, _fasta_of_part(spark, d), "fasta", lambda path: genomic.fasta_chunks(spark, path, 1000))
    sizes = chunks.where("chrom <> 'chr7'").groupBy("chrom").agg(F.sum(F.length("sequence")).cast("long").alias("length"))
    out = pipelines.generated(points, sizes, chunks, mask, k=3, distance=50, motif_aware=True, size=1000)
    return out.select(*KEYS, "label", "source_id", "region_id", "notes", F.md5("sequence").alias("digest"))


_WHOLE = "cast(concat('0x', substr(md5(concat({0}, '|{1}')), 1, {2})) as bigint)"
_MOTIFS = "AATAAA|ATTAAA|AGTAAA|TATAAA|CATAAA|GATAAA|AATACA|AATAGA|AATATA|AATGAA|ACTAAA|AAGAAA"


def _drawn_sql(name: str, tries: int, bound: int, target: str, taken: str, motif: bool) -> str:
    """One bucket: all the draws that it may make, the first attempt of each that passes, each site once, the first `target`."""
    k, cut = "concat(cast(i as varchar), ':', cast(attempt as varchar), ':42')", "greatest(greatest(new - 50, u_start), 0)"
    near = f"substr(s, cast({cut} + 1 as int), cast(greatest(least(new + 50, u_end) - {cut}, 0) as int))"
    heard = f" where regexp_matches(concat({near}, '-', reverse(translate({near}, 'ACGT', 'TGCA'))), '{_MOTIFS}')" if motif else ""
    return f"""{name}_drawn as (select i, attempt, (select count(*) from usable) as n_u, {k} as k from (select unnest(range(0, {bound} * ({target}))) as i from n), (select unnest(range(0, {tries})) as attempt)),
{name}_placed as (select i, attempt, chrom, strand, gene_name, u_start, u_end, u_start + 60 + {_WHOLE.format('k', name + '-place', 7)} % 134217728 % (u_end - u_start - 119) as new from {name}_drawn join usable on u_no = {_WHOLE.format('k', name + '-utr', 13)} % n_u),
{name}_clear as (select p.* from {name}_placed p anti join blocked b on p.chrom = b.chrom and p.new = b.pos),
{name}_fine as (select c.* from {name}_clear c left join letters using (chrom){heard}),
{name}_first as (select i, arg_min(struct_pack(chrom := chrom, pos := new, strand := strand, gene_name := gene_name), attempt) as v from {name}_fine group by i),
{name}_free as (select v.chrom as chrom, v.pos as pos, v.strand as strand, min(i) as i, arg_min(v.gene_name, i) as gene_name from {name}_first anti join ({taken}) t on v.chrom = t.chrom and v.pos = t.pos and v.strand = t.strand group by all),
{name} as (select chrom, pos, strand, gene_name from {name}_free order by i limit (select {target} from n))"""


_NEGATIVES = f"""with {_PART_LETTERS}, size as (select 64 * (count(*) // 22) as l from part),
positives as (select {_CHROM.format('varchar')} as chrom, (p_partkey * 97) % l + p_size * 30 as pos, case when p_partkey % 2 = 0 then '+' else '-' end as strand from part, size where p_size between 8 and 20),
usable as (select *, row_number() over (order by chrom, u_start, u_end, strand, gene_name) - 1 as u_no from (select {_CHROM.format('varchar')} as chrom, case when p_partkey % 2 = 0 then '+' else '-' end as strand, (p_partkey * 97) % l as u_start, (p_partkey * 97) % l + p_size * 60 as u_end, concat('G', cast(p_partkey as varchar)) as gene_name from part, size) where u_end - u_start > 64 + 120),
n as (select count(*) as n from positives), sites as (select distinct chrom, pos, strand from positives), blocked as (select distinct chrom, unnest(range(pos - 50, pos + 51)) as pos from sites),
own as (select s.chrom, s.pos, s.strand, arg_min(struct_pack(s := u_start, e := u_end, g := gene_name), u_no) as u from sites s join usable u on s.chrom = u.chrom and s.strand = u.strand and s.pos between u_start and u_end group by all),
tries as (select own.*, attempt, concat(chrom, ':', cast(pos as varchar), ':', strand, ':', cast(attempt as varchar), ':42') as k from own, (select unnest(range(0, 6)) as attempt)),
moved as (select *, pos + (case when {_WHOLE.format('k', 'side', 7)} % 2 = 0 then 1 else -1 end) * (100 + {_WHOLE.format('k', 'offset', 7)} % 301) as new from tries),
kept as (select m.* from moved m anti join blocked b on m.chrom = b.chrom and m.new = b.pos where m.new >= m.u.s + 60 and m.new <= m.u.e - 60),
firsts as (select chrom, pos, strand, arg_min(struct_pack(new := new, g := u.g), attempt) as v from kept group by chrom, pos, strand),
ranked as (select *, row_number() over (order by md5(concat(chrom, ':', cast(pos as varchar), ':', strand, ':42|42'))) as rank from firsts),
shifted as (select chrom, v.new as pos, strand, min(v.g) as gene_name from ranked, n where rank <= n group by all),
{_drawn_sql('random', 4, 20, _TARGETS['random'], 'select * from shifted', False)},
{_drawn_sql('motif', 8, 40, _TARGETS['motif'], 'select * from shifted union all select * from random', True)},
every as (select *, 0 as bucket from shifted union all select *, 1 from random union all select *, 2 from motif)
select chrom, cast(pos as bigint) as pos, strand, gene_name, cast(bucket as int) as bucket from every"""


@query(_NEGATIVES)
def negatives_in_buckets(spark, d):
    """Twice as many negatives as positives in three buckets, on the contigs of part's bases. The SQL makes every draw that a bucket may make."""
    p = _part(spark, d)
    chrom, side, size = _CHROM.format("string"), "case when p_partkey % 2 = 0 then '+' else '-' end", 64 * (p.count() // 22)
    pos = p.where("p_size between 8 and 20").selectExpr(f"{chrom} as chrom", f"(p_partkey * 97) % {size} + p_size * 30 as pos", f"{side} as strand")
    utrs = p.selectExpr(f"{chrom} as chrom", f"{side} as strand", f"(p_partkey * 97) % {size} as u_start", f"(p_partkey * 97) % {size} + p_size * 60 as u_end", "concat('G', p_partkey) as gene_name")
    chunks = _lines(spark, _fasta_of_part(spark, d), "fasta", lambda path: genomic.fasta_chunks(spark, path, 1000))
    return pipelines.negative_sites(pos, utrs, chunks, 64, size=1000)


@query(f"{with_('sites')}, n as (select cast(2 * count(distinct (chrom, pos, strand)) as bigint) as t from sites where source = 'R') select unnest(['window', 'random', 'motif']) as bucket, unnest([t // 2, cast(floor(0.35::double * t) as bigint), t - t // 2 - cast(floor(0.35::double * t) as bigint)]) as target from n")
def bucket_targets(spark, d):
    return spark.createDataFrame(list(sampling.bucket_targets(_positives(spark, d).count()).items()), "bucket string, target long")


@query(f"{with_('sites')}, b as (select chrom, pos, strand, case source when 'N' then 0 when 'A' then 1 else 2 end as bucket from sites) select chrom, pos, strand, cast(min(bucket) as int) as bucket from b group by chrom, pos, strand")
def seen_sites(spark, d):
    """A site is taken by the first of three buckets that has it."""
    t = _sites(spark, d).select(*KEYS, F.expr("case source when 'N' then 0 when 'A' then 1 else 2 end").alias("bucket"))
    return rows.keep_first(t, KEYS, ["bucket"])


@query(f"{with_('sites')} select arg_min(length(sequence), (chrom, pos, strand, length(sequence))) as n from sites")
def sequence_length(spark, d):
    return spark.createDataFrame([(pipelines.sequence_length(_sites(spark, d)),)], "n long")


# -- tokens, inference, null keys ----------------------------------------------------------------------------------------


@query(f"""with t as (select p_partkey, substr(s, 1, cast(1 + p_partkey % 40 as int)) as s from ({_PARTS})), k as (select p_partkey, case when length(s) < 6 then [rpad(s, 6, 'N')] else list_transform(range(1, length(s) - 4), lambda i: substr(s, i, 6)) end as k from t),
w as (select p_partkey, list_concat(['[CLS]'], k[1:18], ['[SEP]']) as w from k) select p_partkey, array_to_string(list_concat(w, list_transform(range(0, 20 - len(w)), lambda i: '[PAD]')), ' ') as tokens, cast(len(w) as int) as n_attended from w""")
def kmer_padded(spark, d):
    """The k-mer fallback, cut off and filled up to 20 tokens."""
    t = _parts(spark, d).select("p_partkey", seq.kmer_tokens(F.substring(F.col("s"), F.lit(1), (1 + F.col("p_partkey") % 40).cast("int")), 20).alias("t"))
    return t.select("p_partkey", F.array_join("t.tokens", " ").alias("tokens"), F.expr("aggregate(t.attention_mask, 0, (a, x) -> a + x)").alias("n_attended"))


@query(f"with t as ({_PARTS}) select p_partkey, round(1 / (1 + exp((length(s) - length(replace(s, 'C', '')) - (length(s) - length(replace(s, 'A', '')))) / 4.0)), 9) as prob from t")
def batch_scores(spark, d):
    """Inference in Arrow batches by a model that weighs A against C."""
    def predict(texts: list[str]) -> pd.DataFrame:
        return pd.DataFrame({0: [x.count("C") / 4 for x in texts], 1: [x.count("A") / 4 for x in texts]})

    return pipelines.scored(_parts(spark, d), predict, "s").select("p_partkey", F.round("prob", 9).alias("prob"))


_HOLES = f"{with_('sites', 'genes')}, holed as (select distinct case when pos % 7 = 0 then null else chrom end as chrom, case when pos % 11 = 0 then null else strand end as strand, pos from sites)"


def _holed(spark, d):
    return _sites(spark, d).select(F.expr("if(pos % 7 = 0, null, chrom) as chrom"), F.expr("if(pos % 11 = 0, null, strand) as strand"), "pos").distinct()


@query(f"""{_HOLES}, f as (select *, case when lag(pos) over w is null or pos - lag(pos) over w > 12 then 1 else 0 end as is_new from holed window w as (partition by chrom, strand order by pos)),
n as (select *, sum(is_new) over (partition by chrom, strand order by pos rows unbounded preceding) as k from f) select chrom, strand, min(pos) as cluster_start, count(*) as n_sites from n group by chrom, strand, k""")
def islands_null_keys(spark, d):
    t = intervals.islands(_holed(spark, d), ["chrom", "strand"])
    return t.groupBy("chrom", "strand", "cluster_start").agg(F.count("*").alias("n_sites"))


@query(f"""{_HOLES}, last_gene as (select chrom, g_start, max(gene_id) as gene_id from (select *, rank() over (partition by chrom, g_start order by g_end desc) as rn from genes) where rn = 1 group by chrom, g_start)
select h.chrom, h.strand, h.pos, g.gene_id from holed h asof left join last_gene g on h.chrom = g.chrom and h.pos >= g.g_start""")
def asof_null_keys(spark, d):
    t = intervals.asof(held(_holed(spark, d)), load(spark, d, "genes"), ["chrom"], "pos", "g_start", ["gene_id"], ["g_end", "gene_id"])
    return t.select("chrom", "strand", "pos", F.col("asof.gene_id").alias("gene_id"))


@query(f"""{_HOLES}, s as (select distinct chrom, pos - 5 as s, pos + 6 as e from holed), f as (select *, case when s > max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as is_new from s),
n as (select *, sum(is_new) over (partition by chrom order by s, e rows unbounded preceding) as k from f) select chrom, min(s) as "start", max(e) as "end" from n group by chrom, k""")
def merged_null_keys(spark, d):
    return intervals.merged(_holed(spark, d).select("chrom", (F.col("pos") - 5).alias("start"), (F.col("pos") + 6).alias("end")), ["chrom"])


@query("select p_partkey, case when p_partkey % 5 <> 0 then p_size else 0 end as a from part")
def numeric_filled(spark, d):
    t = _part(spark, d).selectExpr("p_partkey", "if(p_partkey % 5 = 0, p_name, cast(p_size as string)) as a")
    return rows.numeric(t, ["a"], 0)
