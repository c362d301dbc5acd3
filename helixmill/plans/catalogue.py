"""The registered queries, each with its SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from helixmill.functions import sequence as seq
from helixmill.functions.ids import negative_id, positive_id
from helixmill.operators import free_space, intervals, metrics, rows, sampling
from helixmill.plans import pipelines
from helixmill.plans.adapters import load, with_
from helixmill.plans.stages import held
from helixmill.sources import genomic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
KEYS, ORDER = ["chrom", "pos", "strand"], ["source", "sequence"]


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def _sites(spark, d):
    return load(spark, d, "sites")


def _distinct(spark, d):
    return rows.keep_first(_sites(spark, d), KEYS, ORDER)


# -- de-duplication, merging, clustering ------------------------------------------------------------------------------

_D = with_("sites", "distinct_sites")


@query(f"{_D} select * from distinct_sites")
def site_dedup(spark, d):
    return _distinct(spark, d)


_MERGE = f"""{_D},
a as (select chrom, pos, strand, 'setA' as source, sequence as seq_a, cast(null as varchar) as seq_b, 0 as side from distinct_sites where source = 'A'),
b as (select chrom, pos, strand, concat('setB, ', source) as source, cast(null as varchar) as seq_a, sequence as seq_b, 1 as side from sites where source <> 'A'),
u as (select * from a union all select * from b),
names as (select chrom, pos, strand, string_agg(distinct trim(n), ',' order by trim(n)) as source from (select chrom, pos, strand, unnest(string_split(source, ',')) as n from u) where trim(n) <> '' group by chrom, pos, strand)
select chrom, pos, strand, min(seq_a) as seq_a, min(seq_b) as seq_b, any_value(names.source) as source from u join names using (chrom, pos, strand) group by chrom, pos, strand"""


@query(_MERGE)
def coord_merge(spark, d):
    a = _distinct(spark, d).where("source = 'A'").select(*KEYS, F.lit("setA").alias("source"), F.col("sequence").alias("seq_a"))
    b = _sites(spark, d).where("source <> 'A'").select(*KEYS, F.concat(F.lit("setB, "), "source").alias("source"), F.col("sequence").alias("seq_b"))
    merged = rows.merge_by_coordinates(a, b, KEYS, ["seq_a", "seq_b"])
    return merged.select(*KEYS, "seq_a", "seq_b", "source")


def _islands_sql(keys: str) -> str:
    return f"""flagged as (select *, case when lag(pos) over w is null or pos - lag(pos) over w > 12 then 1 else 0 end as is_new from base window w as (partition by {keys} order by pos, source, sequence)),
numbered as (select *, sum(is_new) over (partition by {keys} order by pos, source, sequence rows unbounded preceding) as cl from flagged),
stats as (select *, median(pos) over (partition by {keys}, cl) as med, min(pos) over (partition by {keys}, cl) as cluster_start, count(*) over (partition by {keys}, cl) as n_sites from numbered),
best as (select * from (select *, row_number() over (partition by {keys}, cl order by abs(pos - med), pos, source, sequence) as rn from stats) where rn = 1)"""


@query(f"""{_D}, base as (select * from distinct_sites), {_islands_sql('chrom, strand')},
names as (select chrom, strand, cl, string_agg(distinct source, ',' order by source) as sources from numbered group by chrom, strand, cl)
select chrom, strand, cluster_start, n_sites, pos, sequence, sources as source from best join names using (chrom, strand, cl)""")
def cluster_nearby(spark, d):
    keys = ["chrom", "strand"]
    t = held(intervals.islands(held(_distinct(spark, d)), keys))
    return intervals.representatives(t, keys, ORDER, sources="source").select(*keys, "cluster_start", "n_sites", "pos", "sequence", "source")


@query(f"{with_('sites')}, base as (select chrom, pos, strand, case when source = 'R' then 1 else 0 end as label, source, min(sequence) as sequence from sites group by all), {_islands_sql('chrom, strand, label')} select chrom, strand, label, cluster_start, n_sites, pos, sequence from best")
def cluster_per_class(spark, d):
    t = _sites(spark, d).withColumn("label", (F.col("source") == "R").cast("int")).groupBy(*KEYS, "label", "source").agg(F.min("sequence").alias("sequence"))
    keys = ["chrom", "strand", "label"]
    return intervals.representatives(held(intervals.islands(held(t), keys)), keys, ORDER).select(*keys, "cluster_start", "n_sites", "pos", "sequence")


@query(f"""{_D}, ranked as (select *, row_number() over (partition by sequence order by chrom, pos, strand, source) as rn, count(*) over (partition by sequence) as n from distinct_sites),
names as (select sequence, string_agg(distinct source, ',' order by source) as source from distinct_sites group by sequence)
select sequence, chrom, pos, strand, names.source, n as n_coords_collapsed from ranked join names using (sequence) where rn = 1""")
def unique_sequences(spark, d):
    return rows.one_per_sequence(_distinct(spark, d), ["chrom", "pos", "strand"])


# -- gene joins -------------------------------------------------------------------------------------------------------

_ASOF = f"""{with_('sites', 'distinct_sites', 'genes')},
last_gene as (select chrom, g_start, g_end, gene_id from (select *, row_number() over (partition by chrom, g_start order by g_end desc, gene_id desc) as rn from genes) where rn = 1),
near as (select s.chrom, s.pos, s.strand, g.gene_id, g.g_start, g.g_end from distinct_sites s asof left join last_gene g on s.chrom = g.chrom and s.pos >= g.g_start),
inside as (select s.chrom, s.pos, s.strand, arg_min(g.gene_id, g.ord) as gene_id from distinct_sites s join genes g on s.chrom = g.chrom and s.pos between g.g_start and g.g_end group by s.chrom, s.pos, s.strand)"""


def _asof(spark, d):
    near = intervals.asof(held(_distinct(spark, d).select(*KEYS)), load(spark, d, "genes"), ["chrom"], "pos", "g_start", ["g_end", "gene_id"], ["g_end", "gene_id"])
    return near.withColumn("near", F.when(F.col("pos") <= F.col("asof.g_end"), F.col("asof.gene_id")))


def _first_containing(sites, genes):
    hit = intervals.least_covering(sites, genes.where("ord is not null"), ["chrom"], "pos", "g_start", "g_end", __first=F.struct("ord", "gene_id"))
    return hit.select("chrom", "pos", F.col("__first.gene_id").alias("inside"))


@query(f"{_ASOF} select chrom, pos, strand, case when pos <= g_end then gene_id end as gene_id from near")
def gene_asof(spark, d):
    return _asof(spark, d).select(*KEYS, F.col("near").alias("gene_id"))


@query(f"{_ASOF} select s.chrom, s.pos, s.strand, coalesce(i.gene_id, '') as gene_id from distinct_sites s left join inside i using (chrom, pos, strand)")
def gene_fallback(spark, d):
    sites = _distinct(spark, d).select(*KEYS)
    return sites.join(_first_containing(sites, load(spark, d, "genes")), ["chrom", "pos"], "left").select(*KEYS, F.coalesce("inside", F.lit("")).alias("gene_id"))


@query(f"{_ASOF} select n.chrom, n.pos, n.strand, coalesce(case when n.pos <= n.g_end then n.gene_id end, i.gene_id, '') as gene_id from near n left join inside i using (chrom, pos, strand)")
def annotate_full(spark, d):
    near = held(_asof(spark, d).select(*KEYS, "near"))
    missed = _first_containing(near.where("near is null"), load(spark, d, "genes"))
    return near.join(missed, ["chrom", "pos"], "left").select(*KEYS, F.coalesce("near", "inside", F.lit("")).alias("gene_id"))


@query(f"""{with_('sites', 'distinct_sites', 'utrs')} select s.chrom, s.pos, s.strand, min(u.utr_id) as utr_id from distinct_sites s join utrs u on s.chrom = u.chrom and s.strand = u.strand and s.pos between u.u_start and u.u_end group by all""")
def containing_utr(spark, d):
    hit = intervals.least_covering(_sites(spark, d), load(spark, d, "utrs"), ["chrom", "strand"], "pos", "u_start", "u_end", utr_id=F.col("utr_id"))
    return hit.where("utr_id is not null").select(*KEYS, "utr_id")


# -- overlaps ---------------------------------------------------------------------------------------------------------

_AB = f"{with_('sites')}, a as (select distinct chrom, pos, strand from sites where source = 'A'), b as (select distinct chrom, pos, strand from sites where source = 'R')"
_PAIRS = f"{_AB}, pairs as (select a.chrom, a.strand, a.pos as pos_a, b.pos as pos_b from a join b on a.chrom = b.chrom and a.strand = b.strand and b.pos between a.pos - 12 and a.pos + 12)"


def _ab(spark, d):
    return tuple(_sites(spark, d).where(F.col("source") == x).select(*KEYS).distinct() for x in "AR")


@query(f"{_AB} select (select count(*) from a) as n_a, (select count(*) from b) as n_b, count(*) as n_both, round(count(*) / (select count(*) from a), 9) as share_a, round(count(*) / (select count(*) from b), 9) as share_b from a join b using (chrom, pos, strand)")
def exact_overlap(spark, d):
    a, b = _ab(spark, d)
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), KEYS, "full")
    n = both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"))
    return n.select("*", F.round(F.try_divide("n_both", "n_a"), 9).alias("share_a"), F.round(F.try_divide("n_both", "n_b"), 9).alias("share_b"))


@query(f"{_PAIRS} select count(*) as n_pairs, count(distinct (chrom, strand, pos_a)) as n_positions_a, count(distinct (chrom, strand, pos_b)) as n_positions_b from pairs")
def near_overlap_stats(spark, d):
    pairs = intervals.band_pairs(*_ab(spark, d), ["chrom", "strand"], 12)
    per_a = pairs.groupBy("chrom", "strand", "pos_a").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.count("*").alias("n_positions_a"))
    return per_a.crossJoin(pairs.select("chrom", "strand", "pos_b").distinct().agg(F.count("*").alias("n_positions_b")))


@query(f"{_PAIRS} select * from pairs order by chrom, strand, pos_a, pos_b limit 25")
def near_overlap_examples(spark, d):
    return intervals.band_pairs(*_ab(spark, d), ["chrom", "strand"], 12).orderBy("chrom", "strand", "pos_a", "pos_b").limit(25)


@query(f"""{with_('sites')}, n as (select chrom, strand, pos, count(*) over (partition by chrom, strand order by pos range between 12 preceding and 12 following) - count(*) over (partition by chrom, strand, pos) as k from sites)
select chrom, strand, count(*) filter (k > 0) as n_rows, cast(sum(k) as bigint) as n_pairs from n group by chrom, strand""")
def near_neighbours(spark, d):
    t = intervals.neighbours(_sites(spark, d).select(*KEYS), ["chrom", "strand"], 12)
    return t.groupBy("chrom", "strand").agg(F.count_if(F.col("n_near") > 0).alias("n_rows"), F.sum("n_near").alias("n_pairs"))


@query(f"{with_('sites')} select count(*) as n_rows, count(*) - count(distinct (chrom, pos, strand)) as n_duplicates, count(distinct (chrom, pos, strand)) as n_distinct from sites")
def dup_counts(spark, d):
    return rows.duplicate_counts(_sites(spark, d), KEYS)


@query("select min(length(text)) as min_len, max(length(text)) as max_len, cast(floor(median(length(text))) as int) as median_len, count(*) filter (regexp_matches(text, '[^ACGT]')) as n_non_acgt from documents")
def seq_quality(spark, d):
    return rows.sequence_quality(load(spark, d, "docs"))


@query(f"""{with_('sites')}, g as (select chrom, pos, strand, count(*) as n_in_group from sites group by all having count(*) > 1 order by chrom, pos, strand limit 10),
r as (select s.chrom, s.pos, s.strand, s.source, s.sequence, n_in_group, row_number() over (partition by s.chrom, s.pos, s.strand order by s.source, s.sequence) as n_example from sites s join g using (chrom, pos, strand))
select chrom, pos, strand, source, sequence, n_in_group, n_example from r where n_example <= 2 order by chrom, pos, strand, n_example limit 10""")
def dup_examples(spark, d):
    return rows.duplicate_examples(_sites(spark, d), KEYS, ORDER)


@query(f"{with_('sites', 'candidates')} select * from candidates c where not exists (select 1 from sites s where s.chrom = c.chrom and s.source = 'R' and s.pos between c.pos - 50 and c.pos + 50)")
def clear_of_sites(spark, d):
    return intervals.clear_of(load(spark, d, "candidates"), _sites(spark, d).where("source = 'R'"), ["chrom"], 50)


_BUFFERS = f"""{with_('sites', 'candidates')}, spans as (select distinct chrom, pos - 20 as s, pos + 21 as e from sites where source = 'R'),
f as (select *, case when s > max(e) over (partition by chrom order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end as is_new from spans),
n as (select *, sum(is_new) over (partition by chrom order by s, e rows unbounded preceding) as k from f),
merged as (select chrom, min(s) as "start", max(e) as "end" from n group by chrom, k)"""


def _buffers(spark, d, distance=20):
    p = _sites(spark, d).where("source = 'R'").select("chrom", "pos").distinct()
    return intervals.merged(p.select("chrom", (F.col("pos") - distance).alias("start"), (F.col("pos") + distance + 1).alias("end")), ["chrom"])


@query(f"{_BUFFERS} select * from merged")
def merged_buffers(spark, d):
    return _buffers(spark, d)


@query(f'{_BUFFERS} select * from candidates c where not exists (select 1 from merged m where m.chrom = c.chrom and m."start" <= c.pos and c.pos < m."end")')
def outside_buffers(spark, d):
    return intervals.outside(load(spark, d, "candidates"), _buffers(spark, d), ["chrom"])


# -- labels, keys, samples --------------------------------------------------------------------------------------------

_LABELLED = f"{_D}, labelled as (select chrom, pos, strand, sequence, case when source = 'R' then 1 else 0 end as label from distinct_sites)"


def _labelled(spark, d):
    return _distinct(spark, d).select(*KEYS, "sequence", (F.col("source") == "R").cast("int").alias("label"))


@query(f"{_LABELLED} select * from labelled where label = 1 or sequence not in (select sequence from labelled where label = 1)")
def label_conflict_drop_neg(spark, d):
    return rows.label_conflicts(_labelled(spark, d), "drop_neg")


@query(f"{_LABELLED} select * from labelled where label = 0 or sequence not in (select sequence from labelled where label = 0)")
def label_conflict_drop_pos(spark, d):
    return rows.label_conflicts(_labelled(spark, d), "drop_pos")


@query(f"{_LABELLED} select * from labelled")
def label_conflict_keep_both(spark, d):
    return rows.label_conflicts(_labelled(spark, d), "keep_both")


@query(f"{_LABELLED} select label, sequence, min(chrom || ':' || lpad(cast(pos as varchar), 9, '0') || ':' || strand) as at from labelled group by label, sequence")
def within_label_dedup(spark, d):
    at = F.concat_ws(":", "chrom", F.lpad(F.col("pos").cast("string"), 9, "0"), "strand")
    return _labelled(spark, d).groupBy("label", "sequence").agg(F.min(at).alias("at"))


_KEYED = f"""{with_('sites')}, mixed as (select distinct case when pos % 3 = 0 then cast(pos as varchar) end as id, case when pos % 5 <> 1 then chrom end as chrom, pos, strand, sequence, source as label from sites),
keyed as (select *, case when id is not null then concat('ID::', id) when chrom is not null then concat('CSP::', chrom, '::', strand, '::', cast(pos as varchar)) else concat('HASH::', sha1(concat(sequence, '::', label, '::', strand))) end as stable_key from mixed)"""


def _keyed(spark, d):
    t = _sites(spark, d).select(F.expr("case when pos % 3 = 0 then cast(pos as string) end").alias("id"), F.expr("case when pos % 5 <> 1 then chrom end").alias("chrom"), "pos", "strand", "sequence", F.col("source").alias("label")).distinct()
    return t.withColumn("stable_key", seq.stable_key(t.columns))


@query(f"{_KEYED} select * from keyed")
def stable_key(spark, d):
    return _keyed(spark, d)


@query(f"{_KEYED} select * from keyed where stable_key not in (select stable_key from keyed where pos % 2 = 0)")
def remainder_anti(spark, d):
    t = _keyed(spark, d)
    return rows.remainder(t, t.where("pos % 2 = 0"), "stable_key")


_POINTS = f"{_LABELLED}, points as (select concat(chrom, ':', cast(pos as varchar), ':', strand) as key, chrom, label from labelled)"


def _points(spark, d):
    return _labelled(spark, d).select(F.concat_ws(":", "chrom", F.col("pos").cast("string"), "strand").alias("key"), "chrom", "label")


@query(f"""{_POINTS}, n as (select count(*) filter (label = 1) as p, count(*) filter (label = 0) as n from points),
k as (select least(p, n, greatest(2, (cast(round_even((p + n) * 0.5, 0) as bigint) // 2) * 2) // 2) as each_n from n),
r as (select *, row_number() over (partition by label order by md5(concat(key, '|42')), key) as rn from points)
select key, chrom, label from r, k where rn <= each_n""")
def balanced_half(spark, d):
    return sampling.balanced(_points(spark, d), "key", 0.5, 42).select("key", "chrom", "label")


@query(f"{_POINTS} select key, chrom, label from (select *, row_number() over (partition by label order by md5(concat(key, '|7')), key) as rn from points) where rn <= 100")
def n_per_class(spark, d):
    return sampling.per_class(_points(spark, d), "key", 100, 7).select("key", "chrom", "label")


@query(f"{_POINTS} select key, label, case when row_number() over (order by md5(concat(key, '|42')), key) <= greatest(1, cast(floor((select count(*) from points) * 0.1) as bigint)) then 'val' else 'train' end as split from points")
def random_split(spark, d):
    return sampling.random_split(_points(spark, d), "key", 0.1, 42).select("key", "label", "split")


@query(f"{_POINTS} select key, row_number() over (order by md5(concat(key, '|1')), key) as rank from points")
def seeded_shuffle(spark, d):
    return sampling.shuffled(_points(spark, d), "key", 1).select("key", "rank")


@query(f"{_POINTS}, c as (select chrom, row_number() over (order by chrom desc) as r, count(*) over () as n from (select distinct chrom from points)) select key, chrom, case when r <= greatest(1, floor(n * 0.1)) then 'val' else 'train' end as split from points join c using (chrom)")
def chrom_split(spark, d):
    return sampling.chromosome_split(_points(spark, d), 0.1).select("key", "chrom", "split")


# -- negatives: attempts are drawn by hash, filtered, and each positive keeps its first -------------------------------

_POSITIVES = f"{with_('sites', 'utrs')}, positives as (select distinct chrom, pos, strand from sites where source = 'R')"
_HEX = "cast(concat('0x', substr(md5(concat({0}, '|{1}')), 1, 7)) as bigint)"


def _positives(spark, d):
    return _sites(spark, d).where("source = 'R'").select(*KEYS).distinct()


_SHIFT = f"""{_POSITIVES},
own as (select p.chrom, p.pos, p.strand, arg_min(struct_pack(s := u_start, e := u_end), utr_id) as u from positives p join utrs u on u.chrom = p.chrom and u.strand = p.strand and p.pos between u_start and u_end where u_end - u_start > 203 + 120 group by all),
tries as (select *, a.attempt, concat(chrom, ':', cast(pos as varchar), ':', strand, ':', cast(a.attempt as varchar)) as k from own, (select unnest(range(0, 6)) as attempt) a),
moved as (select *, pos + (case when {_HEX.format('k', 'side')} % 2 = 0 then 1 else -1 end) * (100 + {_HEX.format('k', 'offset')} % 301) as new_pos from tries),
fine as (select * from moved m where new_pos >= u.s + 102 and new_pos <= u.e - 102 and not exists (select 1 from positives p where p.chrom = m.chrom and p.pos between m.new_pos - 50 and m.new_pos + 50))
select chrom, pos, strand, cast(min(attempt) as int) as attempt, cast(arg_min(new_pos, attempt) as bigint) as new_pos from fine group by chrom, pos, strand"""


@query(_SHIFT)
def window_shift_neg(spark, d):
    """Windows moved 100 to 400 bases inside the UTR that holds the positive, clear of all positives."""
    margin = max(60, 203 // 2 + 1)
    pos = _positives(spark, d)
    long = load(spark, d, "utrs").where(F.col("u_end") - F.col("u_start") > 203 + 2 * 60)
    own = intervals.least_covering(pos, long, ["chrom", "strand"], "pos", "u_start", "u_end", u=F.struct("utr_id", "u_start", "u_end"))
    tries = own.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(5))))
    key = F.concat_ws(":", "chrom", F.col("pos").cast("string"), "strand", F.col("attempt").cast("string"))
    side = F.when(sampling.whole_number(key, "side", 2) == 0, 1).otherwise(-1)
    moved = tries.withColumn("new_pos", F.col("pos") + side * (100 + sampling.whole_number(key, "offset", 301)))
    fine = moved.where((F.col("new_pos") >= F.col("u.u_start") + margin) & (F.col("new_pos") <= F.col("u.u_end") - margin)).drop("u")
    return sampling.first_attempt(intervals.clear_of(fine, pos.withColumnRenamed("pos", "site").select("chrom", F.col("site").alias("new_pos")), ["chrom"], 50, "new_pos"), KEYS)


#: How many negatives of a kind are drawn, by the number of positives n.
_TARGETS = {"random": "cast(floor(0.35::double * (2 * n)) as bigint)", "motif": "n - cast(floor(0.35::double * (2 * n)) as bigint)"}


def _uniform_sql(tries: int, kind: str, motif: str) -> str:
    return f"""{_POSITIVES}, blocked as (select distinct chrom, unnest(range(pos - 50, pos + 51)) as pos from positives), usable as (select *, row_number() over (order by utr_id) - 1 as u_no from utrs where u_end - u_start > 203 + 120),
draws as (select i, attempt, (select count(*) from usable) as n_u, concat(cast(i as varchar), ':', cast(attempt as varchar)) as k from (select unnest(range(0, {_TARGETS[kind]})) as i from (select count(*) as n from positives)), (select unnest(range(0, {tries})) as attempt)),
placed as (select i, attempt, chrom, strand, utr_id, u_start + 102 + {_HEX.format('k', 'place')} % (u_end - u_start - 203) as pos from draws join usable on u_no = {_HEX.format('k', 'utr')} % n_u),
fine as (select * from placed m where not exists (select 1 from blocked p where p.chrom = m.chrom and p.pos = m.pos){motif})
select cast(i as bigint) as i, cast(min(attempt) as int) as attempt, arg_min(chrom, attempt) as chrom, cast(arg_min(pos, attempt) as bigint) as pos, arg_min(strand, attempt) as strand, arg_min(utr_id, attempt) as utr_id from fine group by i"""


#: Made-up surroundings of a place: 64 bases, half of them A.
_AROUND = "translate(concat(md5(concat(cast(utr_id as {0}), ':', cast({1}pos as {0}))), md5(concat(cast({1}pos as {0}), 'x'))), '0123456789abcdef', 'AACGTAATAGTAACTA')"
_MOTIF_SQL = f" and (regexp_matches({_AROUND.format('varchar', 'm.')}, 'AATAAA|ATTAAA|AGTAAA|TATAAA|CATAAA|GATAAA|AATACA|AATAGA|AATATA|AATGAA|ACTAAA|AAGAAA') or regexp_matches(reverse(translate({_AROUND.format('varchar', 'm.')}, 'ACGT', 'TGCA')), 'AATAAA|ATTAAA|AGTAAA|TATAAA|CATAAA|GATAAA|AATACA|AATAGA|AATATA|AATGAA|ACTAAA|AAGAAA'))"


def _uniform(spark, d, tries: int, kind: str):
    """As many draws of a UTR (weighted by record) and a place in it as the positives' bucket asks for, a few tries each."""
    positives = held(_positives(spark, d))
    target = sampling.bucket_targets(positives.count())[kind]
    utrs = load(spark, d, "utrs").where(F.col("u_end") - F.col("u_start") > 203 + 2 * 60)
    numbered = sampling.numbered(utrs, ["utr_id"], "u_no")
    n = utrs.agg(F.count("*").alias("n_u"))
    draws = spark.range(target).withColumnRenamed("id", "i").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    key = F.concat_ws(":", F.col("i").cast("string"), F.col("attempt").cast("string"))
    draws = draws.crossJoin(F.broadcast(n)).withColumn("u_no", sampling.whole_number(key, "utr", F.col("n_u"))).withColumn("place", F.conv(F.substring(sampling.draw(key, "place"), 1, 7), 16, 10).cast("long"))
    placed = draws.join(numbered, "u_no").withColumn("pos", F.col("u_start") + 102 + F.col("place") % (F.col("u_end") - F.col("u_start") - 203))
    return intervals.clear_of(placed.select("i", "attempt", "chrom", "pos", "strand", "utr_id"), positives, ["chrom"], 50)


@query(_uniform_sql(4, "random", ""))
def uniform_utr_neg(spark, d):
    return sampling.first_attempt(_uniform(spark, d, 4, "random"), ["i"])


@query(_uniform_sql(8, "motif", _MOTIF_SQL))
def motif_neg(spark, d):
    """As uniform_utr_neg, of places whose (made-up) surroundings hold a hexamer on either strand."""
    return sampling.first_attempt(_uniform(spark, d, 8, "motif").where(seq.has_hexamer(F.expr(_AROUND.format("string", "")))), ["i"])


@query(f"""{_BUFFERS}, pos as (select distinct chrom, pos, strand from sites where source = 'R'),
tries as (select chrom, pos, strand, attempt, concat(chrom, ':', cast(pos as varchar), ':', strand, ':', cast(attempt as varchar)) as k from pos, (select unnest(range(0, 32)) as attempt)),
drawn as (select *, {_HEX.format('k', 'whole')} % 100000 as new_pos from tries),
fine as (select * from drawn c where not exists (select 1 from merged m where m.chrom = c.chrom and m."start" <= c.new_pos and c.new_pos < m."end")),
missed as (select * from pos p where not exists (select 1 from fine f where f.chrom = p.chrom and f.pos = p.pos and f.strand = p.strand)),
late as (select chrom, pos, strand, attempt, concat(chrom, ':', cast(pos as varchar), ':', strand, ':', cast(attempt as varchar)) as k from missed, (select unnest(range(32, 5000)) as attempt)),
placed as (select *, {_HEX.format('k', 'whole')} % 100000 as new_pos from late),
every as (select * from fine union all select * from placed c where not exists (select 1 from merged m where m.chrom = c.chrom and m."start" <= c.new_pos and c.new_pos < m."end"))
select chrom, pos, strand, cast(min(attempt) as int) as attempt, cast(arg_min(new_pos, attempt) as bigint) as new_pos from every group by chrom, pos, strand""")
def whole_chrom_neg(spark, d):
    """A place anywhere on the positive's chromosome outside the merged buffers; the first of 5,000 draws that is, in rounds. Draws are looked up among the
    free runs, and chromosomes without a free place, where each draw would fail, make none."""
    pos = held(_positives(spark, d))
    sizes = pos.select("chrom", F.lit(100000).cast("long").alias("length")).distinct()
    runs = held(free_space.free_runs(sizes, _buffers(spark, d), ["chrom"]).select("chrom", "start", (F.col("end") - 1).alias("last")))

    def draw(tries):
        key = F.concat_ws(":", "chrom", F.col("pos").cast("string"), "strand", F.col("attempt").cast("string"))
        drawn = tries.withColumn("new_pos", sampling.whole_number(key, "whole", 100000))
        return intervals.containing(drawn, runs, ["chrom"], "new_pos", "start", "last", 64).drop("start", "last")

    return pipelines.drawn_in_rounds(pos.join(runs.select("chrom").distinct(), "chrom", "left_semi"), KEYS, draw)


@query(f"""{_D} select chrom, pos, strand, case when source = 'R' then 1 else 0 end as label, case when source = 'N' then 'unknown' else source end as source, upper(sequence) as sequence from distinct_sites""")
def dataset_union(spark, d):
    t = _distinct(spark, d).withColumn("source", F.nullif("source", F.lit("N")))
    pos = t.where("source = 'R'").withColumn("label", F.lit(1))
    neg = t.where("source is null or source <> 'R'").withColumn("label", F.lit(0))
    both = pos.unionByName(neg).withColumns({"source": F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("unknown")), "sequence": F.upper("sequence")})
    return both.na.drop(subset=KEYS).select(*KEYS, "label", "source", "sequence")


@query(f"{with_('sites')} select distinct sequence from sites where source = 'A' intersect select distinct sequence from sites where source = 'R'")
def common_sequences(spark, d):
    s = _sites(spark, d)
    return s.where("source = 'A'").select("sequence").intersect(s.where("source = 'R'").select("sequence"))


# -- sequence functions -----------------------------------------------------------------------------------------------

_BENCH = "select item_id, regexp_replace(text, '[^ -~]', '', 'g') as s from benchmark"
_CLEAN = "regexp_replace(translate(upper(regexp_replace(s, '\\s+', '', 'g')), 'U', 'T'), '[^ACGTN]', 'N', 'g')"
_PARTS = "select distinct p_partkey, translate(concat(md5(concat(cast(p_partkey as varchar), 'a')), md5(concat(cast(p_partkey as varchar), 'b'))), '0123456789abcdef', 'ACGTNACGTAAATAAT') as s from part"


def _bench(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.regexp_replace("text", "[^ -~]", "").alias("s"))


def _parts(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet").select("p_partkey").distinct()
    return t.withColumn("s", F.translate(F.concat(F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit("a"))), F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit("b")))), "0123456789abcdef", "ACGTNACGTAAATAAT"))


@query(f"with t as ({_BENCH}) select item_id, {_CLEAN} as cleaned, length({_CLEAN}) as n from t")
def seq_clean(spark, d):
    return _bench(spark, d).select("item_id", seq.clean(F.col("s")).alias("cleaned")).withColumn("n", F.length("cleaned").cast("long"))


@query(f"with t as (select p_partkey, s from ({_PARTS})) select p_partkey, array_to_string(list_transform(range(1, length(s) - 4), lambda i: substr(s, i, 6)), ' ') as tokens from t")
def kmers(spark, d):
    return _parts(spark, d).select("p_partkey", seq.kmer_text(F.col("s")).alias("tokens"))


@query(f"with t as ({_BENCH}), c as (select item_id, {_CLEAN} as c from t), w as (select item_id, c, unnest(range(0, greatest(length(c) - 300, 0) + 1, 100)) as o from c where length(c) > 0) select item_id, cast(o // 100 as int) as win_index, case when length(c) <= 300 then c else substr(c, o + 1, 300) end as win, length(c) as len_nt from w")
def sliding_windows(spark, d):
    t = _bench(spark, d).select("item_id", F.length(seq.clean(F.col("s"))).cast("long").alias("len_nt"), F.posexplode(seq.sliding_windows(F.col("s"))).alias("win_index", "win"))
    return t.select("item_id", "win_index", "win", "len_nt")


@query(f"with t as ({_PARTS}) select p_partkey, substr(s, greatest(0, least(p_partkey % 64 - 10, 64 - 20)) + 1, 20) as win from t")
def centered_window(spark, d):
    return _parts(spark, d).select("p_partkey", seq.centered_window(F.col("s"), 20, F.col("p_partkey") % 64)[0].alias("win"))


@query(f"with t as ({_PARTS}) select p_partkey, reverse(translate(s, 'ACGTacgt', 'TGCAtgca')) as rc from t")
def revcomp(spark, d):
    return _parts(spark, d).select("p_partkey", seq.reverse_complement(F.col("s")).alias("rc"))


# Of these queries the SQL spells out its motifs: it shares no constant with the functions that it checks.
@query(f"with t as ({_PARTS}) select p_partkey, regexp_matches(concat(s, '-', reverse(translate(s, 'ACGT', 'TGCA'))), 'AATAAA|ATTAAA|AGTAAA|TATAAA|CATAAA|GATAAA|AATACA|AATAGA|AATATA|AATGAA|ACTAAA|AAGAAA') as has_hexamer from t")
def hexamer_flag(spark, d):
    return _parts(spark, d).select("p_partkey", seq.has_hexamer(F.col("s")).alias("has_hexamer"))


@query(f"with t as (select *, case when p_partkey % 2 = 0 then '+' else '-' end as strand from ({_PARTS})), w as (select p_partkey, case when strand = '-' then reverse(translate(substr(s, 1, 40), 'ACGT', 'TGCA')) else substr(s, 1, 40) end as w from t) select p_partkey, regexp_matches(w, 'AATAAA|ATTAAA|AGTAAA') as motif from w")
def upstream_motif(spark, d):
    strand = F.when(F.col("p_partkey") % 2 == 0, "+").otherwise("-")
    return _parts(spark, d).select("p_partkey", seq.upstream_motif(F.col("s"), 40, strand).alias("motif"))


@query(f"with t as (select p_partkey, substr(translate(s, 'T', 'U'), 11, 30) as w from ({_PARTS})), n as (select *, cast(len(list_filter(range(1, length(w) - 4), lambda i: substr(w, i, 6) in ('AAUAAA', 'AUUAAA', 'AGUAAA', 'AAGAAA', 'AACAAA', 'AAUAUA', 'AAUUAA', 'AAUAAG', 'UAUAAA', 'GAUAAA', 'CAUAAA', 'ACUAAA', 'AAUGAA'))) as int) as n from t) select p_partkey, case when contains(w, 'AAUAAA') then 1 else 0 end as canonical, n as n_motifs, case when n > 0 then 1 else 0 end as any_motif from n")
def pas_scan(spark, d):
    t = _parts(spark, d).withColumn("m", seq.scan_motifs(F.translate("s", "T", "U")))
    return t.select("p_partkey", "m.canonical", F.col("m.n").alias("n_motifs"), F.col("m.any").alias("any_motif"))


_N = "(length(s) - length(replace(s, '{0}', '')))"
_TOTAL = "greatest(" + " + ".join(_N.format(c) for c in "AUGCN") + ", 1)"


@query(f"with t as (select p_partkey, translate(s, 'T', 'U') as s from ({_PARTS})) select p_partkey, " + ", ".join(f"cast({_N.format(c)} as int) as {c}_count, 100.0::double * {_N.format(c)} / {_TOTAL} as {c}_pct" for c in "AUGC") + f", 100.0::double * ({_N.format('G')} + {_N.format('C')}) / {_TOTAL} as GC_pct, cast({_N.format('N')} as int) as N_count from t")
def base_composition(spark, d):
    t = _parts(spark, d).withColumn("c", seq.composition(F.translate("s", "T", "U")))
    return t.select("p_partkey", *(F.col(f"c.{x}").alias(x) for x in (*(f"{b}_{k}" for b in "AUGC" for k in ("count", "pct")), "GC_pct", "N_count")))


_CHROMS = "select p_partkey, case p_partkey % 10 when 0 then 'chr1' when 1 then '2' when 2 then 'MT' when 3 then 'chrMT' when 4 then 'GL000192.1' when 5 then 'chrUn_KI270742v1' when 6 then 'mt' when 7 then 'chrm' when 8 then 'm' else 'chrX' end as c, case p_partkey % 5 when 0 then '1' when 1 then 'Minus' when 2 then 'pos' when 3 then '.' else '-' end as s from part"


def _chroms(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet").select("p_partkey")
    return t.withColumns({"c": F.expr("case p_partkey % 10 when 0 then 'chr1' when 1 then '2' when 2 then 'MT' when 3 then 'chrMT' when 4 then 'GL000192.1' when 5 then 'chrUn_KI270742v1' when 6 then 'mt' when 7 then 'chrm' when 8 then 'm' else 'chrX' end"), "s": F.expr("case p_partkey % 5 when 0 then '1' when 1 then 'Minus' when 2 then 'pos' when 3 then '.' else '-' end")})


@query(f"""with t as ({_CHROMS}) select p_partkey, case when c in ('MT', 'chrMT', 'mt', 'chrm', 'm') then 'chrM' when starts_with(c, 'chr') then c else concat('chr', c) end as chrom, case when c in ('MT', 'chrMT', 'mt') then 'M' when starts_with(c, 'chr') then substr(c, 4) else c end as bare,
contains(c, '_') or starts_with(replace(c, 'chr', ''), 'GL') or starts_with(replace(c, 'chr', ''), 'KI') as alternative, case when starts_with(c, 'chr') then c else concat('chr', c) end in ('chr1', 'chr2', 'chrX') as canonical from t""")
def chrom_normalise(spark, d):
    c = F.col("c")
    return _chroms(spark, d).select("p_partkey", seq.chrom_style(c).alias("chrom"), seq.chrom_style(c, False).alias("bare"), seq.is_alternative(c).alias("alternative"), seq.with_chr(c).isin(*seq.CANONICAL).alias("canonical"))


@query(f"with t as ({_CHROMS}) select p_partkey, case s when '1' then '+' when 'pos' then '+' when 'Minus' then '-' else s end as strand, case when s in ('+', '-') then s else '+' end as defaulted from t")
def strand_normalise(spark, d):
    return _chroms(spark, d).select("p_partkey", seq.normal_strand(F.col("s")).alias("strand"), seq.default_strand(F.col("s")).alias("defaulted"))


@query("select p_partkey, case when p_partkey % 3 = 2 then '' else concat('G', cast(p_partkey as varchar)) end as gene_id, case when p_partkey % 3 = 0 then p_brand else '' end as gene_name from part")
def attr_parse(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.expr("case p_partkey % 3 when 0 then format_string('gene_id \"G%d\"; gene_name \"%s\";', p_partkey, p_brand) when 1 then format_string('ID=x;gene_id=G%d;note=1', p_partkey) else 'nothing here' end").alias("a"))
    return t.select("p_partkey", seq.attribute(F.col("a"), "gene_id").alias("gene_id"), seq.attribute(F.col("a"), "gene_name").alias("gene_name"))


@query(f"with t as ({_CHROMS}), u as (select p_partkey, p_partkey * 10 as a, p_partkey * 10 + 7 as e, case when s in ('+', '-') then s else '+' end as s from t) select p_partkey, case when s = '+' then e else a end as pos_pipeline, case when s = '+' then e - 1 else a end as pos_generator, case when s = '+' then e else a + 1 end as pos_features from u")
def cleavage_positions(spark, d):
    t = _chroms(spark, d).select("p_partkey", (F.col("p_partkey") * 10).alias("a"), (F.col("p_partkey") * 10 + 7).alias("e"), seq.default_strand(F.col("s")).alias("s"))
    args = F.col("a"), F.col("e"), F.col("s")
    return t.select("p_partkey", seq.cleavage_pipeline(*args).alias("pos_pipeline"), seq.cleavage_generator(*args).alias("pos_generator"), seq.cleavage_features(*args).alias("pos_features"))


@query("select p_partkey, case p_partkey % 4 when 0 then 1 when 1 then 0 when 2 then 1 else -1 end as label from part")
def label_map(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.expr("case p_partkey % 4 when 0 then 'Positive' when 1 then 'NEG' when 2 then ' true' else 'maybe' end").alias("l"))
    return t.select("p_partkey", F.coalesce(seq.label_number(F.col("l")), F.lit(-1)).alias("label"))


@query(f"{_LABELLED} select label, count(*) as n from labelled group by label")
def class_counts(spark, d):
    return _labelled(spark, d).groupBy("label").agg(F.count("*").alias("n"))


# -- metrics ----------------------------------------------------------------------------------------------------------

_S = with_("scores")


def _scores(spark, d):
    return load(spark, d, "scores")


@query(f"{_S}, c as (select count(*) as samples, count(*) filter ((label = 1) = (prob >= 0.5)) as ok, count(*) filter (label = 1 and prob >= 0.5) as tp, count(*) filter (label = 0 and prob >= 0.5) as fp, count(*) filter (label = 1 and prob < 0.5) as fn from scores) select samples, round(ok / samples, 10) as accuracy, round(2 * tp / (2 * tp + fp + fn), 10) as f1 from c")
def metrics_threshold(spark, d):
    return metrics.thresholded(_scores(spark, d)).select("samples", F.round("accuracy", 10).alias("accuracy"), F.round("f1", 10).alias("f1"))


@query(f"""{_S}, g as (select prob, count(*) filter (label = 1) as p, count(*) filter (label = 0) as n from scores group by prob),
c as (select *, sum(p) over (order by prob desc) as tp, sum(n) over (order by prob desc) as fp from g)
select round(sum(n * (tp - p / 2)) / (sum(p) * sum(n)), 10) as auroc, round(sum(p * tp / (tp + fp)) / sum(p), 10) as auprc from c""")
def metrics_ranked(spark, d):
    return metrics.ranked(_scores(spark, d)).select(F.round("auroc", 10).alias("auroc"), F.round("auprc", 10).alias("auprc"))


_RANKED = f"{_S}, k as (select key, min(label) as label, min(prob) as prob from scores group by key), r as (select *, row_number() over (order by md5(concat(key, '|3')), key) as rank from k)"


def _ranked_scores(spark, d):
    one = _scores(spark, d).groupBy("key").agg(F.min("label").alias("label"), F.min("prob").alias("prob"))
    return sampling.hash_rank(one, "key", 3)


@query(f"""{_RANKED}, l as (select (rank - 1) // 128 as batch, -case when label = 1 then ln(least(greatest(prob, 1e-7), 1 - 1e-7)) else ln(1 - least(greatest(prob, 1e-7), 1 - 1e-7)) end as loss from r),
b as (select batch, avg(loss) as m, sum(loss) as s, count(*) as n from l group by batch) select count(*) as n_batches, round(avg(m), 8) as loss, round(sum(s) / sum(n), 8) as row_loss from b""")
def batch_loss(spark, d):
    t = metrics.batches(_ranked_scores(spark, d), 128).withColumn("loss", metrics.log_loss(F.col("label"), F.col("prob")))
    return metrics.mean_of_batches(t, "batch", "loss").select("n_batches", F.round("loss", 8).alias("loss"), F.round("row_loss", 8).alias("row_loss"))


@query(f"{_RANKED}, m as (select key, (rank - 1) // 64 as batch, case when prob < 0.9 then label end as label from r) select key, cast(batch as bigint) as batch, count(label) over (partition by batch) between 1 and count(*) over (partition by batch) - 1 as mixed from m")
def batch_assign(spark, d):
    t = _ranked_scores(spark, d).withColumn("label", F.when(F.col("prob") < 0.9, F.col("label")))
    return metrics.batches(t, 64).select("key", "batch", "mixed")


@query("select l_orderkey % 1000 as k, count(*) as n, round(1 / (1 + exp(avg(l_tax) - avg(l_discount))), 9) as p from lineitem group by 1")
def softmax_probability(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet").groupBy((F.col("l_orderkey") % 1000).alias("k")).agg(F.count("*").alias("n"), F.avg("l_tax").alias("a"), F.avg("l_discount").alias("b"))
    return t.select("k", "n", F.round(seq.positive_probability(F.col("a"), F.col("b")), 9).alias("p"))


# -- liftover, overlaps, contigs, genome windows ----------------------------------------------------------------------

_BLOCKS = "blocks as (select concat('chr', cast(1 + p_partkey % 22 as varchar)) as src_chrom, (p_partkey * 97) % 100000 as src_start, (p_partkey * 97) % 100000 + p_size * 20 as src_end, concat('chr', cast(1 + p_partkey % 19 as varchar)) as dst_chrom, p_partkey * 50 as dst_start, case when p_partkey % 3 = 0 then '-' else '+' end as dst_strand, p_partkey as score from part)"


@query(f"""{_D}, {_BLOCKS}, hit as (select s.chrom as src_chrom, s.pos as src_pos, s.strand as src_strand, b.dst_chrom, b.dst_start, b.dst_strand, b.src_start, row_number() over (partition by s.chrom, s.pos, s.strand order by b.score desc) as rn from distinct_sites s join blocks b on s.chrom = b.src_chrom and s.pos >= b.src_start and s.pos < b.src_end)
select src_chrom, src_pos, src_strand, dst_chrom as chrom, case when dst_strand = '-' then dst_start - (src_pos - src_start) else dst_start + (src_pos - src_start) end as pos, case when dst_strand = '-' then translate(src_strand, '+-', '-+') else src_strand end as strand from hit where rn = 1""")
def liftover(spark, d):
    """Sites through chain blocks: the block of the highest score decides; on a minus block strands flip."""
    blocks = spark.read.parquet(f"{d}/part.parquet").selectExpr("concat('chr', cast(1 + p_partkey % 22 as string)) as src_chrom", "(p_partkey * 97) % 100000 as src_start", "(p_partkey * 97) % 100000 + p_size * 20 as src_end", "concat('chr', cast(1 + p_partkey % 19 as string)) as dst_chrom", "p_partkey * 50 as dst_start", "case when p_partkey % 3 = 0 then '-' else '+' end as dst_strand", "p_partkey as score")
    return intervals.lifted(_distinct(spark, d).select(*KEYS, F.col("strand").alias("src_strand")), blocks).select("src_chrom", "src_pos", "src_strand", "chrom", "pos", "strand")


@query(f"{with_('genes')}, q as (select chrom, key, pos as a_start, pos + 40 as a_end from (select 'chr' || cast(1 + o_custkey % 22 as varchar) as chrom, o_orderkey as key, cast((o_orderkey * 53 + o_custkey) % 100000 as bigint) as pos from orders)) select q.key, q.chrom, g.gene_id from q join genes g on q.chrom = g.chrom and q.a_start < g.g_end and g.g_start < q.a_end")
def gene_overlaps(spark, d):
    spans = load(spark, d, "candidates").select("key", "chrom", F.col("pos").alias("a_start"), (F.col("pos") + 40).alias("a_end"))
    genes = load(spark, d, "genes").select("chrom", F.col("g_start").alias("b_start"), F.col("g_end").alias("b_end"), "gene_id")
    return genomic.overlapping(spans, genes).select("key", "chrom", "gene_id")


@query(f"with t as ({_CHROMS}) select p_partkey, case c when 'chr1' then '1' when '2' then '2' when 'MT' then 'chrM' when 'chrX' then 'chrX' end as contig from t")
def contig_resolve(spark, d):
    """Names resolved against the contigs 1, 2, chrX and chrM."""
    contigs = spark.createDataFrame([("1",), ("2",), ("chrX",), ("chrM",)], "contig string")
    return genomic.resolved_contigs(_chroms(spark, d).select("p_partkey", F.col("c").alias("chrom")), contigs).select("p_partkey", F.col("chrom").alias("contig"))


_GENOME = """genome as (select concat('chr', cast(k as varchar)) as chrom, string_agg(md5(concat(cast(k as varchar), ':', cast(i as varchar))), '' order by i) as raw from (select unnest(range(1, 23)) as k), (select unnest(range(0, 400)) as i) group by k),
letters as (select chrom, translate(raw, '0123456789abcdef', 'ACGTACGTACGTACGT') as s from genome)"""


def _genome(spark, size):
    """A made-up genome of 22 contigs of 12,800 bases, as chunks."""
    parts = spark.range(1, 23).withColumnRenamed("id", "k").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(399)))).withColumn("raw", F.md5(F.concat_ws(":", F.col("k").cast("string"), F.col("i").cast("string"))))
    per = size // 32
    chunks = parts.groupBy("k", F.floor(F.col("i") / per).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "raw"))), lambda x: x["raw"]), "").alias("raw"))
    return chunks.select(F.concat(F.lit("chr"), F.col("k").cast("string")).alias("chrom"), "chunk", F.translate("raw", "0123456789abcdef", "ACGTACGTACGTACGT").alias("sequence"))


def _placed(spark, d):
    return _distinct(spark, d).select("chrom", (F.col("pos") % 12800).alias("pos"), "strand").distinct()


_PLACED = f"{_D}, {_GENOME}, placed as (select distinct chrom, pos % 12800 as pos, strand from distinct_sites)"


@query(f"{_PLACED}, w as (select p.chrom, pos, strand, substr(s, cast(greatest(pos - 101, 0) + 1 as int), cast(least(pos + 102, 12800) - greatest(pos - 101, 0) as int)) as w from placed p join letters using (chrom)) select chrom, pos, strand, md5(case when strand = '-' then reverse(translate(w, 'ACGT', 'TGCA')) else w end) as digest, length(w) as n from w")
def pipeline_windows(spark, d):
    """203 bases around each site, reverse-complemented on minus, cut off at the contig's ends."""
    t = genomic.pipeline_windows(_placed(spark, d), _genome(spark, 1024), size=1024)
    return t.select(*KEYS, F.md5("sequence").alias("digest"), F.length("sequence").cast("long").alias("n"))


@query(f"{_PLACED}, w as (select p.chrom, pos, strand, substr(s, cast(greatest(pos - 200, 0) + 1 as int), cast(least(pos + 100, 12800) - greatest(pos - 200, 0) as int)) as w from placed p join letters using (chrom)) select chrom, pos, strand, md5(case when strand = '-' then reverse(translate(w, 'ACGT', 'TGCA')) else w end) as digest, length(w) as n from w")
def generator_windows(spark, d):
    t = genomic.generator_windows(_placed(spark, d), _genome(spark, 1024), size=1024)
    return t.select(*KEYS, F.md5("sequence").alias("digest"), F.length("sequence").cast("long").alias("n"))


@query(f"{_PLACED}, w as (select p.chrom, pos, strand, substr(s, cast(greatest(pos - 50, 1) as int), cast(least(pos + 49, 12800) - greatest(pos - 50, 1) + 1 as int)) as w from placed p join letters using (chrom) where pos > 0), r as (select chrom, pos, strand, translate(case when strand = '-' then reverse(translate(w, 'ACGT', 'TGCA')) else w end, 'T', 'U') as s from w) select chrom, pos, strand, md5(s) as digest, cast({_N.format('A')} as int) as a_count, cast({_N.format('U')} as int) as u_count from r")
def feature_windows(spark, d):
    t = genomic.feature_windows(_placed(spark, d).where("pos > 0"), _genome(spark, 1024), size=1024).withColumn("b", seq.composition(F.col("sequence")))
    return t.select(*KEYS, F.md5("sequence").alias("digest"), F.col("b.A_count").alias("a_count"), F.col("b.U_count").alias("u_count"))


@query()
def positive_ids(spark, d):
    """BLAKE2b ids of the sites: no SQL function of DuckDB gives them; tests compare with hashlib."""
    return _distinct(spark, d).select(*KEYS, positive_id(F.col("chrom"), F.col("pos"), F.col("strand"), F.col("sequence")).alias("id"))


@query()
def negative_ids(spark, d):
    """BLAKE2b ids of sites with their gene, which may be null; as for positive_ids no SQL gives them, and tests compare with hashlib."""
    gene = F.nullif(F.col("source"), F.lit("N"))
    return _distinct(spark, d).select(*KEYS, gene.alias("gene_name"), negative_id(F.col("chrom"), F.col("pos"), F.col("strand"), gene).alias("id"))


@query("select 'R' as source, count(*) as n_rows, count(distinct p_brand) as n_distinct from part union all select coalesce(nullif(trim(p_type), ''), 'none'), count(*), count(distinct p_brand) from part group by 1")
def source_counts(spark, d):
    """Counts by source with a default for missing names."""
    p = spark.read.parquet(f"{d}/part.parquet")
    named = p.withColumn("source", F.coalesce(F.nullif(F.trim("p_type"), F.lit("")), F.lit("none")))
    total = p.agg(F.lit("R").alias("source"), F.count("*").alias("n_rows"), F.countDistinct("p_brand").alias("n_distinct"))
    return total.unionByName(named.groupBy("source").agg(F.count("*").alias("n_rows"), F.countDistinct("p_brand").alias("n_distinct")))


@query("select label, count(*) as n, min(doc_id) as first_doc from (select text, quality as label, min(l.doc_id) as doc_id from documents d join labels l using (doc_id) group by text, quality) group by label")
def labelled_text_dedup(spark, d):
    """Within-label de-duplication of the labelled documents by text."""
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("doc_id", "text", F.col("quality").alias("label"))
    return rows.keep_first(t, ["text", "label"], ["doc_id"]).groupBy("label").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(f"{_LABELLED}, c as (select chrom, count(*) as n_rows, count(*) filter (label = 1) as n_pos from labelled group by chrom) select metric, cast(value as double) as value from (select 'n_chroms' as metric, count(*) as value from c union all select 'n_rows', sum(n_rows) from c union all select 'n_pos', sum(n_pos) from c)")
def dataset_report(spark, d):
    """A (metric, value) report."""
    c = _labelled(spark, d).groupBy("chrom").agg(F.count("*").alias("n_rows"), F.sum("label").alias("n_pos")).agg(F.count("*").alias("n_chroms"), F.sum("n_rows").alias("n_rows"), F.sum("n_pos").alias("n_pos"))
    return c.select(F.explode(F.array(*(F.struct(F.lit(x).alias("metric"), F.col(x).cast("double").alias("value")) for x in c.columns))).alias("x")).select("x.*")
