"""The dataset pipelines as functions from DataFrames to DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from helixmill.functions import sequence as seq
from helixmill.functions.ids import negative_id, positive_id
from helixmill.operators import free_space, intervals, metrics, rows, sampling
from helixmill.plans.stages import held
from helixmill.sources import genomic

SITE = ["chrom", "pos", "strand"]
#: The columns and types of a labelled dataset.
DATASET = {"id": "string", "chrom": "string", "pos": "bigint", "strand": "string", "gene_name": "string", "source": "string", "sequence": "string", "label": "int"}
# The columns of the feature table.
FEATURES = ["Chromosome", "Start_1based", "End_1based", "Strand", "Score_or_ReadCount", "gene_id", "gene_name", "transcript_id", "Feature_type", "transcript_biotype", "presence_AAUAAA", "pas_variant_count", "presence_any_PAS_variant", "A", "U", "G", "C", "A_pct", "U_pct", "G_pct", "C_pct", "GC_pct", "N_count"]
#: The window of negatives where no positive has a sequence.
WINDOW = 101


def annotated_sites(sites: DataFrame, genes: DataFrame, chunks: DataFrame, source: str, match_strand: bool = False, size: int = genomic.CHUNK) -> DataFrame:
    """sites (chrom, pos, strand) with their gene and the 203 bases around them, one row for each row: the last gene that
    starts at or before the site if it reaches it, else the first in file order that holds it, else empty names."""
    keys = ["chrom", "strand"] if match_strand else ["chrom"]
    names = ["gene_id", "gene_name", "gene_type"]
    g = genes if match_strand else genes.drop("strand")
    near = intervals.asof(sites.select(*SITE), g, keys, "pos", "g_start", ["g_end", *names], ["g_end", "gene_id"])
    hit = F.col("asof.g_end") >= F.col("pos")
    near = held(near.select(*SITE, F.when(hit, F.struct(*(F.col(f"asof.{n}").alias(n) for n in names))).alias("near")))
    inside = intervals.least_covering(near.where("near is null"), g.where("ord is not null"), keys, "pos", "g_start", "g_end", inside=F.struct("ord", *names))
    both = near.join(inside, [*keys, "pos"], "left")
    named = both.select(*SITE, *(F.coalesce(F.col(f"near.{n}"), F.col(f"inside.{n}"), F.lit("")).alias(n) for n in names), F.lit(source).alias("source"))
    return genomic.pipeline_windows(named, chunks, size=size)


def bed_sites(bed: DataFrame) -> DataFrame:
    t = bed.select(seq.with_chr(F.col("chrom")).alias("chrom"), "start", "end", seq.default_strand(F.col("strand")).alias("strand")).where(F.col("chrom").isin(*seq.CANONICAL))
    return t.select("chrom", seq.cleavage_pipeline(F.col("start"), F.col("end"), F.col("strand")).alias("pos"), "strand")


def lifted_sites(table: DataFrame, blocks: DataFrame) -> DataFrame:
    """1-based sites through the chain: to 0-based, lifted, back to 1-based."""
    t = intervals.lifted(table.withColumn("pos", F.col("pos") - 1), blocks)
    return t.select("chrom", (F.col("pos") + 1).alias("pos"), "strand")


def positives(a: DataFrame, b: DataFrame, tol: int = 12) -> dict[str, DataFrame]:
    """Two annotated tables to merged, clustered, one per sequence, and the positives (of the clustered table)."""
    order = ["source", "sequence"]
    merged = held(rows.merge_by_coordinates(rows.keep_first(a, SITE, order), rows.keep_first(b, SITE, order), SITE, ["sequence"]))
    keys = ["chrom", "strand"]
    islands = held(intervals.islands(merged, keys, tol=tol))
    clustered = intervals.representatives(islands, keys, ["sequence"], sources="source").drop("cluster_start", "n_sites")
    out = clustered.select(positive_id(F.col("chrom"), F.col("pos"), F.col("strand"), F.col("sequence")).alias("id"), *SITE, "gene_name", "source", "sequence")
    return {"merged": merged, "clustered": clustered, "unique": rows.one_per_sequence(merged, SITE), "positives": out}


def sequence_length(pos: DataFrame) -> int:
    """The length of the first sequence, by site, that isn't blank; WINDOW where there is none."""
    if "sequence" not in pos.columns:
        return WINDOW
    first = pos.where(F.trim("sequence") != "").agg(F.min(F.struct(*SITE, F.length(F.trim("sequence")).alias("n")))["n"]).first()[0]
    return first or WINDOW


def negative_sites(pos: DataFrame, utrs: DataFrame, chunks: DataFrame, length: int, seed: int = 42, size: int = genomic.CHUNK) -> DataFrame:
    """chrom, pos, strand, gene_name, bucket: places for twice as many negatives as positives, in three buckets: windows shifted inside the positive's UTR
    (0), places uniform in UTRs (1), and such places with a hexamer nearby (2). The last two draw in rounds for what is missing, 20 and 40 times their target at
    most; a bucket that falls short isn't filled up by another. A site is taken once, earlier buckets first, then smaller draws. Each round's finds and what
    earlier buckets took are written, so a round reads them and no plan grows. Draws are by hash: the same rows on every run."""
    pos = held(pos)
    want = sampling.bucket_targets(pos.count())
    margin = max(60, length // 2 + 1)
    p = pos.select(*SITE).distinct()
    long = held(sampling.numbered(utrs.where(F.col("u_end") - F.col("u_start") > length + 120), ["chrom", "u_start", "u_end", "strand", "gene_name"], "u_no"))
    n_utrs = long.count()
    key = lambda *c: F.concat_ws(":", *(F.col(x).cast("string") for x in c), F.lit(str(seed)))

    own = intervals.least_covering(p, long, ["chrom", "strand"], "pos", "u_start", "u_end", u=F.struct("u_no", "u_start", "u_end", "gene_name"))
    k = key(*SITE, "attempt")
    moved = own.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("new", F.col("pos") + F.when(sampling.whole_number(k, "side", 2) == 0, 1).otherwise(-1) * (100 + sampling.whole_number(k, "offset", 301)))
    moved = moved.where((F.col("new") >= F.col("u.u_start") + margin) & (F.col("new") <= F.col("u.u_end") - margin)).select(*SITE, "attempt", "new", F.col("u.gene_name").alias("gene_name"))
    sites = held(p.select("chrom", F.col("pos").alias("new")))
    shifted = sampling.first_attempt(intervals.clear_of(moved, sites, ["chrom"], 50, "new"), SITE)
    shifted = sampling.first_rows(shifted.withColumn("key", key(*SITE)), "key", want["window"], seed).select("chrom", F.col("new").alias("pos"), "strand", "gene_name")
    shifted = held(rows.keep_first(shifted, SITE, ["gene_name"]))

    def uniform(name: str, tries: int, start: int, stop: int) -> DataFrame:
        draws = pos.sparkSession.range(start, stop).withColumnRenamed("id", "i").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
        kk = key("i", "attempt")
        placed = draws.withColumn("u_no", sampling.place_number(kk, f"{name}-utr", F.lit(n_utrs))).withColumn("at", sampling.whole_number(kk, f"{name}-place", 1 << 27)).join(long, "u_no")
        placed = placed.withColumn("new", F.col("u_start") + margin + F.col("at") % (F.col("u_end") - F.col("u_start") - 2 * margin + 1)).select("i", "attempt", "chrom", "new", "strand", "gene_name", "u_start", "u_end")
        return intervals.clear_of(placed, sites, ["chrom"], 50, "new")

    def bucket(name: str, tries: int, bound: int, before: DataFrame) -> DataFrame:
        target, stop, found, n_found = want[name] if n_utrs else 0, 0, None, 0
        while n_found < target and stop < bound * target:
            start, stop = stop, min(max(2 * target, 2 * stop), bound * target)
            t = uniform(name, tries, start, stop)
            if name == "motif":
                near = genomic.windows(t.withColumn("pos", F.col("new")), chunks, F.greatest(F.col("new") - 50, F.col("u_start")), F.least(F.col("new") + 50, F.col("u_end")), size)
                t = near.where(seq.has_hexamer(F.col("dna"))).drop("dna", "pos")
            t = sampling.first_attempt(t.drop("u_start", "u_end"), ["i"]).withColumnRenamed("new", "pos").join(before.select(*SITE), SITE, "left_anti")
            found = held(rows.keep_first(t if found is None else found.unionByName(t), SITE, ["i"]))
            n_found = found.count()
        if found is None:
            return shifted.where("false")
        if n_found > target:  # the draws' order decides: numbered by ranges of it, not sorted in one task
            found = sampling.numbered(found, ["i"], "no").where(F.col("no") < target)
        return held(found.select(*SITE, "gene_name"))

    plain = bucket("random", 4, 20, shifted)
    motif = bucket("motif", 8, 40, shifted.unionByName(plain))
    every = [t.withColumn("bucket", F.lit(b)) for b, t in enumerate((shifted, plain, motif))]
    return every[0].unionByName(every[1]).unionByName(every[2])


def negatives(pos: DataFrame, utrs: DataFrame, chunks: DataFrame, seed: int = 42, size: int = genomic.CHUNK) -> DataFrame:
    """negative_sites() with ids and sequences as long as the positives', in the columns of a dataset; their source is `negative`."""
    length = sequence_length(pos)
    every = held(negative_sites(pos, utrs, chunks, length, seed, size)).drop("bucket").withColumn("source", F.lit("negative"))
    out = genomic.pipeline_windows(every, chunks, length // 2, size, length - length // 2)
    return out.select(negative_id(F.col("chrom"), F.col("pos"), F.col("strand"), F.col("gene_name")).alias("id"), *SITE, "gene_name", "source", "sequence", F.lit(0).alias("label"))


def dataset(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """Positives and negatives with labels, upper-cased sequences and a source; null coordinates go, equal sites stay once for
    each label."""
    both = rows.shaped(pos.withColumn("label", F.lit(1)), DATASET).unionByName(rows.shaped(neg.withColumn("label", F.lit(0)), DATASET))
    both = both.na.drop(subset=SITE).withColumns({"sequence": F.upper("sequence"), "source": F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("unknown"))})
    return held(rows.keep_first(both, [*SITE, "label"], ["id", "sequence"]))


def halved(data: DataFrame, fraction: float = 0.5, tol: int = 12, rule: str = "drop_neg", seed: int = 42) -> DataFrame:
    """Exact, per-label and cross-label duplicates out, clustered in each class, balanced."""
    t = rows.keep_first(data, [*SITE, "label"], ["id"])
    t = rows.keep_first(t.where(F.col("sequence").isNotNull()), ["sequence", "label"], [*SITE, "id"]).unionByName(t.where(F.col("sequence").isNull()))
    t = held(rows.label_conflicts(held(t), rule))
    keys = ["chrom", "strand", "label"]
    t = intervals.representatives(held(intervals.islands(t, keys, tol=tol)), keys, ["id", "sequence"]).drop("cluster_start", "n_sites")
    return sampling.balanced(held(t.withColumn("key", F.concat_ws(":", *SITE))), "key", fraction, seed).drop("key").select(*DATASET)


def test_samples(full: DataFrame, half: DataFrame, n: int = 100, seed: int = 42) -> dict[str, DataFrame]:
    """Rows of full not in half by stable key; n of each class of them, together shuffled, and their heads."""
    key = lambda t: t.withColumn("stable_key", seq.stable_key(t.columns))
    rest = held(rows.remainder(key(full), key(half), "stable_key"))
    some = sampling.hash_rank(sampling.per_class(rest, "stable_key", n, seed), "stable_key", seed)
    return {"remainder": rest.drop("stable_key"), "positives": some.where("label = 1").drop("stable_key", "rank"), "negatives": some.where("label = 0").drop("stable_key", "rank"), "sample": some.drop("stable_key")}


def drawn_in_rounds(todo: DataFrame, keys: list[str], draw: Callable[[DataFrame], DataFrame], attempts: int = 32, most: int = 5000) -> DataFrame:
    """For each row of todo the first attempt that draw() lets pass: its columns are keys, attempt and what was drawn. The first
    round makes `attempts` of them, each further one twice as many, for what is still missing; a row that none of `most`
    passes for is left out."""
    todo, done, stop = held(todo), None, 0
    while done is None or (stop < most and not todo.isEmpty()):
        start, stop = stop, min(2 * stop + attempts, most)
        tries = todo.withColumn("attempt", F.explode(F.sequence(F.lit(start), F.lit(stop - 1))))
        found = held(sampling.first_attempt(draw(tries), keys))
        done = found if done is None else done.unionByName(found)
        todo = held(todo.join(found.select(*keys), keys, "left_anti"))
    return done


def generated(points: DataFrame, sizes: DataFrame, chunks: DataFrame | None = None, mask: DataFrame | None = None, k: int = 1, distance: int = 200, up: int = 200, down: int = 100, motif_aware: bool = False, reach: int = 40, motifs: tuple = seq.UPSTREAM_MOTIFS, seed: int = 42, size: int = genomic.CHUNK) -> DataFrame:
    """Positive points (chrom, pos, strand, name) and k negatives for each row of them, anywhere on its chromosome outside the buffers of `distance` around positives. On a
    chromosome that the mask has regions of, negatives lie in one of these: every region wider than one place is as likely, and in it every place,
    but for what is covered. With motif_aware no negative has one of the motifs in the `reach` bases before it (read on its strand).

    Each negative is drawn once, by rank among the free places (operators.free_space), so it is found however little is free. Points get no negative if
    their chromosome has no size over 0 or no free place, if the mask's regions there have none, or if they hold a null. Negatives may repeat. Without a
    genome sequences are empty and motifs aren't asked for."""
    screened = motif_aware and chunks is not None
    keys = ["chrom", "minus"] if screened else ["chrom"]
    sided = (lambda t: t.withColumn("minus", F.explode(F.array(F.lit(False), F.lit(True))))) if screened else (lambda t: t)
    spans = sided(points.select("chrom", (F.col("pos") - distance).alias("start"), (F.col("pos") + distance + 1).alias("end")))
    if screened:  # a hit covers the places that have it within their reach
        for minus in (False, True):
            own = tuple(m.upper().replace("U", "T")[::-1].translate(str.maketrans("ACGT", "TGCA")) for m in motifs) if minus else motifs
            hits = genomic.motif_hits(chunks, own, size)
            spans = spans.unionByName(hits.select("chrom", F.lit(minus).alias("minus"), (F.col("at") + F.col("n")).alias("start"), (F.col("at") + reach + 1).alias("end")).where("start < end"))
    runs = held(free_space.free_runs(sided(sizes.select("chrom", "length")), spans, keys))
    # equal points draw for themselves
    todo = points.select(*SITE).na.drop().groupBy(*SITE).count().withColumn("n", F.explode(F.sequence(F.lit(1), F.col("count") * k)))
    todo = todo.select(*SITE, "n", *([(F.col("strand") == "-").alias("minus")] if screened else []))
    key = F.concat_ws(":", *(F.col(c).cast("string") for c in (*SITE, "n")), F.lit(str(seed)))
    if mask is None:
        done = free_space.drawn(todo, runs, keys, key, "place", "new").withColumn("region", F.lit(""))
    else:
        regions = sided(mask.select("chrom", "start", "end", F.coalesce("region", F.lit("")).alias("region")))
        weighted = held(free_space.weighted_regions(regions, runs, keys))
        own = mask.where("chrom is not null").select("chrom").distinct()
        whole = free_space.drawn(todo.join(own, "chrom", "left_anti"), runs, keys, key, "place", "new").withColumn("region", F.lit(""))
        done = whole.unionByName(free_space.drawn_in_regions(todo.join(own, "chrom", "left_semi"), weighted, runs, keys, key, "new"))
    neg = done.select("chrom", F.col("new").alias("pos"), "strand", F.lit(0).alias("label"), F.lit("").alias("source_id"), F.col("region").alias("region_id"), F.lit("neg").alias("notes"))
    pos = points.select(*SITE, F.lit(1).alias("label"), F.col("name").alias("source_id"), F.lit("").alias("region_id"), F.lit("").alias("notes"))
    both = pos.unionByName(neg)
    both = genomic.generator_windows(both, chunks, up, down, size) if chunks is not None else both.withColumn("sequence", F.lit(""))
    return both.select(*SITE, "label", "sequence", "source_id", "region_id", "notes")


def site_features(features: DataFrame, chunks: DataFrame, contigs: DataFrame, size: int = genomic.CHUNK) -> DataFrame:
    """The 23-column feature table of 1-based features (GTF rows, BED rows as such). Rows without chrom, start, end or strand,
    or with an end before the start, are left out; contigs that the genome lacks give a null Chromosome and no bases."""
    t = features.na.drop(subset=["chrom", "start", "end", "strand"]).where("end >= start")
    t = genomic.resolved_contigs(t, contigs).withColumn("pos", F.when(F.col("strand") == "+", F.col("end")).otherwise(F.col("start")))
    t = genomic.feature_windows(t, chunks, size=size)
    t = t.withColumns({"m": seq.scan_motifs(F.col("sequence")), "b": seq.composition(F.col("sequence"))})
    named = [F.col("chrom"), F.col("start"), F.col("end"), F.col("strand"), F.col("score"), F.col("gene_id"), F.col("gene_name"), F.col("transcript_id"), F.col("feature"), F.col("transcript_biotype"), F.col("m.canonical"), F.col("m.n"), F.col("m.any")]
    named += [F.col(f"b.{c}") for c in ("A_count", "U_count", "G_count", "C_count", "A_pct", "U_pct", "G_pct", "C_pct", "GC_pct", "N_count")]
    return t.select(*(c.alias(name) for c, name in zip(named, FEATURES)))


def model_windows(df: DataFrame, width: int = 203, stride: int = 100) -> DataFrame:
    """sequence, label to seq_index-free samples: one row for each window, with win_index, len_nt and its k-mer text."""
    t = df.na.drop("any", subset=[c for c in ("chrom", "sequence", "label") if c in df.columns])
    t = t.select(*df.columns, F.posexplode(seq.sliding_windows(F.col("sequence"), width, stride)).alias("win_index", "window"))
    return t.withColumn("len_nt", F.length("window")).withColumn("tokens", seq.kmer_text(F.col("window")))


def scored(samples: DataFrame, predict: Callable[[list[str]], "pd.DataFrame"], text: str = "tokens", batch: int = 128) -> DataFrame:
    """samples with prob, from predict(texts) -> a frame of two logits, in Arrow batches. The model is the caller's."""
    return _scored(samples, lambda: predict, text, batch)


def _scored(samples: DataFrame, model: Callable[[], Callable], text: str, batch: int) -> DataFrame:
    """model() makes predict, once in each task."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema.fields)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = model()
        for pdf in parts:
            logits = pd.concat([predict(pdf[text].iloc[i : i + batch].tolist()) for i in range(0, len(pdf), batch)], ignore_index=True) if len(pdf) else pd.DataFrame({0: [], 1: []})
            yield pdf.assign(l0=logits.iloc[:, 0].to_numpy("float64"), l1=logits.iloc[:, 1].to_numpy("float64"))

    out = samples.mapInPandas(run, f"{fields}, l0 double, l1 double")
    return out.withColumn("prob", seq.positive_probability(F.col("l0"), F.col("l1"))).drop("l0", "l1")


def scored_by_model(samples: DataFrame, path: str, load: Callable[[bytes], Callable[[list[str]], "pd.DataFrame"]], text: str = "tokens", batch: int = 128, most: int = 1 << 30) -> DataFrame:
    """samples with prob, by the model in the one file at path (or in the folder path), of at most `most` bytes: Spark reads it, its size is checked before its
    content is read, and it reaches each executor once, as a broadcast. load(content) -> predict is called once in each task. Texts are dealt to
    batches by their length, so that those of a batch need little padding; a null text comes to predict as an empty one. ValueError unless there is
    exactly one file, within the bound."""
    spark = samples.sparkSession
    files = spark.read.format("binaryFile").load(path)
    found = files.select("path", "length").take(2)
    if len(found) != 1 or found[0]["length"] > most:
        raise ValueError(f"one model file of at most {most} bytes: {path} has {[f['length'] for f in found]}")
    content = spark.sparkContext.broadcast(bytes(files.select("content").first()[0]))
    own = samples.withColumn("__text", F.coalesce(F.col(text), F.lit(""))).sortWithinPartitions(F.length("__text"))
    return _scored(own, lambda: load(content.value), "__text", batch).drop("__text")


def evaluated(scores: DataFrame) -> DataFrame:
    return metrics.thresholded(scores).crossJoin(metrics.ranked(scores))


def quality_report(df: DataFrame) -> DataFrame:
    """(metric, value) of one table: rows, duplicates, neighbours, sequence lengths."""
    d = rows.duplicate_counts(df, SITE)
    s = rows.sequence_quality(df)
    n = intervals.neighbours(df, ["chrom", "strand"], 12).agg(F.count_if(F.col("n_near") > 0).alias("rows_near"), F.coalesce(F.sum("n_near"), F.lit(0)).alias("pairs_near"))
    one = d.crossJoin(s).crossJoin(n)
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns))).alias("x")).select("x.*")


def overlap_report(a: DataFrame, b: DataFrame, tol: int = 12) -> DataFrame:
    """(metric, value) of two tables: sites, exact and near overlaps, shares."""
    da, db = a.select(*SITE).distinct(), b.select(*SITE).distinct()
    counts = da.withColumn("a", F.lit(1)).join(db.withColumn("b", F.lit(1)), SITE, "full").agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"))
    pairs = intervals.band_pairs(da, db, ["chrom", "strand"], tol)
    near = pairs.agg(F.count("*").alias("near_pairs")).crossJoin(pairs.select("chrom", "strand", "pos_a").distinct().agg(F.count("*").alias("near_a"))).crossJoin(pairs.select("chrom", "strand", "pos_b").distinct().agg(F.count("*").alias("near_b")))
    one = counts.crossJoin(near).withColumns({"share_a": F.coalesce(F.try_divide("n_both", "n_a"), F.lit(0.0)), "share_b": F.coalesce(F.try_divide("n_both", "n_b"), F.lit(0.0))})
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns))).alias("x")).select("x.*")
