"""Readers for BED, GTF, PAS tables, chromosome sizes, chain files and FASTA, and writers.

Whole-line comments are skipped; a # inside a line stays. All readers are Spark's own, so any path that Spark reads will
do, .gz included; only windows by an index into a FASTA file read its bytes themselves. FASTA and chain records span lines, which Spark splits over tasks; a line gets its number in the
file by its place in its partition plus the lines of the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from helixmill.functions import sequence as seq
from helixmill.operators import intervals, sampling
from helixmill.operators.rows import shaped

BED6 = "chrom string, start long, `end` long, name string, score string, strand string"
GTF = "chrom string, source string, feature string, start long, `end` long, score string, strand string, frame string, attributes string"
CHUNK = 1 << 14


def numbered(df: DataFrame) -> DataFrame:
    """df (rows read from files) with line: consecutive numbers in the order of file names and of places in them. Two passes; the
    second adds to a row's place in its block of a file the rows of the blocks before it (one row a block). Spark deals
    blocks to tasks by size, so the order of tasks isn't that of the files."""
    t = df.withColumns({"__id": F.monotonically_increasing_id(), "__file": F.col("_metadata.file_path"), "__at": F.col("_metadata.file_block_start")})
    blocks = t.groupBy("__file", "__at").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    earlier = Window.orderBy("__file", "__at").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("__file", "__at", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__base"))
    return t.join(F.broadcast(before), ["__file", "__at"]).withColumn("line", F.col("__base") + F.col("__id")).drop("__id", "__file", "__at", "__base")


def has_chr_prefix(names: DataFrame, column: str = "chrom") -> bool:
    """Whether any name starts with chr."""
    return not names.where(F.col(column).startswith("chr")).isEmpty()


def chrom_mapper(sizes: DataFrame, names: DataFrame) -> DataFrame:
    """raw, chrom: the distinct chromosome names of `names` and their spelling in the style of `sizes`."""
    prefixed = has_chr_prefix(sizes)
    return names.select(F.col("chrom").alias("raw")).distinct().select("raw", seq.chrom_style(F.col("raw"), prefixed).alias("chrom"))


def peeked(names: DataFrame, most: int = 2000) -> DataFrame:
    """At most `most` distinct chromosome names: all of them in any genome, and no long list where a file isn't one."""
    return names.select("chrom").where("chrom is not null").distinct().limit(most)


def bed6(spark: SparkSession, path: str) -> DataFrame:
    """The first six fields of a BED file; further ones are ignored."""
    return spark.read.schema(BED6).csv(path, sep="\t", comment="#")


def bed(spark: SparkSession, path: str, skip_headers: bool = True) -> DataFrame:
    """BED of three to six fields with line; name "", score "0" and strand "+" where missing. Shorter and blank lines, comments
    and, with skip_headers, track lines are left out, and so are lines whose start or end is no number."""
    t = numbered(spark.read.text(path)).withColumn("value", F.rtrim("value"))
    t = t.where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    if skip_headers:
        t = t.where(~F.col("value").startswith("track") & ~F.col("value").startswith("browser"))
    f = F.split("value", "\t")
    field = lambda i, default: F.coalesce(F.nullif(F.try_element_at(f, F.lit(i)), F.lit("")), F.lit(default))
    t = t.where(F.size(f) >= 3).select("line", f[0].alias("chrom"), F.expr("try_cast(split(value, '\t')[1] as bigint)").alias("start"), F.expr("try_cast(split(value, '\t')[2] as bigint)").alias("end"), field(4, "").alias("name"), field(5, "0").alias("score"), field(6, "+").alias("strand"))
    return t.where(F.col("start").isNotNull() & F.col("end").isNotNull())


def _kept(t: DataFrame, prefixed: bool, primary_only: bool, skip_alt: bool) -> DataFrame:
    t = t.withColumn("chrom", seq.chrom_style(F.col("chrom"), prefixed))
    if primary_only:
        t = t.where(seq.with_chr(F.col("chrom")).isin(*seq.CANONICAL))
    return t.where(~seq.is_alternative(F.col("chrom"))) if skip_alt else t


def bed_points(spark: SparkSession, path: str, prefixed: bool = True, primary_only: bool = False, skip_alt: bool = False, assume_plus: bool = True) -> DataFrame:
    """chrom, pos, strand, name: the cleavage position end - 1 on plus, start on minus. Rows without a strand count as plus or,
    with assume_plus off, are left out."""
    t = _kept(bed(spark, path), prefixed, primary_only, skip_alt)
    t = t.withColumn("strand", seq.default_strand(F.col("strand"))) if assume_plus else t.where(F.col("strand").isin("+", "-"))
    return t.select("chrom", seq.cleavage_generator(F.col("start"), F.col("end"), F.col("strand")).alias("pos"), "strand", "name")


def bed_regions(spark: SparkSession, path: str, prefixed: bool = True, primary_only: bool = False, skip_alt: bool = False) -> DataFrame:
    """chrom, start, end, region: its name, or region_k where it has none, for the k-th kept line (from 0)."""
    t = _kept(bed(spark, path), prefixed, primary_only, skip_alt)
    t = sampling.numbered(t, ["line"], "k")  # by ranges of lines, not in one task
    return t.withColumn("region", F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("region_"), F.col("k").cast("string")))).select("chrom", "start", "end", "region")


# What rows of a BED file are called among features.
BED_SOURCE, BED_FEATURE, BED_ATTRIBUTES = "PolyASite2", "polyA_site", 'name "%s"; dataset "human_polyAsite";'


def bed_as_features(spark: SparkSession, path: str) -> DataFrame:
    """BED as 1-based feature rows, their names in attributes; gene and transcript are empty."""
    t = bed6(spark, path).withColumn("start", F.col("start") + 1)
    text = F.format_string(BED_ATTRIBUTES, F.coalesce("name", F.lit("")))
    empty = [F.lit("").alias(c) for c in ("gene_id", "gene_name", "transcript_id", "transcript_biotype")]
    return t.select("chrom", F.lit(BED_SOURCE).alias("source"), F.lit(BED_FEATURE).alias("feature"), "start", "end", "score", "strand", text.alias("attributes"), *empty)


def gtf(spark: SparkSession, path: str, features: tuple[str, ...] | None = None) -> DataFrame:
    """GTF rows (1-based, both ends in) with gene_id, gene_name, gene_type (gene_biotype where missing), transcript_id and
    transcript_biotype."""
    t = spark.read.schema(GTF).csv(path, sep="\t", comment="#", quote="")
    t = t.where(F.col("feature").isin(*features)) if features else t
    a = F.col("attributes")
    kind = F.coalesce(F.nullif(seq.attribute(a, "gene_type"), F.lit("")), seq.attribute(a, "gene_biotype"))
    return t.withColumns({"gene_id": seq.attribute(a, "gene_id"), "gene_name": seq.attribute(a, "gene_name"), "gene_type": kind, "transcript_id": seq.attribute(a, "transcript_id"), "transcript_biotype": seq.attribute(a, "transcript_biotype")})


def genes(spark: SparkSession, path: str, canonical_only: bool = True) -> DataFrame:
    """chrom, g_start, g_end, strand, gene_id, gene_name, gene_type and ord, the order of the file."""
    t = numbered(gtf(spark, path, ("gene",))).withColumn("chrom", seq.with_chr(F.col("chrom")))
    t = t.where(F.col("chrom").isin(*seq.CANONICAL)) if canonical_only else t
    return t.select("chrom", F.col("start").alias("g_start"), F.col("end").alias("g_end"), "strand", "gene_id", "gene_name", "gene_type", F.col("line").alias("ord"))


def utrs(spark: SparkSession, path: str, distinct: bool = False) -> DataFrame:
    """Half-open 3'UTRs, one for each transcript's record, or each span once."""
    t = gtf(spark, path, ("three_prime_UTR", "three_prime_utr")).select("chrom", "strand", (F.col("start") - 1).alias("u_start"), F.col("end").alias("u_end"), "gene_name")
    return t.distinct() if distinct else t


# The accepted spellings of a PAS table's columns.
PAS_COLUMNS = {"chrom": ("chr", "chrom", "chromosome"), "pos": ("pos", "position", "site", "pas"), "strand": ("strand", "str"), "start": ("start",), "end": ("end",)}


def pas_table(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, strand of a headed TSV, its columns found by name, whatever their case: pos, or else start and end. An error
    without chromosome, strand or position columns."""
    t = spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=False)
    names = {c.strip().lower(): c for c in t.columns}
    found = {k: next((names[a] for a in aliases if a in names), None) for k, aliases in PAS_COLUMNS.items()}
    if not (found["chrom"] and found["strand"]) or not (found["pos"] or (found["start"] and found["end"])):
        raise ValueError(f"no chromosome, strand or position columns among {t.columns}")
    number = lambda k: F.expr(f"try_cast(`{found[k]}` as bigint)")
    strand = seq.normal_strand(F.col(f"`{found['strand']}`"))
    pos = number("pos") if found["pos"] else seq.cleavage_pipeline(number("start"), number("end"), strand)
    return t.select(seq.with_chr(F.col(f"`{found['chrom']}`")).alias("chrom"), pos.alias("pos"), strand.alias("strand")).na.drop(subset=["chrom", "pos"])


def chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length. An error where the file has none."""
    f = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#")).where(F.size(f) >= 2).select(f[0].alias("chrom"), f[1].cast("long").alias("length"))
    if t.isEmpty():
        raise ValueError(f"no chromosome sizes in {path}")
    return t


def chain_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The aligned blocks of a chain file: src_chrom, src_start, src_end (half-open), dst_chrom, dst_start, dst_strand, score.
    On a minus target dst_start is the forward position of the block's first base. A chain's blocks lie where the sums
    of the sizes and gaps before them say, which run over the chain's own lines, whatever the file."""
    t = numbered(spark.read.text(path)).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    t = t.withColumn("tile", F.floor(F.col("line") / CHUNK))
    last = F.max(F.when(F.col("value").startswith("chain"), F.col("line")))
    carried = t.groupBy("tile").agg(last.alias("l")).withColumn("open", F.max("l").over(Window.orderBy("tile").rowsBetween(Window.unboundedPreceding, -1))).drop("l")
    inside = Window.partitionBy("tile").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("own", F.max(F.when(F.col("value").startswith("chain"), F.col("line"))).over(inside)).join(carried, "tile").withColumn("chain", F.coalesce("own", "open"))

    f = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+")
    t = t.where("chain is not null").select("chain", "line", f.alias("f"), (F.col("line") == F.col("chain")).alias("is_head"))
    number = lambda i: F.col("f")[i].cast("long")
    moves = ~F.col("is_head") & (F.size("f") > 1)
    t = t.withColumns({"src_step": F.when(moves, number(0) + number(1)), "dst_step": F.when(moves, number(0) + number(2)), "h": F.when(F.col("is_head"), F.col("f"))})
    before = Window.partitionBy("chain").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    gone = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    t = t.withColumns({"head": F.first("h", ignorenulls=True).over(before), "src_gone": gone("src_step"), "dst_gone": gone("dst_step")}).where(~F.col("is_head"))
    h = F.col("head")
    src, dst = h[5].cast("long") + F.col("src_gone"), h[10].cast("long") + F.col("dst_gone")
    first = F.when(h[9] == "+", dst).otherwise(h[8].cast("long") - 1 - dst)
    return t.select(h[2].alias("src_chrom"), src.alias("src_start"), (src + number(0)).alias("src_end"), h[7].alias("dst_chrom"), first.alias("dst_start"), h[9].alias("dst_strand"), h[1].cast("long").alias("score"))


def fasta_chunks(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """chrom, chunk, sequence: a genome as chunks of `size` bases, the last one of a contig shorter. Each line learns its
    contig and its first base from the lines before it, a tile of lines at a time."""
    t = numbered(spark.read.text(path)).withColumn("value", F.trim("value")).withColumn("tile", F.floor(F.col("line") / 4096))
    head = F.col("value").startswith(">")
    mark = F.when(head, F.struct("line", F.split(F.substring("value", 2, 1 << 20), r"\s+")[0].alias("chrom")))
    inside = Window.partitionBy("tile").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    tiles = t.groupBy("tile").agg(F.max(mark).alias("l")).select("tile", F.max("l").over(earlier).alias("open"))
    t = t.withColumn("own", F.max(mark).over(inside)).join(tiles, "tile").withColumn("contig", F.coalesce("own", "open")).where(~head & (F.col("value") != "") & F.col("contig").isNotNull())
    t = t.select("line", "tile", F.col("contig.chrom").alias("chrom"), F.col("contig.line").alias("head"), "value", F.length("value").cast("long").alias("n"))
    per_tile = t.groupBy("head", "tile").agg(F.sum("n").alias("s")).select("head", "tile", F.coalesce(F.sum("s").over(Window.partitionBy("head").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("head", "tile").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("before", before).join(per_tile, ["head", "tile"]).withColumn("first", F.col("base") + F.col("before"))
    spread = t.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("first") / size), F.floor((F.col("first") + F.col("n") - 1) / size))))
    lo, hi = F.greatest("first", F.col("chunk") * size), F.least(F.col("first") + F.col("n"), (F.col("chunk") + 1) * size)
    piece = F.substring(F.col("value"), (lo - F.col("first") + 1).cast("int"), (hi - lo).cast("int"))
    parts = spread.groupBy("chrom", "chunk").agg(F.array_sort(F.collect_list(F.struct(lo.alias("at"), piece.alias("p")))).alias("parts"))  # a chunk's lines
    return parts.select("chrom", "chunk", F.array_join(F.transform("parts", lambda x: x["p"]), "").alias("sequence"))


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """chrom, bases, offset, line_bases, line_width, file: where each contig's bases lie in its file, as a .fai index has it. One pass
    over the text, best written once and read for every later question. A contig lies in one file; of contigs of one name the first
    counts. Lines of a contig but its last are equally long; where they aren't, and for compressed files, the query fails."""
    t = spark.read.option("lineSep", "\n").text(path).withColumn("file", F.col("_metadata.file_path"))
    t = numbered(t).withColumns({"tile": F.floor(F.col("line") / 4096), "w": F.octet_length("value") + 1, "value": F.rtrim("value", F.lit("\r"))})
    head = F.col("value").startswith(">")
    mark = F.when(head, F.struct("line", F.split(F.substring("value", 2, 1 << 20), r"\s+")[0].alias("chrom")))
    earlier = Window.partitionBy("file").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    tiles = t.groupBy("file", "tile").agg(F.max(mark).alias("l"), F.sum("w").alias("s"))  # a row for 4096 lines
    tiles = tiles.select("file", "tile", F.max("l").over(earlier).alias("open"), F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "tile").orderBy("line")
    t = t.withColumn("own", F.max(mark).over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.coalesce(F.sum("w").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.join(tiles, ["file", "tile"]).withColumn("contig", F.coalesce("own", "open")).where("contig is not null")
    some = ~head & (F.col("value") != "")
    line = F.when(some, F.struct("line", F.length("value").cast("long").alias("b"), F.col("w").cast("long").alias("w"), (F.col("base") + F.col("before")).alias("at")))
    g = t.groupBy("file", "contig").agg(F.min(line).alias("f"), F.max(line).alias("l"), F.count(line).alias("k"), F.sum(line["b"]).alias("b"), F.sum(line["w"]).alias("w"), F.max(line["b"]).alias("most"), F.max(line["w"] - line["b"]).alias("odd"))
    alike = (F.col("b") - F.col("l.b") == (F.col("k") - 1) * F.col("f.b")) & (F.col("w") - F.col("l.w") == (F.col("k") - 1) * F.col("f.w")) & (F.col("most") == F.col("f.b"))
    fine = F.col("f").isNull() | (alike & (F.col("l.line") - F.col("f.line") + 1 == F.col("k")) & (F.col("odd") <= 2))
    fine &= ~F.col("file").rlike(r"\.(gz|bz2|zst|lz4|snappy|deflate)$")
    bases = F.when(fine, F.coalesce("b", F.lit(0))).otherwise(F.raise_error(F.concat(F.lit("no index for contig "), F.col("contig.chrom"), F.lit(" of "), F.col("file"))))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    found = F.struct("file", zero("f.at").alias("offset"), bases.cast("long").alias("bases"), zero("f.b").alias("line_bases"), zero("f.w").alias("line_width"))
    return g.groupBy(F.col("contig.chrom").alias("chrom")).agg(F.min(F.struct("contig.line", found.alias("x"))).alias("i")).select("chrom", *(f"i.x.{c}" for c in ("bases", "offset", "line_bases", "line_width", "file")))


def fai(spark: SparkSession, fasta: str) -> DataFrame:
    """The columns of fasta_index from the index file beside `fasta` (its name and .fai), as other tools write it."""
    t = spark.read.csv(f"{fasta}.fai", sep="\t", schema="chrom string, bases long, offset long, line_bases long, line_width long")
    return t.withColumn("file", F.lit(fasta))


#: Bytes between two ranges that are read along rather than skipped, and bytes of one read of several ranges.
RANGE_GAP, RANGE_MOST = 1 << 14, 1 << 23


def fasta_ranges(need: DataFrame, index: DataFrame) -> DataFrame:
    """need: distinct (chrom, __from, __to), not below 0. Returns them, cut off at the contig's end, with dna and n_read, the bytes that were read for
    this and the ranges that follow close by. Ranges are sorted by file and place, so a task reads forward in a few
    files; nothing but coordinates is shuffled. Files are opened by pyarrow, so they must be where it can read."""
    n = need.join(index, "chrom").withColumn("end", F.least("__to", "bases")).where("__from < end")
    place = lambda c: F.col("offset") + F.floor(c / F.col("line_bases")) * F.col("line_width") + c % F.col("line_bases")
    n = n.select("chrom", "__from", "__to", "file", place(F.col("__from")).cast("long").alias("first"), (place(F.col("end") - 1) + 1).cast("long").alias("stop"))

    def read(batches):
        import re

        import pyarrow as pa
        from pyarrow import fs

        name = stream = None
        for b in batches:
            files, first, stop = (b.column(k).to_pylist() for k in (3, 4, 5))
            dna, cost, k = [], [], 0
            while k < len(files):
                e, to = k + 1, stop[k]
                while e < len(files) and files[e] == files[k] and first[e] <= to + RANGE_GAP and max(to, stop[e]) - first[k] <= RANGE_MOST:
                    to, e = max(to, stop[e]), e + 1
                if files[k] != name:
                    if stream:
                        stream.close()
                    name = files[k]
                    where, own = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                    stream = where.open_input_file(own)
                data = stream.read_at(to - first[k], first[k])
                dna += [data[first[i] - first[k] : stop[i] - first[k]].translate(None, b"\r\n").decode("utf-8", "replace") for i in range(k, e)]
                cost += [len(data)] + [0] * (e - k - 1)
                k = e
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(dna, pa.string()), pa.array(cost, pa.int64())], ["chrom", "__from", "__to", "dna", "n_read"])
        if stream:
            stream.close()

    return n.repartitionByRange("file", "first").sortWithinPartitions("file", "first").mapInArrow(read, "chrom string, __from long, __to long, dna string, n_read long")


def windows(points: DataFrame, chunks: DataFrame, start: Column, end: Column, size: int = CHUNK) -> DataFrame:
    """points with dna: bases [start, end) of their chrom, cut off at the contig's ends; empty where the contig is unknown. chunks: the
    genome's chunks, or its index, by which only the bytes of the windows are read.
    Windows meet the chunks they touch by an equi-join; only coordinates are shuffled with the chunks. Each window is made once, and points
    get it by its coordinates, so nothing depends on how rows are numbered."""
    p = points.withColumns({"__from": F.greatest(start, F.lit(0)).cast("long"), "__to": end.cast("long")})
    need = p.where("__to > __from").select("chrom", "__from", "__to").distinct()
    if "line_bases" in chunks.columns:
        got = fasta_ranges(need, chunks).select(F.col("chrom").alias("__chrom"), F.col("__from").alias("__f"), F.col("__to").alias("__t"), "dna")
    else:
        need = need.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("__from") / size), F.floor((F.col("__to") - 1) / size))))
        lo = F.greatest("__from", F.col("chunk") * size)
        piece = F.substring(F.col("__s"), (lo - F.col("chunk") * size + 1).cast("int"), (F.col("__to") - lo).cast("int"))
        got = need.join(chunks.select("chrom", "chunk", F.col("sequence").alias("__s")), ["chrom", "chunk"]).groupBy(F.col("chrom").alias("__chrom"), F.col("__from").alias("__f"), F.col("__to").alias("__t"))
        got = got.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("p")))), lambda x: x["p"]), "").alias("dna"))
    on = (F.col("chrom") == F.col("__chrom")) & (F.col("__from") == F.col("__f")) & (F.col("__to") == F.col("__t"))
    return p.join(got, on, "left").withColumn("dna", F.coalesce("dna", F.lit(""))).drop("__chrom", "__from", "__to", "__f", "__t")


def motif_hits(chunks: DataFrame, motifs: tuple[str, ...], size: int = CHUNK) -> DataFrame:
    """chrom, at, n: each place (of the first base, from 0) where a motif of n bases lies, overlapping ones too; upper and lower case and U and T are equal.
    A chunk borrows the bases that it needs from the next one's beginning. The text is cut before every hit, so positions are sums of lengths."""
    wanted = {m.upper().replace("U", "T") for m in motifs if m}
    longest = max(map(len, wanted), default=1)
    if longest > size:
        raise ValueError(f"motifs of at most a chunk of {size} bases")
    s = chunks.select("chrom", "chunk", F.translate(F.upper("sequence"), "U", "T").alias("s"))
    heads = s.select(F.col("chrom").alias("__c"), (F.col("chunk") - 1).alias("__k"), F.substring("s", 1, longest - 1).alias("head"))
    s = s.join(heads, (F.col("chrom") == F.col("__c")) & (F.col("chunk") == F.col("__k")), "left").select("chrom", "chunk", F.length("s").alias("own"), F.concat("s", F.coalesce("head", F.lit(""))).alias("s"))
    out = None
    for n in sorted(set(map(len, wanted))):
        some = "|".join(sorted(m for m in wanted if len(m) == n))
        t = s.select("chrom", "chunk", "own", F.col("s").rlike(f"^(?:{some})").alias("begins"), F.posexplode(F.split("s", f"(?={some})")).alias("i", "piece"))
        before = F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy("chrom", "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        t = t.withColumn("before", before).where((F.col("i") > 0) | F.col("begins")).where("before < own").select("chrom", (F.col("chunk") * size + F.col("before")).alias("at"), F.lit(n).alias("n"))
        out = t if out is None else out.unionByName(t)
    return out if out is not None else s.select("chrom", F.col("chunk").alias("at"), F.lit(0).alias("n")).where("false")


def pipeline_windows(points: DataFrame, chunks: DataFrame, left: int = 101, size: int = CHUNK, right: int = 102) -> DataFrame:
    """[pos - left, pos + right), reverse-complemented on minus: 203 bases away from a contig's ends."""
    t = windows(points, chunks, F.col("pos") - left, F.col("pos") + right, size)
    return t.withColumn("sequence", F.when(F.col("strand") == "-", seq.reverse_complement(F.col("dna"))).otherwise(F.col("dna"))).drop("dna")


def generator_windows(points: DataFrame, chunks: DataFrame, up: int = 200, down: int = 100, size: int = CHUNK, strand_aware: bool = False) -> DataFrame:
    """[pos - up, pos + down) on the genome, upper-cased, reverse-complemented on minus; strand_aware counts upstream along
    the strand."""
    minus = F.lit(strand_aware) & (F.col("strand") == "-")
    start = F.when(minus, F.col("pos") - down + 1).otherwise(F.col("pos") - up)
    t = windows(points, chunks, start, F.when(minus, F.col("pos") + up + 1).otherwise(F.col("pos") + down), size)
    dna = seq.upper_acgtn(F.col("dna"))
    return t.withColumn("sequence", F.when(F.col("strand") == "-", seq.reverse_complement(dna)).otherwise(dna)).drop("dna")


def feature_windows(points: DataFrame, chunks: DataFrame, up: int = 50, down: int = 49, size: int = CHUNK) -> DataFrame:
    """RNA of 1-based [cut - up, cut + down], reverse-complemented where the strand isn't +."""
    t = windows(points, chunks, F.greatest(F.col("pos") - up, F.lit(1)) - 1, F.col("pos") + down, size)
    dna = F.upper("dna")
    rna = F.translate(F.when(F.col("strand") == "+", dna).otherwise(seq.reverse_complement(dna)), "T", "U")
    return t.withColumn("sequence", rna).drop("dna")


def resolved_contigs(points: DataFrame, contigs: DataFrame) -> DataFrame:
    """points whose chrom is spelt as among contigs (column contig): as it is, without or with chr, then the spellings of the
    mitochondrion; null where none fits."""
    c = F.trim("chrom")
    options = F.array_distinct(F.array(c, F.regexp_replace(c, "^chr", ""), F.when(~c.startswith("chr"), F.concat(F.lit("chr"), c)), F.when(c == "chrM", "MT"), F.when(c == "chrM", "M"), F.when(c.isin("M", "MT"), "chrM")))
    names = points.select("chrom").distinct().select("chrom", F.posexplode(options).alias("k", "contig"))
    found = names.join(contigs, "contig").groupBy("chrom").agg(F.min_by("contig", "k").alias("contig"))
    return points.join(found, "chrom", "left").withColumn("chrom", F.col("contig")).drop("contig")


def first_existing(spark: SparkSession, paths: list[str]) -> str:
    """The first path that exists, asked of Spark's own file systems."""
    jvm = spark._jvm
    for p in paths:
        h = jvm.org.apache.hadoop.fs.Path(p)
        if h.getFileSystem(spark._jsc.hadoopConfiguration()).exists(h):
            return p
    raise FileNotFoundError(f"none of {paths}")


def overlapping(a: DataFrame, b: DataFrame, tile: int = 1 << 10) -> DataFrame:
    """Pairs of half-open spans (chrom, a_start, a_end) and (chrom, b_start, b_end) that overlap, each once."""
    return intervals.overlapping(a, b, ["chrom"], tile)


def headed_csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """A headed CSV. With columns (name: type) exactly these, in this order: those that the file lacks are null, and so are
    values that don't cast. Without, types are inferred."""
    read = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    return shaped(read.csv(path), columns) if columns else read.option("inferSchema", True).csv(path)


def training_rows(spark: SparkSession, path: str) -> DataFrame:
    """sequence, label and, where there is one, chrom of a headed CSV, rows with a null among them left out; only these
    columns are parsed."""
    t = spark.read.option("header", True).csv(path)
    kept = [c for c in ("sequence", "label", "chrom") if c in t.columns]
    return t.select(*(F.expr("try_cast(label as int)").alias(c) if c == "label" else F.col(c) for c in kept)).na.drop("any")


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

