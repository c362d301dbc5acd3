import gzip
import random

import pytest
from pyspark.sql import functions as F

from helixmill.plans import pipelines
from helixmill.sources import genomic

RNG = random.Random(4)
GENOME = {c: "".join(RNG.choice("ACGT") for _ in range(n)) for c, n in (("chr1", 5000), ("chr2", 777))}


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
    return str(p)


def fasta(tmp_path):
    return write(tmp_path, "g.fa", "".join(f">{c} note\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for c, s in GENOME.items()))


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_bed(spark, tmp_path):
    p = write(tmp_path, "a.bed", "# c\ntrack x\nchr1\t10\t20\nchr1\t1\n\n2\t5\t9\tn#1\t7\t-\nchrM\tx\t9\nMT\t1\t4\t\t\t.\n")
    got = [tuple(r)[1:] for r in genomic.bed(spark, p).orderBy("line").collect()]
    assert got == [("chr1", 10, 20, "", "0", "+"), ("2", 5, 9, "n#1", "7", "-"), ("MT", 1, 4, "", "0", ".")]
    assert [tuple(r) for r in genomic.bed_points(spark, p).orderBy("pos").collect()] == [("chrM", 3, "+", ""), ("chr2", 5, "-", "n#1"), ("chr1", 19, "+", "")]
    assert [r.region for r in genomic.bed_regions(spark, p).orderBy("start").collect()] == ["region_2", "n#1", "region_0"]


def test_gtf_and_utrs(spark, tmp_path):
    p = write(tmp_path, "a.gtf.gz", '#!x\n1\ts\tgene\t5\t9\t.\t+\t.\tgene_id "G1"; gene_name "N1"; gene_biotype "b";\nchrU_1\ts\tgene\t5\t9\t.\t+\t.\tgene_id "G2";\nchr1\ts\tthree_prime_UTR\t5\t9\t.\t-\t.\tgene_name "N";\n')
    g = genomic.genes(spark, p).collect()
    assert [(r.chrom, r.g_start, r.g_end, r.gene_id, r.gene_type) for r in g] == [("chr1", 5, 9, "G1", "b")]
    assert [(r.chrom, r.u_start, r.u_end) for r in genomic.utrs(spark, p).collect()] == [("chr1", 4, 9)]


def test_fasta_windows(spark, tmp_path):
    chunks = genomic.fasta_chunks(spark, fasta(tmp_path), 128)
    whole = {}
    for r in chunks.orderBy("chrom", "chunk").collect():
        whole[r.chrom] = whole.get(r.chrom, "") + r.sequence
    assert whole == GENOME
    points = spark.createDataFrame([("chr1", 300, "+"), ("chr1", 300, "-"), ("chr2", 5, "+"), ("chr9", 5, "+")], "chrom string, pos long, strand string")
    got = {(r.chrom, r.pos, r.strand): r.sequence for r in genomic.pipeline_windows(points, chunks, size=128).collect()}
    s = GENOME["chr1"][199:402]
    assert got == {("chr1", 300, "+"): s, ("chr1", 300, "-"): revcomp(s), ("chr2", 5, "+"): GENOME["chr2"][:107], ("chr9", 5, "+"): ""}
    gen = genomic.generator_windows(points.where("pos = 300"), chunks, size=128).collect()
    assert {len(r.sequence) for r in gen} == {300}
    assert {len(r.sequence) for r in genomic.feature_windows(points.where("pos = 300"), chunks, size=128).collect()} == {100}


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_fasta_by_index(spark, tmp_path, newline):
    genome = {c: "".join(RNG.choice("ACGTacgtN") for _ in range(n)) for c, n in (("chr1", 300_000), ("chr2", 120), ("chr3", 1), ("chr4", 0), ("chr5", 61))}
    text = "".join(f">{c} note{newline}" + "".join(s[i : i + 60] + newline for i in range(0, len(s), 60)) for c, s in genome.items())
    folder = tmp_path / "with space"
    folder.mkdir()
    path = write(folder, "g.fa", text + newline + f">chr1 again{newline}AC")
    index = genomic.fasta_index(spark, path)
    got = {r.chrom: r for r in index.collect()}
    assert {c: r.bases for c, r in got.items()} == {c: len(s) for c, s in genome.items()}
    assert all(got[c].offset == text.index(f">{c} ") + len(f">{c} note{newline}") for c in genome if c != "chr4")
    places = [("chr1", a, b) for a, b in ((0, 1), (59, 61), (60, 60), (61, 59), (-5, 3), (299_990, 300_020), (150_000, 150_203), (400_000, 400_010))]
    places += [("chr2", 0, 200), ("chr2", 119, 120), ("chr3", 0, 9), ("chr4", 0, 9), ("chr5", 60, 61), ("chr9", 0, 5), (None, 0, 5)]
    points = spark.createDataFrame([*places, places[0]], "chrom string, a long, b long")
    want = sorted((c or "", a, b, genome.get(c, "")[max(a, 0) : b] if b > a else "") for c, a, b in [*places, places[0]])
    rows = genomic.windows(points, index, F.col("a"), F.col("b")).collect()
    assert sorted((r.chrom or "", r.a, r.b, r.dna) for r in rows) == want
    need = points.where("b > a and a >= 0").selectExpr("chrom", "a as __from", "b as __to").distinct()
    read = genomic.fasta_ranges(need, index).agg(F.sum("n_read")).first()[0]
    assert 0 < read < len(text) / 10
    write(folder, "g.fa.fai", "".join(f"{r.chrom}\t{r.bases}\t{r.offset}\t{r.line_bases}\t{r.line_width}\n" for r in got.values()))
    by_file = genomic.fai(spark, path).withColumn("file", F.lit(got["chr1"].file))
    assert sorted((r.chrom or "", r.a, r.b, r.dna) for r in genomic.windows(points, by_file, F.col("a"), F.col("b")).collect()) == want


@pytest.mark.parametrize("name, lines", [("g.fa", ">a\nACG\nAC\nACG\n"), ("g.fa", ">a\nAC\nACG\n"), ("g.fa", ">a\nAC\n\nAC\n"), ("g.fa.gz", ">a\nAC\n")])
def test_fasta_without_an_index(spark, tmp_path, name, lines):
    with pytest.raises(Exception, match="no index for contig a"):
        genomic.fasta_index(spark, write(tmp_path, name, lines)).collect()


def test_chain_and_sizes(spark, tmp_path):
    p = write(tmp_path, "a.chain", "chain 100 chr1 1000 + 10 60 chr2 2000 + 100 160 1\n20 5 15\n25\n\nchain 7 chr1 1000 + 500 510 chr3 300 - 20 30 2\n10\n")
    got = sorted(tuple(r) for r in genomic.chain_blocks(spark, p).collect())
    assert got == [("chr1", 10, 30, "chr2", 100, "+", 100), ("chr1", 35, 60, "chr2", 135, "+", 100), ("chr1", 500, 510, "chr3", 279, "-", 7)]
    sizes = genomic.chrom_sizes(spark, write(tmp_path, "s", "chr1 5000\nchr2\t777\n"))
    assert {r.chrom: r.length for r in sizes.collect()} == {"chr1": 5000, "chr2": 777}


def test_pas_table(spark, tmp_path):
    p = write(tmp_path, "p.tsv", "Chromosome\tStart\tEnd\tStr\n1\t5\t9\t+\nchr1\t5\t9\tminus\n1\tx\ty\t+\n")
    assert sorted(tuple(r) for r in genomic.pas_table(spark, p).collect()) == [("chr1", 5, "-"), ("chr1", 9, "+")]
    with pytest.raises(ValueError):
        genomic.pas_table(spark, write(tmp_path, "q.tsv", "Chromosome\tPos\n1\t5\n"))


def test_pipelines_end_to_end(spark, tmp_path):
    chunks = genomic.fasta_chunks(spark, fasta(tmp_path), 512)
    genes = spark.createDataFrame([("chr1", 100, 4800, "+", "G1", "N1", "t", 0), ("chr1", 900, 950, "+", "G2", "N2", "t", 1)], "chrom string, g_start long, g_end long, strand string, gene_id string, gene_name string, gene_type string, ord long")
    a = spark.createDataFrame([("chr1", 930, "+"), ("chr1", 2000, "+"), ("chr1", 2005, "+"), ("chr2", 400, "-")], "chrom string, pos long, strand string")
    left = pipelines.annotated_sites(a, genes, chunks, "A", size=512)
    assert {r.pos: r.gene_name for r in left.collect()} == {930: "N2", 2000: "N1", 2005: "N1", 400: ""}
    right = pipelines.annotated_sites(a.where("pos = 930"), genes, chunks, "B", size=512)
    out = pipelines.positives(left, right)
    pos = out["positives"]
    assert {r.pos: r.source for r in pos.collect()} == {930: "A,B", 2000: "A", 400: "A"}
    utrs = spark.createDataFrame([("chr1", "+", 100, 4800, "N1"), ("chr2", "-", 1, 770, "N3")], "chrom string, strand string, u_start long, u_end long, gene_name string")
    neg = pipelines.negatives(pos, utrs, chunks, size=512)
    rows = neg.collect()
    assert rows and all(abs(r.pos - p) > 50 for r in rows for p in (930, 2000) if r.chrom == "chr1")
    assert {tuple(r) for r in rows} == {tuple(r) for r in neg.collect()}  # the same draws again
    data = pipelines.dataset(pos, neg)
    assert data.where("label = 1").count() == 3 and data.columns == list(pipelines.DATASET)
    half = pipelines.halved(data)
    n = {r.label: r["count"] for r in half.groupBy("label").count().collect()}
    assert n[0] == n[1]
    rest = pipelines.test_samples(data, half)
    assert rest["remainder"].count() == data.count() - half.count()


def test_negatives_fill_dense_buckets(spark, tmp_path):
    chunks = genomic.fasta_chunks(spark, fasta(tmp_path), 512)
    sites = [("chr1", p, "+", "N1", "A", "ACGT") for p in range(150, 4800, 108)]
    pos = spark.createDataFrame(sites, "chrom string, pos long, strand string, gene_name string, source string, sequence string")
    utrs = spark.createDataFrame([("chr1", "+", 100, 4800, "N1")], "chrom string, strand string, u_start long, u_end long, gene_name string")
    assert {r.source for r in pipelines.negatives(pos, utrs, chunks, size=512).collect()} == {"negative"}
    neg = pipelines.negative_sites(pos, utrs, chunks, 4, size=512).collect()
    n = len([r for r in neg if r.bucket == 1])
    assert n == int(0.35 * 2 * len(sites)) and len({r.pos for r in neg}) == len(neg)
    assert all(abs(r.pos - p) > 50 for r in neg for _, p, *_ in sites)


def test_generator(spark, tmp_path):
    chunks = genomic.fasta_chunks(spark, fasta(tmp_path), 512)
    points = spark.createDataFrame([("chr1", 1000, "+", "a"), ("chr1", 3000, "-", "b")], "chrom string, pos long, strand string, name string")
    sizes = spark.createDataFrame([("chr1", 5000)], "chrom string, length long")
    got = pipelines.generated(points, sizes, chunks, k=3, size=512).collect()
    neg = [r for r in got if r.label == 0]
    assert len(got) - len(neg) == 2 and len(neg) == 6
    assert all(abs(r.pos - p) > 200 for r in neg for p in (1000, 3000))
    mask = spark.createDataFrame([("chr1", 4000, 4100, "m")], "chrom string, start long, end long, region string")
    masked = [r for r in pipelines.generated(points, sizes, None, mask).collect() if r.label == 0]
    assert masked and all(4000 <= r.pos < 4100 and r.region_id == "m" for r in masked)


def test_generator_goes_on_for_misses(spark):
    points = spark.createDataFrame([("chr1", p, "+", "a") for p in range(200, 40_000, 401)], "chrom string, pos long, strand string, name string")
    sizes = spark.createDataFrame([("chr1", 40_300)], "chrom string, length long")  # the buffers leave a few places at its end
    neg = [r.pos for r in pipelines.generated(points, sizes).collect() if r.label == 0]
    free = [p for p in range(40_300) if all(abs(p - q) > 200 for q in range(200, 40_000, 401))]
    assert 0 < len(free) < 400 and len(neg) == points.count() and set(neg) <= set(free)


def test_generator_reaches_all_of_a_long_chromosome(spark):
    points = spark.createDataFrame([("chr1", 1000 * i, "+", "a") for i in range(1, 41)], "chrom string, pos long, strand string, name string")
    sizes = spark.createDataFrame([("chr1", 1 << 29)], "chrom string, length long")
    mask = spark.createDataFrame([("chr1", 1 << 20, 1 << 29, "m")], "chrom string, start long, end long, region string")
    for m in (None, mask):
        neg = [r.pos for r in pipelines.generated(points, sizes, None, m, k=5).collect() if r.label == 0]
        assert len(neg) == 200 and all(0 <= p < 1 << 29 for p in neg)
        assert all(any(q * (1 << 27) <= p < (q + 1) * (1 << 27) for p in neg) for q in range(4))


@pytest.mark.parametrize("kind", ["parquet", "bed"])
def test_generator_reads_files(spark, tmp_path, kind):
    points = spark.createDataFrame([("chr1", 1000, "+", "a"), ("chr1", 3000, "-", "b")], "chrom string, pos long, strand string, name string")
    sizes = spark.createDataFrame([("chr1", 5000)], "chrom string, length long")
    if kind == "parquet":
        points.write.parquet(str(tmp_path / "p"))
        filed = spark.read.parquet(str(tmp_path / "p"))
    else:
        filed = genomic.bed_points(spark, write(tmp_path, "p.bed", "chr1\t990\t1001\ta\t0\t+\nchr1\t3000\t3009\tb\t0\t-\n"))
    got = lambda p: sorted(tuple(r) for r in pipelines.generated(p, sizes, k=3).collect())
    assert got(filed) == got(points) and len(got(filed)) == 8


def test_negatives_are_as_long_as_the_positives(spark, tmp_path):
    chunks = genomic.fasta_chunks(spark, fasta(tmp_path), 512)
    utrs = spark.createDataFrame([("chr1", "+", 100, 4800, "N1")], "chrom string, strand string, u_start long, u_end long, gene_name string")
    for sequence, n in (("ACGT" * 10, 40), (" ", 101)):
        pos = spark.createDataFrame([("chr1", 1000, "+", "N1", "A", sequence)], "chrom string, pos long, strand string, gene_name string, source string, sequence string")
        assert {len(r.sequence) for r in pipelines.negatives(pos, utrs, chunks, size=512).collect()} == {n}


def test_features(spark, tmp_path):
    chunks = genomic.fasta_chunks(spark, fasta(tmp_path), 512)
    contigs = spark.createDataFrame([("chr1",), ("chr2",)], "contig string")
    p = write(tmp_path, "b.bed", "1\t1000\t1010\tx\t0\t+\nchr2\t300\t310\ty\t0\t-\n")
    t = pipelines.site_features(genomic.bed_as_features(spark, p), chunks, contigs, size=512)
    assert t.columns == pipelines.FEATURES and len(t.columns) == 23
    rows = {r.Chromosome: r for r in t.collect()}
    assert (rows["chr1"].Start_1based, rows["chr1"].End_1based, rows["chr1"].gene_id) == (1001, 1010, "")
    for chrom, cut in (("chr1", 1010), ("chr2", 301)):
        part = GENOME[chrom][cut - 51 : cut + 49]
        rna = (part if chrom == "chr1" else revcomp(part)).replace("T", "U")
        assert [rows[chrom][b] for b in "AUGC"] == [rna.count(b) for b in "AUGC"] and rows[chrom].GC_pct == rna.count("G") + rna.count("C")


def test_windows_scores_and_reports(spark):
    import pandas as pd

    df = spark.createDataFrame([("A" * 303, 1, "chr1"), ("C" * 10, 0, "chr1"), (None, 0, "chr1")], "sequence string, label int, chrom string")
    w = pipelines.model_windows(df)
    assert sorted((r.label, r.win_index, r.len_nt) for r in w.collect()) == [(0, 0, 10), (1, 0, 203), (1, 1, 203)]
    s = pipelines.scored(w, lambda texts: pd.DataFrame({0: [0.0] * len(texts), 1: [2.0 if x.startswith("A") else -2.0 for x in texts]}))
    m = pipelines.evaluated(s).first()
    assert (m.accuracy, m.auroc) == (1.0, 1.0)
    a = spark.createDataFrame([("c", 1, "+", "AC"), ("c", 1, "+", "AN")], "chrom string, pos long, strand string, sequence string")
    assert {r.metric: r.value for r in pipelines.quality_report(a).collect()}["n_duplicates"] == 1
    assert {r.metric: r.value for r in pipelines.overlap_report(a, a).collect()}["share_a"] == 1.0


def test_stream_equals_batch(spark, tmp_path):
    from helixmill.streaming import stateless

    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "a.bed", "1\t10\t20\ta\t0\t+\nchr2\t5\t9\tb\t0\t-\n")
    q = stateless.sites(stateless.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("bed_sites").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("bed_sites").collect()) == [("chr1", 20, "+"), ("chr2", 5, "-")]


def test_write_and_read_again(spark, tmp_path):
    df = spark.range(3).withColumn("b", F.lit("x"))
    genomic.write_csv(df, str(tmp_path / "o"), ["id", "b"])
    assert spark.read.csv(str(tmp_path / "o"), header=True).count() == 3
    assert genomic.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "o")]).endswith("/o")
