"""The index of free space, motif hits and the generator over them, against going through every place."""

import random

import pytest
from pyspark.sql import functions as F

from helixmill.operators import free_space
from helixmill.plans import pipelines
from helixmill.sources import genomic

SPANS = "chrom string, start long, `end` long"
POINTS = "chrom string, pos long, strand string, name string"
CHUNKS = "chrom string, chunk long, sequence string"
REGIONS = "chrom string, start long, `end` long, region string"


def free_places(length, spans):
    return [p for p in range(length) if not any(a <= p < b for a, b in spans)]


@pytest.mark.parametrize("tile", [4, 1 << 16])
def test_index_ranks_and_places(spark, tile):
    draw = random.Random(tile)
    lengths = {"a": 100, "b": 7, "c": 30, "d": 0, "e": None, "f": 50}
    spans = [(c, s, s + draw.randrange(0, 9)) for c in "abcde" for s in (draw.randrange(-5, (lengths[c] or 9) + 5) for _ in range(9))]
    spans += [("b", -3, 99), ("zz", 1, 2), (None, 0, 50), ("a", None, 5)]
    sizes = spark.createDataFrame(list(lengths.items()), "chrom string, length long")
    runs = free_space.free_runs(sizes, spark.createDataFrame(spans, SPANS), ["chrom"], tile=tile)
    free = {c: free_places(n or 0, [(a, b) for k, a, b in spans if k == c and a is not None]) for c, n in lengths.items()}
    rows = sorted((r.chrom, r.before, r.start, r.end) for r in runs.collect())
    assert {c: [p for k, _, a, b in rows if k == c for p in range(a, b)] for c in free} == free
    assert all(before == free[c].index(a) for c, before, a, _ in rows)
    assert {r.chrom: r.free for r in free_space.totals(runs, ["chrom"]).collect()} == {c: len(x) for c, x in free.items() if x}

    points = spark.createDataFrame([(c, p) for c in "abcf" for p in range(-3, 110)] + [("a", None)], "chrom string, pos long")
    got = {(r.chrom, r.pos): r["rank"] for r in free_space.ranks(points, runs, ["chrom"], "pos", "rank").collect()}
    assert got == {(c, p): sum(x < p for x in free[c]) for c in "abcf" for p in range(-3, 110)} | {("a", None): None}
    asked = spark.createDataFrame([(c, r) for c in "abcf" for r in range(120)], "chrom string, r long")
    got = {(x.chrom, x.r): x.at for x in free_space.places(asked, runs, ["chrom"], "r", "at").collect()}
    assert got == {(c, r): free[c][r] if r < len(free[c]) else None for c in "abcf" for r in range(120)}


def test_running_totals(spark):
    rows = [("a", i // 3, i, i % 4) for i in range(40)] + [(None, 1, 1, 5), (None, 2, 2, 6)]
    df = spark.createDataFrame(rows, "k string, o long, p long, v long")
    got = {(r.k, r.p): r.s for r in free_space.running_totals(df, ["k"], ["o", "p"], "v", "s", tile=4).collect()}
    assert got == {(k, p): sum(w for j, _, q, w in rows if j == k and q < p) for k, _, p, _ in rows}


@pytest.mark.parametrize("size", [8, 50, 1 << 14])
def test_motif_hits(spark, size):
    draw = random.Random(size)
    genome = {c: "".join(draw.choice("AATTG") for _ in range(n)) for c, n in (("x", 203), ("y", 8), ("z", 1))}
    genome["w"] = "AAAAAAAAAAAAAAAAAAAA"
    chunks = spark.createDataFrame([(c, k, s[k * size : (k + 1) * size].lower()) for c, s in genome.items() for k in range(-(-len(s) // size))], CHUNKS)
    motifs = ("AAU", "aat", "UUG", "AAAA", "G")
    want = {m.upper().replace("U", "T") for m in motifs}
    got = sorted((r.chrom, r.at, r.n) for r in genomic.motif_hits(chunks, motifs, size).collect())
    assert got == sorted((c, i, len(m)) for c, s in genome.items() for m in want for i in range(len(s)) if s.startswith(m, i))
    assert genomic.motif_hits(chunks, (), size).count() == 0


def test_negatives_avoid_motifs(spark):
    """Motifs in the first half of a contig: all negatives of the plus strand lie in the second, those of the minus strand anywhere."""
    s = "AATAAAC" * 143 + "C" * 999
    chunks = spark.createDataFrame([("chr1", k, s[k * 512 : (k + 1) * 512]) for k in range(4)], CHUNKS)
    points = spark.createDataFrame([("chr1", 990, strand, "a") for strand in ("+", "-") for _ in range(40)], POINTS)
    sizes = spark.createDataFrame([("chr1", 2000)], "chrom string, length long")
    neg = [r for r in pipelines.generated(points, sizes, chunks, distance=5, motif_aware=True, size=512).collect() if r.label == 0]
    plus, minus = ([r.pos for r in neg if r.strand == x] for x in "+-")
    assert len(plus) == len(minus) == 40 and {r.notes for r in neg} == {"neg"} and {r.source_id for r in neg} == {""}
    clear = {p for p in range(2000) if not any(m in s[max(p - 40, 0) : p] for m in ("AATAAA", "ATTAAA", "AGTAAA")) and abs(p - 990) > 5}
    assert set(plus) <= clear and all(p < 6 or p > 994 for p in plus) and any(p < 900 for p in minus)


def test_widths_and_lengths_of_nothing(spark):
    points = spark.createDataFrame([("chr1", 100, "+", "a"), ("chr2", 5, "+", "b"), ("chr3", 5, "+", "c"), ("chr4", 5, "-", "d"), (None, 5, "-", "e"), ("chr1", None, "-", "f")], POINTS)
    sizes = spark.createDataFrame([("chr1", 1000), ("chr2", 0), ("chr3", 400), ("chr4", 300)], "chrom string, length long")
    mask = spark.createDataFrame([("chr1", 700, 700, "none"), ("chr1", 600, 601, "one"), ("chr1", 500, 502, "two"), ("chr1", 90, 110, "covered"), ("chr3", 399, 399, "none"), (None, 1, 9, "null")], REGIONS)
    for m in (mask, mask.where("false"), None):
        neg = [r for r in pipelines.generated(points, sizes, None, m, k=20, distance=200).collect() if r.label == 0]
        by = {c: [r for r in neg if r.chrom == c] for c in ("chr1", "chr2", "chr3", "chr4", None)}
        assert by["chr2"] == by[None] == [] and len(by["chr1"]) == 20
        assert len(by["chr4"]) == 20 and {r.region_id for r in by["chr4"]} == {""} and all(205 < r.pos < 300 for r in by["chr4"])
        assert len(by["chr3"]) == (0 if m is mask else 20)  # no region of its mask has a place
        if m is mask:
            assert {(r.pos, r.region_id) for r in by["chr1"]} == {(500, "two"), (501, "two")}


def test_draws_are_even(spark):
    """Regions are as likely whatever their widths, places inside one too."""
    points = spark.createDataFrame([("chr1", 5000, "+", "a")] * 3, POINTS)
    sizes = spark.createDataFrame([("chr1", 6000)], "chrom string, length long")
    mask = spark.createDataFrame([("chr1", 0, 4, "small"), ("chr1", 1000, 1400, "large"), ("chr1", 4999, 5005, "covered")], REGIONS)
    neg = [r for r in pipelines.generated(points, sizes, None, mask, k=400, distance=100).collect() if r.label == 0]
    assert len(neg) == 1200  # repeated points draw for themselves
    small = [r.pos for r in neg if r.region_id == "small"]
    assert 500 < len(small) < 700 and all(100 < small.count(p) < 200 for p in range(4))
    # half of a region covered: half of the draws
    mask = spark.createDataFrame([("chr1", 0, 100, "free"), ("chr1", 4850, 4950, "half")], REGIONS)
    neg = [r for r in pipelines.generated(points, sizes, None, mask, k=400, distance=100).collect() if r.label == 0]
    assert 320 < sum(r.region_id == "half" for r in neg) < 480 and all(r.pos < 4900 for r in neg)


def test_windows_need_no_row_numbers(spark):
    chunks = spark.createDataFrame([("c", 0, "ACGTACGT"), ("c", 1, "TTTT")], CHUNKS)
    points = spark.createDataFrame([("c", 6, "x"), ("c", 6, "x"), ("c", 0, "y"), ("d", 3, "z"), (None, 3, "n"), ("c", None, "n")], "chrom string, pos long, t string")
    got = genomic.windows(points, chunks, F.col("pos") - 2, F.col("pos") + 4, 8)
    assert sorted((r.t, r.dna) for r in got.collect()) == [("n", ""), ("n", ""), ("x", "ACGTTT"), ("x", "ACGTTT"), ("y", "ACGT"), ("z", "")]
    assert "monotonically" not in got._jdf.queryExecution().toString()


def test_repeated_spans_merge(spark):
    from helixmill.operators import intervals

    for n in (1, 2, 3, 50):
        spans = spark.createDataFrame([("c", 10, 20)] * n + [("c", 10, 12), ("c", 15, 30), ("c", 31, 32)] * n, SPANS).repartition(3)
        assert sorted(map(tuple, intervals.merged(spans, ["chrom"]).collect())) == [("c", 10, 30), ("c", 31, 32)]
