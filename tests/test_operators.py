import math
import random

import pytest
from pyspark.sql import functions as F

from helixmill.operators import intervals, metrics, rows, sampling


def sites(spark, positions, chrom="chr1", strand="+"):
    return spark.createDataFrame([(chrom, p, strand) for p in positions], "chrom string, pos long, strand string")


@pytest.mark.parametrize("tile", [7, 50, 1 << 16])
def test_islands_and_representatives(spark, tile):
    t = intervals.islands(sites(spark, [10, 20, 33, 45, 0 + 200, 212, 224]), ["chrom", "strand"], tile=tile)
    got = {r.cluster_start: (r.pos, r.n_sites) for r in intervals.representatives(t, ["chrom", "strand"], []).collect()}
    assert got == {10: (10, 2), 33: (33, 2), 200: (212, 3)}


@pytest.mark.parametrize("tile", [13, 1 << 16])
def test_islands_equal_brute_force(spark, tile):
    rng = random.Random(5)
    pos = sorted(rng.randrange(3000) for _ in range(300))
    expected, start = {}, None
    for i, p in enumerate(pos):
        if i == 0 or p - pos[i - 1] > 12:
            start = p
        expected[p] = start
    got = {r.pos: r.cluster_start for r in intervals.islands(sites(spark, pos), ["chrom", "strand"], tile=tile).collect()}
    assert got == expected


def test_null_keys(spark):
    t = spark.createDataFrame([("chr1", 10, "+"), (None, 10, "+"), (None, 15, "+"), ("chr1", None, "+"), ("chr1", 12, None)], "chrom string, pos long, strand string")
    got = intervals.representatives(intervals.islands(t, ["chrom", "strand"]), ["chrom", "strand"], []).collect()
    assert sorted((str(r.chrom), str(r.strand), r.pos, r.n_sites) for r in got) == [("None", "+", 10, 2), ("chr1", "+", 10, 1), ("chr1", "None", 12, 1)]
    genes = spark.createDataFrame([("chr1", 5, "A"), (None, 5, "B"), ("chr1", None, "C")], "chrom string, g_start long, gene string")
    joined = intervals.asof(t, genes, ["chrom"], "pos", "g_start", ["gene"], ["gene"]).collect()
    assert sorted((str(r.chrom), str(r.pos), r["asof"] and r["asof"].gene) for r in joined) == sorted([("chr1", "10", "A"), ("None", "10", None), ("None", "15", None), ("chr1", "None", None), ("chr1", "12", "A")], key=lambda x: x[:2])
    spans = spark.createDataFrame([(None, 1, 5), (None, 4, 9), ("c", 1, 2), ("c", None, 4)], "chrom string, start long, end long")
    assert sorted((str(r.chrom), r.start, r.end) for r in intervals.merged(spans, ["chrom"]).collect()) == [("None", 1, 9), ("c", 1, 2)]


def test_numbered(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 500)], "a long")
    got = {r.a: r.n for r in sampling.numbered(df, ["a"], "n").collect()}
    assert got == {a: i for i, a in enumerate(sorted(got))} and len(got) == 500


def test_neighbours(spark):
    near = lambda p, **k: [r.n_near for r in intervals.neighbours(sites(spark, p), ["chrom", "strand"], 12, **k).orderBy("pos").collect()]
    assert near([10, 15, 40]) == [1, 1, 0] and near([10, 10]) == [0, 0]
    rng = random.Random(2)
    p = sorted(rng.randrange(500) for _ in range(100))
    assert near(p, tile=20) == [sum(abs(a - b) <= 12 and a != b for b in p) for a in p]


def test_band_pairs(spark):
    got = intervals.band_pairs(sites(spark, [10]), sites(spark, [22, 23, -2, -3]), ["chrom", "strand"], 12).collect()
    assert sorted(r.pos_b for r in got) == [-2, 22]


@pytest.mark.parametrize("tile", [5, 1 << 16])
def test_merged_spans_touch(spark, tile):
    t = spark.createDataFrame([("c", 8, 13), ("c", 13, 18), ("c", 20, 60), ("c", 25, 30), ("c", 58, 70)], "chrom string, start long, end long")
    got = sorted((r.start, r.end) for r in intervals.merged(t, ["chrom"], tile=tile).collect())
    assert got == [(8, 18), (20, 70)]
    inside = intervals.outside(sites(spark, [7, 8, 17, 18, 69, 70], "c"), intervals.merged(t, ["chrom"], tile=tile), ["chrom"], tile=16)
    assert sorted(r.pos for r in inside.collect()) == [7, 18, 70]


@pytest.mark.parametrize("tile", [10, 1 << 16])
def test_asof(spark, tile):
    genes = spark.createDataFrame([("chr1", 5, 9, "A"), ("chr1", 5, 30, "B"), ("chr1", 90, 95, "C")], "chrom string, g_start long, g_end long, gene string")
    t = intervals.asof(sites(spark, [1, 5, 20, 89, 90, 500]), genes, ["chrom"], "pos", "g_start", ["g_end", "gene"], ["g_end", "gene"], tile=tile)
    got = {r.pos: r["asof"] and r["asof"].gene for r in t.collect()}
    assert got == {1: None, 5: "B", 20: "B", 89: "B", 90: "C", 500: "C"}


def test_clear_of(spark):
    got = intervals.clear_of(sites(spark, [100, 149, 150, 151, 201]), sites(spark, [100]), ["chrom"], 50)
    assert sorted(r.pos for r in got.collect()) == [151, 201]


def test_lifted(spark):
    blocks = spark.createDataFrame([("chr1", 0, 100, "chr2", 1000, "+", 5), ("chr1", 50, 100, "chr3", 2000, "-", 9)], "src_chrom string, src_start long, src_end long, dst_chrom string, dst_start long, dst_strand string, score long")
    got = {r.src_pos: (r.chrom, r.pos, r.strand) for r in intervals.lifted(sites(spark, [10, 60, 100]), blocks).collect()}
    assert got == {10: ("chr2", 1010, "+"), 60: ("chr3", 1990, "-")}


def test_merge_by_coordinates(spark):
    a = spark.createDataFrame([("c", 1, "+", None, "A")], "chrom string, pos long, strand string, gene string, source string")
    b = spark.createDataFrame([("c", 1, "+", "G", "B,A", "x"), ("c", None, "+", "H", "B", "y")], "chrom string, pos long, strand string, gene string, source string, more string")
    got = rows.merge_by_coordinates(a, b, ["chrom", "pos", "strand"], []).collect()
    assert [(r.pos, r.gene, r.source, r.more) for r in got] == [(1, "G", "A,B", "x")]


def test_label_conflicts(spark):
    df = spark.createDataFrame([("s", 0), ("s", 1), ("t", 0), (None, 0), ("u", None)], "sequence string, label int")
    n = lambda rule: rows.label_conflicts(df, rule).count()
    assert (n("drop_neg"), n("drop_pos"), n("keep_both")) == (4, 4, 5)


def test_duplicates_and_quality(spark):
    df = spark.createDataFrame([("a", 1, "ACGT"), ("a", 1, "acg"), (None, 1, "A"), (None, 1, None)], "k string, n long, sequence string")
    r = rows.duplicate_counts(df, ["k", "n"]).first()
    assert (r.n_rows, r.n_duplicates, r.n_distinct) == (4, 2, 1)
    q = rows.sequence_quality(df).first()
    assert (q.min_len, q.max_len, q.median_len, q.n_non_acgt) == (1, 4, 3, 1)
    with pytest.raises(ValueError):
        rows.require(df, ["k", "absent"])


def test_balance_and_splits(spark):
    df = spark.createDataFrame([(str(i), "chr%d" % (i % 25), i % 3 == 0) for i in range(90)], "key string, chrom string, l boolean").withColumn("label", F.col("l").cast("int"))
    got = {r.label: r["count"] for r in sampling.balanced(df, "key", 0.5, 1).groupBy("label").count().collect()}
    assert got == {0: 22, 1: 22}
    five = spark.createDataFrame([(str(i), i % 2) for i in range(5)], "key string, label int")
    assert sampling.balanced(five, "key", 0.5, 1).count() == 2  # round(2.5) is 2
    with pytest.raises(ValueError):
        sampling.balanced(five.where("label = 1"), "key", 0.5, 1)
    assert sampling.random_split(df, "key", 0.1, 3).where("split = 'val'").count() == 9
    ranks = [r["rank"] for r in sampling.hash_rank(df, "key", 9).collect()]
    assert sorted(ranks) == list(range(1, 91))
    names = [f"chr{x}" for x in (*range(1, 23), "X", "Y", "M")]
    split = sampling.chromosome_split(spark.createDataFrame([(n,) for n in names], "chrom string"), 0.1)
    assert {r.chrom for r in split.where("split = 'val'").collect()} == {"chrX", "chrY"}
    assert sampling.bucket_targets(3) == {"window": 3, "random": 2, "motif": 1}


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "label int, prob double")
    t, r = metrics.thresholded(df).first(), metrics.ranked(df).first()
    assert (t.accuracy, round(t.f1, 9)) == (0.75, 0.8)
    assert r.auroc == 0.75 and math.isclose(r.auprc, 0.5 + 0.5 * 2 / 3)
    one = df.where("label = 1")
    assert metrics.ranked(one).first().auroc is None
    assert metrics.thresholded(df.where("false")).first().samples == 0
    b = metrics.mean_of_batches(spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "b int, l double"), "b", "l").first()
    assert (b.n_batches, b.loss, b.row_loss) == (2, 3.5, 3.0)
