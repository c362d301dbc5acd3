"""Spans of any length in bins, and scores that lie close together."""

import random

import pytest
from pyspark.sql import functions as F

from helixmill.operators import intervals, metrics
from helixmill.sources import genomic

SPANS = "chrom string, s long, e long, name string"


def drawn(seed, n):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        length = draw.choice((0, 1, 5, 63, 64, 65, 511, 512, 4000, 100_000, 10**8))
        start = draw.randrange(-50, 3000)
        rows.append((draw.choice(("a", "b", None)), start, start + length, f"{seed}-{i}"))
    return rows


def test_a_long_span_is_two_rows_at_most(spark):
    df = spark.createDataFrame([("a", 5, 5 + n, str(n)) for n in (0, 1, 4095, 4096, 10**5, 10**8, 10**12, 2**59)], SPANS)
    laid = intervals.laid(df, F.col("s"), F.col("e"), 1 << 12).groupBy("name").count().collect()
    assert len(laid) == 8 and max(r["count"] for r in laid) <= 2


@pytest.mark.parametrize("tile", [8, 1 << 12])
def test_containing_and_outside(spark, tile):
    rows = drawn(1, 60) + [("a", 10, 5, "backwards"), ("a", None, 5, "null")]
    spans = spark.createDataFrame(rows, SPANS)
    points = [(c, p) for c in ("a", "b", None, "z") for p in (*range(-60, 3100, 37), 10**8 + 7, None)] + [("a", 14)] * 3
    df = spark.createDataFrame(points, "chrom string, p long")
    got = sorted((r.chrom, r.p, r.name) for r in intervals.containing(df, spans, ["chrom"], "p", "s", "e", tile).collect())
    assert got == sorted((c, p, name) for c, p in points for k, s, e, name in rows if c is not None and c == k and p is not None and s is not None and s <= p <= e)
    open_spans = spans.select("chrom", F.col("s").alias("start"), F.col("e").alias("end"))
    got = intervals.outside(df, open_spans, ["chrom"], "p", tile).collect()
    want = [(c, p) for c, p in points if not any(c is not None and c == k and p is not None and s is not None and s <= p < e for k, s, e, _ in rows)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("tile", [8, 1 << 14])
def test_overlapping(spark, tile):
    a, b = drawn(2, 50), drawn(3, 50)
    left = spark.createDataFrame(a, "chrom string, a_start long, a_end long, x string")
    right = spark.createDataFrame(b, "chrom string, b_start long, b_end long, y string")
    got = sorted((r.x, r.y) for r in genomic.overlapping(left, right, tile).collect())
    assert got == sorted((x, y) for c, s, e, x in a for d, t, f, y in b if c is not None and c == d and s < e and t < f and s < f and t < e)


def test_lifted_points_keep_their_copies(spark):
    blocks = spark.createDataFrame([("a", 0, 10**8, "x", 5, "+", 9), ("a", 20, 30, "y", 100, "-", 10)], "src_chrom string, src_start long, src_end long, dst_chrom string, dst_start long, dst_strand string, score long")
    points = spark.createDataFrame([("a", 7, "+", 1), ("a", 7, "+", 1), ("a", 25, "-", 2), ("a", 10**8, "+", 3), ("b", 7, "+", 4), (None, 7, "+", 5)], "chrom string, pos long, strand string, own int")
    got = sorted(map(tuple, intervals.lifted(points, blocks).select("chrom", "pos", "strand", "src_chrom", "src_pos", "own").collect()))
    assert got == [("x", 12, "+", "a", 7, 1), ("x", 12, "+", "a", 7, 1), ("y", 95, "+", "a", 25, 2)]


def test_close_scores_are_spread(spark):
    """All scores within a thousandth: equal results, and no task has them all."""
    draw = random.Random(4)
    rows = [(draw.randrange(2), 0.999 + draw.randrange(700) / 10**6) for _ in range(3000)]
    df = spark.createDataFrame(rows, "label int, prob double")
    got = metrics.ranked(df).first()
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    assert got.auroc == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg))
    seen, tp, fp = 0.0, 0, 0
    for s in sorted({p for _, p in rows}, reverse=True):
        more = sum(p == s for p in pos)
        tp, fp = tp + more, fp + sum(q == s for q in neg)
        seen += more * tp / (tp + fp)
    assert got.auprc == pytest.approx(seen / len(pos))
    ranges = df.select("prob").distinct().repartitionByRange(4, F.desc("prob")).select(F.spark_partition_id().alias("i")).groupBy("i").count().collect()
    assert len(ranges) == 4
    assert tuple(metrics.ranked(df.where("false")).first()) == (None, None)
