"""Places under many spans at once: the least of each against brute force, without a row for each pair."""

import random

from pyspark.sql import functions as F

from helixmill.operators import intervals
from helixmill.plans import catalogue
from helixmill.sources import genomic

SPANS = "chrom string, s long, e long, v long, w string"


def most_rows(df):
    """The most rows that any one operator of the plan gave. df is computed for it."""
    df.collect()

    def walk(node):
        name, seen = node.getClass().getSimpleName(), []
        own = node.metrics().get("numOutputRows")
        seen = [own.get().value()] if own.isDefined() else []
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        children = node.children()
        for c in inner + [children.apply(i) for i in range(children.size())]:
            seen += walk(c)
        return seen

    return max(walk(df._jdf.queryExecution().executedPlan()))


def test_least_covering(spark):
    draw = random.Random(5)
    lengths = (0, 1, 2, 3, 4, 15, 16, 17, 63, 255, 4095, 4096, 4097, 20_000, 10**6, 10**9)
    rows = [(draw.choice(("a", "b", None)), s, s + draw.choice(lengths), draw.choice((None, *range(50))), draw.choice("xyz")) for s in (draw.randrange(-9000, 30_000) for _ in range(120))]
    rows += [("a", 10, 5, -1, "backwards"), ("a", None, 5, -1, "null"), ("a", 5, None, -1, "null"), ("b", -(10**12), 10**12, 77, "wide")]
    places = [(c, p) for c in ("a", "b", None, "z") for p in (*range(-9100, 50_000, 613), 10**6, 10**9, -(10**12) - 1, None)] + [("a", 16)] * 3
    t = spark.createDataFrame(places, "chrom string, p long")
    got = intervals.least_covering(t, spark.createDataFrame(rows, SPANS), ["chrom"], "p", "s", "e", least=F.col("v"), pair=F.when(F.col("v") > 9, F.struct("v", "w"))).collect()
    want = {}
    for c, p in set(places):
        over = [(v, w) for k, s, e, v, w in rows if c is not None and k == c and None not in (p, s, e) and s <= p <= e]
        if over:
            known = [x for x in over if x[0] is not None]
            want[c, p] = (min((v for v, _ in known), default=None), min((x for x in known if x[0] > 9), default=None))
    assert {(r.chrom, r.p): (r.least, tuple(r.pair) if r.pair else None) for r in got} == want and len(got) == len(want) > 150
    empty = spark.createDataFrame([], SPANS)
    assert intervals.least_covering(t, empty, ["chrom"], "p", "s", "e", v=F.col("v")).collect() == []


def deep(spark, folder, n=400):
    """Tables of n sites and n genes of which each holds each site (18 * 10 <= 60 * 50)."""
    spark.range(n).selectExpr("id * 1100000 as p_partkey", "50 as p_size").write.parquet(f"{folder}/part.parquet")
    spark.range(n).selectExpr("id * 100000 as l_orderkey", "cast(id % 200 as int) as l_linenumber", "id * 0 as l_partkey", "id as l_suppkey", "if(id % 2 = 0, 'R', 'A') as l_returnflag").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_no_row_for_each_pair(spark, tmp_path):
    d = deep(spark, tmp_path)
    for name in ("gene_fallback", "containing_utr", "liftover", "window_shift_neg"):
        assert most_rows(catalogue.QUERIES[name](spark, d)) < 20_000, name


def test_overlaps_meet_in_tasks(spark):
    """Every a overlaps every b: the pairs come from tasks by node, none of which holds all spans, and each comes once."""
    a = spark.range(300).selectExpr("'a' as chrom", "id as a_start", "id + 40 as a_end", "id as x")
    b = spark.range(200).selectExpr("'a' as chrom", "id - 1000 as b_start", "id + 5000 as b_end", "id as y")
    b = b.unionByName(spark.range(200, 210).selectExpr("'a' as chrom", "300 + id as b_start", "301 + id as b_end", "id as y"))
    df = genomic.overlapping(a, b)
    pairs = [(r.x, r.y) for r in df.collect()]
    assert sorted(pairs) == [(x, y) for x in range(300) for y in range(210) if y < 200 or x < 301 + y and 300 + y < x + 40]
    joins = [line for line in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "Join" in line]
    assert sum("SortMergeJoin" in j and "__node" in j for j in joins) == 2 and not any("BroadcastHashJoin" in j for j in joins)


def shuffled_rows(df):
    """The rows that all exchanges of the plan wrote. df is computed for it."""
    df.collect()

    def walk(node):
        name, own = node.getClass().getSimpleName(), node.metrics().get("shuffleRecordsWritten")
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        children = node.children()
        return (own.get().value() if own.isDefined() else 0) + sum(walk(c) for c in inner + [children.apply(i) for i in range(children.size())])

    return walk(df._jdf.queryExecution().executedPlan())


def test_overlaps_shuffle_a_span_once(spark):
    """Short spans and genes of up to three bins' length: the many short ones go through a shuffle once, with few more rows for those that cross bins."""
    a = spark.range(4000).selectExpr("'a' as chrom", "id * 53 % 40000 as a_start", "id * 53 % 40000 + 40 as a_end", "id as x")
    b = spark.range(50).selectExpr("'a' as chrom", "id * 97 % 40000 as b_start", "id * 97 % 40000 + 60 * (1 + id) as b_end", "id as y")
    df = genomic.overlapping(a, b)
    assert 4050 <= shuffled_rows(df) < 1.1 * 4000 + 4 * 50 + 20
    want = {(x, y) for x in range(4000) for y in range(50) if x * 53 % 40000 < y * 97 % 40000 + 60 * (1 + y) and y * 97 % 40000 < x * 53 % 40000 + 40}
    got = [(r.x, r.y) for r in df.collect()]
    assert set(got) == want and len(got) == len(want) > 5000


def test_overlaps_of_any_length(spark):
    """Lengths of many levels on both sides, wide ones among few, and places near the ends of a long."""
    draw = random.Random(8)
    for lengths_a, lengths_b in (((1, 40, 4096, 4097, 10**6), (1, 60, 3000, 40_000, 10**9)), ((40,), (10**12, 2**60)), ((2**60, 5), (7,)), ((10**5,), (1, 2))):
        sides = [[(draw.choice(("a", "b", None)), s, s + draw.choice(lengths), i) for i, s in enumerate(draw.choice((draw.randrange(-9000, 90_000), -(2**61), 2**61)) for _ in range(90))] for lengths in (lengths_a, lengths_b)]
        a, b = (spark.createDataFrame(rows + [("a", 9, 9, -1), ("a", 9, 3, -1), ("a", None, 9, -1), ("a", 9, None, -1)], f"chrom string, {n}_start long, {n}_end long, {v} long") for rows, n, v in zip(sides, "ab", "xy"))
        got = sorted((r.x, r.y) for r in genomic.overlapping(a, b).select("x", "y").collect())
        assert got == sorted((x, y) for c, s, e, x in sides[0] for k, t, f, y in sides[1] if c is not None and c == k and s < f and t < e) and got
