"""Representatives of clusters wider than a tile, by rank, against sorting."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from helixmill.operators import intervals


@pytest.mark.parametrize("tile", [1, 16, 1 << 16])
def test_representatives_of_wide_clusters(spark, tile):
    draw = random.Random(9)
    rows = [("c", draw.choice((p, p, 3)), f"s{draw.randrange(3)}", f"{i:04}") for i, p in enumerate(draw.randrange(0, 400) for _ in range(301))]
    rows += [("d", 1000 * k + draw.randrange(9), "s", f"x{k}{i}") for k in range(5) for i in range(k + 1)] + [(None, 7, "n", "null"), (None, 9, "n", "null2")]
    df = spark.createDataFrame(rows, "chrom string, pos long, source string, sequence string").repartition(4)
    isles = intervals.islands(df, ["chrom"], tol=12, tile=64)
    got = intervals.representatives(isles, ["chrom"], ["source", "sequence"], sources="source", tile=tile)
    want = []
    for chrom in ("c", "d", None):
        own, isle = sorted((r[1:] for r in rows if r[0] == chrom)), []
        for r in [*own, (10**9, "", "")]:
            if isle and r[0] - isle[-1][0] > 12:
                m = median(x[0] for x in isle)
                best = min(isle, key=lambda x: (abs(x[0] - m), *x))
                want.append((chrom, isle[0][0], len(isle), best[0], best[2], ",".join(sorted({x[1] for x in isle}))))
                isle = []
            isle.append(r)
    found = [(r.chrom, r.cluster_start, r.n_sites, r.pos, r.sequence, r.source) for r in got.collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, want))


def test_medians_by_rank(spark):
    rows = [("a", 5)] * 7 + [("a", 900)] * 7 + [("b", p) for p in range(0, 2000, 3)] + [("c", 1)] * 9 + [("c", 700)]
    t = spark.createDataFrame(rows, "k string, pos long").withColumn("__k", F.struct("k"))
    got = {r["__k"].k: r["__median"] for r in intervals.wide_medians(t, "pos", 64).collect()}
    assert got == {k: median(p for j, p in rows if j == k) for k in "abc"}
