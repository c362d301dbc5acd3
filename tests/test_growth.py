"""Steps whose work grew faster than their input: by their plans, and by what they are asked to do."""

from pyspark.sql import functions as F

from helixmill.functions import sequence as seq
from helixmill.plans import catalogue, pipelines
from helixmill.sources import genomic


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_covered_chromosomes_make_no_draws(spark, tmp_path, monkeypatch):
    """Sites every 41 places leave nothing free on chr1; chr2 has one site."""
    rows = [(i, 0, 0) for i in range(20, 100_000, 41)] + [(99_999, 0, 0), (5, 0, 1)]
    inverse = pow(37, -1, 100_000)
    t = spark.createDataFrame([((p * inverse) % 100_000, n, c, 2, "R") for p, n, c in rows], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string")
    t.write.parquet(f"{tmp_path}/lineitem.parquet")
    asked, plain = [], pipelines.drawn_in_rounds

    def watched(todo, *more, **named):
        asked.extend(r.chrom for r in todo.select("chrom").distinct().collect())
        return plain(todo, *more, **named)

    monkeypatch.setattr(pipelines, "drawn_in_rounds", watched)
    got = catalogue.QUERIES["whole_chrom_neg"](spark, str(tmp_path)).collect()
    assert asked == ["chr2"] and [(r.chrom, r.pos) for r in got] == [("chr2", 5)] and not -16 < got[0].new_pos - 5 <= 20


def test_chains_make_no_python_groups(spark, tmp_path):
    lines = ["chain 9 a 500 + 10 90 x 1000 - 5 95 1", "  10\t5  3 ", "7 0 2", "4", "", "# note", "chain 8 b 500 + 0 4 y 50 + 7 11 2", "4", "chain 7 c 5 + 0 0 z 5 + 0 0 3"]
    (tmp_path / "a.chain").write_text("\n".join(lines))
    df = genomic.chain_blocks(spark, str(tmp_path / "a.chain"))
    assert "Pandas" not in plan(df)
    assert sorted(map(tuple, df.collect())) == [("a", 10, 20, "x", 994, "-", 9), ("a", 25, 32, "x", 981, "-", 9), ("a", 32, 36, "x", 972, "-", 9), ("b", 0, 4, "y", 7, "+", 8)]


def test_windows_clean_a_sequence_once(spark):
    for width, stride in ((203, 100), (5, 7), (6, 3), (7, 3), (1, 1)):
        texts = ["", " ", "acgu", "acgtx n" * 30, "A" * width, "C" * (width + 1), "GT" * (width + stride), None]
        df = spark.createDataFrame([(x,) for x in texts], "s string").select("s", seq.sliding_windows(F.col("s"), width, stride).alias("w"))
        assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace(") == 2
        for s, w in df.collect():
            x = "".join(c if c in "ACGTN" else "N" for c in "".join((s or "").split()).upper().replace("U", "T"))
            assert w == ([] if not x else [x] if len(x) <= width else [x[o : o + width] for o in range(0, len(x) - width + 1, stride)])
