import hashlib

import pytest
from pyspark.sql import functions as F

from helixmill.functions import sequence as seq
from helixmill.functions.ids import blake2b64


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s")).alias("x")).first().x


@pytest.mark.parametrize("given, expected", [("aau uug-cag\n", "AATTTGNCAG"), ("AAUXX", "AATNN"), (None, ""), ("", "")])
def test_clean(spark, given, expected):
    assert one(spark, given, seq.clean) == expected


@pytest.mark.parametrize("given, expected", [("AAAUUUG", ["AAATTT", "AATTTG"]), ("A", ["ANNNNN"]), (None, ["NNNNNN"]), ("ACGTAC", ["ACGTAC"])])
def test_kmers(spark, given, expected):
    assert one(spark, given, seq.kmers) == expected


@pytest.mark.parametrize("given, expected", [("A" * 20, ["A" * 8] * 4), ("A" * 10, ["A" * 8]), ("A" * 11, ["A" * 8]), ("", []), (None, []), ("ACG", ["ACG"])])
def test_sliding_windows(spark, given, expected):
    assert one(spark, given, lambda s: seq.sliding_windows(s, 8, 4)) == expected


def test_centered_window(spark):
    assert one(spark, "ACGTACGTAA", lambda s: seq.centered_window(s, 4, F.lit(9))) == ["GTAA"]
    assert one(spark, "ACGTACGTAA", lambda s: seq.centered_window(s, 4, F.lit(0))) == ["ACGT"]


def test_reverse_complement_is_its_own_inverse(spark):
    assert one(spark, "ACGTN", seq.reverse_complement) == "NACGT"
    assert one(spark, "AACCGtN", lambda s: seq.reverse_complement(seq.reverse_complement(s))) == "AACCGtN"


def test_hexamer_on_either_strand(spark):
    assert one(spark, "CCTTTATTCC", seq.has_hexamer) is True
    assert one(spark, "CCCCCCCC", seq.has_hexamer) is False


@pytest.mark.parametrize("motif", ["AATAAA", "ATTAAA", "AGTAAA", "TATAAA", "CATAAA", "GATAAA", "AATACA", "AATAGA", "AATATA", "AATGAA", "ACTAAA", "AAGAAA"])
def test_each_hexamer(spark, motif):
    assert one(spark, "CC" + motif + "CC", seq.has_hexamer) is True
    assert one(spark, "CC" + motif[::-1].translate(str.maketrans("ACGT", "TGCA")) + "CC", seq.has_hexamer) is True


@pytest.mark.parametrize("motif", ["AAAAAG", "AACAAA", "GGTAAA"])
def test_other_hexamers(spark, motif):
    assert one(spark, "CC" + motif + "CC", seq.has_hexamer) is False


@pytest.mark.parametrize("motif", ["AAUAAA", "AUUAAA", "AGUAAA", "AAGAAA", "AACAAA", "AAUAUA", "AAUUAA", "AAUAAG", "UAUAAA", "GAUAAA", "CAUAAA", "ACUAAA", "AAUGAA"])
def test_each_variant(spark, motif):
    m = one(spark, "C" * 20 + motif + "C" * 74, seq.scan_motifs)
    assert (m.canonical, m.n, m.any) == (int(motif == "AAUAAA"), 1, 1)


@pytest.mark.parametrize("motif", ["AAUACA", "AAUAGA", "AAAAAG"])
def test_other_variants(spark, motif):
    assert one(spark, "C" * 20 + motif + "C" * 74, seq.scan_motifs).any == 0


def test_kmer_tokens(spark):
    t = one(spark, "ACGTACG", lambda s: seq.kmer_tokens(s, 6))
    assert t.tokens == ["[CLS]", "ACGTAC", "CGTACG", "[SEP]", "[PAD]", "[PAD]"] and t.attention_mask == [1, 1, 1, 1, 0, 0]
    assert one(spark, "ACGTACGTAC", lambda s: seq.kmer_tokens(s, 4)).tokens == ["[CLS]", "ACGTAC", "CGTACG", "[SEP]"]


def test_composition(spark):
    c = one(spark, "AUGCN", seq.composition)
    assert (c.A_count, c.U_count, c.G_count, c.C_count, c.N_count) == (1, 1, 1, 1, 1)
    assert c.A_pct == 20 and c.GC_pct == 40
    assert one(spark, "", seq.composition).A_pct == 0


def test_motif_scan(spark):
    m = one(spark, "C" * 20 + "AAUAAA" + "C" * 74, seq.scan_motifs)
    assert (m.canonical, m.n, m.any) == (1, 1, 1)
    m = one(spark, "C" * 12, seq.scan_motifs)
    assert (m.canonical, m.n, m.any) == (0, 0, 0)


def test_attributes(spark):
    assert one(spark, 'gene_id "E1"; gene_name "N"', lambda s: seq.attribute(s, "gene_id")) == "E1"
    assert one(spark, "ID=x;gene_id=E1;a=b", lambda s: seq.attribute(s, "gene_id")) == "E1"
    assert one(spark, "nothing", lambda s: seq.attribute(s, "gene_id")) == ""


def test_sources(spark):
    df = spark.createDataFrame([("B,A",), ("A",), (" ,C",), (None,)], "s string")
    assert df.agg(seq.sources_of(F.col("s")).alias("x")).first().x == "A,B,C"


def test_stable_key(spark):
    df = spark.createDataFrame([("7", "chr1", 5, "plus", "A", "1"), (None, "chr1", 5, "plus", "A", "1"), (None, None, 5, "plus", "A", "1")], "id string, chrom string, pos long, strand string, sequence string, label string")
    keys = [r.k for r in df.select(seq.stable_key(df.columns).alias("k")).collect()]
    digest = lambda x: "HASH::" + hashlib.sha1(x.encode()).hexdigest()
    assert keys[0] == "ID::7" and keys[1] == "CSP::chr1::+::5" and keys[2] == digest("A::1::+")
    df = spark.createDataFrame([("chr1", 5, 9, "a"), ("chr1", None, 9, "a")], "chrom string, Start long, End long, sequence string")
    assert [r.k for r in df.select(seq.stable_key(df.columns).alias("k")).collect()] == ["CSE::chr1::None::5::9", digest("A::NA::None")]
    df = spark.createDataFrame([(" x ",), ("",)], "id string")
    assert [r.k for r in df.select(seq.stable_key(df.columns).alias("k")).collect()] == ["ID:: x ", digest("::NA::None")]


def test_chromosome_styles(spark):
    assert one(spark, "MT", seq.chrom_style) == "chrM"
    assert one(spark, "chrMT", lambda c: seq.chrom_style(c, False)) == "M"
    assert [one(spark, c, seq.chrom_style) for c in ("mt", "Mt", "m", "chrm", "M", "chr1", "2")] == ["chrM"] * 5 + ["chr1", "chr2"]
    assert [one(spark, c, lambda x: seq.chrom_style(x, False)) for c in ("mt", "Mt", "chrmt", "m", "chr1")] == ["M", "M", "M", "m", "1"]
    assert one(spark, "chrUn_KI270742v1", seq.is_alternative) is True


def test_cleavage_positions(spark):
    df = spark.createDataFrame([(100, 110, "+"), (100, 110, "-")], "a long, b long, s string")
    args = F.col("a"), F.col("b"), F.col("s")
    got = df.select(seq.cleavage_pipeline(*args), seq.cleavage_generator(*args), seq.cleavage_features(*args)).collect()
    assert [tuple(r) for r in got] == [(110, 109, 110), (100, 100, 101)]


def test_blake2b(spark):
    assert one(spark, "chr1|5|+|ACGT", blake2b64) == hashlib.blake2b(b"chr1|5|+|ACGT", digest_size=8).hexdigest()


def test_ids_of_rows(spark):
    from pyspark.sql import functions as F

    from helixmill.functions.ids import negative_id, positive_id

    df = spark.createDataFrame([("chr1", 5, "+", "ACGT", "G1"), ("chr2", 6, "-", "T", None)], "c string, p long, s string, q string, g string")
    c = [F.col(x) for x in "cpsqg"]
    got = df.select(positive_id(c[0], c[1], c[2], c[3]).alias("a"), negative_id(c[0], c[1], c[2], c[4]).alias("b")).collect()
    of = lambda text: hashlib.blake2b(text.encode(), digest_size=8).hexdigest()
    assert [tuple(r) for r in got] == [(of("chr1|5|+|ACGT"), of("chr1:5:+:G1")), (of("chr2|6|-|T"), of("chr2:6:-:"))]
