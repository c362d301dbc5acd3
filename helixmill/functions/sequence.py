"""Sequence functions as Spark columns: cleaning, k-mers, windows, motifs, composition. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The motifs that are searched for.
DNA_HEXAMERS = ("AATAAA", "ATTAAA", "AGTAAA", "TATAAA", "CATAAA", "GATAAA", "AATACA", "AATAGA", "AATATA", "AATGAA", "ACTAAA", "AAGAAA")
RNA_CANONICAL = "AAUAAA"
RNA_VARIANTS = ("AAUAAA", "AUUAAA", "AGUAAA", "AAGAAA", "AACAAA", "AAUAUA", "AAUUAA", "AAUAAG", "UAUAAA", "GAUAAA", "CAUAAA", "ACUAAA", "AAUGAA")
UPSTREAM_MOTIFS = ("AAUAAA", "AUUAAA", "AGUAAA")


def clean(seq: Column) -> Column:
    """Without white space, upper-cased, U to T, anything but ACGTN to N; null gives an empty string."""
    bare = F.translate(F.upper(F.regexp_replace(seq, r"\s+", "")), "U", "T")
    return F.coalesce(F.regexp_replace(bare, "[^ACGTN]", "N"), F.lit(""))


def upper_acgtn(seq: Column) -> Column:
    return F.regexp_replace(F.upper(seq), "[^ACGTN]", "N")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once a row: inside a lambda function it would be computed again for each element."""
    return F.transform(F.array(value), use)[0]


def kmers(seq: Column, k: int = 6, pad: str = "N") -> Column:
    """The k-mers of the cleaned sequence at stride 1; one padded k-mer where it is shorter than k."""
    many = lambda s: F.transform(F.sequence(F.lit(0), F.greatest(F.length(s) - k, F.lit(0))), lambda i: F.substring(s, i + 1, F.lit(k)))
    return _bound(clean(seq), lambda s: F.when(F.length(s) < k, F.array(F.rpad(s, k, pad))).otherwise(many(s)))


def kmer_text(seq: Column, k: int = 6) -> Column:
    """The fallback tokenization: k-mers joined by blanks."""
    return F.array_join(kmers(seq, k), " ")


def kmer_tokens(seq: Column, max_length: int, k: int = 6, first: str = "[CLS]", last: str = "[SEP]", pad: str = "[PAD]") -> Column:
    """The fallback tokenization as a model takes it: a struct of tokens (k-mers between first and last, cut off and filled up
    with pad to max_length) and attention_mask (1 for what isn't pad)."""
    own = F.concat(F.array(F.lit(first)), F.slice(kmers(seq, k), 1, max_length - 2), F.array(F.lit(last)))
    fill = lambda x, n: F.array_repeat(F.lit(x), (F.lit(max_length) - n).cast("int"))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(own)), fill(0, F.size(own)))
    return F.struct(F.concat(own, fill(pad, F.size(own))).alias("tokens"), mask.alias("attention_mask"))


def sliding_windows(seq: Column, width: int = 300, stride: int = 100) -> Column:
    """Windows of the cleaned sequence: none of an empty one, itself where it fits, else each whole window. The sequence is cleaned once and cut
    into pieces of the stride, of which windows are put together, so that the work grows with the length and not with its square."""
    pieces = lambda s: F.regexp_extract_all(s, F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
    starts = lambda s: F.sequence(F.lit(0), F.greatest(F.length(s) - width, F.lit(0)), F.lit(stride))
    one = lambda p, i: F.substring(F.array_join(F.slice(p, (i / stride).cast("int") + 1, F.lit(-(-width // stride))), ""), 1, width)
    many = lambda s: _bound(pieces(s), lambda p: F.transform(starts(s), lambda i: one(p, i)))
    return _bound(clean(seq), lambda s: F.when(s == "", F.array().cast("array<string>")).when(F.length(s) <= width, F.array(s)).otherwise(many(s)))


def centered_window(seq: Column, width: int, center: Column) -> Column:
    """One window around center, shifted inside the sequence."""
    s = clean(seq)
    n = F.length(s)
    left = F.greatest(F.lit(0), F.least(center - width // 2, n - width))
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= width, F.array(s)).otherwise(F.array(F.substring(s, left.cast("int") + 1, F.lit(width))))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def has_hexamer(seq: Column) -> Column:
    """Whether a polyadenylation hexamer lies on either strand."""
    pattern, up = "|".join(DNA_HEXAMERS), F.upper(seq)
    return up.rlike(pattern) | reverse_complement(up).rlike(pattern)


def upstream_motif(window: Column, up: int, strand: Column, reach: int = 40, motifs: tuple = UPSTREAM_MOTIFS, strand_aware: bool = False) -> Column:
    """Whether one of the motifs (RNA letters) lies in the `reach` bases before base `up` of a genomic window. On the minus
    strand the bases are read as the reverse complement; with strand_aware they are those after base `up`."""
    before = F.substring(window, max(up - reach, 0) + 1, min(reach, up))
    after = F.substring(window, up + 1, reach)
    part = F.when(strand == "-", reverse_complement(after if strand_aware else before)).otherwise(before)
    rna = F.translate(F.upper(part), "T", "U")
    found = F.lit(False)
    for m in motifs:
        found = found | F.contains(rna, F.lit(m.upper().replace("T", "U")))
    return found


def scan_motifs(seq: Column, first: int = 10, last: int = 40) -> Column:
    """A struct canonical, n (overlapping 6-mers that are a variant) and any, over bases first to last of an RNA window."""
    w = F.substring(seq, first + 1, last - first)
    six = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 5, F.lit(1))), lambda i: F.substring(w, i, F.lit(6)))
    n = F.when(F.length(w) >= 6, F.size(F.filter(six, lambda m: m.isin(*RNA_VARIANTS)))).otherwise(0)
    return F.struct(F.contains(w, F.lit(RNA_CANONICAL)).cast("int").alias("canonical"), n.alias("n"), (n > 0).cast("int").alias("any"))


def composition(seq: Column) -> Column:
    """Counts of A, U, G, C and N, and shares in percent of their sum (of 1 where there are none)."""
    count = {c: F.length(seq) - F.length(F.replace(seq, F.lit(c), F.lit(""))) for c in "AUGCN"}
    total = F.greatest(sum(count.values(), F.lit(0)), F.lit(1))
    share = [(100.0 * count[c] / total).alias(f"{c}_pct") for c in "AUGC"]
    return F.struct(*(count[c].alias(f"{c}_count") for c in "AUGC"), *share, (100.0 * (count["G"] + count["C"]) / total).alias("GC_pct"), count["N"].alias("N_count"))


def positive_probability(first: Column, second: Column) -> Column:
    """Softmax of two logits: the probability of the second."""
    return 1 / (1 + F.exp(first - second))


def stable_key(columns: list[str], ids: tuple = ("uid", "site_id", "id")) -> Column:
    """A key for rows whose columns vary: the first id column that is neither null nor empty, as it is; else chrom, strand and
    pos; else chrom, strand and start, end (or Start, End); else a hash of sequence, label and strand. Coordinates that
    are no whole numbers don't count. In keys a null strand or label is nan; without such a column strand is None, label NA."""
    text = lambda c, absent: F.coalesce(F.col(c).cast("string"), F.lit("nan")) if c in columns else F.lit(absent)
    strand = F.coalesce(normal_strand(F.col("strand")), F.lit("nan")) if "strand" in columns else F.lit("None")
    options = [F.when(F.col(c).cast("string") != "", F.concat(F.lit("ID::"), F.col(c).cast("string"))) for c in ids if c in columns]
    for mark, parts in (("CSP::", ["pos"]), ("CSE::", ["start", "end"]), ("CSE::", ["Start", "End"])):
        if {"chrom", *parts} <= set(columns):  # a null part makes the whole null
            options.append(F.concat(F.lit(mark), F.col("chrom").cast("string"), F.lit("::"), strand, *(x for p in parts for x in (F.lit("::"), F.expr(f"cast(try_cast(`{p}` as bigint) as string)")))))
    sequence = F.upper(text("sequence", ""))
    return F.coalesce(*options, F.concat(F.lit("HASH::"), F.sha1(F.concat_ws("::", sequence, text("label", "NA"), strand))))


# The spellings of strands and chromosomes.
PLUS, MINUS = ("1", "+1", "plus", "Plus", "POS", "pos", "+"), ("-1", "minus", "Minus", "NEG", "neg", "-")
CANONICAL = tuple(f"chr{x}" for x in (*range(1, 23), "X", "Y", "M"))
MITOCHONDRIA = ("chrMT", "chrMt", "chrm", "chrmt")


def normal_strand(strand: Column) -> Column:
    s = F.trim(strand.cast("string"))
    return F.when(s.isin(*PLUS), "+").when(s.isin(*MINUS), "-").otherwise(s)


def default_strand(strand: Column) -> Column:
    return F.when(strand.isin("+", "-"), strand).otherwise("+")


def with_chr(chrom: Column) -> Column:
    c = F.trim(chrom)
    return F.when(c.startswith("chr"), c).otherwise(F.concat(F.lit("chr"), c))


def chrom_style(chrom: Column, prefixed: Column | bool = True) -> Column:
    """With or without chr. The mitochondrion becomes chrM once it has its prefix (of any of its spellings), or M (of MT,
    whatever its case)."""
    own = chrom.startswith("chr")
    full, bare = F.when(own, chrom).otherwise(F.concat(F.lit("chr"), chrom)), F.when(own, F.substring(chrom, 4, 1 << 20)).otherwise(chrom)
    full, bare = F.when(full.isin(*MITOCHONDRIA), "chrM").otherwise(full), F.when(F.upper(bare) == "MT", "M").otherwise(bare)
    return F.when(F.lit(prefixed) if isinstance(prefixed, bool) else prefixed, full).otherwise(bare)


def is_alternative(chrom: Column) -> Column:
    return F.contains(chrom, F.lit("_")) | F.replace(chrom, F.lit("chr"), F.lit("")).rlike("^(GL|KI)")


def cleavage_pipeline(start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == "+", end).otherwise(start)


def cleavage_generator(start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == "+", end - 1).otherwise(start)


def cleavage_features(start: Column, end: Column, strand: Column) -> Column:
    return F.when(strand == "+", end).otherwise(start + 1)


def label_number(label: Column) -> Column:
    s = F.lower(F.trim(label.cast("string")))
    return F.when(s.isin("1", "pos", "positive", "true"), 1).when(s.isin("0", "neg", "negative", "false"), 0)


def attribute(text: Column, key: str) -> Column:
    """Of GTF (key "value") or GFF (key=value) attributes; empty where there is none."""
    quoted = F.regexp_extract(text, rf'(?:^|[;\s]){key}\s+"([^"]*)"', 1)
    plain = F.regexp_extract(text, rf"(?:^|[;\s]){key}=([^;]*)", 1)
    return F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(plain, F.lit("")), F.lit(""))


def sources_of(sources: Column) -> Column:
    """Aggregate: the comma-separated names of all rows, trimmed, each once, sorted, joined by commas."""
    names = F.transform(F.flatten(F.collect_set(F.split(F.coalesce(sources, F.lit("")), ","))), lambda x: F.trim(x))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(names, lambda x: x != ""))), ",")
