"""Seeded sampling without random state: rows are ordered by md5(key|seed), so any engine draws the same rows.

The n rows of the smallest digests are found by radix selection: rows are counted by the first digits, then those of the one group that holds
the border by the next digits, and so on, until the border is known; what follows is a filter. Only where ranks themselves are wanted are rows
ranked, inside groups of equal first digits, as many as the number of rows asks for.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from helixmill.plans.stages import held

#: Hex digits that are counted at a time, rows that the driver may read to find a border among them, rows of a group that is ranked in one task.
DIGITS, LEAF, GROUP = 3, 1 << 12, 1 << 16


def draw(key: Column, seed: int | str) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def hash_rank(df: DataFrame, key: str, seed: int | str, by: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """df with rank (from 1) in the order of draw(key), then key, for each value of `by`. Without `digits` df is counted, so that
    groups of equal first digits have about GROUP rows."""
    by = by or []
    if digits is None:
        digits = max(1, math.ceil(math.log(max(df.count(), 1) / GROUP, 16)))
    t = df.withColumn("__draw", draw(F.col(key), seed)).withColumn("__first", F.substring("__draw", 1, digits))
    counts = t.groupBy(*by, "__first").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*by, "__first").orderBy("__draw", key))
    on = t["__first"] == counts["__first"]
    for c in by:
        on = on & t[c].eqNullSafe(counts[c])
    return t.withColumn("__k", inside).join(counts.select(*(F.col(c) for c in by), "__first", "__base"), [*by, "__first"]).withColumn("rank", F.col("__base") + F.col("__k")).drop("__draw", "__first", "__base", "__k")


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return hash_rank(df, key, seed)


def _border(t: DataFrame, n: int, groups: dict[str, int]) -> tuple[str, int, int]:
    """Of t (__draw): the digest of its n-th smallest row, how many rows of that digest belong to the n smallest, and how many there are. groups: rows by the
    first digits. 0 < n < their sum."""
    prefix = ""
    while True:
        for digits in sorted(groups):
            if n <= groups[digits]:
                break
            n -= groups[digits]
        prefix, size = prefix + digits, groups[digits]
        inside = t.where(F.col("__draw").startswith(prefix))
        if len(prefix) >= 32 or not digits:  # rows of one digest, or without one
            return prefix, n, size
        if size <= LEAF:
            rest = sorted(r[0] for r in inside.select("__draw").collect())
            border = rest[n - 1]
            return border, n - rest.index(border), rest.count(border)
        groups = {r[0]: r[1] for r in inside.groupBy(F.substring("__draw", len(prefix) + 1, DIGITS)).count().collect()}


def marked(df: DataFrame, key: str, seed: int | str, want: Callable[[dict], dict], name: str, by: str | None = None) -> DataFrame:
    """df with `name`: whether the row is one of the first want(n)[class] of its class in the order of draw(key); want gets the rows of each class. Classes are
    the values of `by` (few; null is one too), or None for all rows. Rows of equal keys follow each other by their other columns. df should be held: it is
    read once for the counts, again for a border's digits (of large tables a few times) and for the result."""
    t = df.withColumns({"__draw": draw(F.col(key), seed), "__by": F.col(by) if by else F.lit(None).cast("string")})
    groups: dict = {}
    for c, digits, n in t.groupBy("__by", F.substring("__draw", 1, DIGITS)).count().collect():
        groups.setdefault(c, {})[digits or ""] = n  # rows without a key have no digest and come first
    inside, tied = F.lit(False), []
    for c, n in want({c: sum(g.values()) for c, g in groups.items()}).items():
        own = F.col("__by").eqNullSafe(F.lit(c))
        if n >= sum(groups.get(c, {}).values()):
            inside = inside | own
        elif n > 0:
            filled = t.where(own).withColumn("__draw", F.coalesce("__draw", F.lit("")))
            border, taken, there = _border(filled, n, groups[c])
            at = F.coalesce("__draw", F.lit(""))
            inside = inside | (own & (at <= border if taken == there else at < border))
            if taken < there:
                tied.append((own & (at == border), taken))
    if not tied:
        return t.withColumn(name, inside).drop("__draw", "__by")
    some = F.lit(False)
    for rows, _ in tied:
        some = some | rows
    out = t.where(~some).withColumn(name, inside)
    for rows, taken in tied:
        out = out.unionByName(numbered(t.where(rows), df.columns, "__no").withColumn(name, F.col("__no") < taken).drop("__no"))
    return out.drop("__draw", "__by")


def balanced(df: DataFrame, key: str, fraction: float, seed: int, label: str = "label") -> DataFrame:
    """As many rows of label 1 as of 0: `fraction` of all rows, rounded half to even, made even and at least 2; fewer if
    a class has fewer. An error if a class is empty. df is held."""

    def each(n: dict) -> dict:
        of_class = min(n.get(0, 0), n.get(1, 0), max(2, round(sum(n.values()) * fraction) // 2 * 2) // 2)
        if of_class <= 0:
            raise ValueError(f"nothing to balance: {n}")
        return {0: of_class, 1: of_class}

    return marked(held(df.where(F.col(label).isin(0, 1))), key, seed, each, "__in", label).where("__in").drop("__in")


def per_class(df: DataFrame, key: str, n: int, seed: int, label: str = "label") -> DataFrame:
    """The first n rows of each label, one that is null too. df is held."""
    return marked(held(df), key, seed, lambda sizes: dict.fromkeys(sizes, n), "__in", label).where("__in").drop("__in")


def first_rows(df: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """The first n rows. df is held."""
    return marked(held(df), key, seed, lambda sizes: dict.fromkeys(sizes, n), "__in").where("__in").drop("__in")


def random_split(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """df with split: val for max(1, int(n * fraction)) rows, train for the others. df is held."""
    val = lambda sizes: {c: max(1, int(n * fraction)) for c, n in sizes.items()}
    return marked(held(df), key, seed, val, "__in").withColumn("split", F.when(F.col("__in"), "val").otherwise("train")).drop("__in")


def chromosome_split(df: DataFrame, fraction: float, chrom: str = "chrom") -> DataFrame:
    """df with split: the lexicographically last max(1, int(k * fraction)) of k chromosomes are val."""
    names = df.where(F.col(chrom).isNotNull()).select(chrom).distinct()
    ranked = names.select(chrom, F.row_number().over(Window.orderBy(F.desc(chrom))).alias("__r"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("__n"))
    val = ranked.select(chrom, F.when(F.col("__r") <= F.greatest(F.lit(1), F.floor(F.col("__n") * fraction)), "val").otherwise("train").alias("split"))
    return df.join(val, chrom)


def whole_number(key: Column, seed: str, n: Column | int) -> Column:
    """A number from 0 to n - 1 drawn from the key: the first seven hex digits of draw(), modulo n."""
    seven = F.conv(F.substring(draw(key, seed), 1, 7), 16, 10).cast("long")
    return seven % (F.lit(n) if isinstance(n, int) else n)


def place_number(key: Column, seed: str, n: Column) -> Column:
    """As whole_number for an n of any size over 0: the first 13 hex digits of draw(), modulo n."""
    return F.conv(F.substring(draw(key, seed), 1, 13), 16, 10).cast("long") % n


def first_attempt(candidates: DataFrame, keys: list[str], attempt: str = "attempt") -> DataFrame:
    """Of the attempts that passed, each key's first."""
    rest = [c for c in candidates.columns if c not in (*keys, attempt)]
    return candidates.groupBy(*keys).agg(F.min(F.struct(attempt, *rest)).alias("v")).select(*keys, F.col(f"v.{attempt}").alias(attempt), *(F.col(f"v.{c}").alias(c) for c in rest))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with consecutive numbers (from 0) in the order of columns: sorted by ranges, not in one task. Held in between, so
    that the ranges counted are the ranges numbered."""
    t = held(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part, own = F.shiftrightunsigned("__id", 33).alias("__part"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = t.groupBy(part).agg(F.count("*").alias("__n"))  # one row a range
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    return t.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, F.col("__base") + own).drop("__id", "__part", "__base")


def bucket_targets(n: int) -> dict[str, int]:
    """Negatives for n positives: twice as many, half of them shifted windows, 35 % random, the rest with motifs."""
    total = int(2 * n)
    window, uniform = int(0.5 * total), int(0.35 * total)
    return {"window": window, "random": uniform, "motif": total - window - uniform}
