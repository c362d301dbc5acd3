"""Keyed de-duplication, merging with provenance, set operations, quality reports and label conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from helixmill.functions.sequence import sources_of


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}; there are {df.columns}")
    return df


def shaped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly these columns in this order, of these types; ones that df lacks are null, values that don't cast too."""
    return df.select(*((F.expr(f"try_cast(`{c}` as {t})") if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in columns.items()))


def numeric(df: DataFrame, columns: list[str], fill: int | None = None) -> DataFrame:
    """df with the columns as whole numbers; what doesn't cast is null, or `fill`."""
    number = lambda c: F.expr(f"try_cast(`{c}` as bigint)")
    return df.withColumns({c: number(c) if fill is None else F.coalesce(number(c), F.lit(fill)) for c in columns})


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order` (then by the remaining columns). As a minimum of structs it is summed up
    before the shuffle, which a row number is not."""
    rest = [c for c in df.columns if c not in keys]
    first = [c for c in order if c not in keys]
    value = F.struct(*(F.col(c).alias(f"__o{i}") for i, c in enumerate(first)), *rest)
    return df.groupBy(*keys).agg(F.min(value).alias("__v")).select(*(F.col(c) if c in keys else F.col(f"__v.{c}").alias(c) for c in df.columns))


def first_filled(column: str, order: Column) -> Column:
    """Aggregate: the first non-null value by order."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), order)).alias(column)


def merge_by_coordinates(a: DataFrame, b: DataFrame, keys: list[str], order: list[str], source: str = "source") -> DataFrame:
    """One row for each key of a and b: of each other column the first non-null value, rows of a before those of b, and the
    sources of all. Keys with a null are dropped; columns that one side lacks are filled with nulls."""
    both = a.withColumn("__side", F.lit(0)).unionByName(b.withColumn("__side", F.lit(1)), allowMissingColumns=True).na.drop(subset=keys)
    rank = F.struct("__side", *order)
    rest = [c for c in both.columns if c not in (*keys, source, "__side")]
    return both.groupBy(*keys).agg(*(first_filled(c, rank) for c in rest), sources_of(F.col(source)).alias(source))


def one_per_sequence(df: DataFrame, order: list[str], sequence: str = "sequence", source: str = "source") -> DataFrame:
    """One row for each sequence: first values by order, all sources, and n_coords_collapsed."""
    rest = [c for c in df.columns if c not in (sequence, source)]
    value = F.struct(*(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), *rest)
    g = df.where(F.col(sequence).isNotNull()).groupBy(sequence).agg(F.min(value).alias("__v"), sources_of(F.col(source)).alias(source), F.count("*").alias("n_coords_collapsed"))
    return g.select(sequence, *(F.col(f"__v.{c}").alias(c) for c in rest), source, "n_coords_collapsed")


def label_conflicts(df: DataFrame, rule: str, sequence: str = "sequence", label: str = "label") -> DataFrame:
    """Sequences under both labels: drop_neg, drop_pos or keep_both. Rows without a sequence stay."""
    if rule == "keep_both":
        return df
    drop = {"drop_neg": 0, "drop_pos": 1}[rule]
    other = df.where(F.col(label) == 1 - drop).select(F.col(sequence).alias("__s")).distinct()
    hit = df.where(F.col(label) == drop).join(other, F.col(sequence) == F.col("__s"), "left_anti")
    return df.where((F.col(label) != drop) | F.col(label).isNull()).unionByName(hit)


def remainder(full: DataFrame, part: DataFrame, key: str) -> DataFrame:
    """Rows of full whose key part doesn't have. Rows with a null key stay."""
    return full.join(part.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """n_rows, n_duplicates (rows beyond the first of a key, nulls being equal), n_distinct (keys without nulls)."""
    full = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    per_key = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    return per_key.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_duplicates"), F.count_if(full).alias("n_distinct"))


def duplicate_examples(df: DataFrame, keys: list[str], order: list[str], per_group: int = 2, limit: int = 10) -> DataFrame:
    """Up to per_group rows of each key that occurs more than once, the first `limit` in order: a report."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("n_in_group")).where("n_in_group > 1").orderBy(*keys).limit(limit)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.join(F.broadcast(twice), keys).withColumn("n_example", n).where(F.col("n_example") <= per_group).orderBy(*keys, "n_example").limit(limit)


def sequence_quality(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """min_len, max_len, median_len (whole part) and n_non_acgt (case-sensitive). The median is of length counts, so no
    task holds all rows."""
    n = F.length(sequence)
    return df.where(F.col(sequence).isNotNull()).groupBy(n.alias("n")).agg(F.count("*").alias("rows"), F.count_if(F.col(sequence).rlike("[^ACGT]")).alias("bad")).agg(F.min("n").alias("min_len"), F.max("n").alias("max_len"), F.expr("cast(percentile(n, 0.5, rows) as int)").alias("median_len"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_non_acgt"))
