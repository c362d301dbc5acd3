"""Classification metrics from (label, prob) rows, and batches.

Scores are counted by value before anything is ordered; cumulative sums run in ranges of scores with measured borders, whose totals are a
short table, so neither many rows nor many distinct scores meet in one task, however close the scores are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from helixmill.plans.stages import held


def thresholded(df: DataFrame, label: str = "label", prob: str = "prob", at: float = 0.5) -> DataFrame:
    """One row: samples, accuracy, f1 (0 where nothing is predicted or true), at prob >= `at`."""
    y, p = F.col(label) == 1, F.col(prob) >= at
    d = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull()).agg(F.count("*").alias("samples"), F.count_if(y == p).alias("right"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    return d.select("samples", F.try_divide("right", "samples").alias("accuracy"), F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"))


def ranked(df: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """One row: auroc (ties count half) and auprc (average precision, stepwise); null without both classes."""
    by = df.where(F.col(label).isNotNull() & F.col(prob).isNotNull()).groupBy(F.col(prob).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    # held with the range that a score fell into: the ranges that are summed up are the ranges that are read again
    by = held(by.repartitionByRange(F.desc("s")).withColumn("block", F.spark_partition_id()))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = by.groupBy("block").agg(F.sum("p").alias("bp"), F.sum("n").alias("bn")).select("block", F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("n0"))
    here = Window.partitionBy("block").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    t = by.join(blocks, "block").select("p", "n", (F.col("p0") + F.sum("p").over(here)).alias("tp"), (F.col("n0") + F.sum("n").over(here)).alias("fp"))
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    steps = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return t.agg(F.try_divide(area, F.sum("p") * F.sum("n")).alias("auroc"), F.try_divide(steps, F.sum("p")).alias("auprc"))


def mean_of_batches(df: DataFrame, batch: str, loss: str) -> DataFrame:
    """The mean of the batches' mean losses, and the mean over rows (they differ where batches do in size)."""
    b = df.groupBy(batch).agg(F.avg(loss).alias("m"), F.sum(loss).alias("s"), F.count(loss).alias("n"))
    return b.agg(F.count("*").alias("n_batches"), F.avg("m").alias("loss"), F.try_divide(F.sum("s"), F.sum("n")).alias("row_loss"))


def log_loss(label: Column, prob: Column) -> Column:
    p = F.least(F.greatest(prob, F.lit(1e-7)), F.lit(1 - 1e-7))
    return -F.when(label == 1, F.ln(p)).otherwise(F.ln(1 - p))


def batches(ranked_rows: DataFrame, size: int, label: str = "label") -> DataFrame:
    """ranked_rows (with rank from 1) with batch, and mixed: whether the batch has both labelled and unlabelled rows."""
    t = ranked_rows.withColumn("batch", F.floor((F.col("rank") - 1) / size))
    some = F.count(label).over(Window.partitionBy("batch"))
    return t.withColumn("mixed", (some > 0) & (some < F.count("*").over(Window.partitionBy("batch"))))
