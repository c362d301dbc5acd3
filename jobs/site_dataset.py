"""From tables of sites and genes to a training table of sites, partitioned by chromosome.

    python jobs/site_dataset.py --sites PATH --genes PATH --out PATH [--config FILE]

Sites of two collections are made distinct and merged by coordinate (the leading collection's values come first, all sources are kept), nearby ones
are clustered and stand as their representative, each gets its gene (the last that starts before it and reaches it, else the first that holds
it, else an empty name), a flag for a hexamer in its sequence, and the part of its chromosome: the last ones by name are held out for validation.

Written are OUT/sites (Parquet, a folder a chromosome) and OUT/report (JSON lines, metric and value). A run replaces the
whole of both. With `chroms` in the config only these chromosomes' folders and no others are replaced, and the report stays as it is; sites on other
chromosomes have no influence on them but for the names held out. A rerun over the same input gives the same rows.

Nulls: sites without chrom, pos or strand and genes without chrom, start or end are left out and counted in the log. Empty tables give empty ones.
"""

from __future__ import annotations

import os
import sys

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))] if __name__ == "__main__" else []

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from helixmill.functions import sequence as seq  # noqa: E402
from helixmill.operators import intervals, rows, sampling  # noqa: E402
from helixmill.plans import pipelines  # noqa: E402
from helixmill.plans.stages import held  # noqa: E402
from jobs.common import LOG, command, counted, counts, shaped  # noqa: E402

SITE, KEYS = ["chrom", "pos", "strand"], ["chrom", "strand"]
#: Columns by SQL expression, the condition of leading rows, the clusters' tolerance, the share of chromosomes to hold out (or their names), and the
#: chromosomes to make anew (null: all).
DEFAULTS = {"sites": {c: c for c in (*SITE, "source", "sequence")}, "genes": {c: c for c in ("chrom", "g_start", "g_end", "gene_id", "ord")}, "leading": "true", "tolerance": 12, "held_out": 0.1, "chroms": None}
SCHEMA = "strand string, cluster_start long, n_sites long, pos long, sequence string, source string, gene_id string, hexamer boolean, split string, chrom string"


def merged(sites: DataFrame, leading: str) -> DataFrame:
    order, first = ["source", "sequence"], F.coalesce(F.expr(leading), F.lit(False))
    a, b = (rows.keep_first(sites.where(c), SITE, order) for c in (first, ~first))
    return rows.merge_by_coordinates(a, b, SITE, ["source", "sequence"])


def with_gene(sites: DataFrame, genes: DataFrame) -> DataFrame:
    near = intervals.asof(sites, genes, ["chrom"], "pos", "g_start", ["g_end", "gene_id"], ["g_end", "gene_id"])
    near = held(near.withColumn("near", F.when(F.col("pos") <= F.col("asof.g_end"), F.col("asof.gene_id"))).drop("asof"))
    inside = intervals.least_covering(near.where("near is null"), genes.where("ord is not null"), ["chrom"], "pos", "g_start", "g_end", inside=F.struct("ord", "gene_id"))
    return near.join(inside, ["chrom", "pos"], "left").withColumn("gene_id", F.coalesce("near", "inside.gene_id", F.lit(""))).drop("near", "inside")


def with_split(sites: DataFrame, names: DataFrame, held_out: float | list[str]) -> DataFrame:
    if isinstance(held_out, list):
        return sites.withColumn("split", F.when(F.col("chrom").isin(held_out), "val").otherwise("train"))
    return sites.join(sampling.chromosome_split(names, held_out), "chrom")


def run(spark: SparkSession, sites_path: str, genes_path: str, out: str, config: dict) -> None:
    config, seen = DEFAULTS | config, {}
    sites = counted(shaped(spark.read.parquet(sites_path), config["sites"]), "sites read", seen)
    sites = counted(sites.na.drop(subset=SITE), "sites with coordinates", seen)
    genes = counted(shaped(spark.read.parquet(genes_path), config["genes"]), "genes read", seen).na.drop(subset=["chrom", "g_start", "g_end"])
    names = shaped(spark.read.parquet(sites_path), {c: config["sites"][c] for c in SITE}).na.drop().select("chrom").distinct()
    if config["chroms"] is not None:
        sites, genes = (t.where(F.col("chrom").isin(config["chroms"])) for t in (sites, genes))

    one = held(counted(merged(sites, config["leading"]), "distinct sites", seen))
    islands = held(intervals.islands(one, KEYS, tol=config["tolerance"]))
    clusters = held(counted(intervals.representatives(islands, KEYS, ["source", "sequence"], sources="source"), "clusters", seen))
    table = with_split(with_gene(clusters, held(genes)), names, config["held_out"])
    table = table.withColumn("hexamer", F.coalesce(seq.has_hexamer(F.col("sequence")), F.lit(False))).select(*(c.split()[0] for c in SCHEMA.split(", ")))
    # rows of a chromosome come from several tasks, so that a large one isn't one task's
    mode = "static" if config["chroms"] is None else "dynamic"
    counted(table, "sites written", seen).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("chrom").parquet(f"{out}/sites")
    if config["chroms"] is None:
        report = pipelines.quality_report(read(spark, out))
        report.write.mode("overwrite").json(f"{out}/report")
    for what, n in counts(seen).items():
        LOG.info("%s: %d", what, n)
    LOG.info("written: %s (%s)", out, "all chromosomes" if config["chroms"] is None else ", ".join(config["chroms"]))


def read(spark: SparkSession, out: str) -> DataFrame:
    """The job's sites."""
    return spark.read.schema(SCHEMA).parquet(f"{out}/sites")


if __name__ == "__main__":
    command(__doc__.split("\n")[0], "site_dataset.json", {"sites": "Parquet table of sites", "genes": "Parquet table of genes", "out": "folder of the output"}, run, DEFAULTS)
