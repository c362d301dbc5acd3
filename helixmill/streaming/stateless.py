"""The row-wise steps on a stream of BED rows: a DataFrame in, a DataFrame out, batch or streaming. There is no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from helixmill.plans.pipelines import bed_sites
from helixmill.sources.genomic import BED6


def read(spark, folder: str) -> DataFrame:
    """BED files as they arrive in a folder."""
    return spark.readStream.schema(BED6).option("sep", "\t").option("comment", "#").csv(folder)


def sites(bed: DataFrame) -> DataFrame:
    return bed_sites(bed)
