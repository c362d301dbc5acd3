"""Row ids by BLAKE2b with 64 bits. Spark has no such function, so they run in Arrow batches."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, functions as F


def blake2b64(text: Column) -> Column:
    def digests(values: pd.Series) -> pd.Series:  # nested, so that it travels with the plan
        return values.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=8).hexdigest())

    return F.pandas_udf(digests, "string")(text)


def positive_id(chrom: Column, pos: Column, strand: Column, sequence: Column) -> Column:
    return blake2b64(F.concat_ws("|", chrom, pos.cast("string"), strand, sequence))


def negative_id(chrom: Column, pos: Column, strand: Column, gene: Column) -> Column:
    return blake2b64(F.concat_ws(":", chrom, pos.cast("string"), strand, F.coalesce(gene, F.lit(""))))
