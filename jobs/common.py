"""What both jobs share: configs, sessions of the command line, logs, columns by expression."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

LOG = logging.getLogger("jobs")


def load_config(path: str, known: dict) -> dict:
    """The config file laid over the defaults. Names that the job doesn't know are an error, so that a slip isn't silently a default."""
    with open(path) as f:
        own = json.load(f)
    if unknown := own.keys() - known.keys():
        raise ValueError(f"{path}: unknown settings {sorted(unknown)}; there are {sorted(known)}")
    return known | own


def shaped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The columns of df that the config names, by SQL expression."""
    return df.select(*(F.expr(e).alias(name) for name, e in columns.items()))


def counted(df: DataFrame, name: str, seen: dict[str, Observation]) -> DataFrame:
    """df, whose rows are counted while it is computed: no second pass. seen[name] has the count then."""
    seen[name] = Observation()
    return df.observe(seen[name], F.count(F.lit(1)).alias("n"))


def counts(seen: dict[str, Observation]) -> dict[str, int]:
    return {name: o.get["n"] for name, o in seen.items()}


def command(about: str, config: str, paths: dict[str, str], run: Callable[..., object], known: dict) -> None:
    """Parse the command line, start a session, run(spark, *paths, config), stop the session."""
    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), config))
    for name, what in paths.items():
        parser.add_argument(f"--{name}", required=True, help=what)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    settings = load_config(args.config, known)
    spark = SparkSession.builder.appName(os.path.splitext(config)[0]).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, *(getattr(args, p) for p in paths), settings)
    finally:
        spark.stop()
