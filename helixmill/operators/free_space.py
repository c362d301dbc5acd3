"""An index of the places of a genome that no span covers, and drawing from it: by rank, without rejection.

The index has a row for each free run of a key (a chromosome, or chromosome and strand) with the number of free places before it. A place has
a rank, the number of free places below it, and a rank has a place: each is one as-of join along the index. So a uniform draw is a number below
the key's total, and a draw inside a region a number between the ranks of its ends. However little is free, one draw finds it.

As everywhere, a key isn't one task's: running totals run inside tiles and take what lies before a tile from a table of one row a tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from helixmill.operators import intervals
from helixmill.operators.intervals import TILE
from helixmill.operators.sampling import place_number


def running_totals(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, tile: int = TILE) -> DataFrame:
    """df with `name`: the sum of `value` over the rows of the same keys that come before in the order. The first column of the order is a whole number,
    by which rows fall into tiles."""
    t = df.withColumn("__k", F.struct(*keys)).withColumn("__t", F.floor(F.col(order[0]) / tile))
    sums = t.groupBy("__k", "__t").agg(F.sum(value).alias("__s"))
    base = F.sum("__s").over(Window.partitionBy("__k").orderBy("__t").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("__base", F.coalesce(base, F.lit(0))).drop("__s")
    own = F.sum(value).over(Window.partitionBy("__k", "__t").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return t.join(sums, ["__k", "__t"]).withColumn(name, F.col("__base") + F.coalesce(own, F.lit(0))).drop("__k", "__t", "__base")


def free_runs(lengths: DataFrame, spans: DataFrame, keys: list[str], length: str = "length", tile: int = TILE) -> DataFrame:
    """keys, start, end, before: the half-open runs of [0, length) that no span (keys, start, end) covers, and the free places of the key
    before each. Spans may overlap, be empty or reach beyond the ends; those of keys without a length, lengths that are null or not over
    0, and rows with a null key or end are left out."""
    whole = lengths.na.drop(subset=[*keys, length]).where(F.col(length) > 0).groupBy(*keys).agg(F.max(length).alias("__length"))
    held = spans.na.drop(subset=[*keys, "start", "end"]).select(*keys, "start", "end").join(whole, keys)
    held = held.select(*keys, F.greatest("start", F.lit(0)).alias("start"), F.least("end", "__length").alias("end")).where("start < end")
    # an empty span at the length ends the last run
    ends = whole.select(*keys, F.col("__length").alias("start"), F.col("__length").alias("end"))
    t = intervals.merged(held, keys, tile=tile).unionByName(ends).withColumn("__k", F.struct(*keys)).withColumn("__t", F.floor(F.col("start") / tile))
    tops = t.groupBy("__k", "__t").agg(F.max("end").alias("__top"))
    tops = tops.withColumn("__open", F.max("__top").over(Window.partitionBy("__k").orderBy("__t").rowsBetween(Window.unboundedPreceding, -1))).drop("__top")
    last = F.max("end").over(Window.partitionBy("__k", "__t").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    runs = t.join(tops, ["__k", "__t"]).select(*keys, F.coalesce(F.greatest(last, "__open"), F.lit(0)).alias("start"), F.col("start").alias("end")).where("start < end")
    return running_totals(runs.withColumn("__n", F.col("end") - F.col("start")), keys, ["start"], "__n", "before", tile).drop("__n")


def totals(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, free: the number of free places, for keys that have any."""
    return runs.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("free"))


def ranks(points: DataFrame, runs: DataFrame, keys: list[str], pos: str, name: str) -> DataFrame:
    """points with `name`: the number of free places below pos, which need not be free itself. 0 for keys without free places; null where pos is."""
    found = intervals.asof(points, runs, keys, pos, "start", ["start", "end", "before"], ["end"])
    at = F.col("asof")
    rank = F.when(F.col(pos).isNotNull(), F.coalesce(at["before"] + F.least(F.col(pos), at["end"]) - at["start"], F.lit(0)))
    return found.withColumn(name, rank).drop("asof")


def places(points: DataFrame, runs: DataFrame, keys: list[str], rank: str, name: str) -> DataFrame:
    """points with `name`: the free place of that rank (from 0); null where the key has no such place."""
    found = intervals.asof(points, runs.withColumnRenamed("before", "__before"), keys, rank, "__before", ["__before", "start", "end"], ["start"])
    place = F.col("asof.start") + F.col(rank) - F.col("asof.__before")
    return found.withColumn(name, F.when(place < F.col("asof.end"), place)).drop("asof")


def drawn(points: DataFrame, runs: DataFrame, keys: list[str], key: Column, seed: str, name: str) -> DataFrame:
    """points with `name`: a free place of the point's keys, every one as likely, drawn by hash of the column key. Points whose keys have no free place
    are left out."""
    t = points.join(totals(runs, keys), keys).withColumn("__rank", place_number(key, seed, F.col("free"))).drop("free")
    return places(t, runs, keys, "__rank", name).drop("__rank")


#: Weights of regions are whole numbers: this many for a region that is all free.
WEIGHT = 1 << 20


def weighted_regions(regions: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """regions (keys, start, end, region) that are wider than one place and have free places, with `first` (the rank of the first), `n` (their number),
    `weight` (WEIGHT times their share of the region, at least 1) and `before`, the weights before it in the order of start, end and region.
    A region chosen by weight and then a free place in it by rank is what drawing any region, any place in it, and rejecting covered places comes to."""
    wide = regions.na.drop(subset=[*keys, "start", "end"]).where(F.col("end") - F.col("start") > 1)
    t = ranks(ranks(wide, runs, keys, "start", "first"), runs, keys, "end", "__last").withColumn("n", F.col("__last") - F.col("first")).where("n > 0")
    share = F.expr(f"n * {WEIGHT} div (end - start)")
    return running_totals(t.withColumn("weight", F.greatest(share, F.lit(1))).drop("__last"), keys, ["start", "end", "region"], "weight", "before")


def drawn_in_regions(points: DataFrame, weighted: DataFrame, runs: DataFrame, keys: list[str], key: Column, name: str) -> DataFrame:
    """points with `name` and `region`: a free place of one of the regions of the point's keys. Points whose keys have no region with a free place are left out."""
    sums = weighted.groupBy(*keys).agg(F.sum("weight").alias("__sum"))
    t = points.join(sums, keys).withColumn("__at", place_number(key, "region", F.col("__sum"))).withColumn("__key", key)
    t = intervals.asof(t, weighted.select(*keys, "before", "first", "n", "start", "end", "region"), keys, "__at", "before", ["before", "first", "n", "region"], ["start", "end", "region"])
    t = t.withColumns({"__rank": F.col("asof.first") + place_number(F.col("__key"), "place", F.col("asof.n")), "region": F.col("asof.region")}).drop("asof", "__at", "__sum", "__key")
    return places(t, runs, keys, "__rank", name).drop("__rank")
