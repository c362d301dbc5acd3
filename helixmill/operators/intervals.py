"""Joins and clustering by position: as-of, containment, band, anti-band, islands, interval merging.

A genome has a few chromosomes but a position table has any number of rows, so nothing here keeps a chromosome in one
task. Positions are cut into tiles; windows run inside a tile, and what a tile needs from those before it (the
last gene, the highest end, the start of an open cluster) comes from a table with one row for each tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from helixmill.functions.sequence import sources_of

TILE = 1 << 16


def _tile(pos: Column, width: int) -> Column:
    return F.floor(pos / width)


def _whole(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with __k, its keys as one struct: such structs are equal where both have a null, so rows with a null key stay through
    joins, and joins and windows share one partitioning."""
    return df.withColumn("__k", F.struct(*keys))


def _earlier():
    return Window.partitionBy("__k").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)


def islands(df: DataFrame, keys: list[str], pos: str = "pos", tol: int = 12, tile: int = TILE) -> DataFrame:
    """df with cluster_start: the first position of the row's cluster. A new cluster starts where the gap to the position
    before is over tol (single linkage). Null positions are left out; rows with a null key cluster among themselves."""
    t = _whole(df.where(F.col(pos).isNotNull()), keys).withColumn("tile", _tile(F.col(pos), tile))
    edges = t.groupBy("__k", "tile").agg(F.max(pos).alias("__hi")).withColumn("__before", F.lag("__hi").over(Window.partitionBy("__k").orderBy("tile"))).drop("__hi")
    t = t.join(edges, ["__k", "tile"])
    inside = Window.partitionBy("__k", "tile").orderBy(pos)
    t = t.withColumn("__prev", F.coalesce(F.lag(pos).over(inside), "__before"))
    t = t.withColumn("__new", F.when(F.col("__prev").isNull() | (F.col(pos) - F.col("__prev") > tol), F.col(pos)))
    starts = t.groupBy("__k", "tile").agg(F.max("__new").alias("__last"))
    starts = starts.withColumn("__open", F.last("__last", ignorenulls=True).over(_earlier())).drop("__last")
    here = F.max("__new").over(inside.rangeBetween(Window.unboundedPreceding, 0))
    return t.join(starts, ["__k", "tile"]).withColumn("cluster_start", F.coalesce(here, "__open")).drop("__k", "tile", "__before", "__prev", "__new", "__open")


def representatives(df: DataFrame, keys: list[str], order: list[str], pos: str = "pos", sources: str | None = None, tile: int = TILE) -> DataFrame:
    """Of each cluster the row nearest to its median position, ties by position, then by `order`; with n_sites, and, where
    `sources` names a column, in it the sources of all its rows.

    A cluster narrower than a tile has at most `tile` positions, whose counts give its median in one task. Wider ones, of which a genome holds no more than
    it has tiles, so that they are broadcast, get theirs by rank (wide_medians), and their rows are only ever summed up before a shuffle."""
    t = _whole(df, [*keys, "cluster_start"])
    names = [sources_of(F.col(sources)).alias("__sources")] if sources else []
    more = ["n_sites", *(["__sources"] if sources else [])]
    wide = t.where(F.col(pos) - F.col("cluster_start") >= tile).select("__k").distinct()
    narrow = t.join(F.broadcast(wide), "__k", "left_anti")
    middle = narrow.groupBy("__k").agg(F.median(pos).alias("__median"), F.count("*").alias("n_sites"), *names)
    broad = t.join(F.broadcast(wide), "__k", "left_semi")
    broad_middle = broad.groupBy("__k").agg(F.count("*").alias("n_sites"), *names).join(wide_medians(broad, pos, tile), "__k")
    near = narrow.join(middle, "__k").unionByName(broad.join(F.broadcast(broad_middle), "__k"))
    best = near.groupBy("__k").agg(F.min(F.struct(F.abs(F.col(pos) - F.col("__median")).alias("__d"), F.col(pos).alias("__p"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), *df.columns, *more)).alias("__best"))
    of = lambda c: F.col("__best.__sources" if c == sources else f"__best.{c}").alias(c)
    return best.select(*(of(c) for c in [*keys, "cluster_start", "n_sites"]), *(of(c) for c in df.columns if c not in (*keys, "cluster_start")))


def wide_medians(df: DataFrame, pos: str, tile: int) -> DataFrame:
    """__k, __median: the exact median position of each __k by rank: rows are counted by tile, the tiles that hold the middle ranks are found from the
    counts, and only these tiles' positions are counted singly. No task has more than a tile's positions, or a row for each tile of a __k."""
    t = df.withColumn("__t", _tile(F.col(pos), tile))
    counts = t.groupBy("__k", "__t").agg(F.count("*").alias("__n"))
    all_ = Window.partitionBy("__k")
    earlier = all_.orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"__base": F.coalesce(F.sum("__n").over(earlier), F.lit(0)), "__all": F.sum("__n").over(all_)})
    ranks = counts.withColumn("__r", F.explode(F.array_distinct(F.array(F.expr("(__all - 1) div 2"), F.expr("__all div 2"))))).where("__r >= __base and __r < __base + __n")
    # one or two tiles a __k
    own = t.join(F.broadcast(ranks.select("__k", "__t").distinct()), ["__k", "__t"], "left_semi").groupBy("__k", "__t", pos).agg(F.count("*").alias("__c"))
    own = own.withColumn("__b", F.coalesce(F.sum("__c").over(Window.partitionBy("__k", "__t").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hit = own.join(F.broadcast(ranks.select("__k", "__t", "__r", "__base")), ["__k", "__t"]).where("__r >= __base + __b and __r < __base + __b + __c")
    return hit.groupBy("__k").agg(F.avg(pos).alias("__median"))


def asof(left: DataFrame, right: DataFrame, keys: list[str], pos: str, start: str, take: list[str], order: list[str], tile: int = TILE) -> DataFrame:
    """left with a struct `asof` of `take` from the last row of right, by (start, *order), whose start is at or before pos;
    null where there is none. A null key or position matches nothing, but its row stays; rows of right with one are left
    out. One shuffle of both sides, by keys and tile."""
    value = F.struct(F.col(start).alias("__s"), *(F.col(c).alias(f"__o{i}") for i, c in enumerate(order)), *(c for c in take if c != start))
    r = right.na.drop(subset=[*keys, start]).select(*keys, F.col(start).alias("__at"), value.alias("__v"))
    columns = F.struct(*left.columns).alias("__l")
    both = left.select(*keys, F.col(pos).alias("__at"), columns).unionByName(r, allowMissingColumns=True)
    both = _whole(both, keys).drop(*keys).withColumn("tile", _tile(F.col("__at"), tile))
    carried = both.groupBy("__k", "tile").agg(F.max("__v").alias("__last")).withColumn("__open", F.max("__last").over(_earlier())).drop("__last")
    carried = carried.where("tile is not null").withColumnRenamed("tile", "__tile")
    here = F.max("__v").over(Window.partitionBy("__k", "tile").orderBy("__at").rangeBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__here", here).where("__l is not null").withColumnRenamed("__k", "__own")
    out = out.join(carried, (F.col("__own") == F.col("__k")) & (F.col("tile") == F.col("__tile")), "left")
    found = F.when(F.col("__at").isNotNull(), F.coalesce("__here", "__open"))
    fields = [found["__s"].alias(start), *(found[c].alias(c) for c in take if c != start)]
    return out.select("__l.*", F.when(found.isNotNull(), F.struct(*fields)).alias("asof"))


#: Bins of spans: those of a level are 8 times as wide as those of the one below.
LEVELS = 16


def _width(level: Column, tile: int) -> Column:
    return F.call_function("shiftleft", F.lit(tile).cast("long"), (3 * level).cast("int"))


def level_of(start: Column, last: Column, tile: int) -> Column:
    """The lowest level whose bins are wider than the span, so that it touches two bins at most, whatever its length."""
    out = F.lit(0)
    for k in range(LEVELS):
        out = out + (last - start >= tile << 3 * k).cast("int")
    return out


def laid(spans: DataFrame, start: Column, last: Column, tile: int) -> DataFrame:
    """spans with __level and __tile: a row for each bin (one or two) that a span from start to last touches."""
    t = spans.withColumn("__level", level_of(start, last, tile))
    w = _width(F.col("__level"), tile)
    return t.withColumn("__tile", F.explode(F.sequence(F.floor(start / w), F.floor(last / w))))


def asking(points: DataFrame, levels: DataFrame, pos: str, tile: int) -> DataFrame:
    """points with __level and __tile: a row for each level that has spans, LEVELS and one at most, so that the levels are broadcast."""
    return points.crossJoin(F.broadcast(levels)).withColumn("__tile", F.floor(F.col(pos) / _width(F.col("__level"), tile)))


def containing(points: DataFrame, spans: DataFrame, keys: list[str], pos: str, start: str, end: str, tile: int = 1 << 12) -> DataFrame:
    """Inner join of points and the spans with start <= pos <= end. A span lies in one or two bins of the level that fits its length, and a point
    asks one bin of each level that has spans; rows with a null key or position match nothing."""
    s = laid(spans.where(F.col(end) >= F.col(start)), F.col(start), F.col(end), tile)
    p = asking(points, s.select("__level").distinct(), pos, tile)
    return p.join(s, [*keys, "__level", "__tile"]).where((F.col(start) <= F.col(pos)) & (F.col(pos) <= F.col(end))).drop("__level", "__tile")


#: Nodes of least_covering(): those of a level are 2 ** NODE_BITS times as wide as those of the one below; places ask no level above NODE_TOP.
NODE_BITS, NODE_TOP = 2, 6


#: The highest level that the nodes of a span from __s up to __e can have.
HIGHEST = f"(length(bin(__e - __s)) - 1) div {NODE_BITS}"


def _noded(spans: DataFrame, top: bool) -> DataFrame:
    """spans with __level and __node in place of __s and __e: a row for each node of the fewest that make up the span from __s up to __e, which is left out.
    Of a level these are at most six. With top only the nodes of levels above NODE_TOP, else only the others."""
    fan = 1 << NODE_BITS
    last = f"cast({HIGHEST} as int)"
    levels = f"if({HIGHEST} > {NODE_TOP}, sequence({NODE_TOP + 1}, {last}), array())" if top else f"sequence(0, least({NODE_TOP}, {last}))"
    t = spans.withColumn("__level", F.explode(F.expr(levels)))
    # the whole nodes of this level and of the one above
    for name, up in (("", 0), ("1", 1)):
        t = t.withColumn(f"__l{name}", F.expr(f"-shiftright(-__s, {NODE_BITS} * (__level + {up}))")).withColumn(f"__r{name}", F.expr(f"shiftright(__e, {NODE_BITS} * (__level + {up}))"))
    run = lambda a, b: f"if({a} < {b}, sequence({a}, {b} - 1), cast(array() as array<bigint>))"
    nodes = f"if(__l1 < __r1, concat({run('__l', f'{fan} * __l1')}, {run(f'{fan} * __r1', '__r')}), {run('__l', '__r')})"
    return t.withColumn("__node", F.explode(F.expr(nodes))).drop("__s", "__e", "__l", "__r", "__l1", "__r1")


def least_covering(points: DataFrame, spans: DataFrame, keys: list[str], pos: str, start: str, end: str, **values: Column) -> DataFrame:
    """keys, pos and the columns `values`: for each distinct place of points that lies in a span (start <= pos <= end) the least of each value among
    all spans that hold it; nulls are passed over. Rows with a null key or position match nothing.

    Pairs of points and spans are never made, so depth costs nothing: a span becomes the few nodes of a tree over positions that make it up, of a node only the
    least values stay, summed up before the shuffle, and a place asks the nodes above it, one of each level in use. Levels above NODE_TOP are asked
    by nodes of that level and not by places, so that no node is asked by more places than it is wide there."""
    least = [F.min(v).alias(v) for v in values]
    own = [F.col(c).cast("long") for c in (start, end)]
    s = spans.na.drop(subset=[*keys, start, end]).where(own[1] >= own[0]).select(*keys, own[0].alias("__s"), (own[1] + 1).alias("__e"), *(v.alias(name) for name, v in values.items()))
    places = points.select(*keys, pos).na.drop().distinct()
    node = lambda of, level: F.expr(f"shiftright({of}, {NODE_BITS} * cast({level} as int))")
    low, high = _noded(s, False), _noded(s, True).groupBy(*keys, "__level", "__node").agg(*least)
    wide = points.select(*keys, node(f"cast({pos} as bigint)", NODE_TOP).alias("__top")).na.drop().distinct()
    above = s.agg(F.max(F.expr(HIGHEST)).alias("__highest"))  # one row
    asked = wide.crossJoin(F.broadcast(above)).where(F.col("__highest") > NODE_TOP)
    asked = asked.withColumn("__level", F.explode(F.expr(f"sequence({NODE_TOP + 1}, cast(__highest as int))"))).withColumn("__node", node("__top", f"(__level - {NODE_TOP})"))
    down = asked.join(high, [*keys, "__level", "__node"]).select(*keys, F.lit(NODE_TOP).alias("__level"), F.col("__top").alias("__node"), *values)
    nodes = low.unionByName(down).groupBy(*keys, "__level", "__node").agg(*least)
    asks = places.crossJoin(F.broadcast(above)).where("__highest is not null").withColumn("__level", F.explode(F.expr(f"sequence(0, cast(least(__highest, {NODE_TOP}) as int))"))).drop("__highest")
    asks = asks.withColumn("__node", node(f"cast({pos} as bigint)", "__level"))
    return asks.join(nodes, [*keys, "__level", "__node"]).groupBy(*keys, pos).agg(*least)


#: A span of overlapping() touches so many bins of its own level, and one more, at most.
FEW = 4


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], tile: int = 1 << 10) -> DataFrame:
    """Inner join of the half-open spans a_start to a_end and b_start to b_end that overlap, each pair once. A span lies in the few bins, here nodes named by their
    first positions, of the level that fits its length; a pair meets at the higher level of its two, in the node of the later start. Rows with a null key, start or
    end match nothing.

    A span goes through a shuffle at its own level, and at others only where the other side has spans of theirs. So where one level fits both sides, what is
    shuffled is little more than both, however many pairs they make. Ends travel as lengths, which repeat and so compress. Neither side is broadcast:
    the planner's estimate doesn't know how many pairs a row makes."""
    columns = [*keys, *(c for c in [*a.columns, *b.columns] if c not in keys)]
    ends = {"a": a.schema["a_end"].dataType, "b": b.schema["b_end"].dataType}

    def leveled(t: DataFrame, n: str) -> tuple[DataFrame, DataFrame]:
        # as level_of(), but for rounding, which is harmless here (any level near is right), and short: it is computed for each row several times
        level = F.expr(f"cast(greatest(0, ceil(log2(({n}_end - {n}_start) / {FEW * tile}) / 3)) as int)")
        t = t.where(F.col(f"{n}_end") > F.col(f"{n}_start")).withColumn(f"__{n}", level)
        return t, t.select(F.col(f"__{n}").alias("__level")).distinct()

    (a, in_a), (b, in_b) = leveled(a, "a"), leveled(b, "b")  # levels in use: some twenty at most, so that they are broadcast

    def own(t: DataFrame, n: str, other: DataFrame, order: str) -> DataFrame:
        """At their own levels, the spans that can meet such of the other side's levels."""
        least = F.broadcast(other.agg(F.min("__level").alias("__least")))  # one row
        return laid_out(t.crossJoin(least).where(f"__{n} {order} __least").drop("__least").withColumnRenamed(f"__{n}", "__level"), n)

    def raised(t: DataFrame, n: str, other: DataFrame, order: str) -> DataFrame:
        """At the other side's levels."""
        return laid_out(t.crossJoin(F.broadcast(other)).where(f"__level {order} __{n}").drop(f"__{n}"), n)

    def laid_out(t: DataFrame, n: str) -> DataFrame:
        w = _width(F.col("__level"), tile)
        first = lambda pos: pos - F.pmod(pos, w)
        t = t.withColumn("__node", F.explode(F.sequence(first(F.col(f"{n}_start").cast("long")), first(F.col(f"{n}_end").cast("long") - 1), w)))
        return t.withColumn(f"__{n}_length", F.col(f"{n}_end") - F.col(f"{n}_start")).drop(f"{n}_end")

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(b.hint("merge"), [*keys, "__level", "__node"])
        both = both.withColumns({f"{n}_end": (F.col(f"{n}_start") + F.col(f"__{n}_length")).cast(kind) for n, kind in ends.items()})
        return both.where("a_start < b_end and b_start < a_end and greatest(a_start, b_start) >= __node").select(*columns)

    return met(own(a, "a", in_b, ">="), raised(b, "b", in_a, ">=")).unionByName(met(raised(a, "a", in_b, ">"), own(b, "b", in_a, ">")))


def band_pairs(a: DataFrame, b: DataFrame, keys: list[str], tol: int, pos: str = "pos") -> DataFrame:
    """keys, pos_a, pos_b: pairs at most tol apart. Bins of tol + 1, each row of a looks into three."""
    width = tol + 1
    left = a.select(*keys, F.col(pos).alias("pos_a")).withColumn("__bin", F.explode(F.array(*(_tile(F.col("pos_a"), width) + d for d in (-1, 0, 1)))))
    right = b.select(*keys, F.col(pos).alias("pos_b"), _tile(F.col(pos), width).alias("__bin"))
    return left.join(right, [*keys, "__bin"]).where(F.abs(F.col("pos_a") - F.col("pos_b")) <= tol).drop("__bin")


def clear_of(points: DataFrame, sites: DataFrame, keys: list[str], radius: int, pos: str = "pos") -> DataFrame:
    """Anti-join: the points with no site within radius."""
    width = radius + 1
    own = [F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    s = sites.select(*own, F.col(pos).alias("__site")).distinct().withColumn("__near", F.explode(F.array(*(_tile(F.col("__site"), width) + d for d in (-1, 0, 1)))))
    p = points.withColumn("__bin", _tile(F.col(pos), width))
    on = [F.col(k) == F.col(f"__key{i}") for i, k in enumerate(keys)] + [F.col("__bin") == F.col("__near"), F.abs(F.col(pos) - F.col("__site")) <= radius]
    return p.join(s, on, "left_anti").drop("__bin")


def neighbours(df: DataFrame, keys: list[str], tol: int, pos: str = "pos", tile: int = TILE) -> DataFrame:
    """df with n_near: rows at another position at most tol away. A row near a tile's edge is also lent to the next tile."""
    p = F.col(pos)
    lent = F.array_distinct(F.array(_tile(p, tile), _tile(p - tol, tile), _tile(p + tol, tile)))
    t = df.withColumn("tile", F.explode(lent))
    near = Window.partitionBy(*keys, "tile").orderBy(pos).rangeBetween(-tol, tol)
    same = Window.partitionBy(*keys, "tile").orderBy(pos).rangeBetween(0, 0)
    return t.withColumn("n_near", F.count("*").over(near) - F.count("*").over(same)).where(F.col("tile") == _tile(p, tile)).drop("tile")


def merged(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", tile: int = TILE) -> DataFrame:
    """keys, start, end: half-open spans merged where the next starts at or before the highest end so far. Spans with a null
    key merge among themselves; those with a null start or end are left out. Spans of one start become one before the rest, so the order is
    that of the starts alone, however often a span is repeated."""
    t = _whole(spans.na.drop(subset=[start, end]), keys).groupBy("__k", start).agg(F.max(end).alias(end)).withColumn("tile", _tile(F.col(start), tile))
    reach = t.groupBy("__k", "tile").agg(F.max(end).alias("__hi")).withColumn("__before", F.max("__hi").over(_earlier())).drop("__hi")
    inside = Window.partitionBy("__k", "tile").orderBy(start)
    t = t.join(reach, ["__k", "tile"]).withColumn("__high", F.greatest(F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1)), "__before"))
    t = t.withColumn("__new", F.when(F.col("__high").isNull() | (F.col(start) > F.col("__high")), F.col(start)))
    opened = t.groupBy("__k", "tile").agg(F.max("__new").alias("__last")).withColumn("__open", F.max("__last").over(_earlier())).drop("__last")
    t = t.join(opened, ["__k", "tile"]).withColumn("__from", F.coalesce(F.max("__new").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "__open"))
    return t.groupBy("__k", "__from").agg(F.max(end).alias(end)).select(*(F.col("__k")[k].alias(k) for k in keys), F.col("__from").alias(start), end)


def outside(points: DataFrame, spans: DataFrame, keys: list[str], pos: str = "pos", tile: int = 1 << 12) -> DataFrame:
    """Anti-join: the points in none of the half-open spans, which lie in bins as in containing(). Those that are in one are told by keys and position, so
    points stay as they are, equal ones and ones with nulls too."""
    s = spans.where(F.col("end") > F.col("start")).select(*keys, F.col("start").alias("__start"), (F.col("end") - 1).alias("__last"))
    asked = points.select(*keys, F.col(pos).alias("__pos"))
    own = [F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]
    hit = containing(asked, s, keys, "__pos", "__start", "__last", tile).select(*own, "__pos").distinct()
    on = [F.col(k) == F.col(f"__key{i}") for i, k in enumerate(keys)] + [F.col(pos) == F.col("__pos")]
    return points.join(hit, on, "left_anti")


def lifted(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """points (chrom, pos, strand) through chain blocks (src_chrom, src_start, src_end, dst_chrom, dst_start, dst_strand,
    score): the block of the highest score decides, then the first by target; points in none are dropped. On a minus
    block positions run backwards from dst_start and the strand flips. However many blocks hold a point, one of each strand, the first of
    these, comes to it: on a strand targets differ by what is added to the position."""
    rest = [c for c in points.columns if c not in ("chrom", "pos", "strand")]
    minus = F.coalesce(F.col("dst_strand") == "-", F.lit(False))
    start = F.col("src_start").cast("long")
    first = lambda test, add: F.when(test, F.struct((-F.col("score")).alias("s"), F.col("dst_chrom").alias("chrom"), add.alias("add")))
    b = blocks.withColumn("__last", F.col("src_end") - 1)
    p = points.withColumnRenamed("chrom", "src_chrom")
    hit = least_covering(p, b, ["src_chrom"], "pos", "src_start", "__last", __plus=first(~minus, F.col("dst_start") - start), __minus=first(minus, F.col("dst_start") + start))

    def target(side: str, to: Column, strand: Column) -> Column:
        v = F.col(side)
        return F.when(v.isNotNull(), F.struct(v["s"].alias("s"), v["chrom"].alias("chrom"), to.alias("pos"), strand.alias("strand")))

    best = F.least(target("__plus", F.col("__plus.add") + F.col("pos"), F.col("strand")), target("__minus", F.col("__minus.add") - F.col("pos"), F.translate("strand", "+-", "-+")))
    out = p.join(hit, ["src_chrom", "pos"]).withColumn("__b", best)
    return out.select("__b.chrom", "__b.pos", "__b.strand", "src_chrom", F.col("pos").alias("src_pos"), *rest)
