"""Vector code compression by a filtering Lloyd iteration (operator 11).

Vectors are cut into parts, and each part position has a codebook of its own. Every partition builds, once, kd-trees over its parts,
for blocks of BLOCK vectors: a node keeps the box, the sum and the count of its points. The trees are written to the shared folder. A round
walks down each tree, a level at a time, with the entries that may still be nearest: an entry is eliminated if another is nearer at the box's
corner that favours it most, so nearer in all of the box, and a node with one entry left is assigned whole, by its cached sum and count. What is
shuffled is a row for each task, part and used entry; what the driver holds are the codebooks and their sums.

All arithmetic is on integers, so results don't depend on how rows are spread over partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from helixmill.llm.common import forget, prepare, trimmed, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of one kd-tree, points of a leaf, and (node, entry) pairs that are compared at a time: bounds of memory, without influence on results.
BLOCK, LEAF, PAIRS = 1 << 14, 8, 1 << 15


def _bound(width: int) -> int:
    """Largest absolute value of an integer component, so that the squared distances of `width` components, summed over parts, fit a long."""
    return int((2.0**60 / max(width, 1)) ** 0.5) // 2


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not empty and has neither null nor non-finite components."""
    x = F.col(vector)
    return vectors.where(x.isNotNull() & (F.size(x) > 0)).where(~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))


def whole_numbers(rows: np.ndarray, parts: int, scale: int) -> np.ndarray:
    """floor(scale * x) as parts x rows x width; zeros fill up the last part."""
    n, d = rows.shape
    width = -(-d // parts)
    held = np.clip(np.floor(rows * float(scale)), -_bound(width), _bound(width)).astype(np.int64)
    return np.pad(held, ((0, 0), (0, parts * width - d))).reshape(n, parts, width).transpose(1, 0, 2)


class Tree:
    """A kd-tree over points, its nodes in order of levels: node k's children are 2k+1 and 2k+2, and each level's nodes cut the points, in `order`,
    into runs of about equal length."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.levels = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
        order, starts = np.arange(n), [np.array([0, n])]
        for _ in range(self.levels):
            edges = starts[-1]
            group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            here = points[order]
            spread = np.maximum.reduceat(here, edges[:-1]) - np.minimum.reduceat(here, edges[:-1])
            key = here[np.arange(n), spread.argmax(1)[group]]
            order = order[np.lexsort((order, key, group))]
            starts.append(np.sort(np.concatenate([edges, (edges[:-1] + edges[1:]) // 2])))
        self.points, self.order, self.edges = points[order], order, starts
        at = [e[:-1] for e in starts]
        self.low = [np.minimum.reduceat(self.points, a) for a in at]
        self.high = [np.maximum.reduceat(self.points, a) for a in at]
        self.sums = [np.add.reduceat(self.points, a) for a in at]

    FIELDS = ("points", "order", "edges", "low", "high", "sums")

    def packed(self) -> list[bytes]:
        """Each field as bytes; levels follow each other."""
        join = lambda x: np.concatenate(x) if isinstance(x, list) else x
        return [np.ascontiguousarray(join(getattr(self, f))).astype("<i8").tobytes() for f in self.FIELDS]

    @classmethod
    def unpacked(cls, fields: list[bytes], n: int) -> "Tree":
        self = cls.__new__(cls)
        self.levels = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
        read = {f: np.frombuffer(b, "<i8") for f, b in zip(cls.FIELDS, fields)}
        width = len(read["points"]) // n
        self.points, self.order = read["points"].reshape(n, width), read["order"]
        nodes = [1 << k for k in range(self.levels + 1)]
        self.edges = np.split(read["edges"], np.cumsum([k + 1 for k in nodes])[:-1])
        for f in ("low", "high", "sums"):
            setattr(self, f, np.split(read[f].reshape(-1, width), np.cumsum(nodes)[:-1]))
        return self

    def assign(self, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(entry, first point, end, sum) of runs of points that have the entry nearest; ties go to the lower entry. Each point is in
        one run, each array of a yielded tuple has one item a run."""
        node, entry = np.zeros(len(book), np.int64), np.arange(len(book))
        for level in range(self.levels + 1):
            kept = [self._filtered(level, node[a:b], entry[a:b], book) for a, b in _stretches(node)]
            keep = np.concatenate(kept)
            node, entry = node[keep], entry[keep]
            alone = np.bincount(node, minlength=1 << level)[node] == 1
            edges = self.edges[level]
            if alone.any():
                at = node[alone]
                yield entry[alone], edges[at], edges[at + 1], self.sums[level][at]
            node, entry = node[~alone], entry[~alone]
            if not len(node):
                return
            if level < self.levels:
                first = np.concatenate([[True], node[1:] != node[:-1]])
                begin = np.flatnonzero(first)
                size = np.diff(np.append(begin, len(node)))
                # each node's entries, once for each child
                take = np.concatenate([np.arange(s, s + k) for s, k in zip(np.repeat(begin, 2), np.repeat(size, 2))])
                child = np.repeat(np.stack([2 * node[begin], 2 * node[begin] + 1], 1).ravel(), np.repeat(size, 2))
                node, entry = child, entry[take]
        for a, b in _stretches(node):
            yield self._leaves(node[a:b], entry[a:b], book)

    def _filtered(self, level: int, node: np.ndarray, entry: np.ndarray, book: np.ndarray) -> np.ndarray:
        """Which of the pairs stay. Pairs are sorted by node."""
        low, high, z = self.low[level][node], self.high[level][node], book[entry]
        begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(node))))
        off = 2 * z - (low + high)
        far = (off.astype(np.float64) ** 2).sum(1)  # only chooses whom to compare with
        best = np.lexsort((entry, far, group))[begin]
        best_z, best_entry = z[best][group], entry[best][group]
        toward = z - best_z
        corner = np.where(toward > 0, high, low)
        gain = (toward * (z + best_z - 2 * corner)).sum(1)
        return (entry == best_entry) | (gain < 0) | (gain == 0) & (entry < best_entry)

    def _leaves(self, node: np.ndarray, entry: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        edges = self.edges[self.levels]
        size = edges[node + 1] - edges[node]
        pair = np.repeat(np.arange(len(node)), size)
        point = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + edges[node][pair]
        apart = ((self.points[point] - book[entry[pair]]) ** 2).sum(1)
        order = np.lexsort((entry[pair], apart, point))
        best = order[np.flatnonzero(np.concatenate([[True], np.diff(point[order]) > 0]))]
        at = point[best]
        return entry[pair][best], at, at + 1, self.points[at]


def _stretches(node: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts between nodes, about PAIRS pairs apart."""
    at = 0
    while at < len(node):
        end = len(node) if at + PAIRS >= len(node) else int(np.searchsorted(node, node[at + PAIRS], "right"))
        yield at, end
        at = end


def _trees(batches: Iterator[pa.RecordBatch], names: list[str], parts: int, scale: int) -> Iterator[pa.RecordBatch]:
    """One row for each block of up to BLOCK vectors: their ids and labels, and each part's tree."""

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        vectors = t.column(2).combine_chunks()
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1)
        trees = [Tree(p).packed() for p in whole_numbers(x, parts, scale)]
        ids, labels = t.column(0), t.column(1)
        columns = [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([labels.to_pylist()], pa.list_(labels.type)), pa.array([trees], pa.list_(pa.list_(pa.binary())))]
        return pa.RecordBatch.from_arrays(columns, names)

    rows, n = [], 0
    for b in batches:
        while b.num_rows:
            take = b.slice(0, BLOCK - n)
            rows, n, b = [*rows, take], n + take.num_rows, b.slice(take.num_rows)
            if n == BLOCK:
                yield block(rows)
                rows, n = [], 0
    if n:
        yield block(rows)


def _each_tree(batch: pa.RecordBatch, ids: int, trees: int) -> Iterator[tuple[int, int, Tree]]:
    """(row, part, tree)."""
    for r in range(batch.num_rows):
        n = len(batch.column(ids)[r])
        for p, fields in enumerate(batch.column(trees)[r]):
            yield r, p, Tree.unpacked([f.as_buffer() for f in fields], n)


def codebooks(trees: DataFrame, first: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks, parts x entries x width, after `rounds` rounds from the first ones. `trees`: written blocks."""
    books = first
    parts, entries, width = books.shape
    for _ in range(rounds if entries else 0):

        def summed(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
            for b in batches:
                for _, p, tree in _each_tree(b, 0, 1):
                    for entry, begin, end, total in tree.assign(books[p]):
                        np.add.at(sums[p], entry, total)
                        np.add.at(counts[p], entry, end - begin)
            p, k = counts.nonzero()
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(counts[p, k]), pa.array(list(sums[p, k]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        found = trees.select("ids", "trees").mapInArrow(lambda b: trimmed(summed(b)), "part int, entry int, n long, sums array<long>")
        # a row a part and entry comes back: what the driver reads is as large as the codebooks
        totals = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(width)]).alias("sums")).collect()
        books = books.copy()
        for t in totals:
            books[t.part, t.entry] = np.array(t.sums, np.int64) // t.n
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(rows with the id, the label, `codes` array<int> and `error`; the codebooks, parts x entries x width).

    Components become floor(scale * x). The codebooks begin as the parts of the vectors of the smallest ids, ties by the vector; with fewer
    vectors than entries they are as short. Each round assigns every part to the nearest entry (squared Euclidean distance, ties to the lower one)
    and replaces each entry by the componentwise floor of its parts' mean; unused entries stay. `error`: squared distances to
    the final entries, summed over the parts.

    Vectors that are null, empty or hold null or non-finite components are dropped. Those of another length than the commonest (ties: the longer) stay out of
    the codebooks and come back with null codes and error. A length that is no multiple of `parts` is filled up with zeros. Components beyond 2^29 /
    sqrt(width of a part) are held to that. Null and repeated ids are rows like any other (null ids sort last). No rows give no rows and empty codebooks.
    The result is read from the shared folder."""
    spark = vectors.sparkSession
    prepare(spark)
    kept = usable(vectors.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x")), "x")
    lengths = kept.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    length = lengths[0].n if lengths else 0
    alike = kept.where(F.size("x") == length)
    seeds = alike.orderBy(F.asc_nulls_last("id"), "x").limit(entries).collect()
    first = whole_numbers(np.array([r.x for r in seeds], np.float64).reshape(len(seeds), length), parts, scale)
    label_type = kept.schema["label"].dataType.simpleString()
    trees = written(alike.mapInArrow(lambda b: trimmed(_trees(b, ["ids", "labels", "trees"], parts, scale)), f"ids array<long>, labels array<{label_type}>, trees array<array<binary>>"), "vector-trees")
    books = codebooks(trees, first, rounds)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                one = b.slice(r, 1)
                n = len(one.column(0)[0])
                codes, error = np.zeros((n, parts), np.int32), np.zeros(n, np.int64)
                for _, p, tree in _each_tree(one, 0, 2):
                    for entry, begin, end, _ in tree.assign(books[p]):
                        at, k = np.concatenate([np.arange(s, e) for s, e in zip(begin, end)]), np.repeat(entry, end - begin)
                        codes[tree.order[at], p] = k
                        error[tree.order[at]] += ((tree.points[at] - books[p][k]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([one.column(0)[0].values, one.column(1)[0].values, pa.array(list(codes), pa.list_(pa.int32())), pa.array(error)], [id, label, "codes", "error"])

    out = trees.mapInArrow(lambda b: trimmed(coded(b)), f"`{id}` long, `{label}` {label_type}, codes array<int>, error long")
    others = kept.where(F.size("x") != length).select(F.col("id").alias(id), F.col("label").alias(label), F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
    found = written(out.unionByName(others), "vector-codes")
    forget(trees)
    return found, books


def digest(books: np.ndarray) -> str:
    """Lowercase hex SHA-256 of all entries' decimal integers, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """compress()'s rows for its defaults as vec_id, code (two hex digits a part), error, and label_error: the error summed over equal labels, nulls together.
    A label's rows are summed up before the shuffle; labels come back by a join, which splits a label of very many rows."""
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    sums = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")), "left").select("vec_id", code.alias("code"), "error", "label_error")


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in DuckDB SQL, by comparing each part with each entry."""
    steps = f"""with kept as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(cast(x as double) * {scale}) as bigint)) v from embeddings
      where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    part as (select vec_id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] x from kept, range({parts}) t(p)),
    book0 as (select p, row_number() over (partition by p order by vec_id) - 1 k, x z from part where vec_id in (select vec_id from kept order by vec_id limit {entries}))"""
    near = "select vec_id, p, min(d) d, cast(arg_min(k, {{'d': d, 'k': k}}) as bigint) k from (select vec_id, part.p, k, cast(list_sum(list_transform(list_zip(x, z), lambda e: (e[1] - e[2]) * (e[1] - e[2]))) as bigint) d from part join book{0} b on part.p = b.p) group by all"
    for r in range(rounds):
        steps += f""",
    near{r} as ({near.format(r)}),
    mean{r} as (select p, k, list(m order by i) z from (select part.p, k, i, cast(floor(sum(x[i]) / count(*)) as bigint) m from near{r} n join part on part.vec_id = n.vec_id and part.p = n.p, range(1, 1 + len(x)) t(i) group by all) group by all),
    book{r + 1} as (select b.p, b.k, coalesce(m.z, b.z) z from book{r} b left join mean{r} m on b.p = m.p and b.k = m.k)"""
    steps += f""",
    near{rounds} as ({near.format(rounds)}),
    coded as (select vec_id, string_agg(lower(printf('%02x', k)), '' order by p) code, cast(sum(d) as bigint) error from near{rounds} group by all),
    label_sum as (select label, cast(sum(error) as bigint) label_error from coded join kept using (vec_id) group by all)
    select vec_id, code, error, label_error, (select sha256(string_agg(array_to_string(z, ','), ',' order by p, k)) from book{rounds}) codebooks_sha256
    from coded join kept using (vec_id) join label_sum on kept.label is not distinct from label_sum.label"""
    return steps


ORACLE = _oracle()
